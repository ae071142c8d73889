"""Joins against a table of one row per key when a few keys hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows is hot; so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.005


def skewed_lookup(rows: DataFrame, lookup: DataFrame, key: str, count: str) -> DataFrame:
    """rows inner join lookup on key, with hot keys broadcast.

    lookup holds each key once, with its number of rows in column ``count``.
    Keys that hold HOT_SHARE of all rows or more are at most 1 / HOT_SHARE, a
    bound that does not depend on the data; only those are broadcast. All other
    keys join by an ordinary shuffle, in which no key is large any more.
    """
    total = lookup.agg(F.sum(count)).first()[0] or 0
    most = int(1 / HOT_SHARE)
    hot = lookup.filter(F.col(count) >= max(2, total * HOT_SHARE)).limit(most)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def skewed_left(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """rows left join lookup on keys, with the keys that hold most rows broadcast.

    lookup holds each key once. The keys of rows are counted, and the 1 / HOT_SHARE with most rows are
    hot, a bound that does not depend on the data. All others join by an ordinary shuffle. Null keys meet nothing.
    """
    hot = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.col("__n").desc(), *keys).limit(int(1 / HOT_SHARE)).drop("__n")
    found = [c for c in lookup.columns if c not in keys]
    warm = rows.join(F.broadcast(hot.join(lookup, keys, "left")), keys)
    cold = rows.join(F.broadcast(hot), keys, "left_anti").join(lookup, keys, "left")
    return warm.select(*rows.columns, *found).unionByName(cold.select(*rows.columns, *found))
