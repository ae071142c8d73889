"""Row numbers, running sums and neighbours in one order of a whole table, without a single-task window.

Rows are dealt by range of the order, so ranges are about equally large whatever the keys; each range works on its
own rows, and what earlier (or later) ranges hold comes from a table of one row per range and scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

PART = "__part"
BEFORE = (Window.unboundedPreceding, -1)


def dealt(df: DataFrame, order: list[Column], name: str = "dealt") -> DataFrame:
    """df with the number of each row's range, written."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), name)


def global_rank(df: DataFrame, name: str, order: list[Column], keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with 0, 1, 2, ... in the given order; the order must be total to be repeatable.

    Only one row per range meets in one task. keep chooses the rows to be ranked
    from the dealt ones, which are written by then.
    """
    rows = dealt(df, order, "ranked")
    rows = keep(rows) if keep else rows
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(PART).rowsBetween(*BEFORE)
    before = counts.select(PART, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    return rows.withColumn(name, nth.cast("long")).join(F.broadcast(before), PART).withColumn(name, F.col(name) + F.col("__before")).drop(PART, "__before")


def rank_within(df: DataFrame, name: str, total: str, scope: str, order: list[Column]) -> DataFrame:
    """df with 1, 2, 3, ... within each value of scope and the number of rows of that value; a value that holds most rows spreads."""
    rows = dealt(df, [F.col(scope), *order], "ranked")
    counts = rows.groupBy(PART, scope).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(scope)
    before = counts.select(PART, F.col(scope), F.coalesce(F.sum("__n").over(w.orderBy(PART).rowsBetween(*BEFORE)), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias(total))
    nth = F.row_number().over(Window.partitionBy(PART, scope).orderBy(*order))
    ranked = rows.withColumn(name, nth.cast("long")).withColumnRenamed(scope, "__scope")
    joined = ranked.join(before, (ranked[PART] == before[PART]) & ranked["__scope"].eqNullSafe(before[scope]))
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop(PART, "__before", "__scope")


def nearest_values(df: DataFrame, value: Column, scope: list[str], order: list[str]) -> DataFrame:
    """df with ``before`` and ``after``: the last value above and the first value below each row that are not null, in its scope."""
    rows = dealt(df, [F.col(c) for c in [*scope, *order]], "dealt")
    # what follows is looked up in the order turned round, as a frame that ends with its partition takes quadratic time
    down, up = (Window.partitionBy(PART, *scope).orderBy(*(F.col(c) if way else F.col(c).desc() for c in order)).rowsBetween(*BEFORE) for way in (True, False))
    at = F.when(value.isNotNull(), F.struct(*order))
    ends = rows.groupBy(PART, *scope).agg(F.max_by(value, at).alias("__last"), F.min_by(value, at).alias("__first"))
    earlier, later = (Window.partitionBy(*scope).orderBy(F.col(PART) if way else F.col(PART).desc()).rowsBetween(*BEFORE) for way in (True, False))
    ends = ends.select(PART, *scope, F.last("__last", ignorenulls=True).over(earlier).alias("__b"), F.last("__first", ignorenulls=True).over(later).alias("__a"))
    out = rows.withColumn("before", F.last(value, ignorenulls=True).over(down)).withColumn("after", F.last(value, ignorenulls=True).over(up))
    out = out.join(ends, [PART, *scope])
    return out.withColumn("before", F.coalesce("before", "__b")).withColumn("after", F.coalesce("after", "__a")).drop(PART, "__b", "__a")


def running_sums(df: DataFrame, values: list[str], order: list[str]) -> DataFrame:
    """df with each of values summed up to and including its row; the order must be total."""
    rows = dealt(df, [F.col(c) for c in order], "dealt")
    w = Window.orderBy(PART).rowsBetween(*BEFORE)
    before = rows.groupBy(PART).agg(*(F.sum(v).alias(v) for v in values)).select(PART, *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"__{v}") for v in values))
    own = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(PART, *(c for c in rows.columns if c not in (PART, *values)), *(F.sum(v).over(own).alias(v) for v in values))
    out = sums.join(F.broadcast(before), PART)  # a row for each range
    return out.select(*(c for c in sums.columns if c not in (PART, *values)), *((F.col(v) + F.col(f"__{v}")).alias(v) for v in values))
