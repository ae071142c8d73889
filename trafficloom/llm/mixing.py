"""Mixing of sources to target weights by systematic sampling.

A source's documents, in order of size, each have target / source_size expected
copies. Their prefix sums, moved by one random offset per source, cross integers;
a document is emitted once for each integer that it crosses. As equal sizes
are neighbours, the words taken miss the target by about one document at most.

Prefix sums are made in two levels: the rows are dealt by range of (source,
size, id), so a hot source spreads over many tasks; each range counts its rows,
and the counts before it are added to the rank within the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    Sources in code-point order, null last, weigh 5, 2, 1, repeating. A target is
    least(3 * source_size, level * weight), where the level makes targets add up
    to all words: what is cut from sources at their limit goes to the others by weight.
    Of the levels that result if the k sources that reach their limit first are
    cut, the right one is the highest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = sizes.withColumn("nth", F.row_number().over(by_name) % 3).withColumn("weight", F.expr("CASE nth WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END"))
    w = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = weigh.withColumn("rest_weight", F.sum("weight").over(w)).withColumn("rest_size", F.sum("source_size").over(w))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = rest.withColumn("total", F.sum("source_size").over(every)).withColumn("level", F.max((F.col("total") - MOST * (F.col("total") - F.col("rest_size"))) / F.col("rest_weight")).over(every))
    return level.select("source", "source_size", F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", uid_col: str | None = None) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, copies, taken for each row of docs.

    uid is uid_col, which must be unique, or else monotonically_increasing_id() of docs. Null and empty texts have size
    0 and are taken without words; a null source is a source; repeated rows count
    each for itself; other columns are ignored. Offsets come from the source's name: reruns agree.
    """
    spark = docs.sparkSession
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows, "sizes")
    order = [F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("uid")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("source").asc_nulls_last(), *order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("n").over(by_part) - F.col("n")).alias("before"))
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = before.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("source", "part").orderBy(*order)))
    joined = ranked.join(before, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("double") / 4096
    nth = F.col("before") + F.col("rank")
    copies = F.least(F.floor(nth * rate + offset) - F.floor((nth - 1) * rate + offset), F.lit(MOST)).cast("long")
    return joined.select("uid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for the whole of documents."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, sum(weight) OVER t AS rest_weight, sum(source_size) OVER t AS rest_size, sum(source_size) OVER () AS total FROM w
      WINDOW t AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, max((total - 3 * (total - rest_size))::DOUBLE / rest_weight) OVER () * weight) AS target FROM r),
n AS (SELECT d.doc_id, d.size, l.source_size, l.target, CASE WHEN l.source_size > 0 THEN l.target / l.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5(coalesce('=' || d.source, '')), 1, 3))::INT::DOUBLE / 4096 AS u,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS nth
      FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target, (least(floor(nth * rate + u) - floor((nth - 1) * rate + u), 3) * size)::BIGINT AS taken FROM n
"""
