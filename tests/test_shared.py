import os
import random

import pytest
from pyspark.sql import functions as F

from trafficloom.plans import ranking, shared
from trafficloom.plans.shared import materialize, numbered
from trafficloom.plans.skew import skewed_left


@pytest.mark.parametrize("plain", [True, False])
def test_row_numbers_do_not_follow_the_splits(spark, plain):
    rows = spark.range(4000).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("_metadata"))
    docs = materialize(rows.repartition(3), "t") if plain else rows.withColumn("id", F.explode(F.array("id", "id")))
    one = numbered(docs, ["id", "k"])
    assert one.columns == ["id", "k", "__uid"]
    kept = materialize(one.filter("k = 3").select("id", "__uid"), "t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        again = (numbered(docs, ["id", "k"]) if plain else one).join(kept.withColumnRenamed("id", "i"), "__uid")
        assert again.count() == docs.filter("k = 3").count() and again.filter("id <> i").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert one.select("__uid").distinct().count() == docs.count()


def test_ranges_carry_on(spark):
    """Ranks, running sums and neighbours against plain Python, with one scope that holds most rows and ranges that split it."""
    rng = random.Random(3)
    rows = [(i, None if k == 0 else "hot" if k < 7 else f"s{k}", rng.randint(0, 40), rng.randint(-5, 5), rng.choice([None, None, f"v{i}"])) for i in range(300) for k in [rng.randint(0, 9)]]
    df = spark.createDataFrame(rows, "id long, scope string, at long, x long, v string")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        order = sorted(rows, key=lambda r: (r[2], r[0]))
        total, want = 0, {}
        for r in order:
            total += r[3]
            want[r[0]] = total
        assert {r.id: r.x for r in ranking.running_sums(df, ["x"], ["at", "id"]).collect()} == want
        got = {r.id: (r.nth, r.of, r.scope) for r in ranking.rank_within(df, "nth", "of", "scope", [F.col("at"), F.col("id")]).collect()}
        for s in {r[1] for r in rows}:
            own = [r[0] for r in order if r[1] == s]
            assert [got[i] for i in own] == [(k + 1, len(own), s) for k in range(len(own))]
        scoped = df.filter("scope IS NOT NULL")
        for scope, table in (([], df), (["scope"], scoped)):
            got = {r.id: (r.before, r.after) for r in ranking.nearest_values(table, F.col("v"), scope, ["at", "id"]).collect()}
            for s in {r[1] for r in rows if not scope or r[1]} if scope else {0}:
                own = [r for r in order if not scope or r[1] == s]
                for k, r in enumerate(own):
                    above = [o[4] for o in own[:k] if o[4]]
                    below = [o[4] for o in own[k + 1:] if o[4]]
                    assert got[r[0]] == (above[-1] if above else None, below[0] if below else None)
        assert ranking.running_sums(df.limit(0), ["x"], ["at", "id"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_left_join_with_hot_and_null_keys(spark):
    rows = [(i, "hot" if i < 60 else f"k{i % 9}" if i < 90 else None) for i in range(100)]
    lookup = [("hot", 1), ("k1", 2), ("k2", 3), ("never", 4)]
    got = skewed_left(spark.createDataFrame(rows, "id long, k string"), spark.createDataFrame(lookup, "k string, x int"), ["k"]).collect()
    assert sorted((r.id, r.k, r.x) for r in got) == sorted(((i, k, dict(lookup).get(k)) for i, k in rows))


def test_tables_are_deleted(spark, tmp_path):
    def there(df):
        return os.path.isdir(df._shared_path.removeprefix("file:").removeprefix("//"))

    outer = shared.materialize(spark.range(3))
    with shared.temporary(spark) as kept:
        kept.append(shared.materialize(spark.range(4)))
        other = shared.materialize(spark.range(5))
    assert there(outer) and there(kept[0]) and not there(other) and kept[0].count() == 4
    shared.release(outer)
    assert not there(outer)
    with shared.text_file(spark, f"{tmp_path}/t.txt") as out:
        out.writelines(f"zeile {k} é\n" for k in range(50_000))
    assert (tmp_path / "t.txt").read_text(encoding="utf-8").splitlines()[-1] == "zeile 49999 é"


def test_batches_of_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    shared.bounded_batches(spark)
    assert spark.conf.get(key) == str(shared.BATCH_BYTES)
    spark.conf.set(key, "12345")
    shared.bounded_batches(spark)
    assert spark.conf.get(key) == "12345"
    spark.conf.unset(key)


def test_shuffle_files_go_when_a_table_is_written(spark):
    def held():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_") and name.endswith(".data")}

    before = held()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert held() <= before and table.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
