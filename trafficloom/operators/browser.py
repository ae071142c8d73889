"""Browser detection: rolling features over flows in time, and a random forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import nearest_values, running_sums
from ..plans.shared import materialize

FEATURES = ("d_cluster", "d_incoming", "d_outgoing", "ratio")


def rolling(rows: DataFrame, seconds: float = 5.0) -> DataFrame:
    """flow_idx, us, n_clusters, incoming, outgoing over the frame (t - seconds, t], later rows of the same time left out.

    rows: flow_idx, time_start, dest_id, bytes_in, bytes_out. Every row enters the frame at its time and leaves it
    ``seconds`` later, and running sums over both kinds of events give counts and bytes, so no frame is ever
    gathered. A destination enters with a row that has no other one of it in the ``seconds`` before, and leaves after one
    without another in the ``seconds`` that follow. For that its rows are compared within slices of the frame's width, and
    with the ends of the slices beside (one row for each destination and slice).
    """
    width = int(seconds * 1e6)
    t = rows.select("flow_idx", F.round(F.col("time_start") * 1e6).cast("long").alias("us"), "dest_id", F.col("bytes_in").cast("long").alias("incoming"), F.col("bytes_out").cast("long").alias("outgoing"))
    t = materialize(t.withColumn("slice", F.floor(F.col("us") / width)), "timed")
    ends = t.groupBy("dest_id", "slice").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    w, v = Window.partitionBy("dest_id", "slice").orderBy("us", "flow_idx"), Window.partitionBy("dest_id").orderBy("slice")
    beside = ends.select("dest_id", "slice", F.lag("high").over(v).alias("earlier"), F.lead("low").over(v).alias("later"))
    t = t.withColumn("prev", F.lag("us").over(w)).withColumn("next", F.lead("us").over(w)).join(beside, ["dest_id", "slice"])
    enters = F.coalesce(F.coalesce("prev", "earlier") + width <= F.col("us"), F.lit(True)).cast("long")
    leaves = F.coalesce(F.col("us") + width <= F.coalesce("next", "later"), F.lit(True)).cast("long")

    def event(at, comes, sign, turn):
        return F.struct(at.alias("us"), F.lit(comes).alias("comes"), F.lit(sign).cast("long").alias("n"), (turn * sign).alias("n_clusters"), (F.col("incoming") * sign).alias("incoming"), (F.col("outgoing") * sign).alias("outgoing"))

    # at equal times rows leave before others come, as the frame is open on its left
    events = t.select("flow_idx", F.explode(F.array(event(F.col("us"), True, 1, enters), event(F.col("us") + width, False, -1, leaves))).alias("e")).select("flow_idx", "e.*")
    sums = running_sums(events, ["n", "n_clusters", "incoming", "outgoing"], ["us", "comes", "flow_idx"]).filter("comes")
    return sums.select("flow_idx", "us", F.col("n_clusters").cast("int").alias("n_clusters"), (F.col("incoming") / F.col("n")).alias("incoming"), (F.col("outgoing") / F.col("n")).alias("outgoing"))


def features(rows: DataFrame) -> DataFrame:
    """flow_idx with the changes of each rolling value from the flow before, and incoming per outgoing change."""
    value = F.struct("n_clusters", "incoming", "outgoing")
    r = nearest_values(rolling(rows), value, [], ["us", "flow_idx"])

    def change(name):
        return F.coalesce(F.col(name) - F.col(f"before.{name}"), F.lit(0)).cast("double")

    r = r.select("flow_idx", change("n_clusters").alias("d_cluster"), change("incoming").alias("d_incoming"), change("outgoing").alias("d_outgoing"))
    return r.withColumn("ratio", F.coalesce(F.try_divide("d_incoming", "d_outgoing"), F.lit(0.0)))


def smooth(rows: DataFrame, before: float = 10.0, after: float = 10.0) -> DataFrame:
    """rows (flow_idx, time_start, prediction) with the flows around a browser's, from ``before`` seconds ahead to ``after`` seconds later, +1 too.

    Not part of predict(). Rows are sent to the slices of time that their frame touches; only whether a time has a browser's flow is looked at there.
    """
    width = int(max(before, after) * 1e6) + 1
    t = rows.select("flow_idx", "prediction", F.round(F.col("time_start") * 1e6).cast("long").alias("us"))
    hits = t.filter("prediction = 1").select("us", F.lit(None).cast("long").alias("flow_idx")).distinct()
    hits = hits.withColumn("slice", F.explode(F.sequence(F.floor(F.col("us") / width) - 1, F.floor(F.col("us") / width) + 1)))
    asked = t.select("us", "flow_idx").withColumn("slice", F.floor(F.col("us") / width))
    down = Window.partitionBy("slice").orderBy("us", F.col("flow_idx").asc_nulls_first())
    up = Window.partitionBy("slice").orderBy(F.col("us").desc(), F.col("flow_idx").desc_nulls_last())
    at = F.when(F.col("flow_idx").isNull(), F.col("us"))
    near = hits.select("us", "flow_idx", "slice").unionByName(asked.select("us", "flow_idx", "slice"))
    near = near.withColumn("earlier", F.last(at, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("later", F.last(at, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).filter("flow_idx IS NOT NULL")
    hit = (F.col("us") - F.col("earlier") <= int(after * 1e6)) | (F.col("later") - F.col("us") <= int(before * 1e6))
    return near.select("flow_idx", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(-1).alias("prediction"))


class BrowserDetector:
    """A forest of ten trees over the features; labels are +1 (browser) and -1."""

    def __init__(self, trees: int = 10, seed: int = 42, depth: int = 20):
        self.trees, self.seed, self.depth, self.forest = trees, seed, depth, None

    def fit(self, clustered: DataFrame, label: str = "label") -> BrowserDetector:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        self.assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        rows = features(clustered).join(clustered.select("flow_idx", F.when(F.col(label) == 1, 1.0).otherwise(0.0).alias("y")), "flow_idx")
        self.forest = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(self.assemble.transform(rows))
        return self

    def predict(self, clustered: DataFrame) -> DataFrame:
        """flow_idx, prediction (+1 or -1)."""
        out = self.forest.transform(self.assemble.transform(features(clustered)))
        return out.select("flow_idx", F.when(F.col("prediction") > 0.5, 1).otherwise(-1).alias("prediction"))

    def fit_predict(self, clustered: DataFrame, label: str = "label") -> DataFrame:
        return self.fit(clustered, label).predict(clustered)
