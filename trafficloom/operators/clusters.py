"""Network destinations: flows that share an endpoint or a certificate, directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import destination_key, destinations_of
from ..plans.components import connected_components
from ..plans.shared import materialize
from ..plans.skew import skewed_left


def key_destinations(flows: DataFrame) -> DataFrame:
    """(batch, key, dest_id): endpoints d|ip|port and certificates c|serial; dest_id is the component's first flow."""
    rows = flows.select("batch", "flow_idx", destination_key().alias("d"), F.concat(F.lit("c|"), F.col("cert")).alias("c"))
    ends = materialize(rows.groupBy("batch", "d", "c").agg(F.min("flow_idx").alias("i")), "ends")

    def node(key):
        return F.concat(F.col("batch").cast("string"), F.lit("/"), F.col(key))

    linked = connected_components(ends.filter("c IS NOT NULL").select(node("d").alias("src"), node("c").alias("dst")))
    linked = materialize(linked, "clusters")
    keys = ends.select("batch", F.explode(F.filter(F.array("d", "c"), lambda k: k.isNotNull())).alias("key"), "i").groupBy("batch", "key").agg(F.min("i").alias("i"))
    keys = keys.join(linked.withColumnRenamed("node", "n"), node("key") == F.col("n"), "left").withColumn("component", F.coalesce("component", node("key")))
    firsts = keys.groupBy("component").agg(F.min("i").alias("dest_id"))
    return keys.join(firsts, "component").select("batch", "key", "dest_id")


def lookup_destinations(flows: DataFrame, keys: DataFrame) -> DataFrame:
    """flows with dest_id: by endpoint first, then by certificate, else -1. flow_idx names a flow."""
    rows = materialize(flows.select("flow_idx", "batch", destination_key().alias("d"), F.concat(F.lit("c|"), F.col("cert")).alias("c")), "asked")
    found = skewed_left(rows, keys.select("batch", F.col("key").alias("d"), F.col("dest_id").alias("by_end")), ["batch", "d"])
    found = skewed_left(found, keys.select("batch", F.col("key").alias("c"), F.col("dest_id").alias("by_cert")), ["batch", "c"])
    return flows.join(found.select("flow_idx", F.coalesce("by_end", "by_cert", F.lit(-1)).alias("dest_id")), "flow_idx").select(*flows.columns, "dest_id")


def destination_state(clustered: DataFrame) -> DataFrame:
    """Each destination's keys (n| for flows without certificate), number of flows and labels."""
    keys = F.array_union(F.collect_set(destination_key()), F.collect_set(F.coalesce(F.concat(F.lit("c|"), F.col("cert")), F.lit("n|"))))
    labels = clustered.groupBy("batch", "dest_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("batch", "dest_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    return clustered.groupBy("batch", "dest_id").agg(F.array_sort(keys).alias("keys"), F.count(F.lit(1)).alias("n_flows")).join(labels, ["batch", "dest_id"])


def destination_descriptions(clustered: DataFrame) -> DataFrame:
    """The most frequent certificate, else the most frequent endpoint; first seen wins ties."""
    seen = clustered.select("batch", "dest_id", "flow_idx", F.explode(F.filter(F.array(F.concat(F.lit("c|"), F.col("cert")), destination_key()), lambda k: k.isNotNull())).alias("key"))
    counts = seen.groupBy("batch", "dest_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("flow_idx").alias("i"))
    return counts.groupBy("batch", "dest_id").agg(F.max_by("key", F.struct(F.col("key").startswith("c|"), "n", -F.col("i"))).alias("description"))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Numbers of samples, destinations, certificates and endpoints of each batch."""
    return clustered.groupBy("batch").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct(F.when(F.col("dest_id") >= 0, F.col("dest_id"))).alias("destinations"), F.count_distinct("cert").alias("certificates"), F.count_distinct(destination_key()).alias("endpoints"))


def plot_sizes(clustered: DataFrame) -> DataFrame:
    """What a plot of the destinations needs: description, flows and node size."""
    n = clustered.groupBy("batch", "dest_id").agg(F.count(F.lit(1)).alias("n"))
    return destination_descriptions(clustered).join(n, ["batch", "dest_id"]).withColumn("size", 20 * F.pow("n", F.lit(0.7)))


def destination_text() -> Column:
    """A destination in words, from the columns of destination_state: its id, flows, endpoints and labels."""
    ends = F.transform(destinations_of(F.col("keys")), lambda d: F.format_string("('%s', %d)", d["ip"], d["port"]))
    labels = F.transform(F.map_entries("labels"), lambda e: F.format_string("'%s': %d", e["key"], e["value"]))
    # fixed value: the form of a destination's line
    return F.format_string("NetworkDestination [%4d] [size=%4d] [IPs=[%s]] [labels={%s}]", F.col("dest_id"), F.col("n_flows"), F.array_join(ends, ", "), F.array_join(labels, ", "))


def save(clustered: DataFrame, path: str) -> None:
    """Write clustered flows as Parquet; load() gives them back with the destinations of their keys."""
    clustered.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(flows with dest_id, key_destinations) of saved clusters."""
    clustered = spark.read.parquet(path)
    return clustered, key_destinations(clustered)
