"""Packets to flows, time batches and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clock
from ..plans.ranking import global_rank, rank_within

FLOW = ["file", "proto", "stream"]
PRIME = 2**31 - 1


def oriented_packets(packets: DataFrame) -> DataFrame:
    """Packets with their flow's ends (from its first packet) and signed length.

    The destination is the end with the smaller port; equal ports swap. Length is
    positive from the source. bad_ends: neither the addresses nor the ports are the flow's.
    """
    ends = F.struct("ip_src", "port_src", "ip_dst", "port_dst")
    first = packets.groupBy(*FLOW).agg(F.min_by(ends, "pkt_no").alias("f"), F.min("pkt_no").alias("first_pkt"))
    ahead = F.col("f.port_src") > F.col("f.port_dst")

    def side(a, b):
        return F.when(ahead, F.col(f"f.{a}")).otherwise(F.col(f"f.{b}"))

    first = first.select(*FLOW, "first_pkt", side("ip_src", "ip_dst").alias("src"), side("port_src", "port_dst").alias("sport"), side("ip_dst", "ip_src").alias("dst"), side("port_dst", "port_src").alias("dport"))

    def pair(a, b):
        return F.array_sort(F.array_distinct(F.array(a, b)))

    both = packets.join(first, FLOW)
    return both.withColumn("signed", F.when(F.col("ip_src") == F.col("src"), F.col("len")).otherwise(-F.col("len"))).withColumn("bad_ends", (pair("ip_src", "ip_dst") != pair("src", "dst")) & (pair("port_src", "port_dst") != pair("sport", "dport")))


def flow_checks(packets: DataFrame) -> DataFrame:
    """Each flow's number of packets of other ends and of distinct certificates."""
    return oriented_packets(packets).groupBy(*FLOW).agg(F.count(F.when(F.col("bad_ends"), 1)).alias("bad_ends"), F.count_distinct("cert").alias("n_certs"))


def assemble_flows(packets: DataFrame, labels: DataFrame | None = None, on_error: str = "drop_file") -> DataFrame:
    """One row per flow, numbered by flow_idx in order of file and first packet.

    A flow whose packets have other ends or two certificates spoils its file:
    'drop_file' leaves the whole file out, 'fail' raises. labels (file, label)
    gives each flow a label, else the file is the label. Packets are shuffled once, by flow; the
    pairs of ends that a flow has seen (one, unless it is spoilt) are kept beside its packets.
    """
    def pair(a, b):
        return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))

    flows = packets.groupBy(*FLOW).agg(
        F.min_by(F.struct("ip_src", "port_src", "ip_dst", "port_dst"), "pkt_no").alias("f"), F.collect_set(F.struct(pair("ip_src", "ip_dst").alias("ips"), pair("port_src", "port_dst").alias("ports"))).alias("seen"),
        F.max("cert").alias("cert"), F.min("cert").alias("other"), F.min("pkt_no").alias("first_pkt"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end"), F.count(F.lit(1)).alias("n_packets"),
        F.array_sort(F.collect_list(F.struct("pkt_no", "ts", "len", "ip_src"))).alias("p"))
    ahead = F.col("f.port_src") > F.col("f.port_dst")

    def side(a, b):
        return F.when(ahead, F.col(f"f.{a}")).otherwise(F.col(f"f.{b}"))

    other_ends = F.exists("seen", lambda e: (e["ips"] != pair("f.ip_src", "f.ip_dst")) & (e["ports"] != pair("f.port_src", "f.port_dst")))
    flows = flows.select(
        *FLOW, side("ip_src", "ip_dst").alias("src"), side("port_src", "port_dst").alias("sport"), side("ip_dst", "ip_src").alias("dst"), side("port_dst", "port_src").alias("dport"), "cert", "first_pkt",
        "time_start", "time_end", "n_packets", "p", (other_ends | F.coalesce(F.col("cert") != F.col("other"), F.lit(False))).alias("spoilt"))
    flows = flows.withColumn("lengths", F.transform("p", lambda x: F.when(x["ip_src"] == F.col("src"), x["len"]).otherwise(-x["len"])))

    def total(sign):
        return F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + F.greatest(x * sign, F.lit(0)))

    flows = flows.select(
        *FLOW, "src", "sport", "dst", "dport", "cert", "first_pkt", "time_start", "time_end", "n_packets", total(1).alias("bytes_out"), total(-1).alias("bytes_in"), F.transform("p", lambda x: x["ts"]).alias("timestamps"), "lengths", "spoilt")
    flows = flows.join(labels, "file") if labels is not None else flows.withColumn("label", F.col("file"))

    def sound(dealt):
        spoilt = dealt.filter("spoilt").select("file").distinct()
        if on_error == "fail":
            if bad := spoilt.first():
                raise ValueError(f"flows of {bad.file} are not consistent")
            return dealt
        return dealt if spoilt.isEmpty() else dealt.join(spoilt, "file", "left_anti")

    return global_rank(flows, "flow_idx", [F.col("file"), F.col("first_pkt"), F.col("proto"), F.col("stream")], sound).drop("first_pkt", "spoilt")


def time_batches(flows: DataFrame, width: float = 300.0) -> DataFrame:
    """flows with batch 1..n: n = ceil(span / width) bins of equal width over the whole span.

    The bin's edge k * (span / n) + min is compared in doubles; the estimate by division
    is moved by one where rounding put it on the other side.
    """
    low, high = flows.agg(F.min("time_start"), F.max("time_start")).first()
    if low is None or high == low or math.isinf(width):
        return flows.withColumn("batch", F.lit(1))
    n = max(1, math.ceil((high - low) / width))
    step, t = (high - low) / n, F.col("time_start")
    guess = F.least(F.floor((t - F.lit(low)) / F.lit(step)), F.lit(n - 1))

    def edge(k):
        return k.cast("double") * F.lit(step) + F.lit(low)

    k = F.when(edge(guess) > t, guess - 1).when((guess + 1 < n) & (edge(guess + 1) <= t), guess + 1).otherwise(guess)
    return flows.withColumn("batch", (k + 1).cast("int"))


def sequential_split(flows: DataFrame, train_ratio: float, label: str = "label", order: str = "flow_idx") -> DataFrame:
    """flows with is_train: the first int(n * ratio) of each label, by position."""
    ranked = rank_within(flows, "__nth", "__of", label, [F.col(order)])
    return ranked.withColumn("is_train", F.col("__nth") <= F.floor(F.col("__of") * F.lit(float(train_ratio)))).select(*flows.columns, "is_train")


def shuffled(x: Column, seed: int) -> Column:
    """A number below 2^31 - 1 that scatters positions: two steps of a multiplicative generator with a shift between."""
    def step(v, factor):
        return F.pmod(v * factor + seed, F.lit(PRIME))

    first = step(F.pmod(x, F.lit(PRIME)), 48271)
    return step(first.bitwiseXOR(F.shiftright(first, 15)), 69621)


def random_split(flows: DataFrame, test_size: float, seed: int = 42, order: str = "flow_idx") -> DataFrame:
    """flows with is_train: the ceil(test_size * n) rows that come first when shuffled are the test set."""
    ranked = global_rank(flows.withColumn("__h", shuffled(F.col(order).cast("long"), seed)), "__nth", [F.col("__h"), F.col(order)])
    n = flows.count()
    return ranked.withColumn("is_train", F.col("__nth") >= math.ceil(test_size * n)).drop("__h", "__nth")


def flow_text() -> Column:
    """A flow in words: its times, ends and number of packets."""
    # fixed value: the form of a flow's line
    return F.format_string("[Time %s to %s] %15s:%-5d <-> %15s:%-5d [Length %d]", clock(F.col("time_start")), clock(F.col("time_end")), F.col("src"), F.col("sport"), F.col("dst"), F.col("dport"), F.col("n_packets"))
