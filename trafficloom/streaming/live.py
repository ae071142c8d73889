"""An extension: fingerprints and labels for a stream of packets, batch by closed batch.

Time batches are fixed windows here, as the span of a stream is not known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fingerprints, flows, model
from ..plans.shared import materialize, temporary


def closed_packets(packets: DataFrame, batch: float = 300.0, late: str = "10 minutes") -> DataFrame:
    """Packets grouped by fixed window and flow, put out when the watermark has passed their window."""
    at = packets.withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long"))).withWatermark("event_time", late)
    row = F.struct("pkt_no", "ts", "len", "ip_src", "port_src", "ip_dst", "port_dst", "cert")
    return at.groupBy(F.window("event_time", f"{batch:g} seconds").alias("w"), "file", "proto", "stream").agg(F.collect_list(row).alias("packets"))


def label_stream(packets: DataFrame, known: DataFrame, sink, batch: float = 300.0, window: float = 30.0, correlation: float = 0.1, late: str = "10 minutes"):
    """A query writer: each closed window's flows get fingerprints and the label of the closest known one; sink(df, epoch) takes them.

    The tables behind df are deleted when sink returns.
    """

    def step(rows: DataFrame, epoch: int) -> None:
        opened = rows.select("file", "proto", "stream", F.explode("packets").alias("p")).select("file", "proto", "stream", "p.*")
        with temporary(rows.sparkSession):
            made = materialize(fingerprints.generate(flows.assemble_flows(opened), batch, window, correlation), "made")
            sink(made.join(model.recognize(made, known), "fp_id"), epoch)

    return closed_packets(packets, batch, late).writeStream.outputMode("append").foreachBatch(step)
