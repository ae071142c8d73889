"""Packets from the events table: each event is a flow of one to four packets."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = e.select("event_id", "user_id", k.alias("k"), F.col("event_type").isin("click", "view", "purchase").alias("tcp"), start.alias("start"), F.explode(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int"))).alias("j"))
    back, tcp = F.col("j") % 2 == 1, F.col("tcp")
    client, server = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")), F.concat(F.lit("192.0.2."), F.col("k").cast("string"))
    cport, sport = (F.lit(49152) + F.col("event_id") % 16000).cast("int"), F.when(tcp, 443).otherwise(53)
    us = F.col("start") + F.col("j") * 7500000
    return e.select(
        F.concat(F.lit("cap_"), (F.col("user_id") % 5).cast("string")).alias("file"), F.when(tcp, "tcp").otherwise("udp").alias("proto"), F.col("event_id").cast("string").alias("stream"),
        (F.col("event_id") * 4 + F.col("j")).alias("pkt_no"), (us / 1e6).alias("ts"), (F.lit(40) + (F.col("event_id") * 31 + F.col("j") * 13) % 1400).cast("long").alias("len"),
        F.when(back, server).otherwise(client).alias("ip_src"), F.when(back, sport).otherwise(cport).alias("port_src"), F.when(back, client).otherwise(server).alias("ip_dst"), F.when(back, cport).otherwise(sport).alias("port_dst"),
        F.when(tcp & (F.col("k") % 3 == 0), (F.lit(1000) + F.floor(F.col("k") / 6)).cast("string")).alias("cert"))


def write_captures(packets: DataFrame, folder: str) -> None:
    """Packets as capture files of a pcap kind, a file for each ``file``, that read_captures() reads back; a means to test with.

    A certificate travels in packets with room for its message (CERTIFICATE_ROOM bytes of IP length).
    """
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        with system.open_output_stream(f"{inner}/{rows.file.iloc[0]}.pcap") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101))
            for r in rows.sort_values("pkt_no").itertuples(index=False):
                us = round(r.ts * 1e6)
                head = struct.pack(">HHIIBBHHH", r.port_src, r.port_dst, 0, 0, 80, 24, 0, 0, 0) if r.proto == "tcp" else struct.pack(">HHHH", r.port_src, r.port_dst, r.len - 20, 0)
                ip = struct.pack(">BBHHHBBH", 0x45, 0, r.len, 0, 0, 64, 6 if r.proto == "tcp" else 17, 0) + b"".join(bytes(map(int, a.split("."))) for a in (r.ip_src, r.ip_dst))
                body = certificate_message(int(r.cert)) if r.cert is not None and r.len >= CERTIFICATE_ROOM else b""
                frame = (ip + head + body).ljust(r.len, b"\0")[:r.len]
                out.write(struct.pack("<IIII", us // 10**6, us % 10**6, len(frame), len(frame)) + frame)
        return pd.DataFrame({"file": [rows.file.iloc[0]]})

    packets.groupBy("file").applyInPandas(write, "file string").write.format("noop").mode("overwrite").save()


CERTIFICATE_ROOM = 104


def certificate_message(serial: int) -> bytes:
    """A TLS record with a Certificate message of one bare certificate of this serial."""
    n = serial.to_bytes(serial.bit_length() // 8 + 1, "big")
    part = b"\xa0\x03\x02\x01\x02\x02" + bytes([len(n)]) + n + b"\x05\x00"
    part = b"\x30" + bytes([len(part)]) + part
    der = b"\x30" + bytes([len(part)]) + part
    listed = len(der).to_bytes(3, "big") + der
    message = len(listed).to_bytes(3, "big") + listed
    message = b"\x0b" + len(message).to_bytes(3, "big") + message
    return b"\x16\x03\x03" + struct.pack(">H", len(message)) + message


PACKETS_SQL = """
packets AS (SELECT 'cap_' || user_id % 5 AS file, CASE WHEN tcp THEN 'tcp' ELSE 'udp' END AS proto, event_id::VARCHAR AS stream, event_id * 4 + j AS pkt_no,
  (start + j * 7500000) / 1e6::DOUBLE AS ts, 40 + (event_id * 31 + j * 13) % 1400 AS len,
  CASE WHEN j % 2 = 1 THEN server ELSE client END AS ip_src, CASE WHEN j % 2 = 1 THEN sport ELSE cport END AS port_src,
  CASE WHEN j % 2 = 1 THEN client ELSE server END AS ip_dst, CASE WHEN j % 2 = 1 THEN cport ELSE sport END AS port_dst,
  CASE WHEN tcp AND k % 3 = 0 THEN (1000 + k // 6)::VARCHAR END AS cert
  FROM (SELECT *, unnest(range(event_id % 4 + 1)) AS j, '10.0.0.' || user_id % 250 AS client, '192.0.2.' || k AS server, (49152 + event_id % 16000)::INT AS cport, CASE WHEN tcp THEN 443 ELSE 53 END AS sport
    FROM (SELECT event_id, user_id, epoch_us(ts) AS start, event_type IN ('click', 'view', 'purchase') AS tcp, json_extract_string(props, '$.k')::INT AS k FROM events)))"""
