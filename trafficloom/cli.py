"""Command line: fingerprints from captures, and recognition or detection with stored models."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import flows
from .operators.model import TrafficModel
from .sources.captures import read_packets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trafficloom", description=__doc__)
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--fingerprint", nargs="?", const="", metavar="FILE", help="make fingerprints and save or print them (default)")
    mode.add_argument("--detection", type=float, metavar="T", help="tell known (+1) from unknown (-1) fingerprints at threshold T")
    mode.add_argument("--recognition", action="store_true", help="label fingerprints with the closest of the model")
    for short, name, default in (("-b", "--batch", 300.0), ("-w", "--window", 30.0), ("-c", "--correlation", 0.1), ("-s", "--similarity", 0.9)):
        p.add_argument(short, name, type=float, default=default)
    p.add_argument("-p", "--pcaps", nargs="+", help="capture files")
    p.add_argument("-r", "--read", nargs="+", help="flows written before (Parquet)")
    p.add_argument("-o", "--write", help="write flows (Parquet)")
    p.add_argument("-l", "--split", type=float, help="share of flows to keep as a test set")
    p.add_argument("-a", "--random", type=int, default=42, help="seed of the split")
    p.add_argument("-t", "--train", nargs="+", help="model files")
    p.add_argument("-e", "--test", nargs="+", help="model files to label")
    return p


def check(p: argparse.ArgumentParser, args: argparse.Namespace) -> None:
    if args.detection is not None or args.recognition:
        if not args.train or not args.test:
            p.error("--detection and --recognition need --train and --test")
    elif not args.pcaps and not args.read:
        p.error("--fingerprint needs --pcaps or --read")


def load_flows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Flows of all captures and flow files; numbers of later sources follow those of earlier ones."""
    parts = [flows.assemble_flows(read_packets(spark, list(args.pcaps)))] if args.pcaps else []
    parts += [spark.read.parquet(f) for f in args.read or []]
    out, base = None, 0
    for part in parts:
        part = part.withColumn("flow_idx", F.col("flow_idx") + base)
        last = part.agg(F.max("flow_idx")).first()[0]
        base = base if last is None else last + 1
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def split_name(path: str, part: str) -> str:
    name, ext = os.path.splitext(path)
    return f"{name}.{part}{ext}"


def show(model: DataFrame) -> None:
    """Each label's fingerprints, the smallest first."""
    for r in model.orderBy("label", F.size("keys"), "n_flows", "fp_id").toLocalIterator():
        print(f"{r.label}: {r.fp_id[:16]} ({len(r['keys'])} keys, {r.n_flows} flows)")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    args = p.parse_args(argv)
    check(p, args)
    spark = spark or SparkSession.builder.appName("trafficloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = dict(batch=args.batch, window=args.window, correlation=args.correlation, similarity=args.similarity)
    if args.detection is not None or args.recognition:
        known, asked = TrafficModel(**settings), TrafficModel()
        known.load(spark, *args.train)
        tests = asked.load(spark, *args.test, store=False)
        if args.recognition:
            out = known.recognize(tests).withColumnRenamed("label", "prediction")
        else:
            out = known.detect(tests, args.detection)
        labelled = tests.select("fp_id", F.explode("labels").alias("label")).join(out, "fp_id")
        for r in labelled.orderBy("label", "fp_id").toLocalIterator():
            print(f"{r.label}: {r.fp_id[:16]} --> {r.prediction}")
        return
    rows = load_flows(spark, args)
    if args.write:
        rows.write.mode("overwrite").parquet(args.write)
    parts = {"": rows}
    if args.split:
        marked = flows.random_split(rows, args.split, args.random)
        parts = {"train": marked.filter("is_train"), "test": marked.filter("NOT is_train")}
    for name, part in parts.items():
        fitted = TrafficModel(**settings).fit(part)
        if args.fingerprint:
            fitted.save(split_name(args.fingerprint, name) if name else args.fingerprint)
        else:
            show(fitted.model)


if __name__ == "__main__":
    main()
