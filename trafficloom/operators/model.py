"""The fingerprint model: fit, predict, recognise, detect, save and load."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import certificates_of, destinations_of, fingerprint_id
from ..plans.shared import materialize, text_file
from . import fingerprints as fp

#: How the first line of a model file ends; a line for each pair follows.
HEAD_END = ', "fingerprints": ['


def label_modes(labelled: DataFrame) -> DataFrame:
    """fp_id, keys, n_flows, label, ord: each fingerprint's most frequent label, the first seen on ties."""
    counts = labelled.groupBy("fp_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("flow_idx").alias("i"), F.first("keys").alias("keys"), F.max("n_flows").alias("n_flows"))
    return counts.groupBy("fp_id").agg(F.first("keys").alias("keys"), F.max("n_flows").alias("n_flows"), F.max_by("label", F.struct("n", -F.col("i"))).alias("label"), F.min("i").alias("ord"))


def default_match(model: DataFrame, kind: str) -> DataFrame:
    """One row (fp_id, keys): 'common' has most flows, 'largest' most keys; the first in the model on ties."""
    by = {"common": F.col("n_flows"), "largest": F.size("keys")}[kind]
    best = model.orderBy(by.desc(), "ord", "fp_id").limit(1).select("fp_id", "keys")
    if best.isEmpty():
        raise ValueError("the model is empty")
    return best


def predict(tests: DataFrame, model: DataFrame, default: str | None = "common") -> DataFrame:
    """tests' distinct fp_id with match_id and score; default None matches the empty fingerprint."""
    asked = tests.dropDuplicates(["fp_id"])
    found = asked.select("fp_id").join(fp.closest(asked, model), "fp_id", "left")
    other = F.lit(default_match(model, default).first().fp_id) if default else fingerprint_id(F.expr(fp.EMPTY))
    return found.select("fp_id", F.coalesce("match_id", other).alias("match_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def recognize(tests: DataFrame, model: DataFrame, default: str = "common") -> DataFrame:
    """tests' distinct fp_id and the label of the closest fingerprint of the model; of a repeated one the first label in the model."""
    labels = model.groupBy(F.col("fp_id").alias("match_id")).agg(F.min_by("label", F.struct("ord", "label")).alias("label"))
    return predict(tests, model, default).join(labels, "match_id", "left").select("fp_id", "label")


def detect(tests: DataFrame, model: DataFrame, threshold: float | None = None, default_threshold: float = 0.1) -> DataFrame:
    """fp_id and +1 (known) or -1; a threshold of 0 counts as not given."""
    least = threshold or default_threshold
    if least > 0:
        return fp.is_in(tests, model, least).select("fp_id", F.when(F.col("found"), 1).otherwise(-1).alias("prediction"))
    return predict(tests, model, None).select("fp_id", F.when(F.col("score") >= least, 1).otherwise(-1).alias("prediction"))


def encoded(model: DataFrame) -> DataFrame:
    """One JSON pair [fingerprint, label] per fingerprint and label; the no-certificate key is not stored."""
    body = F.struct(certificates_of(F.col("keys")).alias("certificates"), F.transform(destinations_of(F.col("keys")), lambda d: F.array(d["ip"], d["port"].cast("string"))).alias("destinations"), "n_flows")
    return model.select("fp_id", "label", F.to_json(F.array(F.to_json(body), F.col("label"))).alias("pair"))


def decoded(pairs: DataFrame) -> DataFrame:
    """fp_id, keys, n_flows, labels from rows whose column pair is an array of two JSON texts."""
    known = F.from_json(F.get("pair", F.lit(0)), "certificates array<string>, destinations array<array<string>>, n_flows long")
    rows = pairs.select(known.alias("f"), F.get("pair", F.lit(1)).alias("label"))
    ends = F.transform(F.coalesce("f.destinations", F.expr("cast(array() as array<array<string>>)")), lambda d: F.concat(F.lit("d|"), F.get(d, F.lit(0)), F.lit("|"), F.get(d, F.lit(1))))
    certs = F.transform(F.coalesce("f.certificates", F.expr(fp.EMPTY)), lambda c: F.concat(F.lit("c|"), c))
    keys = F.array_sort(F.array_union(ends, certs))
    rows = rows.select(keys.alias("keys"), F.coalesce("f.n_flows", F.lit(0)).alias("n_flows"), "label").withColumn("fp_id", fingerprint_id(F.col("keys")))
    return rows.groupBy("fp_id").agg(F.first("keys").alias("keys"), F.max("n_flows").alias("n_flows"), F.array_sort(F.collect_set("label")).alias("labels"))


class TrafficModel:
    """Parameters and a fitted model; all tables are DataFrames."""

    NAMES = ("batch", "window", "correlation", "similarity", "threshold")

    def __init__(self, batch: float = 300.0, window: float = 30.0, correlation: float = 0.1, similarity: float = 0.9, threshold: float = 0.1):
        self.batch, self.window, self.correlation, self.similarity, self.threshold = batch, window, correlation, similarity, threshold
        self.counts: DataFrame | None = None

    def fingerprint(self, flows: DataFrame) -> DataFrame:
        return fp.generate(flows, self.batch, self.window, self.correlation, self.similarity)

    def update(self, flows: DataFrame, labelled: bool = True) -> TrafficModel:
        """Adds flows (with a label column) to what the model has seen; without labels all have label 1."""
        made = self.fingerprint(flows)
        made = materialize(made.join(flows.select("flow_idx", "label"), "flow_idx") if labelled else made.withColumn("label", F.lit("1")), "seen")
        self.counts = made if self.counts is None else self.counts.unionByName(made)
        return self

    def fit(self, flows: DataFrame, labelled: bool = True) -> TrafficModel:
        self.counts = None
        return self.update(flows, labelled)

    @property
    def model(self) -> DataFrame:
        if self.counts is None:
            raise ValueError("fit or load the model first")
        return label_modes(self.counts)

    def predict(self, fps: DataFrame, default: str | None = "common") -> DataFrame:
        return predict(fps, self.model, default)

    def fit_predict(self, flows: DataFrame) -> DataFrame:
        return self.fit(flows).predict(self.counts.select("flow_idx", "fp_id", "keys", "n_flows"))

    def recognize(self, fps: DataFrame) -> DataFrame:
        return recognize(fps, self.model)

    def detect(self, fps: DataFrame, threshold: float | None = None) -> DataFrame:
        return detect(fps, self.model, threshold, self.threshold)

    def save(self, path: str, fps: DataFrame | None = None) -> None:
        """One JSON file, with a line for each pair: parameters and fingerprints; explicit fingerprints without a label get the file's name.

        Pairs pass the driver one by one; a model has one row per distinct fingerprint.
        """
        known = self.model.select("fp_id", "keys", "n_flows", "label") if self.counts is not None else None
        if fps is not None and not fps.isEmpty():
            rows = fps.dropDuplicates(["fp_id"]).select("fp_id", "keys", "n_flows")
            known = rows.join(known.select("fp_id", "label"), "fp_id", "left") if known is not None else rows.withColumn("label", F.lit(None).cast("string"))
            known = known.withColumn("label", F.coalesce("label", F.lit(path)))
        if known is None:
            raise ValueError("there is nothing to save")
        with text_file(known.sparkSession, path) as out:
            out.write(json.dumps({n: getattr(self, n) for n in self.NAMES})[:-1] + HEAD_END)
            for i, r in enumerate(encoded(known).orderBy("fp_id").toLocalIterator()):
                body = json.loads(json.loads(r.pair)[0])
                body["certificates"] = [int(c) if c.isdigit() else c for c in body["certificates"]]
                body["destinations"] = [[ip, int(port)] for ip, port in body["destinations"]]
                out.write((",\n" if i else "\n") + json.dumps([body, r.label], sort_keys=True))
            out.write("\n]}\n")

    def load(self, spark, *paths: str, parameters: bool = False, store: bool = True) -> DataFrame:
        """Fingerprints of model files with the union of their labels; store makes them the model's.

        Files that save() wrote are read by lines, so a large one splits; others as one JSON value each.
        """
        names = ", ".join(f"{n} double" for n in self.NAMES)
        pairs, settings = None, {}
        for path in paths:
            first = spark.read.text(path).first()
            if first and first.value.endswith(HEAD_END):
                lines = spark.read.text(path).filter(F.col("value").startswith("["))
                found, settings = lines.select(F.from_json(F.rtrim("value", F.lit(",")), "array<string>").alias("pair")), json.loads(first.value + "]}")
            else:
                whole = spark.read.schema(names + ", fingerprints array<array<string>>").option("multiLine", True).json(path)
                found = whole.select(F.explode("fingerprints").alias("pair"))
                settings = whole.select(*self.NAMES).first().asDict() if parameters else {}
            pairs = found if pairs is None else pairs.union(found)
        if parameters:
            for n in self.NAMES:
                if settings.get(n) is not None:
                    setattr(self, n, settings[n])
        out = decoded(pairs)
        if store:
            rows = out.select("fp_id", "keys", "n_flows", F.explode("labels").alias("label")).withColumn("flow_idx", F.lit(0).cast("long"))
            self.counts = rows.select("flow_idx", "fp_id", "keys", "n_flows", "label") if self.counts is None else self.counts.unionByName(rows)
        return out


def by_label(model: DataFrame) -> DataFrame:
    """label and its fingerprints' ids, in order of size, then flows, then id."""
    return model.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.size("keys").alias("n"), "n_flows", "fp_id"))), lambda x: x["fp_id"]).alias("fp_ids"))


def fingerprint_text() -> Column:
    """A fingerprint in words: the start of its id and its number of keys."""
    # fixed value: the form of a fingerprint's line
    return F.format_string("Fingerprint(0x%s) [size=%4d]", F.substring("fp_id", 1, 12), F.size("keys"))


def classification_report(judged: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per label and overall (accuracy, macro avg, weighted avg): precision, recall, f1, support; 0 on division by zero."""
    pairs = judged.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select("y", "p", "n", F.explode(F.array_distinct(F.array("y", "p"))).alias("label")).filter("label IS NOT NULL")
    per = sides.groupBy("label").agg(F.sum(F.when((F.col("y") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("p") == F.col("label"), F.col("n")).otherwise(0)).alias("guessed"), F.sum(F.when(F.col("y") == F.col("label"), F.col("n")).otherwise(0)).alias("support"))
    zero = F.lit(0.0)
    per = per.withColumn("precision", F.coalesce(F.try_divide("tp", "guessed"), zero)).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    total = F.sum("support")
    names = ("precision", "recall", "f1")
    accuracy = F.coalesce(F.try_divide(F.sum("tp"), total), zero)
    overall = per.agg(accuracy.alias("accuracy"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), zero).alias(f"w_{c}") for c in names], total.alias("support"))
    rows = F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(c) for c in names], "support"),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{c}").alias(c) for c in names], "support"),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{c}").alias(c) for c in names], "support")))
    return per.select("label", *names, "support").unionByName(overall.select(rows.alias("r")).select("r.*"))
