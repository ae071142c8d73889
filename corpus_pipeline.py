"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal
data is masked, sources are mixed to their weights, and the rest is packed into windows.

Every stage takes documents and gives documents (the last one pieces of them). All of them ignore
columns beyond COLUMNS, whatever their names, and give an empty table for an empty one; null texts
count as empty and stay null; a null doc_id, lang or source is a value like any other; texts are read whole,
however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficloom.llm import mixing, packing, pii, simhash, toxicity
from trafficloom.plans.shared import materialize, numbered, release, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold (a score equal to it is toxic).

    Each row is judged by its text alone: null and empty texts score 0 and stay, repeated rows
    stay or go together. Without labels of both classes nothing goes.
    """
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, COLUMNS).filter(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: the one of the smallest doc_id, null last.

    Of rows that tie on doc_id, repeated rows among them, the first by file and place stays. Null and
    empty texts have fingerprint zero and form one group, with whatever lies near it.
    """
    docs = numbered(docs, COLUMNS)
    kept = simhash.near_duplicate_groups(docs, uid_col="__uid").filter("representative").select(F.col("uid").alias("__uid"))
    return docs.join(kept, "__uid", "left_semi").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal spans replaced by their kind and n_chars counted anew (null for a null text).

    Texts are read twice, once to learn from all votes and once to mask. Of spans that overlap the first, then the longest, names
    the place; repeated rows are masked alike; texts without personal data stay as they are.
    """
    weights = pii.learn(materialize(pii.find_candidates(docs), "spans"))
    return pii.redact_documents(docs.select(*COLUMNS), weights).withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times.

    Repeated rows are sampled each for itself; rows of a source go by size, then doc_id (null last), then place, so
    there are no ties. Null and empty texts have size 0 and are taken at their source's rate; a null source is one of its own.
    """
    docs = numbered(docs, COLUMNS)
    copies = mixing.mix_sources(docs, uid_col="__uid").filter("copies > 0").select(F.col("uid").alias("__uid"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return docs.join(copies, "__uid").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens.

    A null or empty text is its end token alone; repeated rows are packed each for itself; a document longer
    than a window is cut.
    """
    return packing.pack_documents(docs, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", mask_personal_data), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again; what a stage wrote on its way is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary(spark) as kept:
            made = materialize(stage(spark, docs, sf_dir), name)
            kept.append(made)
        release(docs)
        docs = made
    return docs
