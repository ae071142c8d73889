"""Licence scans by diagonal voting, with DataFrame operations only.

All rolling word pairs of all texts are joined, by hash and then by the words
themselves, to the positions of the same pairs in the templates. A hit votes for
the diagonal (word position minus template position) of its template. Votes
are counted per diagonal. A diagonal is merged with its neighbours up to STRETCH times the template's
length further on, which bridges inserted or dropped words however many other diagonals lie
between; a merged band counts if enough of the template's pairs voted within it, and of bands that overlap
the best is the span.

The templates are the constants of this module, some 150 rows, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wordings of licences, matched with a few words changed.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the creative commons attribution 4 0 international license": "cc-by",
    "subject to the terms of the mozilla public license version 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "no part of this publication may be reproduced without permission of the publisher": "reserved",
}
# Pairs made of these alone are in any prose and don't vote.
FUNCTION_WORDS = "a and any are by for in into is may no of or out the this to under with".split()
COVERAGE, STRETCH, SLACK = 0.6, 1.5, 1.03


def _template_rows() -> list[tuple[str, str, bool, int, int, int, str]]:
    """template, label, exact, words, number of voting pairs, position, pair."""
    out = []
    for exact, table in ((True, PHRASES), (False, TEMPLATES)):
        for text, label in table.items():
            words = text.split()
            pairs = [(k, f"{a} {b}") for k, (a, b) in enumerate(zip(words, words[1:])) if exact or not (a in FUNCTION_WORDS and b in FUNCTION_WORDS)]
            out += [(text, label, exact, len(words), len(pairs), k, p) for k, p in pairs]
    return out


def _values() -> str:
    return ", ".join(f"('{t}', '{label}', {str(exact).lower()}, {n}, {g}, {k}, '{p}')" for t, label, exact, n, g, k, p in _template_rows())


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: uid, doc_id, n_words, template, label, exact, first, last (words), coverage.

    uid is monotonically_increasing_id() of docs; a row without any span comes
    back once, with a null template. Null and empty texts have no words; repeated
    rows each have their uid; other columns are ignored.
    """
    templates = docs.sparkSession.sql(f"SELECT *, xxhash64(tpair) AS thash FROM VALUES {_values()} AS t(template, label, exact, size, pairs, tpos, tpair)")
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.filter(F.split(low, BREAK), lambda w: w != "").alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = words.select("uid", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "pair")).withColumn("hash", F.xxhash64("pair"))
    hits = grams.join(F.broadcast(templates), (F.col("hash") == F.col("thash")) & (F.col("pair") == F.col("tpair")), "left")
    hits = hits.filter("pos IS NULL OR pos = 0 OR template IS NOT NULL")
    # one row more per document, without a template, keeps those that have no hit
    hits = hits.select("uid", "doc_id", "n_words", "template", "label", "exact", "size", "pairs", "tpos", F.col("pos").cast("long").alias("pos"), (F.col("pos").cast("long") - F.col("tpos")).alias("diagonal"))
    keys = ["uid", "doc_id", "n_words", "template", "label", "exact", "size", "pairs"]
    votes = hits.repartition("uid").groupBy(*keys, "diagonal").agg(F.count("tpos").alias("votes"), F.expr("bit_or(shiftleft(1L, tpos))").alias("mask"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    # diagonals in units of a template's width, so one frame fits all; diagonals are whole numbers and widths below 16, so SLACK only takes up rounding
    votes = votes.withColumn("at", F.col("diagonal") / F.floor((STRETCH - 1) * F.col("size")))
    order = "PARTITION BY uid, template ORDER BY at RANGE BETWEEN"
    band = f"OVER ({order} CURRENT ROW AND {SLACK}D FOLLOWING)"
    merged = votes.select(*keys, "diagonal", "at", "votes", F.expr(f"bit_count(bit_or(mask) {band})").alias("covered"), F.expr(f"min(low) {band}").alias("low"), F.expr(f"max(high) {band} + 1").alias("high"))
    good = F.coalesce(F.when(F.col("exact"), F.col("votes") == F.col("pairs")).otherwise(F.col("covered") >= COVERAGE * F.col("pairs")), F.lit(False))
    rank = F.when(good, F.struct("covered", (F.col("low") - F.col("high")).alias("short"), (-F.col("diagonal")).alias("early")))
    best = merged.withColumn("rank", rank).withColumn("top", F.expr(f"max(rank) OVER ({order} {SLACK}D PRECEDING AND {SLACK}D FOLLOWING)"))
    keep = best.withColumn("good", F.col("rank").isNotNull() & (F.col("exact") | (F.col("rank") == F.col("top"))))

    def of_good(value):
        return F.when(F.col("good"), value)

    spans = keep.select("uid", "doc_id", "n_words", *(of_good(F.col(c)).alias(c) for c in ("template", "label", "exact")), of_good(F.when(F.col("exact"), F.col("diagonal")).otherwise(F.col("low"))).alias("first"),
                        of_good(F.when(F.col("exact"), F.col("diagonal") + F.col("size") - 1).otherwise(F.col("high"))).alias("last"), of_good(F.when(F.col("exact"), F.lit(1.0)).otherwise(F.col("covered") / F.col("pairs"))).alias("coverage"))
    return spans.distinct()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: uid, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("exact")

    def joined(label):
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    found = license_spans(docs, id_col, text_col).groupBy("uid", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"))
    return found


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and labels for the whole of documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("uid")


def _texts(table: dict[str, str]) -> str:
    return ", ".join(f"({text.split()}, '{text}', '{label}')" for text, label in table.items())


#: From the definitions: phrases are looked up at every word; a template counts if, for some word d, enough of its voting pairs stand at their place after d or up to half its length further on.
OP4_SQL = rf"""
WITH phrases(p, template, label) AS (VALUES {_texts(PHRASES)}), wordings(p, template, label) AS (VALUES {_texts(TEMPLATES)}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
words AS (SELECT row, w, unnest(range(len(w))) AS i FROM d),
base AS (SELECT row, i, label FROM words JOIN phrases ON w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
places AS (SELECT p, template, label, unnest(range(len(p) - 1)) AS j FROM wordings),
voting AS (SELECT template, label, len(p) // 2 AS reach, j, p[j + 1] AS a, p[j + 2] AS b FROM places WHERE NOT (list_contains({FUNCTION_WORDS}, p[j + 1]) AND list_contains({FUNCTION_WORDS}, p[j + 2]))),
hits AS (SELECT row, template, label, reach, i, j FROM words JOIN voting ON w[i + 1] = a AND w[i + 2] = b),
found AS (SELECT x.row, x.template, x.label, x.i - x.j AS d, count(DISTINCT y.j) AS n FROM (SELECT DISTINCT ON (row, template, i - j) * FROM hits) x
  JOIN hits y ON x.row = y.row AND x.template = y.template AND (y.i - y.j) BETWEEN x.i - x.j AND x.i - x.j + x.reach GROUP BY ALL),
good AS (SELECT f.row, f.label, f.n / v.n AS share FROM found f JOIN (SELECT template, count(*) AS n FROM voting GROUP BY template) v USING (template) WHERE f.n >= {COVERAGE} * v.n),
every AS (SELECT row, label, 1.0::DOUBLE AS share FROM base UNION ALL SELECT * FROM good),
b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row),
e AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN e USING (row)
"""
