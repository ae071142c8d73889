import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from trafficloom.llm import pii, toxicity

from test_simhash import slow_fingerprint

SHORT = [("Fresh bread and butter for the whole village today", "en", "web")] * 2
ODD = [(9001, None, "en", "web", None), (9002, "", "en", None, 0), (None, "no id at all in this row of words", "en", "news", 36), (9004, "mail me: ann@site.org or 10.0.0.7", None, None, 33),
       (9005, " ".join(f"word{k % 977}" for k in range(60_000)) + " call +1 (017) 555-7713", "en", "web", 1), (9006, "x" * 300_000, "en", "web", 1)]


def fixture_tables(spark, folder):
    """Documents of the smallest table, rows that repeat, and rows with nulls; two more columns."""
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in src.select(*C.COLUMNS).collect()]
    rows += rows[:5] + ODD + [(9100 + i, *t, len(t[0])) for i, t in enumerate(SHORT)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, uid string, component int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return rows


def slow_representatives(rows):
    fps = [slow_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, r in zip(group, rows):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


def slow_mix(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r[0] is None, r[0] or 0, r))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(x[0] for x in by_source[s]) for s in names}
    cut, level = set(), 0.0
    while len(cut) < len(names):
        level = (sum(size.values()) - 3 * sum(size[s] for s in cut)) / sum(weight[s] for s in names if s not in cut)
        new = {s for s in names if s not in cut and level * weight[s] > 3 * size[s]}
        if not new:
            break
        cut |= new
    out = []
    for s in names:
        target = 3 * size[s] if s in cut else level * weight[s]
        rate = target / size[s] if size[s] else 0.0
        at = int(hashlib.md5(f"={s}".encode() if s is not None else b"").hexdigest()[:3], 16) / 4096
        for n, x in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            out += [x[3]] * min(3, math.floor((n + 1) * rate + at) - math.floor(n * rate + at))
    return out


def in_order(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_stages_against_brute_force(spark, tmp_path):
    rows = fixture_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    expected = [r for r in rows if model.score(r[1]) < 0.7]
    steps = [expected]
    expected = slow_representatives(expected)
    steps.append(expected)
    votes = Counter((k, v) for r in expected for k, _, _, v in pii.candidates(r[1] or ""))
    weights = pii.train_classifier(sorted((k, v, n) for (k, v), n in votes.items()))
    expected = [(r[0], t := pii.redact(r[1], weights), r[2], r[3], None if t is None else len(t)) for r in expected]
    assert not any(pii.base_spans(r[1] or "") for r in expected)
    steps.append(expected)
    expected = slow_mix(expected)
    steps.append(expected)
    for (name, stage), want in zip(C.STAGES, steps):
        docs = C.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == C.COLUMNS
        assert in_order(docs.collect()) == in_order(want), name

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = C.run(spark, str(tmp_path)).collect()
    found = defaultdict(Counter)
    for p in pieces:
        found[p.doc_id][p.start, p.length, p.ids_crc32] += 1
    copies = Counter(r[0] for r in expected)
    assert found.keys() == copies.keys()
    for doc_id, text in {r[0]: r[1] for r in expected}.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert sum(n * length for (_, length, _), n in found[doc_id].items()) == copies[doc_id] * len(ids)
        assert all(crc == zlib.crc32(ids[a:a + n].tobytes()) for a, n, crc in found[doc_id])
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for w in windows.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(w), sorted(w)[1:])) and min(w)[0] == 0 and sum(n for _, n in w) <= 4096


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    from trafficloom.plans import shared

    fixture_tables(spark, tmp_path)
    before = set(shared._made)
    out = C.run(spark, str(tmp_path))
    assert set(shared._made) - before == {out._shared_path} and out.count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
