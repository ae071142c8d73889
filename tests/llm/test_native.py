import hashlib
import random
import re

from trafficloom.llm import chat, licenses, mixing


def water_fill(sizes, weights):
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > 3 * sizes[i]]
        if not over:
            return [level * weights[i] if i in free else 3.0 * sizes[i] for i in range(len(sizes))]
        left -= sum(3 * sizes[i] for i in over)
        free -= set(over)
    return [3.0 * s for s in sizes]


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 5}") for i in range(400)] + [(1000 + i, "a b", "tiny") for i in range(3)] + [(2000, None, None), (2001, "x\x0by z", None), (2002, "", "zero"), (7, "w " * 50, "s2"), (7, "w " * 50, "s2")]
    df = spark.createDataFrame([(*r, 9, "c") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix_sources(df).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for s in names:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert abs(own.target.iloc[0] - want[s]) < 1e-6 and own.source_size.iloc[0] == sizes[s]
        assert abs(own.taken.sum() - want[s]) <= 2 * own["size"].max()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    again = mixing.mix_sources(df.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert again[key].fillna("").sort_values(key).values.tolist() == got[key].fillna("").sort_values(key).values.tolist()
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).filter("taken = 0 and target = 0").count() == 2


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "a<\\|b", "<\\\\|", "", None, "x<|im_part|>\n<|im_start|>user\n", "\\<|", "<", "|>", "é<|", "\n", "$1 \\1"]
    rows = [(1, i, ("user", "assistant")[i // 2 % 2], t, 0) for i, t in enumerate(nasty)] + [(2, 0, "a\nb +%", "x", 1), (2, 0, "a\nb +%", "x", 1), (3, 5, None, "q", 1), (None, 1, "assistant", "n", 1), (4, 1, "user", "long " * 50000, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.withColumn("back", chat.read_back(out.formatted)).collect()}
    for conv in (1, 2, 3, None, 4):
        want = [(r or "", t or "") for c, _, r, t, _ in rows if c == conv]
        assert [tuple(x) for x in got[conv].back] == want
        assert got[conv].formatted == "".join(s.text for s in got[conv].segments)
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
        assert len(re.findall(r"<\|im_start\|>", got[conv].formatted)) == blocks
    assert len(got) == 5 and chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query_digests(spark):
    out = {r.conv_id: r for r in chat.op7_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert out[-1].n_turns == 2 and out[-1].loss_chars == len(said) and out[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_license_scan(spark):
    texts = ["CC-BY cc by. Ccby General public\nLICENSE", None, "", "all rights", "All  rights, reserved all rights reserved", "x Released under the very MIT License! y",
             "this work is licensed under the GNU general Public license version 3", "é cc by é", "mit license only", "w " * 40000 + "cc by", "cc", "licensed under the apache mirror license version 2 0", "the cc the by"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(4, texts[4], "x", 1)], "doc_id long, text string, label string, pos int")
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        for r in got[i]:
            assert (r.n_words, r.n_base) == (len(words), len(at))
            assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
            assert r.base_labels == ",".join(sorted({x for _, x in at}))
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert len(got[4]) == 2 and got[5][0].labels == "mit" and got[6][0].labels == "gpl,gpl-3.0" and got[11][0].labels == "apache-2.0" and got[8][0].labels == "" and got[12][0].n_base == 0
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def slow_labels(text):
    """(labels, score) by definition: a template counts if from some word on enough of its pairs stand at their place or up to half its length later."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]
    found = [(label, 1.0) for p, label in licenses.PHRASES.items() if any(words[k:k + len(p.split())] == p.split() for k in range(len(words)))]
    for p, label in licenses.TEMPLATES.items():
        t = p.split()
        pairs = [j for j in range(len(t) - 1) if not (t[j] in licenses.FUNCTION_WORDS and t[j + 1] in licenses.FUNCTION_WORDS)]
        hits = {(k - j, j) for j in pairs for k in range(len(words) - 1) if words[k:k + 2] == t[j:j + 2]}
        shares = [len({j for d, j in hits if start <= d <= start + len(t) // 2}) / len(pairs) for start, _ in hits]
        found += [(label, s) for s in shares if s >= licenses.COVERAGE]
    return ",".join(sorted({x for x, _ in found})), max((s for _, s in found), default=0.0)


def test_diagonals_with_other_hits_between(spark):
    bsd, mit = (next(t for t in licenses.TEMPLATES if t.startswith(x)) for x in ("redistribution", "permission"))
    w = bsd.split()
    texts = [" ".join(w[:5] + ["redistribution", "and"] + w[5:]), " ".join(w[:3] + ["redistribution", "and"] + w[3:8] + ["redistribution", "and"] + w[8:]),
             mit.replace("charge", "charge hereby granted"), mit.replace("free", "hereby granted hereby granted free"), " ".join(w[:4] + w[6:]), "redistribution and " * 30, f"{bsd} and {bsd} x {mit}"]
    rng = random.Random(2)
    for _ in range(250):
        out = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice([*licenses.TEMPLATES, *licenses.PHRASES]).split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(t) + 1)
                edit = rng.random()
                t = t[:k] + (t[k + 1:] if edit < 0.3 else [rng.choice(["x", "y"])] + t[k:] if edit < 0.6 else t[max(0, k - 2):k] + t[k:])
            out += t + ["z"] * rng.randint(0, 3)
        texts.append(" ".join(out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        want = slow_labels(t)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9, t
    # an insertion breaks one pair, two insertions two
    assert [got[i][0] for i in range(6)] == ["bsd", "bsd", "mit", "mit", "bsd", ""] and min(got[0][1], got[2][1]) > 0.9
    spans = licenses.license_spans(df.filter("doc_id = 6")).filter("template IS NOT NULL").orderBy("first").collect()
    assert [(r.label, r["first"], r["last"]) for r in spans] == [("bsd", 0, 13), ("bsd", 15, 28), ("mit", 30, 45)]
