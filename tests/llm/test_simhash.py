import random

import numpy as np
import pytest
import xxhash

from trafficloom.llm import simhash as S


def slow_fingerprint(text):
    words, word = [], b""
    for c in (text or "").encode():
        if c == 32 or 9 <= c <= 13:
            words, word = (words + [word] if word else words), b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    words += [word] if word else []
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, threshold=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", best[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "A b\x0bC", "a b c d", "É é a B c  d e", "x " * 5000, "a b c d a b c d a b c d"])
def test_fingerprint(text):
    assert S.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_every_word_has_its_anchor_and_near_pairs_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 5000)
    assert np.bitwise_count(words ^ S.nearest_anchor(words)).max() <= 3
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for flips in range(5):
        b = a.copy()
        for _ in range(flips):
            b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
        at = [dict.fromkeys(zip(*map(np.ndarray.tolist, S.anchors(x[i:i + 1])))) for x in (a, b) for i in range(300)]
        assert all({k for k, _ in at[i]} & {k for k, _ in at[i + 300]} for i in range(300))


@pytest.mark.parametrize("limit", [2048, 20])
def test_groups_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "RUN_LIMIT", limit)
    monkeypatch.setattr(S, "SHORT_RUN", 6)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    for i in range(150, 420):
        base = rows[rng.choice([0, 0, 0, rng.randrange(150)])][1].split()
        for _ in range(rng.randint(0, 2)):
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    rows += [(1000, None), (1001, ""), (1002, "\n"), (5, rows[5][1])]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, fp string, uid int, component string")
    out = S.near_duplicate_groups(df)
    got = sorted((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out.collect())
    assert got == slow_groups(rows)
    kept = out.filter("representative").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in got})


@pytest.mark.parametrize("sampled", [1, 64])
def test_hot_anchors(spark, monkeypatch, sampled):
    """Many fingerprints around one: their anchors are dealt as tiles, and the links join what brute force joins."""
    monkeypatch.setattr(S, "RUN_LIMIT", 20)
    monkeypatch.setattr(S, "SAMPLED", sampled)
    rng = random.Random(7)
    base = rng.getrandbits(64)
    known = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(500)} | {rng.getrandbits(64) for _ in range(300)})
    fps = spark.createDataFrame([(f - (1 << 64) * (f >> 63),) for f in known], "fp long")
    assert S.hot_anchors(fps) or sampled > 1
    links = {tuple(x & (2**64 - 1) for x in r) for r in S.near_links(fps).collect()}

    def components(pairs):
        root = {f: f for f in known}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {f: find(f) for f in known}

    assert components(links) == components((a, b) for i, a in enumerate(known) for b in known[:i] if (a ^ b).bit_count() <= 4)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicate_groups(df).count() == 0
