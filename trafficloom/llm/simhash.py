"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints have 64 bits, cut into three blocks (22, 21 and 21 bits). Of two
fingerprints at distance 4 or less some two blocks together differ in at most
2 bits (the two best of three), so the comparison is made per pair of blocks
with a threshold of 2.

The anchors of a block are the words of the perfect binary Golay code of length
23 (covering radius 3, each block padded with zeros); those of a pair of blocks
are all pairs of such words. A fingerprint goes to the anchors that decode
the points of its ball of radius 1. For any two points at distance 2 the point
halfway lies in both balls, hence both meet at its anchor: that is the covering
radius plus the threshold, with the threshold shared between the two sides
rather than put on one (10 copies a pair on average instead of 61).

Each anchor's fingerprints are compared with each other, sorted by anchor and
streamed. The anchors that a sample shows to hold most are dealt as tiles of a grid before anything is
sorted, others with more than RUN_LIMIT fingerprints after. What leaves an anchor is a spanning forest, never all pairs. Groups
of equal fingerprints are collapsed before, and components are found with joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.shared import bounded_batches, materialize
from ..plans.skew import skewed_lookup

SHINGLE, SEED, BITS, THRESHOLD = 4, 42, 64, 4
#: (shift, width) of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
CODE_BITS, CODE_RADIUS, GENERATOR = 23, 3, 0b110001110101
#: Fingerprints of one anchor that are compared within one task at once.
RUN_LIMIT = 2048
SHORT_RUN = 48
#: Anchors that are dealt as tiles from the start, and the share of fingerprints (one of so many) that they are found in.
HOT_ANCHORS, SAMPLED = 200, 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles of a whole text (UTF-8); 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    starts, ends = at[:n].tolist(), (at[min(shingle, len(words)):][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[k:k + (1 << 16)], ends[k:k + (1 << 16)])), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter(map(fingerprint, b.column("text").cast(pa.binary()).to_pylist()), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(fp.view(np.int64))], names=["uid", "doc_id", "fp"])


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainder tables of the low 12 and high 11 bits, and the error pattern of each remainder."""
    rest = np.zeros(CODE_BITS, dtype=np.int64)
    for i in range(CODE_BITS):
        x = 1 << i
        for j in range(i, 10, -1):
            x ^= GENERATOR << (j - 11) if x >> j & 1 else 0
        rest[i] = x
    low, high = (np.bitwise_xor.reduce(np.where(np.arange(1 << n)[:, None] >> np.arange(n) & 1, r, 0), axis=1) for n, r in ((12, rest[:12]), (11, rest[12:])))
    errors = np.zeros(1 << 11, dtype=np.int64)
    bits = range(CODE_BITS)
    for e in [0, *(1 << i for i in bits), *(1 << i | 1 << j for i in bits for j in range(i)), *(1 << i | 1 << j | 1 << k for i in bits for j in range(i) for k in range(j))]:
        errors[low[e & 4095] ^ high[e >> 12]] = e
    return low, high, errors


def nearest_anchor(words: np.ndarray) -> np.ndarray:
    """The one Golay word within distance 3 of each 23-bit word."""
    low, high, errors = _code()
    return words ^ errors[low[words & 4095] ^ high[words >> 12]]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, fingerprint) for every anchor of every fingerprint (uint64)."""
    home, near = [], []
    rows = np.arange(len(fp))
    for shift, width in BLOCKS:
        part = (fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        home.append(nearest_anchor(part))
        around = np.sort(nearest_anchor(part[:, None] ^ (1 << np.arange(width))[None, :]), axis=1)
        new = around != home[-1][:, None]
        new[:, 1:] &= around[:, 1:] != around[:, :-1]
        who, which = np.nonzero(new)
        near.append((who, around[who, which]))
    keys, own = [], []
    for p, (i, j) in enumerate(PAIRS):
        for who, a, b in ((rows, home[i], home[j]), (near[i][0], near[i][1], home[j][near[i][0]]), (near[j][0], home[i][near[j][0]], near[j][1])):
            keys.append(p << 46 | a << 23 | b)
            own.append(fp[who])
    return np.concatenate(keys), np.concatenate(own)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def _to_anchors(hot: dict[int, int]):
    """(anchor, fingerprint) rows; those of hot anchors go to the tiles of a grid of so many parts instead, two parts a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = np.array(sorted(hot), dtype=np.int64), np.array([hot[k] for k in sorted(hot)], dtype=np.int64)
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 4096):
                key, own = anchors(fp[k:k + 4096])
                at = np.searchsorted(names, key).clip(max=max(len(names) - 1, 0))
                warm = names[at] == key if len(names) else np.zeros(len(key), dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[~warm]), pa.array(own[~warm].view(np.int64))], names=["key", "fp"])
                for place in np.unique(at[warm]):
                    mine, n = own[warm & (at == place)], int(parts[place])
                    part = (_mixed(mine) % np.uint64(n)).astype(np.int64)
                    for other in range(n):
                        tile = np.minimum(part, other) * n + np.maximum(part, other)
                        tile = _mixed(_mixed(tile.view(np.uint64)) ^ np.uint64(names[place])).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(mine.view(np.int64))], names=["key", "fp"])

    return run


def hot_anchors(fps: DataFrame) -> dict[int, int]:
    """The anchors that hold most fingerprints, as found in one of SAMPLED of them, and how many parts each is dealt in.

    At most HOT_ANCHORS, whatever the table; any choice gives the same links.
    """
    some = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).select("fp")
    counts = some.mapInArrow(_to_anchors({}), "key long, fp long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    most = counts.filter(F.col("n") * SAMPLED >= 4 * RUN_LIMIT).orderBy(F.col("n").desc(), "key").limit(HOT_ANCHORS).collect()
    return {r.key: -(-r.n * SAMPLED // (RUN_LIMIT // 2)) for r in most}


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable through the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        for x in (i, j):
            np.minimum.at(root, x, low)
            np.minimum.at(root, before[x], low)
        root = root[root]
        if (root == before).all():
            return root


def _links(key: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints of equal keys (sorted)."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[first, len(key)])
    found_i, found_j = [], []
    short = np.repeat((length > 1) & (length <= SHORT_RUN), length)
    at, k, f = np.flatnonzero(short), key[short], fp[short]
    for d in range(1, int(length[(length > 1) & (length <= SHORT_RUN)].max(initial=1))):
        hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= threshold))
        found_i.append(at[hit])
        found_j.append(at[hit + d])
    for r in np.flatnonzero(length > SHORT_RUN):
        a, n = first[r], length[r]
        run, root = fp[a:a + n], np.arange(n)
        for s in range(0, n, 256):
            x, y = np.nonzero(np.bitwise_count(run[s:s + 256, None] ^ run[None, s:]) <= threshold)
            root = _roots(n, np.r_[x + s, np.arange(n)], np.r_[y + s, root])
        found_i.append(np.arange(a, a + n))
        found_j.append(a + root)
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found_i, found_j))
    if not len(i):
        return fp[:0], fp[:0]
    used = np.unique(np.r_[i, j])
    root = _roots(len(used), np.searchsorted(used, i), np.searchsorted(used, j))
    moved = root != np.arange(len(used))
    return fp[used[moved]], fp[used[root[moved]]]


def _compare(threshold: int, limit: int | None):
    """Streams rows sorted by key; rows of keys over limit come back as kind 1 (key, fp), links as kind 0."""

    def batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, passed = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), None
        for b in batches:
            k, f = b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if passed is not None and len(k):
                n = int(np.searchsorted(k, passed, "right"))
                if n:
                    yield batch(1, k[:n], f[:n])
                passed, k, f = (passed if n == len(k) else None), k[n:], f[n:]
            if not len(k):
                continue
            key, fp = np.r_[key, k], np.r_[fp, f]
            cut = int(np.searchsorted(key, key[-1]))
            if limit and cut:
                size = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:cut] != key[:cut - 1]]), cut])
                large = np.repeat(size > limit, size)
                if large.any():
                    yield batch(1, key[:cut][large], fp[:cut][large])
                yield batch(0, *_links(key[:cut][~large], fp[:cut][~large], threshold)) if not large.all() else batch(0, fp[:0], fp[:0])
            elif cut:
                yield batch(0, *_links(key[:cut], fp[:cut], threshold))
            key, fp = key[cut:], fp[cut:]
            if limit and len(key) > limit:
                yield batch(1, key, fp)
                passed, key, fp = key[-1], key[:0], fp[:0]
        if len(key):
            yield batch(0, *_links(key, fp, threshold))

    return run


def _sorted_runs(rows: DataFrame, compare) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "kind int, a long, b long")


def near_links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (column fp) that differ in threshold bits or fewer.

    A spanning forest of each anchor's links: components are those of all links.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover thresholds up to {THRESHOLD}")
    first = materialize(_sorted_runs(fps.select("fp").mapInArrow(_to_anchors(hot_anchors(fps)), "key long, fp long"), _compare(threshold, RUN_LIMIT)), "anchors")
    hot = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    sizes = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (RUN_LIMIT // 2)).cast("int").alias("n"))
    part = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    tiles = hot.join(sizes, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tiles = tiles.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "fp")
    links = first.filter("kind = 0").unionByName(_sorted_runs(tiles, _compare(threshold, None)).select("kind", "a", "b"))
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, uid_col: str | None = None) -> DataFrame:
    """One row per row of docs: uid, doc_id, fp (long), component_id, representative.

    uid is uid_col, which must be unique, or else monotonically_increasing_id() of docs. component_id is the smallest
    doc_id of the rows that can be reached; representative marks one row of each
    component (smallest doc_id, then uid). Null and empty texts have fingerprint
    0 and are linked like any other; repeated rows each get their row; null ids
    come last when the smallest is taken; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(rows.mapInArrow(_fingerprints, f"uid {rows.schema['uid'].dataType.simpleString()}, doc_id long, fp long"), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    fps = materialize(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    component = materialize(connected_components(near_links(fps, threshold)), "components")
    by_fp = fps.join(component, fps.fp == component.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    firsts = by_fp.groupBy("component").agg(F.min("first").alias("best"))
    lookup = by_fp.join(firsts, "component").select("fp", "n", "best")
    return skewed_lookup(rows, lookup, "fp", "n").select("uid", "doc_id", "fp", F.col("best.doc_id").alias("component_id"), (F.col("uid") == F.col("best.uid")).alias("representative"))


def op2_simhash_groups(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for the whole of documents."""
    found = near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
