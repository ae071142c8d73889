import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trafficloom.llm import packing as P

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé'sdl 0\n\t\x0b\x1c ́İß<|endoftext|>ñ語\x00"), max_size=40), max_size=6))
def test_words_encode_like_whole_texts(texts):
    ids, bounds = P.WordEncoder(PATH).texts(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(t)[:-1] for t in texts]


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(P, "MEMORY_WORDS", 3)
    e = P.WordEncoder(PATH)
    for text in ("a b c", "c d e f", "a b", "", "g g g a"):
        assert e.texts(pa.array([text]))[0].tolist() == plain(text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4096), min_size=1, max_size=60))
def test_balance_keeps_capacity_and_items(sizes):
    sizes = np.array(sizes)
    found = P.balance(sizes, 4096)
    assert len(found) == len(sizes) and np.bincount(found, weights=sizes).max() <= 4096
    item, start, length, window = P.pack_sizes(sizes, 4096)
    assert np.bincount(window, weights=length).max() <= 4096
    for k, s in enumerate(sizes):
        own = sorted(zip(start[item == k], length[item == k]))
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) == s


def test_differencing_of_known_sets():
    sums = np.bincount(P.difference(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]
    assert np.ptp(np.bincount(P.difference(np.arange(1, 400), 8), weights=np.arange(1, 400))) <= 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4096), min_size=1, max_size=70), st.integers(1, 9))
def test_differencing_is_multiway_differencing(sizes, windows):
    """Against whole partial partitions, empty windows written out; equal imbalances may be merged in another order."""
    sizes = [s * 128 + k for k, s in enumerate(sizes)]
    parts = [[0] * (windows - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    found = P.difference(np.array(sizes), windows)
    sums = np.bincount(found, weights=sizes, minlength=windows)
    assert sum(sums) == sum(sizes) and len(found) == len(sizes)
    if windows > 1 and len({p for p in sizes}) == len(sizes) and len(sizes) <= 2 * windows:
        assert sorted(sums) == parts[0]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_chunks_hold_all_rows_in_order(monkeypatch, most):
    monkeypatch.setattr(P, "CHUNK_BYTES", most)
    texts = ["abc", None, "", "é" * 9, "x", "yy", "", "zzzz", None]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(a, a + 3)), "text": pa.array(texts[a:a + 3], pa.string())}) for a in (0, 3, 6)]
    found = [(i.to_pylist(), t.to_pylist()) for i, t in P._chunks(iter(batches))]
    assert [x for i, _ in found for x in i] == list(range(9)) and [x for _, t in found for x in t] == [t or "" for t in texts]
    assert all(len(t) == 1 or sum(len(x.encode()) for x in t) <= most for _, t in found) and (most < 1000 or len(found) == 1)
    assert not list(P._chunks(iter([])))


def test_pieces(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 50, n)) for n in [*rng.integers(0, 900, 60), 9000, 4096]] + [None, "", " \n", "é" * 3000]
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(5, texts[5], "again", 4), (None, "no id", "x", 0)]
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int").repartition(2)).toPandas()
    for i, t in enumerate(texts):
        own = got[got.doc_id == i].sort_values("start")
        want = plain(t or "")
        copies = 2 if i == 5 else 1
        assert sum(own.length) == copies * len(want) and set(own.doc_tokens) == {len(want)}
        if copies == 1:
            assert [x for ids in own.ids for x in ids] == want and own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist()
    assert [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in got.ids] == got.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.cumsum([0, *s.length])[:-1].tolist() and s.length.sum() <= 4096
    assert (got.doc_id.isna()).sum() == 1
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_little_padding(spark):
    got = P.op9_packing(spark, "/root/testdata/sf0.01").groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    pad = sum(0 if n & (n - 1) == 0 else 4096 - n for n in got)
    assert pad <= 0.03 * got.sum()
