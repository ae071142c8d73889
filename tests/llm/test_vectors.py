import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficloom.llm import bit_codes, pivot_index, vectors


def table(spark, n=700, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 40, (n, dim)))
    x[100:300] = x[100]
    rows = [(i, v.tolist(), "clash", 1) for i, v in enumerate(x)]
    odd = [(2000, None, "", 0), (2050, [1.0] * 15 + [None], "", 0), (2100, [float("nan")] * dim, "", 0), (2150, [float("inf")] * dim, "", 0), (None, [1.0] * dim, "", 0), (2200, [0.0] * dim, "", 0), (2250, [], "", 0), (50, x[50].tolist(), "", 9)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, group string, rank int"), x


def brute(x, ids, queries, k):
    out = []
    for q in queries:
        s = {i: float(np.dot(v, x[q])) for i, v in ids.items() if i != q}
        out += [(q, r + 1, i, s[i]) for r, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:k])]
    return out


@pytest.mark.parametrize("cell", [8192, 64])
def test_exact(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 5)
    monkeypatch.setattr(vectors, "CENTRES", 6)
    monkeypatch.setattr(pivot_index, "ANNULUS_ROWS", 32)
    df, x = table(spark)
    ids = dict(enumerate(x)) | {2200: np.zeros(16)}
    got = pivot_index.exact_top_k(df, df.filter("vec_id % 50 = 0"), 5)
    rows = [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.orderBy("query_id", "rank").collect()]
    assert rows == brute({**ids}, ids, [*range(0, 700, 50), 2200], 5)


@pytest.mark.parametrize("cell", [8192, 50])
def test_an_index_row_moves_once_a_round(spark, monkeypatch, cell):
    """Rows that the tasks read: at most the index and the visits, however many blocks of queries there are."""
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    df, x = table(spark)
    pivots = vectors.choose_centres(x, 6)
    _, index, cells = vectors.build_index(vectors.valid_vectors(df, "vec_id", "embedding"), pivots)
    assert cells.rows.sum() == 701 and (cells.parts.max() == 1) == (cell == 8192)
    asked = vectors.valid_vectors(df, "vec_id", "embedding").select(F.col("vec_id").alias("query_id"), "v", F.lit(float("-inf")).alias("reach"))
    read, met = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def prepare(rows):
        read.add(rows.num_rows)

        return rows

    def search(rows, queries):
        met.add(rows.num_rows * queries.num_rows)
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    for first in (True, False):
        vectors.visit(index, cells, asked, 5, first, prepare, search, 64).count()
    assert read.value <= 2 * 701 and met.value == 701 * 701


def test_bounds_hold(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    df, x = table(spark)
    _, index, cells = vectors.build_index(vectors.valid_vectors(df, "vec_id", "embedding"), vectors.choose_centres(x, 6))
    bound, _ = cells.bounds(x)
    place = {(int(g), int(a)): i for i, (g, a) in enumerate(zip(cells.group, cells.annulus))}
    assert len(place) > 6
    for r in index.collect():
        assert (x @ np.array(r.v) <= bound[:, place[r.group, r.annulus]]).all()


def test_counts_of_packed_bits_estimate_inner_products():
    rng = np.random.default_rng(9)
    for dim in (3, 64, 100):
        x, q, centre, turn = rng.normal(size=(900, dim)), rng.normal(size=(20, dim)), rng.normal(size=dim) / 3, bit_codes.rotation(dim)
        x[5] = centre
        words, fit = bit_codes.encode(x, centre, turn)
        assert words.shape == (900, -(-dim // 64))
        far = np.sqrt(((x - centre) ** 2).sum(1))
        about, error = bit_codes.Codes(words, far, fit, centre, turn).estimate(q)
        spin, signs = q @ turn, np.where((x - centre) @ turn > 0, 1, -1)
        low, step = spin.min(1, keepdims=True), np.ptp(spin, axis=1)[:, None] / 15
        plain = (q @ centre)[:, None] + (low + step * np.rint((spin - low) / step)) @ signs.T * (far / (np.where(fit > 0, fit, 1) * np.sqrt(dim)))
        assert np.abs(about - plain).max() < 1e-4
        assert (np.abs(about - q @ x.T) <= error).mean() > 0.93


def test_very_large_components(spark):
    df = spark.createDataFrame([(0, [3e30, 1.0]), (50, [2.0**31, 2.0**30 + 1]), (51, [2.0**31, 2.0**30]), (100, [1.0, 2.0]), (7, [-3e30, 0.0])], "vec_id long, embedding array<double>")
    got = pivot_index.exact_top_k(df, "vec_id % 50 = 0", 5).collect()
    assert len(got) == 12 and [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 50] == [0, 51, 100, 7]


def test_exact_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in pivot_index.exact_top_k(df, df, 5).orderBy("query_id").collect()] == [(0, 1, 3.0), (1, 0, 3.0)]
    assert pivot_index.exact_top_k(df.limit(0), df.limit(0)).count() == 0
    assert bit_codes.approximate_top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [8192, 200])
def test_recall_and_scores(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(vectors, "CENTRES", 5)
    df, x = table(spark, dim=32)
    got = bit_codes.approximate_top_k(df, df.filter("vec_id % 20 = 0"), 20).collect()
    ids = dict(enumerate(x))
    want = brute(ids, ids, range(0, 700, 20), 20)
    score = {(q, i): s for q, _, i, s in want}
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(got) == len(want) and sum(k in score for k in found) >= 0.9 * len(score)
    assert all(abs(found[k] - score[k]) < 1e-6 for k in found if k in score)
    assert all(r.query_id != r.vec_id for r in got)


def test_equal_vectors_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(bit_codes, "BLOCK_ROWS", 64)
    same = np.random.default_rng(5).standard_normal(16)
    df = spark.createDataFrame([(i, (same * (2 if i >= 280 else 1)).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    got = bit_codes.approximate_top_k(df, df.filter("vec_id % 100 = 0"), 25).collect()
    for q in (0, 100, 200):
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [*range(280, 300), *[i for i in range(6) if i != q][:5]]


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    ids = dict(zip(rows.vec_id.tolist(), x))
    want = {(q, i) for q, _, i, _ in brute(ids, ids, [i for i in ids if i % 20 == 0], 20)}
    got = {(r.query_id, r.vec_id) for r in bit_codes.op8_bit_code_search(spark, d).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)
