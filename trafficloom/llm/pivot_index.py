"""Exact top-k search by inner product over a pivot-distance index.

Pivots are chosen on a bounded sample. Every vector is keyed by its nearest pivot
and its distance r from it; a pivot's vectors, sorted by r, form annuli (see vectors). For
a query at distance d from the pivot the triangle inequality gives
``|q - v| >= |d - r|`` and so ``q.v <= (|q|^2 + |v|^2 - |d - r|^2) / 2``. A query
visits the annuli of its best pivots first, which bounds its k-th best score from below; then
every annulus whose bound reaches that. Within one it expands rings of ANNULUS_ROWS rows in order of
``|d - r|`` and stops at the first that cannot reach the k-th best any more.
Equal scores count as reaching, so ties are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

ANNULUS_ROWS, BLOCK = 512, 1024


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products; of whole numbers by integers where doubles might round on the way and a long holds the result."""
    most = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * q.shape[1]
    if 2**52 <= most < 2**63 and (q == np.floor(q)).all() and (x == np.floor(x)).all():
        return (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.float64)
    return q @ x.T


def _rings(pivots: np.ndarray):
    def prepare(index: pa.Table) -> tuple:
        r, vid = index.column("r").to_numpy(), index.column("id").to_numpy()
        order = np.lexsort((vid, r))
        r, vid, x = r[order], vid[order], V.matrix(index.column("v"), pivots.shape[1])[order]
        first = np.arange(0, len(r), ANNULUS_ROWS)
        last = np.r_[first[1:], len(r)]
        norm2 = (x * x).sum(1).max()
        for a, z in zip(first, last):  # by id within a ring, for ties
            by_id = a + np.argsort(vid[a:z], kind="stable")
            vid[a:z], x[a:z] = vid[by_id], x[by_id]
        return pivots[index.column("group")[0].as_py()], vid, x, norm2, first, last, r[first], r[last - 1]

    return prepare


def _expand(dim: int, k: int):
    def search(ready: tuple, queries: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pivot, vid, x, norm2, first, last, low, high = ready
        q, qid, reach = V.matrix(queries.column("v"), dim), queries.column("id").to_numpy(), queries.column("reach").to_numpy(zero_copy_only=False)
        q2, d = (q * q).sum(1)[:, None], V.distances(q, pivot[None, :])
        gap = np.maximum(np.maximum(low - d, d - high), 0)
        bound = (q2 + norm2 - gap * gap) / 2 + V.SLACK * (1 + q2 + norm2 + gap * gap)
        tour = np.argsort(gap, axis=1, kind="stable")
        score, ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), dtype=np.int64)
        going = np.ones(len(q), dtype=bool)
        for step in range(len(first)):
            at = tour[:, step]
            going &= bound[np.arange(len(q)), at] >= np.maximum(reach, score[:, -1])
            if not going.any():
                break
            for a in np.unique(at[going]):
                who = np.flatnonzero(going & (at == a))
                part = slice(first[a], last[a])
                s = products(q[who], x[part])
                s[vid[part][None, :] == qid[who][:, None]] = -np.inf
                score[who], ids[who] = V.merge_best(score[who], ids[who], *V.top_of_block(s, vid[part], k), k)
        row, col = np.nonzero((score > -np.inf) & (score >= reach[:, None]))
        return qid[row], ids[row, col], score[row, col]

    return search


def exact_top_k(table: DataFrame, queries: DataFrame | Column | str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double): the k highest inner products of each query with rows of other ids.

    queries: a table of ids and vectors, or a condition on vec_id that picks them from table. See
    valid_vectors for rows that take no part, repeated ids and lengths that differ. Ties go to the smaller id.
    Fewer rows than k give fewer ranks; empty tables none; other columns are ignored. Scores of
    2^53 or more are rounded to doubles; the ranks are those of the rounded scores.
    """
    dim = max(1, V.taking_part(table, id_col, vector_col).agg(F.max(F.size("v"))).first()[0] or 1)
    sample = V.sample_matrix(table, id_col, vector_col, dim)
    if not len(sample):
        return table.sparkSession.sql("SELECT 0L AS query_id, 0 AS rank, 0L AS vec_id, 0D AS score WHERE false")
    pivots = V.choose_centres(sample)
    written, index, cells = V.build_index(V.valid_vectors(table, id_col, vector_col), pivots)
    asked = V.valid_vectors(queries, id_col, vector_col) if isinstance(queries, DataFrame) else written.filter(queries)
    return V.two_rounds(index, cells, asked.select(F.col("vec_id").alias("query_id"), "v"), k, _rings(pivots), _expand(dim, k), BLOCK)


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector of embeddings with all others; scores beyond a long stay at its end."""
    kept = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = kept.filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("e", lambda x: F.floor(x * 256).cast("double")).alias("embedding"))
    out = exact_top_k(whole, "vec_id % 50 = 0", 5)
    most = F.lit(float(2**63 - 1024))  # the largest double below a long's end
    return out.select("query_id", "rank", "vec_id", F.greatest(F.least("score", most), -most).cast("long").alias("score"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
