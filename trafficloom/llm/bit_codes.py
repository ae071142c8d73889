"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is taken relative to its nearest centre, normalised, rotated at random and kept as the signs of
its coordinates (packed bits) with two correction scalars: its distance from the
centre and the inner product ``a`` of its unit vector with its code. A query is rotated too and quantised to
PLANES bits a coordinate, so that its inner product with a code is a sum of bit counts of packed words. With
code o' and query q, ``<o', q> / a`` estimates ``<o, q>`` with an error below
``EPSILON * |q| sqrt((1 - a^2) / (a^2 (dim - 1)))``, and the rounding of q, but for few rows. A query reranks, by
the original vectors, first the rows of a cell with the best estimates, then those
whose upper bound reaches the k-th best exact score so far, in this cell or a first one. Cells that
cannot reach it are not visited (see vectors).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

EPSILON, SEED, PLANES = 2.2, 20, 4
#: So many times k rows of a cell are reranked first; their k-th best score is the bar for the others' upper bounds.
FIRST = 4
#: Queries that are estimated at once, and products that are made at once.
BLOCK, BLOCK_ROWS = 64, 50_000


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    whole = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 64), dtype=bool)
    whole[..., :bits.shape[-1]] = bits
    return np.packbits(whole, axis=-1, bitorder="little").view("<u8")


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits, and the inner product of unit vector and code; centre: one, or one a row."""
    o = x - centre
    far = np.sqrt((o * o).sum(1))
    o = (o / np.where(far > 0, far, 1)[:, None]) @ turn
    return packed(o > 0), np.abs(o).sum(1) / np.sqrt(x.shape[1])


class Codes:
    """The codes of a cell, with everything that does not depend on a query made once."""

    def __init__(self, words: np.ndarray, far: np.ndarray, fit: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.words, self.far, self.centre, self.turn, self.dim = words, far, centre, turn, len(centre)
        safe = np.where(fit > 0, fit, 1)
        self.ones = np.bitwise_count(words).sum(axis=1, dtype=np.int32).astype(np.float32)
        self.scale = (far / (safe * np.sqrt(self.dim))).astype(np.float32)
        # in units of |q|, and of the root mean square that rounding took from q
        self.error = (EPSILON * far * np.sqrt(np.maximum(1 - safe * safe, 0) / max(self.dim - 1, 1)) / safe + 1e-5 * (1 + far)).astype(np.float32)
        self.round = (EPSILON * far / safe).astype(np.float32)

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries with the cell's rows, and their error bounds."""
        spin = q @ self.turn
        low = spin.min(axis=1, keepdims=True)
        step = (spin.max(axis=1, keepdims=True) - low) / (2**PLANES - 1)
        step = np.where(step > 0, step, 1)
        level = np.rint((spin - low) / step).astype(np.int64)
        met = np.zeros((len(q), len(self.words)), dtype=np.uint32 if self.dim > 4000 else np.uint16)
        for j in range(PLANES - 1, -1, -1):
            plane = packed((level >> j & 1).astype(bool))
            met <<= 1
            for w in range(self.words.shape[1]):
                met += np.bitwise_count(plane[:, w, None] & self.words[None, :, w])
        rounded = low + step * level
        lost = np.sqrt(((spin - rounded) ** 2).mean(axis=1, keepdims=True))
        # a code is 2 bit - 1, so its product is twice the sum over ones, less the sum over all
        about = met * (2 * step).astype(np.float32)
        about += (2 * low).astype(np.float32) * self.ones - rounded.sum(axis=1, keepdims=True).astype(np.float32)
        about *= self.scale
        about += (q @ self.centre)[:, None].astype(np.float32)
        size = np.sqrt((q * q).sum(1))[:, None].astype(np.float32)
        return about, size * self.error + lost.astype(np.float32) * self.round


def _first_exact(q: np.ndarray, x: np.ndarray, about: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best exact score among the rows with the best estimates, less what rounding may take; -inf if rows are too few."""
    n = min(FIRST * k, x.shape[0])
    if n < k:
        return np.full(len(q), -np.inf)
    cand = np.argpartition(about, x.shape[0] - n, axis=1)[:, x.shape[0] - n:]
    score = np.einsum("ij,ikj->ik", q, x[cand])
    score[np.take_along_axis(about, cand, 1) == -np.inf] = -np.inf
    kth = np.partition(score, n - k, axis=1)[:, n - k]
    return kth - 1e-9 * np.where(np.isfinite(kth), 1 + np.abs(kth), 0)


def _prepare(centres: np.ndarray, turn: np.ndarray):
    dim = len(turn)

    def prepare(index: pa.Table) -> tuple:
        vid, x = index.column("id").to_numpy(), V.matrix(index.column("v"), dim)
        words = np.frombuffer(b"".join(index.column("bits").to_pylist()), dtype="<u8").reshape(len(vid), -1)
        return vid, x, Codes(words, index.column("r").to_numpy(), index.column("fit").to_numpy(), centres[index.column("group")[0].as_py()], turn)

    return prepare


def _rerank(dim: int, k: int):
    def search(ready: tuple, queries: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vid, x, codes = ready
        q, qid, reach = V.matrix(queries.column("v"), dim), queries.column("id").to_numpy(), queries.column("reach").to_numpy(zero_copy_only=False)
        reach = reach - 1e-9 * np.where(np.isfinite(reach), 1 + np.abs(reach), 0)  # a sum may be rounded otherwise than in the first round
        about, error = codes.estimate(q)
        about[vid[None, :] == qid[:, None]] = -np.inf
        floor = np.maximum(reach, _first_exact(q, x, about, k))
        go = (about + error >= floor[:, None]) & (about > -np.inf)
        row, col = np.nonzero(go)
        blocks = range(0, len(row), BLOCK_ROWS)  # of equal vectors all may be left
        exact = np.concatenate([np.einsum("ij,ij->i", q[row[c:c + BLOCK_ROWS]], x[col[c:c + BLOCK_ROWS]]) for c in blocks] or [np.zeros(0)])
        near = exact >= floor[row]
        row, col, exact = row[near], col[near], exact[near]
        order = np.lexsort((vid[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        good = np.arange(len(row)) - np.searchsorted(row, row) < k
        return qid[row[good]], vid[col[good]], exact[good]

    return search


def approximate_top_k(table: DataFrame, queries: DataFrame | Column | str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (exact inner product): the k nearest found of each query among rows of other ids.

    queries: a table of ids and vectors, or a condition on vec_id that picks them from table. All rows are
    encoded; the centres are fitted on a sample of vectors.SAMPLE_ROWS rows.
    Zero vectors take no part; see valid_vectors for other rows that don't,
    repeated ids and lengths that differ. Ties go to the smaller id; fewer rows than
    k give fewer ranks; empty tables none; other columns are ignored.
    """
    def not_zero(df: DataFrame) -> DataFrame:
        return df.filter(F.exists(F.col(vector_col).cast("array<double>"), lambda x: x != 0))

    dim = max(1, V.taking_part(not_zero(table), id_col, vector_col).agg(F.max(F.size("v"))).first()[0] or 1)
    sample = V.sample_matrix(not_zero(table), id_col, vector_col, dim)
    if not len(sample):
        return table.sparkSession.sql("SELECT 0L AS query_id, 0 AS rank, 0L AS vec_id, 0D AS score WHERE false")
    centres, turn = V.choose_centres(sample), rotation(dim)

    def codes(x: np.ndarray, centre: np.ndarray) -> tuple[pa.Array, pa.Array]:
        words, fit = encode(x, centre, turn)
        return pa.array([w.tobytes() for w in words], pa.binary()), pa.array(fit)

    written, index, cells = V.build_index(V.valid_vectors(not_zero(table), id_col, vector_col), centres, codes)
    asked = V.valid_vectors(not_zero(queries), id_col, vector_col) if isinstance(queries, DataFrame) else written.filter(queries)
    return V.two_rounds(index, cells, asked.select(F.col("vec_id").alias("query_id"), "v"), k, _prepare(centres, turn), _rerank(dim, k), BLOCK)


def op8_bit_code_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector of embeddings among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return approximate_top_k(rows, "vec_id % 20 = 0", 20)
