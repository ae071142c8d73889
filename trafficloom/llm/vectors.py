"""Cells of vectors and the queries that visit them, the frame of both vector searches.

Every vector belongs to its nearest of CENTRES centres; a centre's vectors are cut by
their distance r from it into at most ANNULI annuli of about CELL_ROWS rows, and what is still
larger (equal distances) into parts by hash. For a query at distance d from a centre the
triangle inequality and Cauchy's bound every score in an annulus:
``q.v <= min((|q|^2 + |v|^2 - |d - r|^2) / 2, q.c + |q| r)``. A first round visits the cells that
promise most, which gives every query a score that its k-th best reaches; the second
visits the other cells whose bound reaches that.

A visit is one row, (cell, query). Rows of the index and visits are dealt by cell and sorted, index rows first, and
each task streams them: it holds one cell and one block of queries at a time, so its memory
does not grow with the table. Index rows move once a round; only a cell with more than
QUERY_ROWS visits is sent again for every QUERY_ROWS of them, so what is shuffled grows with the table and the visits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import bounded_batches, materialize

CENTRES, ANNULI, CELL_ROWS, QUERY_ROWS, SAMPLE_ROWS = 48, 64, 32_768, 65_536, 4096
#: Relative slack on bounds in floating point.
SLACK = 1e-9


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double) of rows that take part: no null id, vector or component, all finite, not empty.

    Of rows that repeat an id the largest vector counts; shorter vectors are
    padded with zeros where they meet longer ones.
    """
    return taking_part(table, id_col, vector_col).groupBy("vec_id").agg(F.max("v").alias("v"))


def taking_part(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The rows of valid_vectors before repeated ids are settled; no shuffle."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros to dim."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(length) == 0:
        return np.zeros((0, dim))
    if (length == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(length), dim))
    at = np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - at] = flat
    return out


def sample_matrix(table: DataFrame, id_col: str, vector_col: str, dim: int) -> np.ndarray:
    """A fixed sample of SAMPLE_ROWS vectors at most, on the driver."""
    rows = taking_part(table, id_col, vector_col).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE_ROWS).select("v").toArrow()
    return matrix(rows.column("v"), dim)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def choose_centres(sample: np.ndarray, count: int | None = None, rounds: int = 6) -> np.ndarray:
    """k-means of a sample; the first centres are drawn by their squared distance from those before."""
    rng, chosen, gap = np.random.default_rng(7), [0], None
    for _ in range(min(count or CENTRES, len(sample)) - 1):
        d = ((sample - sample[chosen[-1]]) ** 2).sum(1)
        gap = d if gap is None else np.minimum(gap, d)
        if gap.sum() <= 0:
            break
        chosen.append(int(np.searchsorted(np.cumsum(gap), rng.random() * gap.sum(), "right").clip(max=len(sample) - 1)))
    centres = sample[chosen].astype(float)
    for _ in range(rounds):
        home = distances(sample, centres).argmin(1)
        centres = np.array([sample[home == c].mean(0) if (home == c).any() else centres[c] for c in range(len(centres))])
    return centres


@dataclass
class Cells:
    """The annuli of an index: one place in every array for each, CENTRES * ANNULI at most."""

    centres: np.ndarray
    group: np.ndarray
    annulus: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm2: np.ndarray  # the largest |v|^2

    @property
    def parts(self) -> np.ndarray:
        return -(-self.rows // CELL_ROWS)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and annulus an upper bound of the scores, and the centre's score."""
        d, middle, q2 = distances(q, self.centres)[:, self.group], (q @ self.centres.T)[:, self.group], (q * q).sum(1)[:, None]
        gap = np.maximum(np.maximum(self.low - d, d - self.high), 0)
        size = 1 + q2 + self.norm2 + gap * gap
        return np.minimum((q2 + self.norm2 - gap * gap) / 2, middle + np.sqrt(q2) * self.high) + SLACK * size, middle


def _assign(centres: np.ndarray, encode: Callable | None):
    def run(batches):
        for b in batches:
            x = matrix(b.column("v"), centres.shape[1])
            d = distances(x, centres)
            home = d.argmin(1)
            bits, fit = encode(x, centres[home]) if encode else (pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.float64()))
            columns = {"vec_id": b.column("vec_id"), "v": b.column("v"), "group": pa.array(home.astype(np.int32)), "r": pa.array(np.sqrt(((x - centres[home]) ** 2).sum(1))), "norm2": pa.array((x * x).sum(1)), "bits": bits, "fit": fit}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def build_index(vectors: DataFrame, centres: np.ndarray, encode: Callable | None = None) -> tuple[DataFrame, DataFrame, Cells]:
    """The vectors with group, r, norm2, bits and fit as written; the same with annulus and part; the cells. encode may make packed bits and their fit."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    index = materialize(vectors.mapInArrow(_assign(centres, encode), "vec_id long, v array<double>, group int, r double, norm2 double, bits binary, fit double"), "index")
    measures = [F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.max("norm2").alias("norm2")]
    shares = F.array(*[F.lit(k / ANNULI) for k in range(1, ANNULI)])
    found = index.groupBy("group").agg(*measures, F.percentile_approx("r", shares, F.lit(10_000)).alias("at")).orderBy("group").collect()  # a row for each centre
    cut = index.withColumn("annulus", F.lit(0))
    if any(g.n > CELL_ROWS for g in found):
        counts = {g.group: min(ANNULI, -(-g.n // CELL_ROWS)) for g in found}
        edges = [(g.group, sorted({g["at"][k * ANNULI // counts[g.group] - 1] for k in range(1, counts[g.group])})) for g in found]
        cut = index.join(F.broadcast(spark.createDataFrame(edges, "group int, edges array<double>")), "group")
        cut = cut.withColumn("annulus", F.size(F.filter("edges", lambda e: e < F.col("r")))).drop("edges")
        found = cut.groupBy("group", "annulus").agg(*measures).orderBy("group", "annulus").collect()  # CENTRES * ANNULI rows at most
    annulus = np.array([f["annulus"] if "annulus" in f else 0 for f in found])
    cells = Cells(centres, np.array([f.group for f in found]), annulus, *(np.array([f[c] for f in found]) for c in ("n", "low", "high", "norm2")))
    if cells.parts.max() == 1:
        return index, cut.withColumn("part", F.lit(0)), cells
    parts = spark.createDataFrame([(int(g), int(a), int(p)) for g, a, p in zip(cells.group, cells.annulus, cells.parts)], "group int, annulus int, parts int")
    return index, cut.join(F.broadcast(parts), ["group", "annulus"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts"), cells


def _route(cells: Cells, k: int, first: bool):
    """(group, annulus, query_id, v, reach) for the cells that a query has to visit.

    The first round takes the cells of the best centres until they hold more than k rows; the
    second all others whose bound reaches the query's k-th best score.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                bound, middle = cells.bounds(matrix(part.column("v"), cells.centres.shape[1]))
                order = np.argsort(-middle, axis=1, kind="stable")
                before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
                go = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(go, order, before <= k, axis=1)
                if not first:
                    go = ~go & (bound >= part.column("reach").to_numpy(zero_copy_only=False)[:, None])
                row, col = np.nonzero(go)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cells.group[col].astype(np.int32)), pa.array(cells.annulus[col].astype(np.int32)), *(part.column(c).take(take) for c in ("query_id", "v", "reach"))], names=["group", "annulus", "query_id", "v", "reach"])

    return run


def _streamed(prepare: Callable, search: Callable, block: int):
    """Rows sorted by (cell, kind): kind 0 is the cell's index, which is prepared once, kind 1 its visits."""

    def run(batches):
        cell, held, ready = None, [], None
        for b in batches:
            at, kind = b.column("cell").to_numpy(), b.column("kind").to_numpy()
            cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1, len(at)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                if at[a] != cell:
                    cell, held, ready = at[a], [], None
                rows = b.slice(a, z - a)
                if kind[a] == 0:
                    held.append(rows)
                    continue
                if held:
                    ready, held = prepare(pa.Table.from_batches(held)), []
                for s in range(0, rows.num_rows if ready is not None else 0, block):
                    qid, vid, score = search(ready, rows.slice(s, block))
                    yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(vid), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def visit(index: DataFrame, cells: Cells, asked: DataFrame, k: int, first: bool, prepare: Callable, search: Callable, block: int) -> DataFrame:
    """(query_id, vec_id, score) that search finds for the queries (query_id, v, reach) in the cells of one round."""
    visits = materialize(asked.mapInArrow(_route(cells, k, first), "group int, annulus int, query_id long, v array<double>, reach double"), "visits")
    counts = visits.groupBy("group", "annulus").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each annulus at most
    parts = {(int(g), int(a)): int(p) for g, a, p in zip(cells.group, cells.annulus, cells.parts)}
    sizes = F.broadcast(asked.sparkSession.createDataFrame([(c.group, c.annulus, parts[c.group, c.annulus], -(-c.n // QUERY_ROWS)) for c in counts], "group int, annulus int, parts int, blocks int"))

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    cell = F.shiftleft(F.col("group").cast("long"), 54) + F.shiftleft(F.col("annulus").cast("long"), 47) + F.shiftleft(F.col("part").cast("long"), 23) + F.col("block")
    left = index.join(sizes, ["group", "annulus"]).withColumn("block", each("blocks"))
    left = left.select(cell.alias("cell"), F.lit(0).alias("kind"), "group", F.col("vec_id").alias("id"), "v", "r", "bits", "fit", F.lit(None).cast("double").alias("reach"))
    right = visits.join(sizes, ["group", "annulus"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", each("parts"))
    none = F.lit(None).cast("double")
    right = right.select(cell.alias("cell"), F.lit(1).alias("kind"), "group", F.col("query_id").alias("id"), "v", none.alias("r"), F.lit(None).cast("binary").alias("bits"), none.alias("fit"), "reach")
    rows = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "kind", "id")
    return rows.mapInArrow(_streamed(prepare, search, block), "query_id long, vec_id long, score double")


def two_rounds(index: DataFrame, cells: Cells, asked: DataFrame, k: int, prepare: Callable, search: Callable, block: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best that search finds; asked: query_id, v."""
    none = F.lit(float("-inf"))
    seeds = materialize(ranked(visit(index, cells, asked.withColumn("reach", none), k, True, prepare, search, block), k), "seeds")
    reach = seeds.filter(F.col("rank") == k).select("query_id", F.col("score").alias("reach"))
    bounded = asked.join(reach, "query_id", "left").withColumn("reach", F.coalesce("reach", none))
    found = visit(index, cells, bounded, k, False, prepare, search, block)
    return ranked(found.unionByName(seeds.drop("rank")), k).select("query_id", "rank", "vec_id", "score")


def merge_best(score: np.ndarray, ids: np.ndarray, new_score: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the k best of both: highest score, then smallest id. Empty places have score -inf."""
    s, i = np.concatenate([score, new_score], axis=1), np.concatenate([ids, new_ids], axis=1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def top_of_block(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of a score block whose columns are in order of ids."""
    n = score.shape[1]
    if n > k:
        kth = np.partition(score, n - k, axis=1)[:, n - k]
        above = score > kth[:, None]
        level = score == kth[:, None]
        level &= np.cumsum(level, axis=1) <= (k - above.sum(axis=1))[:, None]
        _, col = np.nonzero(above | level)
        col = col.reshape(len(score), k)
    else:
        col = np.broadcast_to(np.arange(n), score.shape)
    return np.take_along_axis(score, col, 1), ids[col]


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
