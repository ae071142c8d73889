"""Correlation graph of destinations that are active together, and its maximal cliques."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import time_bin
from ..plans.shared import text_file
from .heaviest import bits

Found = TypeVar("Found")


def activity(clustered: DataFrame, window: float = 30.0) -> DataFrame:
    """(batch, dest_id, bins): the time bins, from the batch's start, in which a destination's packets fall."""
    start = clustered.groupBy("batch").agg(F.min("time_start").alias("start"))
    seen = clustered.select("batch", "dest_id", F.explode("timestamps").alias("t")).join(start, "batch")
    return seen.groupBy("batch", "dest_id").agg(F.array_sort(F.collect_set(time_bin(F.col("t") - F.col("start"), window))).alias("bins"))


def signatures(active: DataFrame) -> DataFrame:
    """Nodes: destinations with the same bins become one, named by its first destination."""
    return active.groupBy("batch", "bins").agg(F.min("dest_id").alias("node_id"), F.array_sort(F.collect_set("dest_id")).alias("dest_ids"))


#: Bins that fit into the bits of a positive long.
MASK_BINS = 63


def correlations(nodes: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Edges (batch, u, v, weight): nodes that share a bin, weighted by the Jaccard of their bins.

    At or below a threshold of 0 every pair of a batch is an edge without weight. Nodes with bins below MASK_BINS only carry them as
    the bits of a number, so a pair of those is weighed in the first bin in which it meets; pairs with other nodes are
    moved once for each bin and counted.
    """
    if threshold <= 0:
        a, b = (nodes.select("batch", F.col("node_id").alias(x)) for x in "uv")
        return a.join(b, "batch").filter("u < v").withColumn("weight", F.lit(None).cast("double"))
    bits = F.when((F.array_min("bins") >= 0) & (F.array_max("bins") < MASK_BINS), F.expr("aggregate(bins, 0L, (a, b) -> a | shiftleft(1L, b))"))
    at = nodes.select("batch", "node_id", F.size("bins").alias("n"), bits.alias("bits"), F.explode("bins").alias("bin"))

    def side(rows, x):
        return rows.select("batch", "bin", F.col("node_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))

    def pairs(a, b):
        return side(a, "u").join(side(b, "v"), ["batch", "bin"]).filter("u < v")

    few, many = at.filter("bits IS NOT NULL"), at.filter("bits IS NULL")
    both = F.col("bu").bitwiseAND(F.col("bv"))
    first = pairs(few, few).filter(both.bitwiseAND(-both) == F.expr("shiftleft(1L, bin)")).select("batch", "u", "v", "nu", "nv", F.bit_count(both).cast("long").alias("c"))
    counted = pairs(many, at).unionByName(pairs(few, many)).groupBy("batch", "u", "v", "nu", "nv").agg(F.count(F.lit(1)).alias("c"))
    return first.unionByName(counted).select("batch", "u", "v", (F.col("c") / (F.col("nu") + F.col("nv") - F.col("c"))).alias("weight")).filter(F.col("weight") >= threshold)


def unpack(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between destinations: weight 1 within a node, the node edge's weight across."""
    member = nodes.select("batch", "node_id", F.explode("dest_ids").alias("d"))
    a, b = member.withColumnRenamed("d", "a"), member.withColumnRenamed("d", "b")
    within = a.join(b, ["batch", "node_id"]).filter("a < b").select("batch", "a", "b", F.lit(1.0).alias("weight"))
    across = edges.join(a.withColumnRenamed("node_id", "u"), ["batch", "u"]).join(b.withColumnRenamed("node_id", "v"), ["batch", "v"])
    return within.unionByName(across.select("batch", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight"))


#: Nodes whose cliques one task looks for.
ROOTS = 128


def ordered(neighbours: dict[int, set[int]]) -> tuple[list[int], list[int]]:
    """The nodes of a graph in order of degree, and the neighbours of each as bits."""
    names = sorted(neighbours, key=lambda n: (len(neighbours[n]), n))
    place = {n: i for i, n in enumerate(names)}
    return names, [sum(1 << place[m] for m in neighbours[n]) for n in names]


#: Numbers that the search for cliques holds for the nodes of its branches at a time.
AT_ONCE = 1 << 19
#: Open nodes of a branch whose cliques come from a table.
FEW = 6


def clique_rows(near: list[int], roots: Iterable[int], at_once: int = AT_ONCE) -> Iterator[np.ndarray]:
    """Maximal cliques of one graph, some at a time, by backtracking with a pivot: a row of bits each, 64 nodes a word.

    near holds the neighbours of nodes 0, 1, 2, ... A clique belongs to its first node, so the cliques of
    some nodes (roots) can be found apart from those of others. Many branches are looked at together: chosen nodes, those open to
    join them, and those done with, each a row of bits. The last branches come first, so few are held. A branch of FEW open nodes at most
    ends at once: its cliques are looked up.
    """
    n, words = len(near), (len(near) + 63) // 64
    if not n:
        return

    def rows(sets: Iterable[int]) -> np.ndarray:
        return np.frombuffer(b"".join(x.to_bytes(8 * words, "little") for x in sets), dtype="<u8").reshape(-1, words)

    # the last row is for no node
    table, own, before = rows([*near, (1 << 64 * words) - 1]), rows([*(1 << i for i in range(n)), 0]), rows((1 << i) - 1 for i in range(n))
    linked = np.zeros((n + 1, n + 1), dtype=np.int32)
    linked[:n, :n] = unpacked(table[:n], n)
    weights, most, at = linked[:n, :n].astype(np.float32), max(1, at_once // n), np.fromiter(roots, dtype=np.int64)
    stack = [(own[at], table[at] & ~before[at], table[at] & before[at])]
    while stack:
        branches = stack.pop()
        while stack and len(branches[0]) < most:
            branches = tuple(np.concatenate(both) for both in zip(stack.pop(), branches))
        if len(branches[0]) > most:
            stack.append(tuple(x[:-most] for x in branches))
            branches = tuple(x[-most:] for x in branches)
        few = np.bitwise_count(branches[1]).sum(axis=1) <= FEW
        found = _looked_up(*(x[few] for x in branches), table, own, linked)
        if len(found):
            yield found
        chosen, open_, done = (x[~few] for x in branches)
        if not len(chosen):
            continue
        # the pivot is the open or done node with most neighbours among the open ones, which are left out
        pivot = ((unpacked(open_, n).astype(np.float32) @ weights + 1) * unpacked(open_ | done, n)).argmax(axis=1)
        branch = open_ & ~table[pivot]
        at, node = np.nonzero(unpacked(branch, n))
        prior, some = branch[at] & before[node], table[node]
        if len(at):
            stack.append((chosen[at] | own[node], open_[at] & ~prior & some, (done[at] | prior) & some))


def unpacked(rows: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n nodes is in a row of bits."""
    return np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, count=n, bitorder="little").view(bool)


def _looked_up(chosen: np.ndarray, open_: np.ndarray, done: np.ndarray, table: np.ndarray, own: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The maximal cliques of branches of FEW open nodes at most: those of the open nodes to which no done node can be added."""
    n = len(linked) - 1
    at, node = np.nonzero(unpacked(open_, n))
    size = np.bincount(at, minlength=len(open_))
    nodes = np.full((len(open_), FEW), n)
    nodes[at, np.arange(len(at)) - (size.cumsum() - size)[at]] = node
    key = size << PAIRS
    for k, (i, j) in enumerate(_pairs()):
        key |= linked[nodes[:, i], nodes[:, j]] << k
    ends, sets = _small_cliques()
    count = ends[key + 1] - ends[key]
    at = np.repeat(np.arange(len(key)), count)
    sets = sets[np.arange(len(at)) - (count.cumsum() - count - ends[key])[at]]
    chosen, done, nodes = chosen[at], done[at], nodes[at]
    for i in range(FEW):
        member = np.where(sets >> i & 1, nodes[:, i], n)
        chosen |= own[member]
        done &= table[member]
    return chosen[~done.any(axis=1)]


PAIRS = FEW * (FEW - 1) // 2


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for j in range(FEW) for i in range(j)]


@cache
def _small_cliques() -> tuple[np.ndarray, np.ndarray]:
    """The maximal cliques of every graph of up to FEW nodes as bits, one graph after the other, and where each ends: a graph is its number of nodes and a bit for each pair."""
    graphs, subsets = np.arange(1 << PAIRS)[:, None], np.arange(1 << FEW)
    needed = sum(((subsets >> i & subsets >> j & 1) << k for k, (i, j) in enumerate(_pairs())), np.zeros_like(subsets))
    clique = graphs & needed == needed
    sets, counts = [], []
    for size in range(FEW + 1):
        maximal = clique & (subsets < 1 << size)
        for i in range(size):
            maximal &= (subsets >> i & 1 == 1) | ~clique[:, subsets | 1 << i]
        sets.append(np.nonzero(maximal)[1])
        counts.append(maximal.sum(axis=1))
    return np.concatenate([[0], np.concatenate(counts).cumsum()]), np.concatenate(sets)


def clique_bits(near: list[int], roots: Iterable[int]) -> Iterator[int]:
    """The cliques of clique_rows(), a number each."""
    return (int.from_bytes(row.tobytes(), "little") for rows in clique_rows(near, roots) for row in rows)


def cliques_of(neighbours: dict[int, set[int]]) -> Iterator[list[int]]:
    """Maximal cliques of one graph by name."""
    names, near = ordered(neighbours)
    for chosen in clique_bits(near, range(len(near))):
        yield sorted(names[i] for i in bits(chosen))


def in_blocks(rows: Iterable[np.ndarray], n: int, most: int) -> Iterator[np.ndarray]:
    """Whether each of n nodes is in a clique of clique_rows(), for blocks of most cliques; the last has the rest."""
    held, count = [], 0
    for some in rows:
        held.append(some)
        count += len(some)
        if count >= most:
            whole = np.concatenate(held)
            for i in range(0, count - count % most, most):
                yield unpacked(whole[i:i + most], n)
            held, count = [whole[count - count % most:]], count % most
    if count:
        yield unpacked(np.concatenate(held), n)


def by_roots(nodes: DataFrame, edges: DataFrame, more: list[str], roots: int = ROOTS) -> DataFrame:
    """(batch, part, node_id, near, mine, more): every graph whole for each ``roots`` of its nodes (mine), in one task and one after the other.

    near holds an edge once, at one of its ends (see neighbours). A batch's graph has 2^(batch / window) nodes at most. The rows are
    few and the search is long, so the number of tasks is given: else Spark would put small partitions together.
    """
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    near = edges.groupBy("batch", F.col("u").alias("node_id")).agg(F.collect_set("v").alias("near"))
    parts = nodes.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / roots).cast("int").alias("parts"))
    graph = nodes.select("batch", "node_id", *more).join(near, ["batch", "node_id"], "left").join(parts, "batch").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    graph = graph.withColumn("mine", F.pmod(F.xxhash64("node_id"), "parts") == F.col("part"))
    return graph.repartition(tasks, "batch", "part").sortWithinPartitions("batch", "part", "node_id").select("batch", "part", "node_id", "near", "mine", *more)


def each_graph(frames: Iterator[pd.DataFrame], search: Callable[[list[tuple]], Iterator[Found]]) -> Iterator[Found]:
    """What search finds in the rows of each batch and part of by_roots()."""
    held: list[tuple] = []
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            if held and row[:2] != held[0][:2]:
                yield from search(held)
                held = []
            held.append(row)
    if held:
        yield from search(held)


def neighbours(held: list[tuple]) -> dict[int, set[int]]:
    """The neighbours of each node of a batch and part of by_roots()."""
    near: dict[int, set[int]] = {row[2]: set() for row in held}
    for row in held:
        for other in () if row[3] is None else row[3]:
            near[row[2]].add(other)
            near[other].add(row[2])
    return near


def maximal_cliques(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(batch, node_ids) of every maximal clique; a node without edges is one.

    Each task finds the cliques that belong to its nodes and puts them out as it does. A dense graph may have very many.
    """
    def search(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        names, near = ordered(neighbours(held))
        mine = {row[2] for row in held if row[4]}
        order, ids = np.argsort(names), pa.array(sorted(names), pa.int64())
        for chosen in in_blocks(clique_rows(near, (i for i, name in enumerate(names) if name in mine)), len(near), max(1, AT_ONCE // len(near))):
            lists = pa.ListArray.from_arrays(*members(chosen[:, order], ids))
            yield pa.record_batch([pa.array(np.full(len(chosen), held[0][0]), pa.int32()), lists], names=["batch", "node_ids"])

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_graph((frame.to_pandas() for frame in frames), search)

    return by_roots(nodes, edges, []).mapInArrow(found, "batch int, node_ids array<long>")


def members(has: np.ndarray, values: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Ends and values of lists: a row of has tells which values are in a list."""
    ends = np.concatenate([[0], has.sum(axis=1).cumsum()])
    return pa.array(ends, pa.int32()), values.take(pa.array(np.nonzero(has)[1]))


def _label():
    """Export label from columns keys, labels and window: JSON of certs, ips, labels and window, keys in order."""
    def tagged(tag):
        return F.transform(F.filter("keys", lambda k: k.startswith(tag)), lambda k: F.substring(k, 3, 2147483647))

    return F.to_json(F.struct(tagged("c|").alias("certs"), tagged("d|").alias("ips"), "labels", "window"))


def node_labels(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """(batch, node_id, label): what all destinations of a node of the dense graph hold together."""
    member = nodes.select("batch", "node_id", "bins", F.explode("dest_ids").alias("dest_id")).join(state, ["batch", "dest_id"])
    counts = member.select("batch", "node_id", F.explode("labels").alias("label", "n")).groupBy("batch", "node_id", "label").agg(F.sum("n").alias("n")).groupBy("batch", "node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    keys = member.groupBy("batch", "node_id").agg(F.first("bins").alias("window"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
    return keys.join(counts, ["batch", "node_id"]).select("batch", "node_id", _label().alias("label"))


def destination_labels(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """(batch, node_id, label) for the unpacked graph: a node for each destination, with its own keys and labels and its window."""
    member = nodes.select("batch", F.col("bins").alias("window"), F.explode("dest_ids").alias("dest_id")).join(state, ["batch", "dest_id"])
    return member.select("batch", F.col("dest_id").alias("node_id"), _label().alias("label"))


def export(nodes: DataFrame, edges: DataFrame, state: DataFrame, path: str, dense: bool = True, form: str = "gexf") -> None:
    """Write the graph of a batch: its nodes as they are, or unpacked with a node for each destination."""
    if dense:
        return write_graph(node_labels(nodes, state), edges, path, form)
    loose = unpack(nodes, edges).withColumnRenamed("a", "u").withColumnRenamed("b", "v")
    return write_graph(destination_labels(nodes, state), loose, path, form)


def write_graph(labels: DataFrame, edges: DataFrame, path: str, form: str = "gexf") -> None:
    """One graph file from the nodes' labels and the edges of a batch (a report; the rows pass one by one)."""
    from xml.sax.saxutils import quoteattr

    if form not in ("gexf", "gml"):
        import warnings

        warnings.warn(f"unknown format {form!r}, writing gexf", stacklevel=2)
        form = "gexf"
    with text_file(labels.sparkSession, path) as out:
        if form == "gexf":
            out.write('<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected" mode="static"><nodes>\n')
            out.writelines(f'<node id="{r.node_id}" label={quoteattr(r.label)}/>\n' for r in labels.orderBy("node_id").toLocalIterator())
            out.write("</nodes><edges>\n")
            out.writelines(f'<edge id="{i}" source="{r.u}" target="{r.v}"' + (f' weight="{r.weight!r}"' if r.weight is not None else "") + "/>\n" for i, r in enumerate(edges.orderBy("u", "v").toLocalIterator()))
            out.write("</edges></graph></gexf>\n")
        else:
            out.write("graph [\n")
            for r in labels.orderBy("node_id").toLocalIterator():
                text = r.label.replace("&", "&amp;").replace('"', "&#34;")
                out.write(f'  node [\n    id {r.node_id}\n    label "{text}"\n  ]\n')
            for r in edges.orderBy("u", "v").toLocalIterator():
                out.write(f"  edge [\n    source {r.u}\n    target {r.v}\n" + (f"    weight {r.weight!r}\n" if r.weight is not None else "") + "  ]\n")
            out.write("]\n")
