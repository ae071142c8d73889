"""Graphs with far more cliques than can be listed, and the search for cliques over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from trafficloom.functions import keys as K
from trafficloom.operators import fingerprints, graph
from trafficloom.plans import shared

PAIRS = 40


@pytest.fixture
def dense(spark):
    """Tables of a batch in which every node is a neighbour of all but one: 2 ** PAIRS cliques. Of a pair the node with the odd number has more flows."""
    n = 2 * PAIRS
    t = fingerprints.Tables.__new__(fingerprints.Tables)
    t.nodes = spark.createDataFrame([(1, [i], i, [i]) for i in range(n)], "batch int, bins array<int>, node_id long, dest_ids array<long>")
    t.edges = spark.createDataFrame([(1, a, b, 0.5) for b in range(n) for a in range(b) if a // 2 != b // 2], "batch int, u long, v long, weight double")
    t.state = spark.createDataFrame([(1, i, [f"d|1.1.1.{i}|443", K.NO_CERT], 1 + i % 2) for i in range(n)], "batch int, dest_id long, keys array<string>, n_flows long")
    t.clustered = spark.createDataFrame([(i, 1, float(i), f"1.1.1.{i}", 443, None) for i in range(n)] + [(n, 1, n + 0.4, "9.9.9.9", 443, "7")], "flow_idx long, batch int, time_start double, dst string, dport int, cert string")
    return t


def expected(i):
    """Keys of the largest fingerprint that holds node i."""
    return sorted([f"d|1.1.1.{i if k == i // 2 else 2 * k + 1}|443" for k in range(PAIRS)] + [K.NO_CERT])


def test_flows_get_the_largest_fingerprint_of_a_dense_graph(dense):
    keys = {r.fp_id: r["keys"] for r in dense.fps.collect()}
    got = {r.flow_idx: r.fp_id for r in dense.assigned.collect()}
    assert got.pop(2 * PAIRS) is None and {i: keys[x] for i, x in got.items()} == {i: expected(i) for i in range(2 * PAIRS)}
    assert {r.n_flows for r in dense.fps.collect()} == {2 * PAIRS, 2 * PAIRS - 1}


@pytest.mark.parametrize("over_all", [False, True])
def test_fill_of_a_dense_graph(dense, over_all):
    keys = {r.fp_id: r["keys"] for r in dense.fps.collect()}
    got = {r.flow_idx: r.fp_id for r in fingerprints.fill_nearest(dense.assigned, over_all).collect()}
    assert len(got) == 2 * PAIRS + 1 and keys[got[2 * PAIRS]] == expected(2 * PAIRS - 1)


def test_search_is_spread_over_tasks(spark):
    nodes = spark.createDataFrame([(b, [0], b, [b]) for b in range(64)], "batch int, bins array<int>, node_id long, dest_ids array<long>")
    edges = spark.createDataFrame([], "batch int, u long, v long, weight double")
    rows = graph.by_roots(nodes, edges, [])
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4 and graph.maximal_cliques(nodes, edges).count() == 64


def test_fingerprints_of_all_cliques_are_not_written(spark, dense):
    """Each is put together where its clique is found: the only table made is that of the edges."""
    dense.nodes = dense.nodes.filter("node_id < 12")
    dense.edges = dense.edges.filter("u < 12 AND v < 12")
    before = list(shared._made)
    got = dense.every.collect()
    made = [path.rsplit("/", 1)[1] for path in shared._made if path not in before]
    assert [name.split("-")[0] for name in made] == ["edges"]
    assert len({r.fp_id for r in got}) == len(got) == 64 and {len(r["keys"]) for r in got} == {7}


def test_edges_go_when_fingerprints_are_found(dense):
    before = list(shared._made)
    assert dense.fps.count() > 0
    assert [path.rsplit("/", 1)[1].split("-")[0] for path in shared._made if path not in before] == ["fingerprints"]


@pytest.mark.parametrize("late", [0, 63, 200])
def test_correlations_with_few_and_many_bins(spark, late):
    """Every pair of nodes, some of which have bins beyond those that fit into a long."""
    rng = random.Random(late)
    bins = {i: sorted(rng.sample(range(8), rng.randint(1, 6))) + sorted(rng.sample(range(62, 63 + late), rng.randint(0, 1) if late else 0)) for i in range(40)}
    nodes = spark.createDataFrame([(1 + i % 2, b, i, [i]) for i, b in bins.items()], "batch int, bins array<int>, node_id long, dest_ids array<long>")
    got = {(r.batch, r.u, r.v): r.weight for r in graph.correlations(nodes, 0.2).collect()}
    score = {(1 + a % 2, a, b): len(set(bins[a]) & set(bins[b])) / len(set(bins[a]) | set(bins[b])) for b in bins for a in range(b) if a % 2 == b % 2}
    assert got == {k: w for k, w in score.items() if w >= 0.2}


def test_pairs_of_nodes_are_not_moved(spark):
    """Edges between nodes of few bins come from one join; nothing that grows with the pairs is dealt again."""
    nodes = shared.materialize(spark.createDataFrame([(1, sorted({i % 7, i % 11, i % 13}), i, [i]) for i in range(2000)], "batch int, bins array<int>, node_id long, dest_ids array<long>"))
    sc, edges = spark.sparkContext, graph.correlations(nodes, 0.1)
    sc.setJobGroup("pairs", "pairs")
    assert edges.count() > 200_000
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {stage for job in sc.statusTracker().getJobIdsForGroup("pairs") for stage in sc.statusTracker().getJobInfo(job).stageIds}
    written = sum(sc._jsc.sc().statusStore().lastStageAttempt(stage).shuffleWriteRecords() for stage in stages)
    assert 0 < written < 50_000


@pytest.mark.parametrize("n, share", [(70, 0.5), (130, 0.2), (64, 0.6), (20, 1.0), (9, 0.0)])
def test_cliques_come_together(n, share):
    """Against plain backtracking, with several words of bits: each clique once, from any split of the roots, and with few branches held at a time."""
    rng = random.Random(n)
    near = [0] * n
    for b in range(n):
        for a in range(b):
            if rng.random() < share:
                near[a] |= 1 << b
                near[b] |= 1 << a

    def plain(chosen, open_, done):
        if not open_ | done:
            yield chosen
        while open_:
            low = open_ & -open_
            some = near[low.bit_length() - 1]
            yield from plain(chosen | low, open_ & some, done & some)
            open_ ^= low
            done |= low

    def found(roots, at_once=graph.AT_ONCE):
        return [int.from_bytes(row.tobytes(), "little") for rows in graph.clique_rows(near, roots, at_once) for row in rows]

    expected = sorted(plain(0, (1 << n) - 1, 0))
    assert sorted(found(range(n))) == sorted(found(range(n), 1)) == sorted(found(range(0, n, 3)) + found((i for i in range(n) if i % 3))) == expected
    assert len(list(graph.clique_rows(near, range(n)))) <= 1 + len(expected) // 20


def test_cliques_leave_a_task_in_blocks(spark):
    """2 ** 16 cliques of one graph: all of them, in order of their nodes, by Arrow batches of bounded size."""
    n = 32
    nodes = spark.createDataFrame([(1, [i], 100 - i, [100 - i]) for i in range(n)], "batch int, bins array<int>, node_id long, dest_ids array<long>")
    edges = spark.createDataFrame([(1, 100 - a, 100 - b, 0.5) for a in range(n) for b in range(a) if a // 2 != b // 2], "batch int, u long, v long, weight double")
    found = graph.maximal_cliques(nodes, edges)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r.node_ids) for r in found.collect()]
    assert len(got) == len(set(got)) == 1 << 16 and all(len(c) == n // 2 == len({(100 - i) // 2 for i in c}) and list(c) == sorted(c) for c in got)
    blocks = list(graph.in_blocks(graph.clique_rows(*(lambda near: (near, range(n)))([((1 << n) - 1) & ~(3 << i // 2 * 2) for i in range(n)])), n, 1000))
    assert [len(b) for b in blocks] == [1000] * 65 + [536]
