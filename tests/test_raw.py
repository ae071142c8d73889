"""Fingerprints of all cliques: how they are put together, and what stays on disk while they are searched for."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trafficloom import queries
from trafficloom.functions import keys as K
from trafficloom.operators import fingerprints, graph
from trafficloom.plans import shared

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_fingerprints_are_put_together_in_bounded_batches(seed):
    """Against brute force, with keys that several nodes hold and nodes of one and of several destinations."""
    rng = random.Random(seed)
    n = rng.randint(1, 11)
    edges = {(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6}
    keys = [[f"d|1.1.1.{i}|443", *rng.sample(["c|1", "c|2", K.NO_CERT], rng.randint(0, 3))] for i in range(n)]
    held = [(7, 0, i, [b for a, b in edges if a == i] or None, True, keys[i], 3 + i, rng.randint(1, 2)) for i in range(n)]

    def clique(some):
        return all(pair in edges for pair in itertools.combinations(some, 2))

    cliques = [set(some) for size in range(1, n + 1) for some in itertools.combinations(range(n), size) if clique(some)]
    expected = sorted((7, sorted({k for i in c for k in keys[i]}), sum(3 + i for i in c)) for c in cliques if not any(c < other for other in cliques) and sum(held[i][7] for i in c) > 1)
    for at_once in (1, 60, 1 << 18):
        found = list(fingerprints.put_together(held, at_once))
        assert sorted((r["batch"], r["keys"], r["n_flows"]) for batch in found for r in batch.to_pylist()) == expected
        assert all(batch.num_rows <= max(1, at_once // n) for batch in found)


def test_only_what_the_search_reads_stays(spark):
    before = list(shared._made)
    found = queries.fingerprints_raw(spark, SF)
    assert sorted(path.rsplit("/", 1)[1].split("-")[0] for path in shared._made if path not in before) == ["edges", "nodes", "state"]
    t = queries._tables(spark, SF)
    every = fingerprints.build(t.nodes, t.edges, t.state).collect()
    assert sorted((r.batch, r.fp_id, r["keys"], r.n_flows) for r in found.collect()) == sorted((r.batch, r.fp_id, ",".join(r["keys"]), r.n_flows) for r in every) != []


@pytest.mark.parametrize("seed", range(20))
def test_cliques_of_random_graphs(seed):
    """Each maximal clique once, from any split of the roots."""
    rng = random.Random(seed)
    n, share = rng.randint(1, 12), rng.random()
    near = [0] * n
    for a, b in itertools.combinations(range(n), 2):
        if rng.random() < share:
            near[a] |= 1 << b
            near[b] |= 1 << a
    sets = [x for x in range(1, 1 << n) if all(x & ~(1 << i) & ~near[i] == 0 for i in range(n) if x >> i & 1)]
    expected = sorted(x for x in sets if not any(x != y and x & y == x for y in sets))
    assert sorted(graph.clique_bits(near, range(n))) == expected
    assert sorted([*graph.clique_bits(near, range(0, n, 2)), *graph.clique_bits(near, range(1, n, 2))]) == expected


def test_texts_and_ids_are_made_where_cliques_are_found(spark):
    """As Spark would make them of the lists, with keys outside ASCII and a batch of which no clique has two destinations; Spark itself only passes them on."""
    rng = random.Random(1)
    nodes = spark.createDataFrame([(1 + i // 12, [i], i, [i]) for i in range(14)], "batch int, bins array<int>, node_id long, dest_ids array<long>")
    edges = spark.createDataFrame([(1, a, b, 0.5) for b in range(12) for a in range(b) if rng.random() < 0.6], "batch int, u long, v long, weight double")
    texts = ["é", "z", "\U0001d11e", "￮", "", "A"]
    state = spark.createDataFrame([(1 + i // 12, i, [f"d|{texts[i % 6]}|{i}", *rng.sample(["c|1", "c|é", K.NO_CERT], rng.randint(1, 3))], 1 + i) for i in range(14)], "batch int, dest_id long, keys array<string>, n_flows long")
    found = fingerprints.build(nodes, edges, state, joined=",")
    assert "sha2" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "array_join" not in plan
    every = fingerprints.build(nodes, edges, state).withColumn("other", K.fingerprint_id(F.col("keys"))).collect()
    assert sorted(map(tuple, found.collect())) == sorted((r.batch, r.fp_id, ",".join(r["keys"]), r.n_flows) for r in every) and {r.batch for r in every} == {1}
    assert all(r.fp_id == r.other for r in every) and len(every) > 5
