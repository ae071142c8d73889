"""The heaviest clique of each node, compared with all cliques."""

import random

import pytest

from trafficloom.operators import graph
from trafficloom.operators.heaviest import Heaviest, bits


def test_heaviest_are_the_best_of_all_cliques():
    rng = random.Random(5)
    for _ in range(300):
        n, share, most = rng.randint(1, 12), rng.choice([0.2, 0.5, 0.8, 0.95]), rng.choice([1, 3, 40])
        weight = sorted((rng.randint(1, most) for _ in range(n)), reverse=True)
        near, flagged, bonus = [0] * n, rng.getrandbits(n), rng.choice([1, 2, 50])
        for a in range(n):
            for b in range(a):
                if rng.random() < share:
                    near[a] |= 1 << b
                    near[b] |= 1 << a
        every = [sum(1 << i for i in c) for c in graph.cliques_of({i: set(bits(near[i])) for i in range(n)})]

        def name(clique):
            return f"{clique * 7919 % 1009:04d}"

        def rank(clique):
            return sum(weight[i] for i in bits(clique)) + bonus * bool(clique & flagged), name(clique), clique

        mine = rng.getrandbits(n)
        got = Heaviest(near, weight, flagged, bonus, name).run(mine)
        assert all(got[i] == max(rank(c) for c in every if c >> i & 1) for i in bits(mine))


def test_search_for_all_nodes_of_a_dense_graph_is_short(monkeypatch):
    """What is settled for light nodes is left out for heavier ones; counted in bounds, not in seconds."""
    rng, n = random.Random(7), 80
    weight = sorted((100 * rng.randint(1, 2) + rng.randint(1, 9) for _ in range(n)), reverse=True)
    near = [0] * n
    for a in range(n):
        for b in range(a):
            if rng.random() < 0.8:
                near[a] |= 1 << b
                near[b] |= 1 << a
    bounds, beyond = [], Heaviest._beyond
    monkeypatch.setattr(Heaviest, "_beyond", lambda *args: bounds.append(1) or beyond(*args))
    got = Heaviest(near, weight, 0, 0, str).run((1 << n) - 1)
    assert all(clique >> i & 1 and sum(weight[k] for k in bits(clique)) == w for i, (w, _, clique) in enumerate(got))
    assert len(bounds) < 55_000
