"""Connected components against a plain union of sets, with few edges and as many."""

import random

import pytest

from flotsam.operators import graph


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("few, hub", [(200_000, 1000), (0, 1000), (0, 5)])
def test_components(spark, monkeypatch, few, hub):
    """Chains, a hub, cycles, loops and repeats; with few = 0 by the path for many edges, with hub = 5 by that of hubs."""
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "LEAST_HUB", hub)
    rng = random.Random(2)
    chain = list(range(1000, 1040))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(2000, 2000 + k) for k in range(1, 60)] + [(3000 + k, 3000 + (k + 1) % 9) for k in range(9)]
    edges += [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(7, 7), (5000, 5000)]
    got = graph.connected_components(spark.createDataFrame(edges + edges[:20], "a long, b long").repartition(3)).collect()
    assert {r.id: r.component for r in got} == plain(edges)
    assert len(got) == len(plain(edges))
    assert graph.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
