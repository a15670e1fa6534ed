import random

from tessera.llm.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_random_graphs_chains_and_stars(spark):
    rng = random.Random(4)
    for n, m in ((40, 30), (200, 180)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(17)] + [(5000, 6000 + i) for i in range(30)] + [(None, 3), (7, 7)]
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == brute(edges)


def test_strings_and_no_edges(spark):
    got = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()
    assert {(r.node, r.component) for r in got} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
