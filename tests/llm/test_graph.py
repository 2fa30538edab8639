import random

from procura.llm.graph import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {k: v for k, v in brute(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in found} == expected
    assert len(found) == len(expected)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
