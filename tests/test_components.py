"""Components and witnesses against plain graph walks."""

import random

import pytest

from vellumspark.operators import components as C
from vellumspark.operators import graph


def plain(edges):
    """{node: least node of its component} of the nodes on cycles, by reachability."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in out if a in reach[a]}


def check(spark, edges, kind="long"):
    frame = spark.createDataFrame(edges, f"source {kind}, target {kind}")
    found = C.strong_components(frame)
    got = found.collect()
    want = plain(edges)
    assert len(got) == len(want) and {r.id: r.cycle for r in got} == want
    walks = {}
    for r in C.witness_cycles(frame, found).collect():
        walks.setdefault(r.cycle, []).append((r.position, r.id))
    assert set(walks) == set(want.values())
    for name, walk in walks.items():
        nodes = [node for _, node in sorted(walk)]
        assert [p for p, _ in sorted(walk)] == list(range(len(nodes))) and len(set(nodes)) == len(nodes) and nodes[0] == min(nodes)
        assert all((a, b) in set(edges) for a, b in zip(nodes, nodes[1:] + nodes[:1])) and {want[n] for n in nodes} == {name}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range((50, 110)[seed])]
    edges += [(200 + k, 201 + k) for k in range(20)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)] + [(305, 3), (4, 300), (400, 400), (edges[0][0], 500), (500, edges[0][1])]
    check(spark, edges + edges[:5])


def test_shapes(spark):
    ladder = [(k, k + 1) for k in range(6)] + [(20 + k + 1, 20 + k) for k in range(6)] + [(k, 20 + k) for k in range(7)] + [(20, 0)]
    flower = [(0, 10 * p + 1) for p in range(1, 5)] + [(10 * p + k, 10 * p + k + 1) for p in range(1, 5) for k in range(1, 4)] + [(10 * p + 4, 0) for p in range(1, 5)]
    check(spark, [(f"a{a}", f"a{b}") for a, b in ladder] + [(f"b{a}", f"b{b}") for a, b in flower], "string")


def test_a_long_ring_with_a_long_tail(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("id * 7 % 10000 as source", f"(id + 1) % {n} * 7 % 10000 as target").unionByName(spark.range(3000).selectExpr("10000 + id as source", "10001 + id as target"))
    edges = edges.unionByName(spark.createDataFrame([(0, 10_000)], "source long, target long"))
    found = C.strong_components(edges)
    assert found.count() == n and found.select("cycle").distinct().collect()[0][0] == 0
    walk = C.witness_cycles(edges, found)
    assert walk.where("id = position * 7 % 10000").count() == n


def test_empty_and_null(spark):
    for rows in ([], [(None, 1), (1, None), (None, None)], [(1, 2), (2, 3)]):
        frame = spark.createDataFrame(rows, "source long, target long")
        found = C.strong_components(frame)
        assert found.count() == 0 and C.witness_cycles(frame, found).count() == 0 and graph.on_cycle(frame).count() == 0
