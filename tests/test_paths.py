"""Shortest paths against a plain search over random graphs."""

import random

import pytest

from millrace.operators import graph


def plain(edges, source, target):
    """Least (weight, edges) of a path and, of these, the one through the smallest states from the target back."""
    best = {source: (0.0, 0, None)}
    changed = True
    while changed:
        changed = False
        for u, v, w in edges:
            if u in best:
                new = (best[u][0] + w, best[u][1] + 1, u)
                if v not in best or (best[v][2] is not None and new < best[v]) or (best[v][2] is None and new[:2] < best[v][:2]):
                    best[v], changed = new, True
    if target not in best:
        return None, 51.0
    path, at = [target], best[target][2]
    while at is not None:
        path.append(at)
        at = best[at][2]
    return path[::-1], best[target][0]


@pytest.mark.parametrize("weighted", [True, False])
def test_paths_equal_a_plain_search(spark, weighted):
    rng = random.Random(8)
    edges = [(g, f"s{rng.randrange(14)}", f"s{rng.randrange(14)}", float(rng.choice([0, 1, 1, 2, 3]))) for g in range(6) for _ in range(30)]
    ends = [(g, f"s{rng.randrange(15)}", f"s{rng.randrange(15)}") for g in range(6) for _ in range(5)] + [(0, "nowhere", "s1"), (0, "s2", "s2"), (9, "s1", "s2")]
    e = spark.createDataFrame(edges, "uid int, u string, v string, w double")
    got = {(r.uid, r.source, r.target): (r.path, r.d) for r in graph.shortest_paths(e, spark.createDataFrame(ends, "uid int, source string, target string"), "w" if weighted else None).collect()}
    assert len(got) == len(set(ends))
    for g, a, b in ends:
        assert got[g, a, b] == plain([(u, v, w if weighted else 1.0) for k, u, v, w in edges if k == g], a, b)


def test_no_path_and_negative_cycles(spark):
    e = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "a", -2.0)], "uid int, u string, v string, w double")
    ends = spark.createDataFrame([(1, "a", "c")], "uid int, source string, target string")
    assert [(r.path, r.d) for r in graph.shortest_paths(e, ends).collect()] == [(None, 51.0)]
    assert [(r.path, r.d) for r in graph.shortest_paths(e, ends, missing=None).collect()] == [(None, None)]
    assert graph.shortest_paths(e, ends.limit(0)).collect() == [] and len(graph.shortest_paths(e.limit(0), ends).collect()) == 1


def test_long_chain(spark):
    n = 45
    e = spark.createDataFrame([(1, k, k + 1, 1.0) for k in range(n)], "uid int, u int, v int, w double")
    got = graph.shortest_paths(e, spark.createDataFrame([(1, 0, n), (1, 7, 20)], "uid int, source int, target int"), "w").collect()
    assert {(r.source, r.d, tuple(r.path)) for r in got} == {(0, float(n), tuple(range(n + 1))), (7, 13.0, tuple(range(7, 21)))}
