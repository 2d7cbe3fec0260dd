"""Loops that end by their own condition, against plain versions."""

from millrace.operators import graph, joins


def test_greedy_dedup_of_a_long_chain(spark):
    rows = [(k, f"a{(k + 1) // 2}", f"b{k // 2}") for k in range(75)] + [(100, None, None), (101, None, "b0"), (102, None, "z"), (103, "q", None), (104, "q", "y")]
    want, seen = [], (set(), set())
    for k, a, b in rows:
        if (a and a in seen[0]) or (b and b in seen[1]):
            continue
        want.append(k)
        seen[0].add(a)
        seen[1].add(b)
    got = sorted(r.k for r in joins.greedy_dedup(spark.createDataFrame(rows, "k long, a string, b string").coalesce(1), "k", "a", "b").collect())
    assert got == want


def test_distances_beyond_fifty_edges(spark):
    n = 58
    e = spark.createDataFrame([("g", f"s{k}", f"s{k + 1}" if k < n else graph.SUCCESS, "t", k) for k in range(n + 1)] + [("g", "x", "y", "t", 0)], "uid string, u string, v string, traj_uid string, step int").coalesce(1)
    got = {r.state: r.d for r in graph.distances_to(e).collect()}
    assert got == {graph.SUCCESS: 0, "x": n + 2, "y": n + 2} | {f"s{k}": n + 1 - k for k in range(n + 1)}
