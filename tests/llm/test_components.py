"""Components with hubs that are dealt to parts, against union-find; and no silent end."""

import random

import pytest

from millrace.llm import durable


def test_hubs_chains_and_ties(spark):
    rng = random.Random(2)
    edges = [(5, 10_000 + i) for i in range(3000)] + [(10_500, 7)] + [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(200)] + [(3, 3)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        root[hi] = lo
    got = {r.node: r.root for r in durable.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in list(root) if top(x) != x}
    with pytest.raises(RuntimeError):
        durable.components(spark.createDataFrame(edges, "u long, v long"), max_rounds=1)


def test_split_join_equals_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, i) for i in range(3)] + [(9, 0)], "k long, x long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, name string")
    hot = durable.hot_keys(left, "k")
    assert hot == [1]
    assert sorted(durable.join_split(left, right, "k", "x", hot).collect()) == sorted(left.join(right, "k").collect())
