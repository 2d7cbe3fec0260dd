"""Queries over whole tables, against plain versions."""

import difflib

import numpy as np

from millrace.operators import graph, metrics
from millrace.plans import registry, reports  # noqa: F401
from millrace.plans.views import steps

SF = "/root/testdata/sf0.001"


def test_similar_groups_of_whole_texts(spark):
    want = {}
    heads = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        known = heads.setdefault(r.conv_id, [])
        hit = next((k for k, h in enumerate(known) if difflib.SequenceMatcher(None, r.text or "", h).ratio() >= 0.6), None)
        if hit is None:
            known.append(r.text or "")
            hit = len(known) - 1
        want[r.conv_id, r.turn] = hit
    got = {(r.conv_id, r.turn): r.cluster for r in registry.queries()["a13_similar_groups"](spark, SF).collect()}
    assert got == want


def test_bootstrap_of_all_users(spark):
    sf = "/root/testdata/sf0.01"
    values = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").avg("value").collect():
        values.setdefault(r.user_id, []).append(r[2])
    got = {r.user_id: r for r in registry.queries()["a55_bootstrap"](spark, sf).collect()}
    assert set(got) == set(values)
    for user, v in values.items():
        assert min(v) <= got[user].worst_mean <= got[user].mean_mean <= got[user].best_mean <= max(v)
    flat = spark.createDataFrame([(1, 0.0), (1, 1.0)], "k int, v double")
    state = np.random.RandomState(42)
    best = np.mean([max(state.choice(2, size=3, replace=True)) for _ in range(1000)])
    assert abs(metrics.bootstrap(flat, "v", 3, "k").first().best_mean - best) < 1e-12


def test_all_simple_paths(spark):
    e = graph.neighbours(graph.edges(steps(spark, SF))).collect()
    after = {}
    for r in e:
        after.setdefault((r.uid, r.u), []).append(r.v)
    want = set()

    def walk(uid, path):
        if path[-1] == graph.SUCCESS:
            want.add((uid, tuple(path)))
            return
        for v in after.get((uid, path[-1]), []):
            if v not in path:
                walk(uid, [*path, v])

    for uid in {r.uid for r in e}:
        walk(uid, ["view"])
    got = [(r.uid, tuple(r.path)) for r in registry.queries()["g05_simple_paths"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(len(p) for _, p in want) > 4
