"""Validation metrics against a plain loop over the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import validation as V


def plain(rows, rounds):
    """(source, variable, metric) to the mean over prompts, by loops."""
    prompts = {}
    for source, prompt, i, score, pred in sorted(rows):
        prompts.setdefault((source, prompt), []).append((score, pred))
    values = {}
    for (source, _), own in prompts.items():
        v, p, n = np.array([x for x, _ in own]), [x for _, x in own], len(own)
        add = lambda name, x, source=source: values.setdefault((source, "score", name), []).append(x)
        add(f"mean@{n}", v.mean())
        if n > 1:
            add(f"std@{n}", v.std())
        for k in V.subset_sizes(n):
            draws = V.draw_indices(n, k, rounds)
            majority = []
            for d in draws:
                votes = [p[i] for i in d]
                won = max(dict.fromkeys(votes), key=votes.count)
                majority.append(v[d[votes.index(won)]])
            for name, x in (("best", v[draws].max(1)), ("worst", v[draws].min(1)), ("maj", np.array(majority)), ("mid", np.median(v[draws], axis=1))):
                add(f"{name}@{k}/mean", x.mean())
                add(f"{name}@{k}/std", x.std())
    return {k: np.mean(x) for k, x in values.items()}


def test_equals_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{s}", f"p{p}", i, float(rng.integers(0, 9)) / 4, rng.choice(["A", "B", "C"])) for s in range(2) for p in range(5) for i in range(int(rng.integers(1, 7)))]
    df = spark.createDataFrame([(a, b, c, d, str(e)) for a, b, c, d, e in rows], "source string, prompt string, i int, score double, pred string")
    middle = {"mid": lambda v, p: (F.get(F.array_sort(v), F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(F.array_sort(v), F.floor(F.size(v) / 2).cast("int"))) / 2}
    got = {(r.source, r.variable, r.metric): r.value for r in V.validation_metrics(df, "source", "prompt", "i", ["score"], vote="pred", reducers=middle, rounds=60).collect()}
    want = plain(rows, 60)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_votes_and_means(spark):
    df = spark.createDataFrame([("a", "p", 0, 0.9, "A"), ("a", "p", 1, 0.8, "B"), ("a", "p", 2, 0.7, "A"), ("b", "q", 0, 0.8, None), ("b", "q", 1, 0.9, None), ("c", "r", 0, None, "A")], "source string, prompt string, i int, score double, pred string")
    whole = df.filter("source = 'a'").agg(F.sort_array(F.collect_list(F.struct("i", "score", "pred"))).alias("x"))
    assert whole.select(V.majority_of(F.col("x")["score"], F.col("x")["pred"]).alias("m")).first().m == 0.9
    got = {(r.source, r.metric): r.value for r in V.validation_metrics(df, "source", "prompt", "i", ["score"], vote="pred", rounds=20).collect()}
    assert got["b", "mean@2"] == pytest.approx(0.85) and got["b", "std@2"] == pytest.approx(0.05)
    assert np.isnan(got["c", "mean@1"]) and ("c", "std@1") not in got
    assert V.validation_metrics(df.limit(0), "source", "prompt", "i", ["score"]).collect() == []


def test_sizes():
    assert [V.subset_sizes(n) for n in (0, 1, 2, 3, 4, 5, 8, 9)] == [[], [], [2], [2, 3], [2, 4], [2, 4, 5], [2, 4, 8], [2, 4, 8, 9]]


def test_own_reducers_equal_those_in_columns(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 500)
    rng = np.random.default_rng(8)
    rows = [(f"s{p % 2}", f"p{p}", i, None if rng.random() < 0.05 else float(rng.integers(0, 5)), rng.choice(["A", "B", None])) for p in range(30) for i in range(int(rng.integers(1, 12)))]
    df = spark.createDataFrame(rows, "source string, prompt string, i int, score double, pred string")
    columns = {"best_c": lambda v, p: F.array_max(v), "worst_c": lambda v, p: F.array_min(v), "maj_c": V.majority_of}
    found = {(r.source, r.prompt, r.metric): r.value for r in V.prompt_metrics(df, "source", "prompt", "i", ["score"], vote="pred", reducers=columns, rounds=50).collect()}
    both = [(v, found[s, p, m.replace("_c@", "@")]) for (s, p, m), v in found.items() if "_c@" in m]
    assert len(both) > 300 and [a for a, _ in both] == pytest.approx([b for _, b in both], nan_ok=True, abs=1e-9)


def test_own_reducers_join_no_draws(spark, monkeypatch):
    monkeypatch.setattr(V, "index_tables", lambda *a: pytest.fail("draws were joined"))
    df = spark.createDataFrame([("a", "p", i, float(i), "x") for i in range(5)], "source string, prompt string, i int, score double, pred string")
    assert V.validation_metrics(df, "source", "prompt", "i", ["score"], vote="pred", rounds=20).count() == 2 + 3 * 3 * 2
