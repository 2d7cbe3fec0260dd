"""Hand-derived expectations of statistics, returns, reports, joins, graphs and streams."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import graph as GR
from millrace.operators import groupstats as G
from millrace.operators import joins as J
from millrace.operators import losses as L
from millrace.operators import metrics as M
from millrace.operators import registry as X
from millrace.operators import returns as R
from millrace.streaming import events as S


def test_group_baseline_literal(spark):
    d = spark.createDataFrame([(i, g, r) for i, (g, r) in enumerate(zip("AAAAB", [1.0, 1.0, 0.0, 0.0, 0.7]))], "row_id long, uid string, score double")
    out = d.withColumn("a", G.centred(F.col("score"), "uid", ddof=None, singleton="zero")).orderBy("row_id").collect()
    assert [r.a for r in out] == [0.5, 0.5, -0.5, -0.5, 0.0]


def test_singleton_rules(spark):
    d = spark.createDataFrame([(0, "A", 3.0)], "row_id long, uid string, score double")
    assert G.grpo(d).first().advantage == 3.0
    assert G.rloo(d).first().advantage == 3.0
    assert G.keep_mixed_groups(d, "score").count() == 0
    assert G.keep_mixed_groups(d, "score", keep_single=True).count() == 1


def test_return_to_go_and_gae(spark):
    d = spark.createDataFrame([("t", i, float(r)) for i, r in enumerate([1, 2, 3])], "traj_uid string, step int, reward double")
    assert [r.ret for r in R.return_to_go(d, 0.5).orderBy("step").collect()] == [2.75, 3.5, 3.0]
    assert [r.ret for r in R.return_to_go(d, 0.0).orderBy("step").collect()] == [1.0, 2.0, 3.0]
    a = spark.createDataFrame([([1.0, 0.0], [0.5, 0.25])], "r array<double>, v array<double>")
    got = a.select(R.gae(F.col("r"), F.col("v"), 1.0, 1.0).alias("g")).first().g
    assert got == pytest.approx([0.5, -0.25])


def test_average_tie_percentile(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double").withColumn("k", F.lit(1))
    assert sorted(r.pct for r in R.rank_percentile(d, "v", "k").collect()) == [0, 0.5, 0.5, 1]


def test_majority_first_seen_wins(spark):
    d = spark.createDataFrame([(0, "A", 0.9), (1, "B", 0.8), (2, "A", 0.7)], "i int, pred string, score double").withColumn("k", F.lit(1))
    assert M.majority(d, "pred", "score", "i", "k").first().maj == 0.9


def test_bootstrap_close(spark):
    d = spark.createDataFrame([(float(i), 1) for i in range(1, 6)], "v double, k int")
    assert abs(M.bootstrap(d, "v", 5, "k").first().mean_mean - 3.0) < 0.3


def test_balanced_partitions():
    lens = [5, 9, 1, 7, 3, 8, 2, 6]
    for f in (lambda: M.ldm_partition(lens, 4), lambda: M.ldm_partition(lens, 4, equal=True)):
        parts = f()
        sums = [sum(x for x, p in zip(lens, parts) if p == k) for k in range(4)]
        assert max(sums) - min(sums) <= 3
    assert [M.ldm_partition(lens, 4, equal=True).count(k) for k in range(4)] == [2] * 4
    assert M.greedy_partition([5, 1, 1], 2) == [0, 1, 1]


def test_greedy_dedup_enters_only_accepted_rows(spark):
    # row 1 shares key a with row 0 and is rejected, so its key q does not block row 2
    d = spark.createDataFrame([(0, "a", "p"), (1, "a", "q"), (2, "b", "q"), (3, "c", "p")], "i int, x string, y string")
    assert sorted(r.i for r in J.greedy_dedup(d, "i", "x", "y").collect()) == [0, 2]


def test_as_of_and_intervals(spark):
    l = spark.createDataFrame([(1, 5), (1, 1)], "k int, t int")  # noqa: E741
    r = spark.createDataFrame([(1, 2, "x"), (1, 5, "y")], "k int, rt int, v string")
    assert {(x.t, x.v) for x in J.as_of(l, r, "t", "rt", "v", "k").collect()} == {(5, "y"), (1, None)}
    s = spark.createDataFrame([(1, 0, 4, 2.0, 0), (1, 3, 9, 3.0, 1), (1, 9, 12, 1.0, 2)], "k int, a int, b int, s double, o int")
    assert sorted(x.o for x in J.schedule_intervals(s, "a", "b", "s", "o", "k").collect()) == [1, 2]


def test_pair_budget():
    assert len(J.pair_budget(5, -1)) == 10 and J.pair_budget(5, 0) == []
    assert len(J.pair_budget(50, 60)) == 60


def test_graph_distances_and_mandatory(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "success"), (1, "c", "a"), (1, "d", "d")], "uid long, u string, v string")
    assert {r.state: r.d for r in GR.distances_to(e).collect()} == {"success": 0, "b": 1, "a": 2, "c": 3, "d": 4}
    assert {r.mid for r in GR.mandatory_states(e, "a", "success").collect()} == {"b"}
    assert [r.path for r in GR.simple_paths(e, "a", "success").collect()] == [["a", "b", "success"]]


def test_losses(spark):
    d = spark.createDataFrame([([0.0, 0.0], [0.0, math.log(2)], [1, 1], 1.0)], "old array<double>, new array<double>, mask array<int>, advantage double")
    r = L.ppo_loss(d).first()
    assert r.pg_loss == pytest.approx(-(1 + 1.2) / 2) and r.clip_frac == pytest.approx(0.5)
    assert d.select(L.entropy(F.col("old")).alias("h")).first().h == pytest.approx(math.log(2))


def test_text_functions(spark):
    d = spark.createDataFrame([("so #### 1,234", "The Cat!", "x \\boxed{a{b}c} y", "<answer> 1 </answer><answer>2\n</answer>")], "a string, b string, c string, d string")
    r = d.select(T.strict_answer(F.col("a")).alias("a"), T.normal_answer(F.col("b")).alias("b"), T.last_boxed("c").alias("c"), T.last_tagged(F.col("d")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("1234", "cat", "a{b}c", "2")


def test_scorer_fallback(spark):
    def bad(rs, ts):
        if "x" in rs:
            raise ValueError
        return [1.0] * len(rs)

    d = spark.createDataFrame([("x", ""), ("y", "")], "r string, t string")
    assert sorted(r.s for r in d.select(X.vector_scorer(bad)(F.col("r"), F.col("t")).alias("s")).collect()) == [0.0, 1.0]
    with pytest.raises(ValueError):
        X.advantage(d, "nothing")


def test_request_states(spark):
    d = spark.createDataFrame([(1, 0, "start"), (1, 1, "tool"), (1, 2, "reply"), (1, 3, "finish"), (2, 0, "finish")], "k int, i int, e string")
    assert {r.k: r.state for r in S.request_states(d, "i", "e", "k").collect()} == {1: "completed", 2: "pending"}
