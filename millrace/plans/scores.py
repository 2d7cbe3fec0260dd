"""Queries of scores, filters and remaining group operators on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import scoring as S
from millrace.operators import groupstats as G
from millrace.operators import losses as L
from millrace.operators import returns as R
from millrace.plans.registry import register
from millrace.plans.views import OUTCOMES, STEPS, TOKENS, outcomes, steps, tokens
from millrace.session import table


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


@register("a02_masked_variance", f"WITH {TOKENS}, u AS (SELECT sum(old * m) / sum(m) AS mu, sum(m) AS n FROM tok) SELECT round(sum(m * power(old - mu, 2)) / any_value(n - 1), 6) AS var FROM tok, u")
def a02(s, d):
    t = tokens(s, d).select(F.explode(F.arrays_zip("old", "mask")).alias("z")).filter("z.mask = 1")
    return t.agg(F.round(F.var_samp("z.old"), 6).alias("var"))


@register("a08_remax", f"WITH {TOKENS}, g AS (SELECT row_id, i, sum(old * m) OVER (PARTITION BY row_id ORDER BY i DESC) AS g, first_value(new) OVER (PARTITION BY row_id ORDER BY i) AS b, m FROM tok) SELECT row_id, round(sum((g - b) * m), 4) + 0.0 AS digest FROM g GROUP BY 1")
def a08(s, d):
    t = tokens(s, d).withColumn("g", R.reverse_cumsum(L.zipped(lambda x, m: x * m, F.col("old"), F.col("mask").cast("array<double>"))))
    adv = L.zipped(lambda g, m: (g - F.col("new")[0]) * m, F.col("g"), F.col("mask").cast("array<double>"))
    return t.select("row_id", r4(L.asum(adv)).alias("digest"))


@register("a09_episode_advantage", f"WITH {STEPS}, e AS (SELECT *, sum(reward) OVER (PARTITION BY traj_uid) AS total FROM steps) SELECT row_id, round((total - avg(total) OVER w) / (stddev_samp(total) OVER w + 1e-6), 4) + 0.0 AS advantage FROM e WINDOW w AS (PARTITION BY uid)")
def a09(s, d):
    e = steps(s, d).withColumn("total", F.sum("reward").over(Window.partitionBy("traj_uid")))
    return e.select("row_id", r4(G.centred(F.col("total"), "uid")).alias("advantage"))


@register("a11_joint_advantage", f"WITH {STEPS}, e AS (SELECT *, sum(reward) OVER (PARTITION BY traj_uid) AS total FROM steps) SELECT row_id, round((total - avg(total) OVER w) / (stddev_samp(total) OVER w + 1e-6) + 0.5 * CASE WHEN count(*) OVER g > 1 THEN (reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-6) ELSE 0 END, 4) + 0.0 AS advantage FROM e WINDOW w AS (PARTITION BY uid), g AS (PARTITION BY uid, anchor_obs)")
def a11(s, d):
    e = steps(s, d).withColumn("total", F.sum("reward").over(Window.partitionBy("traj_uid")))
    return G.episode_step_joint(e, "total", "reward", weight=0.5, norm=True).select("row_id", r4(F.col("advantage")).alias("advantage"))


@register("a29_coverage", f"WITH {STEPS} SELECT uid, round(sum(CASE WHEN next_obs = anchor_obs THEN reward ELSE 0 END) / sum(reward), 4) AS share FROM steps GROUP BY 1")
def a29(s, d):
    same = F.coalesce(F.col("next_obs") == F.col("anchor_obs"), F.lit(False))
    return steps(s, d).groupBy("uid").agg(r4(F.sum(F.when(same, F.col("reward")).otherwise(0)) / F.sum("reward")).alias("share"))


@register("a52_lengths", f"WITH {TOKENS} SELECT row_id, CAST(list_sum(mask[1:16]) AS BIGINT) AS prompt, CAST(list_sum(mask[17:32]) AS BIGINT) AS response FROM tokens")
def a52(s, d):
    n = lambda a, b: F.aggregate(F.slice("mask", a, b), F.lit(0).cast("long"), lambda x, y: x + y)
    return tokens(s, d).select("row_id", n(1, 16).alias("prompt"), n(17, 16).alias("response"))


@register("a66_success_by_group", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 4) AS rate FROM orders GROUP BY 1")
def a66(s, d):
    from millrace.operators.metrics import rate_by

    return rate_by(table(s, d, "orders"), F.col("o_orderstatus") == "F", "o_orderpriority").withColumn("rate", r4(F.col("rate")))


@register("a88_prime_norm", f"WITH {TOKENS}, g AS (SELECT row_id, i, old, sum(old) OVER (PARTITION BY row_id ORDER BY i DESC) AS g FROM tok) SELECT row_id, round(sum(old) / ((SELECT max(abs(g)) FROM g) + 1e-6), 4) + 0.0 AS total FROM g GROUP BY 1")
def a88(s, d):
    return G.prime_norm(tokens(s, d), "old").select("row_id", r4(L.asum(F.col("old"))).alias("total"))


@register("w13_band", f"WITH {STEPS}, r AS (SELECT row_id, avg(reward) OVER w AS m, coalesce(stddev_samp(reward) OVER w, 0) AS sd, min(reward) OVER w AS lo, max(reward) OVER w AS hi FROM steps WINDOW w AS (PARTITION BY traj_uid ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT row_id, round(greatest(m - sd, lo), 4) AS band_low, round(least(m + sd, hi), 4) AS band_high FROM r")
def w13(s, d):
    r = R.rolling(steps(s, d), "reward", 5, "step", "traj_uid")
    return r.select("row_id", r4(F.greatest(F.col("roll_mean") - F.col("roll_std"), "roll_min")).alias("band_low"), r4(F.least(F.col("roll_mean") + F.col("roll_std"), "roll_max")).alias("band_high"))


@register("w15_cumulative_accuracy", f"WITH {STEPS} SELECT row_id, round(avg(CASE WHEN reward > 50 THEN 1.0 ELSE 0 END) OVER (PARTITION BY uid ORDER BY step, row_id ROWS UNBOUNDED PRECEDING), 4) AS acc FROM steps")
def w15(s, d):
    w = Window.partitionBy("uid").orderBy("step", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return steps(s, d).select("row_id", r4(F.avg((F.col("reward") > 50).cast("double")).over(w)).alias("acc"))


@register("w24_hunk_lines", f"WITH {STEPS} SELECT row_id, 10 + coalesce(sum(CASE WHEN anchor_obs IN ('click', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY traj_uid ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM steps")
def w24(s, d):
    w = Window.partitionBy("traj_uid").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps(s, d).select("row_id", (10 + F.coalesce(F.sum(F.col("anchor_obs").isin("click", "view").cast("long")).over(w), F.lit(0))).alias("line"))


@register("p20_active_steps", f"WITH {STEPS} SELECT row_id, round(sum(reward) OVER (PARTITION BY traj_uid), 4) AS episode_reward, count(*) OVER (PARTITION BY traj_uid) AS episode_length FROM steps WHERE anchor_obs <> 'error'")
def p20(s, d):
    w = Window.partitionBy("traj_uid")
    return steps(s, d).filter("anchor_obs <> 'error'").select("row_id", r4(F.sum("reward").over(w)).alias("episode_reward"), F.count("*").over(w).alias("episode_length"))


@register("p49_unpad_offsets", f"WITH {TOKENS} SELECT row_id, CAST(sum(list_sum(mask)) OVER (PARTITION BY uid ORDER BY row_id) AS BIGINT) AS cu_seqlen FROM tokens")
def p49(s, d):
    n = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return tokens(s, d).select("row_id", F.sum(n).over(Window.partitionBy("uid").orderBy("row_id")).alias("cu_seqlen"))


@register("p52_terminal_relabel", f"WITH {STEPS} SELECT row_id, CASE WHEN step = max(step) OVER (PARTITION BY traj_uid) AND reward > 20 THEN 'success' ELSE next_obs END AS next_obs FROM steps")
def p52(s, d):
    last = F.max("step").over(Window.partitionBy("traj_uid")) == F.col("step")
    return steps(s, d).select("row_id", F.when(last & (F.col("reward") > 20), "success").otherwise(F.col("next_obs")).alias("next_obs"))


@register("p32_time_limit", "SELECT event_id FROM events WHERE event_type <> 'error'")
def p32(s, d):
    return table(s, d, "events").filter(S.time_limit_free(F.when(F.col("event_type") == "error", "traj_time_limit"))).select("event_id")


@register("p31_special_judge", "SELECT event_id, event_type = 'click' OR event_id % 4 = 1 AS spj FROM events")
def p31(s, d):
    return table(s, d, "events").select("event_id", S.special_judge(F.when(F.col("event_type") == "click", "yes").otherwise("None"), (F.col("event_id") % 4 == 1)).alias("spj"))


@register("p37_needs_rollout", "SELECT o_orderkey, o_orderstatus = 'P' OR (o_orderstatus <> 'F' AND o_custkey < 500) AS again FROM orders")
def p37(s, d):
    o = F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "P", "error").otherwise("lost")
    return table(s, d, "orders").select("o_orderkey", S.needs_rollout(o, F.col("o_custkey"), 500).alias("again"))


@register("p55_selected_tests", "SELECT p_partkey, p_size IN (1, 2) AS sel FROM part")
def p55(s, d):
    name = F.concat(F.lit("suite::t"), F.col("p_size").cast("string"))
    return table(s, d, "part").select("p_partkey", S.selected(name, S.test_names(F.lit("t1, t2"))).alias("sel"))


@register("f09_final_answer", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a FROM orders")
def f09(s, d):
    t = F.concat(F.lit("x = "), F.format_number("o_custkey", 0), F.lit(" dollars"))
    return table(s, d, "orders").select("o_orderkey", S.final_answer(t).alias("a"))


@register("f12_answer_struct", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS score, CAST(o_custkey AS VARCHAR) AS pred FROM orders")
def f12(s, d):
    x = table(s, d, "orders").select("o_orderkey", S.answer_struct(F.concat(F.lit("so\nAnswer: "), F.col("o_custkey").cast("string")), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("no")).alias("x"))
    return x.select("o_orderkey", "x.score", "x.pred")


@register("f21_proportional_span", "SELECT doc_id, CAST(least(trunc(10 * 100 / greatest(n_chars, 1)), 99) AS INT) AS a, CAST(greatest(least(ceil(50 * 100 / greatest(n_chars, 1)), 100), least(trunc(10 * 100 / greatest(n_chars, 1)), 99) + 1) AS INT) AS b FROM documents")
def f21(s, d):
    a, b = S.proportional_span(F.lit(10), F.lit(50), F.col("n_chars"), F.lit(100))
    return table(s, d, "documents").select("doc_id", a.alias("a"), b.alias("b"))


@register("f24_apply_patch", "SELECT o_orderkey, replace(o_orderpriority, '-', '+') AS content, CASE WHEN o_orderpriority LIKE '%-%' THEN NULL ELSE 'search text not found' END AS error FROM orders")
def f24(s, d):
    x = table(s, d, "orders").select("o_orderkey", S.apply_patch(F.col("o_orderpriority"), F.lit("-"), F.lit("+")).alias("x"))
    return x.select("o_orderkey", "x.content", "x.error")


@register("f44_image_reference", "SELECT p_partkey, 'docker.io/' || lower(replace(p_name, '__', '_1776_')) || ':latest' AS image FROM part")
def f44(s, d):
    return table(s, d, "part").select("p_partkey", S.image_reference(F.col("p_name")).alias("image"))


@register("f50_clip", "SELECT event_id, round(greatest(least(value, 100.0), 10.0), 4) AS v FROM events")
def f50(s, d):
    return table(s, d, "events").select("event_id", r4(S.clip(F.col("value"), F.lit(10.0), F.lit(100.0))).alias("v"))


@register("f51_log_softmax", f"WITH {TOKENS}, z AS (SELECT row_id, ln(sum(exp(old))) AS z FROM tok GROUP BY 1) SELECT tok.row_id, round(old - z, 4) AS logp FROM tok JOIN z ON tok.row_id = z.row_id WHERE i = tok.row_id % 32 + 1")
def f51(s, d):
    return tokens(s, d).select("row_id", r4(L.log_softmax_at(F.col("old"), (F.col("row_id") % 32).cast("int"))).alias("logp"))


@register("f52_kl_reward", f"WITH {TOKENS} SELECT row_id, round(sum(old - (new - ref) * 0.2), 4) + 0.0 AS total FROM tok GROUP BY 1")
def f52(s, d):
    return tokens(s, d).select("row_id", r4(L.asum(L.zipped(lambda a, b, c: S.kl_reward(a, b, c, 0.2), F.col("old"), F.col("new"), F.col("ref")))).alias("total"))


@register("f56_score_at_end", f"WITH {TOKENS} SELECT row_id, CAST(list_sum(mask) AS BIGINT) AS at FROM tokens".replace(" AS at", " AS place"))
def f56(s, d):
    n = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return tokens(s, d).select("row_id", F.array_position(L.score_at_end(F.lit(1.0), n, F.lit(32)), F.lit(1.0)).alias("place"))


@register("f58_yes_probability", "SELECT event_id, round(1 / (1 + exp(-(value / 100 - 1))), 4) AS p FROM events")
def f58(s, d):
    return table(s, d, "events").select("event_id", r4(S.yes_probability(F.col("value") / 100, F.lit(1.0))).alias("p"))


@register("f59_pass_fraction", f"WITH {STEPS} SELECT traj_uid, round(avg(CASE WHEN reward > 50 THEN 1.0 ELSE 0 END), 4) AS frac FROM steps GROUP BY 1")
def f59(s, d):
    g = steps(s, d).groupBy("traj_uid").agg(F.collect_list(F.col("reward") > 50).alias("r"))
    return g.select("traj_uid", r4(S.pass_fraction(F.col("r"))).alias("frac"))


@register("f60_shaped_reward", "SELECT event_id, round(0.5 * 10 * value / 500 + 1, 4) AS r FROM events")
def f60(s, d):
    return table(s, d, "events").select("event_id", r4(S.shaped_reward(F.col("value") / 500, F.lit(1.0), 0.5)).alias("r"))


@register("f61_improvement", f"WITH {STEPS} SELECT row_id, CASE WHEN reward > lag(reward) OVER (PARTITION BY traj_uid ORDER BY step) THEN 0.0 ELSE -0.05 END AS r FROM steps")
def f61(s, d):
    return steps(s, d).select("row_id", S.improvement_reward(F.col("reward"), F.lag("reward").over(Window.partitionBy("traj_uid").orderBy("step"))).alias("r"))


@register("f70_canonical_map", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def f70(s, d):
    m = F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.col("event_type"))
    e = table(s, d, "events").select("event_type", S.canonical_map(m).alias("k"))
    return e.groupBy("k").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n")).select("event_type", "n")


@register("f72_parse_io", "SELECT o_orderkey, 1 AS n FROM orders WHERE o_orderkey % 2 = 0")
def f72(s, d):
    t = F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"inputs": ["1"], "outputs": ["2"]}')).otherwise(F.lit('{"inputs": ["1"], "outputs": []}'))
    x = table(s, d, "orders").select("o_orderkey", S.parse_io(t).alias("x")).filter("x IS NOT NULL")
    return x.select("o_orderkey", F.size("x.inputs").alias("n"))


@register("f85_timer_totals", "SELECT event_type AS section, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def f85(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("section")).agg(r4(F.sum("value")).alias("seconds"))


@register("f90_pass_score", f"WITH {STEPS}, a AS (SELECT traj_uid, min(CASE WHEN reward > 50 THEN 1 ELSE 0 END) AS ok, avg(CASE WHEN step < 10 THEN CASE WHEN reward > 50 THEN 1.0 ELSE 0 END END) AS f FROM steps GROUP BY 1) SELECT traj_uid, round(CASE WHEN ok = 1 THEN 1 ELSE f END, 4) AS score FROM a")
def f90(s, d):
    g = steps(s, d).groupBy("traj_uid").agg(F.sort_array(F.collect_list(F.struct("step", (F.col("reward") > 50).alias("ok")))).alias("s"))
    return g.select("traj_uid", r4(S.pass_score(F.col("s")["ok"])).alias("score"))
