"""Queries of batch algebra, group statistics, returns and losses on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import batch as B
from millrace.operators import groupstats as G
from millrace.operators import losses as L
from millrace.operators import returns as R
from millrace.plans.registry import register
from millrace.plans.views import OUTCOMES, STEPS, TOKENS, outcomes, steps, tokens
from millrace.session import table


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


def _events(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("row_id"), "user_id", "event_type", "value")


EV = "ev AS (SELECT event_id AS row_id, user_id, event_type, value FROM events)"


@register("m1_credit_summary", f"""WITH {STEPS},
g AS (SELECT a.traj_uid, a.step, sum(b.reward * power(0.95, b.step - a.step)) AS ret FROM steps a JOIN steps b ON a.traj_uid = b.traj_uid AND b.step >= a.step GROUP BY 1, 2),
e AS (SELECT s.*, g.ret, sum(reward) OVER (PARTITION BY s.traj_uid) AS total FROM steps s JOIN g ON s.traj_uid = g.traj_uid AND s.step = g.step),
a AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY uid) > 1 THEN total - avg(total) OVER (PARTITION BY uid) ELSE total END + CASE WHEN count(*) OVER (PARTITION BY uid, anchor_obs) > 1 THEN ret - avg(ret) OVER (PARTITION BY uid, anchor_obs) ELSE 0 END AS adv FROM e),
s AS (SELECT uid, count(*) AS n_groups, avg(c) AS m, median(c) AS md, avg(CASE WHEN c <= 1 THEN 1.0 ELSE 0.0 END) AS sr FROM (SELECT uid, anchor_obs, count(*) AS c FROM steps GROUP BY 1, 2) GROUP BY 1)
SELECT a.uid, count(*) AS n_rows, count(DISTINCT traj_uid) AS n_traj, any_value(n_groups) AS n_groups, round(any_value(m), 4) AS mean_group_size, round(any_value(md), 4) AS median_group_size, round(any_value(sr), 4) AS singleton_rate,
round(avg(adv), 4) + 0.0 AS mean_adv, round(max(adv), 4) AS max_adv, round(min(adv), 4) AS min_adv FROM a JOIN s ON a.uid = s.uid GROUP BY a.uid""")
def m1(s, d):
    e = R.return_to_go(steps(s, d), 0.95)
    total = e.groupBy("traj_uid").agg(F.sum("reward").alias("total"))
    e = G.episode_step_joint(e.join(total, "traj_uid"), "total", "ret")
    sizes = e.groupBy("uid", "anchor_obs").count().groupBy("uid").agg(F.count("*").alias("n_groups"), r4(F.avg("count")).alias("mean_group_size"), r4(F.median("count")).alias("median_group_size"), r4(F.avg((F.col("count") <= 1).cast("double"))).alias("singleton_rate"))
    a = e.groupBy("uid").agg(F.count("*").alias("n_rows"), F.countDistinct("traj_uid").alias("n_traj"), r4(F.avg("advantage")).alias("mean_adv"), r4(F.max("advantage")).alias("max_adv"), r4(F.min("advantage")).alias("min_adv"))
    return a.join(sizes, "uid")


# ---- batch algebra ----
@register("p01_select", "SELECT event_id AS row_id, value FROM events")
def p01(s, d):
    return B.select_keys(_events(s, d), ["row_id", "value"])


@register("p02_pop", "SELECT event_id AS row_id, user_id, event_type FROM events")
def p02(s, d):
    return B.pop(_events(s, d), ["value"])[1]


@register("p03_rename", "SELECT event_id AS row_id, user_id AS who, event_type AS what, value FROM events")
def p03(s, d):
    return B.rename(_events(s, d), ["user_id", "event_type"], ["who", "what"])


@register("p04_mask_filter", "SELECT event_id AS row_id, user_id, event_type, value FROM events WHERE value > 50")
def p04(s, d):
    return B.select_mask(_events(s, d), F.col("value") > 50)


@register("p05_gather", f"WITH {EV}, i AS (SELECT range AS pos, range * 37 % 500 AS row_id FROM range(1000)) SELECT pos AS row_id, user_id, event_type, value FROM i JOIN ev USING (row_id)")
def p05(s, d):
    return B.gather(_events(s, d), s.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 37 % 500).alias("row_id")))


@register("p06_slice", f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev) SELECT (row_id - (n - 700)) // 3 AS row_id, user_id, event_type, value FROM ev, n WHERE row_id >= n - 700 AND row_id < n - 10 AND (row_id - (n - 700)) % 3 = 0")
def p06(s, d):
    return B.slice_rows(_events(s, d), -700, -10, 3)


@register("p07_reorder", f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev) SELECT n - 1 - row_id AS row_id, user_id, event_type, value FROM ev, n")
def p07(s, d):
    e = _events(s, d)
    n = e.count()
    return B.reorder(e, e.select((F.lit(n - 1) - F.col("row_id")).alias("pos"), "row_id"))


@register("p08_repeat_interleaved", f"WITH {EV} SELECT row_id * 3 + range AS row_id, user_id, event_type, value FROM ev, range(3)")
def p08(s, d):
    return B.repeat(_events(s, d), 3)


@register("p08_repeat_tiled", f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev) SELECT range * n + row_id AS row_id, user_id, event_type, value FROM ev, n, range(2)")
def p08b(s, d):
    return B.repeat(_events(s, d), 2, interleave=False)


@register("p09_repeat_by_count", f"WITH {EV} SELECT row_id, range AS copy FROM ev, range(3) WHERE range < row_id % 4")
def p09(s, d):
    return B.repeat_by(_events(s, d), F.col("row_id") % 4).select("row_id", F.col("copy").cast("long").alias("copy"))


@register("p10_unfold_chunks", f"WITH {TOKENS} SELECT row_id * 4 + k AS row_id, round(list_sum(old[k * 8 + 1 : k * 8 + 8]), 4) + 0.0 AS s FROM tokens, range(4) t(k)")
def p10(s, d):
    u = B.unfold_chunks(tokens(s, d).select("row_id", "old"), 4, ["old"])
    return u.select("row_id", r4(L.asum(F.col("old"))).alias("s"))


@register("p11_fold", f"WITH {EV} SELECT row_id // 5 AS row_id, round(list_sum(list(value ORDER BY row_id)), 4) AS s, count(*) AS n, round(first(value ORDER BY row_id), 4) AS head FROM ev GROUP BY 1")
def p11(s, d):
    f = B.fold(_events(s, d), 5, "value")
    return f.select("row_id", r4(L.asum(F.col("value"))).alias("s"), F.size("value").cast("long").alias("n"), r4(F.col("value")[0]).alias("head"))


@register("p12_unfold", "SELECT event_id AS row_id, value FROM events")
def p12(s, d):
    return B.unfold(B.fold(_events(s, d), 5, "value"), 5, "value")


@register("p13_pad_to_divisor", f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev) SELECT row_id, value FROM ev UNION ALL SELECT n + range, value FROM n, range(7), ev WHERE range < (7 - n % 7) % 7 AND ev.row_id = range % n")
def p13(s, d):
    return B.pad_to_divisor(_events(s, d).select("row_id", "value"), 7)[0]


@register("p14_unpad", f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev) SELECT row_id, value FROM ev, n WHERE row_id < n - 3")
def p14(s, d):
    return B.unpad(_events(s, d).select("row_id", "value"), 3)


@register("p15_pad_repeat", f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev) SELECT row_id, value FROM ev UNION ALL SELECT n + range, value FROM n, ev, range(4) WHERE row_id = n - 1")
def p15(s, d):
    return B.pad_repeat(_events(s, d).select("row_id", "value"), 4, "last")


@register("p16_chunk", f"WITH {EV} SELECT row_id, ntile(7) OVER (ORDER BY row_id) - 1 AS chunk FROM ev")
def p16(s, d):
    return B.chunk(_events(s, d), 7).select("row_id", F.col("chunk").cast("long").alias("chunk"))


@register("p17_mini_batches", "SELECT range AS epoch, event_id AS row_id, event_id // 64 AS batch FROM events, range(2)")
def p17(s, d):
    return B.mini_batches(_events(s, d).select("row_id"), 64, 2).select(F.col("epoch").cast("long").alias("epoch"), "row_id", "batch")


@register("p41_position_ids", f"WITH {TOKENS} SELECT row_id, list_sum(list_transform(range(1, 33), lambda i: greatest(list_sum(mask[1:i]) - 1, 0) * i)) AS digest FROM tokens")
def p41(s, d):
    p = B.position_ids(F.col("mask"))
    return tokens(s, d).select("row_id", F.aggregate(F.transform(p, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("digest"))


@register("p42_response_mask", f"WITH {TOKENS} SELECT row_id, list_sum(mask[17:32]) AS n FROM tokens")
def p42(s, d):
    return tokens(s, d).select("row_id", F.aggregate(B.response_mask(F.col("mask"), 16), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@register("p43_eos_mask", f"WITH {TOKENS}, q AS (SELECT row_id, list_transform(old, lambda x: CAST(floor(x * 20) AS INT)) AS ids FROM tokens) SELECT row_id, least(coalesce(nullif(list_position(ids, 0), 0), 32), coalesce(nullif(list_position(ids, 2), 0), 32)) AS n FROM q")
def p43(s, d):
    ids = F.transform("old", lambda x: F.floor(x * 20).cast("int"))
    return tokens(s, d).select("row_id", F.aggregate(B.eos_mask(ids, [0, 2]), F.lit(0), lambda a, x: a + x).alias("n"))


@register("p44_pad_or_cut", f"WITH {TOKENS}, q AS (SELECT row_id, list_filter(mask, lambda m: m = 1) AS a FROM tokens) SELECT row_id, len(a) AS n, 20 AS size, least(len(a), 20) AS ones FROM q")
def p44(s, d):
    ones = F.filter("mask", lambda m: m == 1)
    out = B.pad_or_cut(ones, 20, F.lit(0), "right", True)
    return tokens(s, d).select("row_id", F.size(ones).alias("n"), F.size(out).alias("size"), F.aggregate(out, F.lit(0), lambda a, x: a + x).alias("ones"))


@register("p45_strip_left_padding", f"WITH {TOKENS} SELECT row_id, round(list_sum(old[33 - list_sum(mask) : 32]), 4) + 0.0 AS s FROM tokens")
def p45(s, d):
    return tokens(s, d).select("row_id", r4(L.asum(B.strip_left_padding(F.col("old"), F.col("mask")))).alias("s"))


@register("p46_sft_loss_mask", f"WITH {TOKENS} SELECT row_id, CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN i < 4 OR i = 19 THEN 0 ELSE mask[i + 1] END)) AS BIGINT) AS n FROM tokens")
def p46(s, d):
    return tokens(s, d).select("row_id", F.aggregate(B.sft_loss_mask(F.col("mask"), F.lit(5), F.lit(15)), F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


@register("p50_micro_batches", "SELECT event_id AS row_id, event_id // 16 AS micro_batch FROM events")
def p50(s, d):
    return B.micro_batches(_events(s, d).select("row_id"), 16)


@register("p51_inverse_permutation", "SELECT event_id * 7 % 10007 AS row_id, event_id AS pos FROM events")
def p51(s, d):
    return B.inverse_permutation(_events(s, d).select("row_id", (F.col("row_id") * 7 % 10007).alias("pos")))


@register("j01_union_columns", "SELECT event_id AS row_id, user_id, event_type, value, value * 2 AS double_value FROM events")
def j01(s, d):
    e = _events(s, d)
    return B.union_columns(e, e.select("row_id", "user_id", (F.col("value") * 2).alias("double_value")))


@register("u01_concat", "SELECT event_id AS row_id, value FROM events WHERE value < 10 UNION ALL SELECT event_id, value FROM events WHERE value > 100")
def u01(s, d):
    e = _events(s, d).select("row_id", "value")
    return B.concat([e.filter("value < 10"), e.filter("value > 100")])


# ---- group statistics ----
@register("a04_grpo_advantage", f"WITH {OUTCOMES} SELECT uid, step, round(CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) ELSE score END, 4) + 0.0 AS advantage FROM outcomes WINDOW w AS (PARTITION BY uid)")
def a04(s, d):
    return G.grpo(outcomes(s, d)).select("uid", "step", r4(F.col("advantage")).alias("advantage"))


@register("a04_first_row_statistics", f"WITH {STEPS}, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY uid, traj_uid ORDER BY row_id) = 1 THEN reward END AS s FROM steps) SELECT row_id, round(CASE WHEN count(s) OVER w > 1 THEN (reward - avg(s) OVER w) / (stddev_samp(s) OVER w + 1e-6) ELSE reward END, 4) + 0.0 AS advantage FROM f WINDOW w AS (PARTITION BY uid)")
def a04b(s, d):
    return G.first_rows_stats(steps(s, d), "reward", "uid", "traj_uid", "row_id").select("row_id", r4(F.col("advantage")).alias("advantage"))


@register("a05_grpo_pass_at_k", f"WITH {OUTCOMES}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, price, part) AS r, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM outcomes) SELECT uid, price, part, round(CASE WHEN r = 1 THEN coalesce((score - max(CASE WHEN r = 2 THEN score END) OVER (PARTITION BY uid)) / (sd + 1e-6), 0) ELSE 0 END, 4) + 0.0 AS advantage FROM r")
def a05(s, d):
    o = outcomes(s, d).withColumn("key", F.struct("price", "part"))
    return G.pass_at_k(o, order="key").select("uid", "price", "part", r4(F.col("advantage")).alias("advantage"))


@register("a06_rfpp_baseline", f"WITH {OUTCOMES}, c AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN score - avg(score) OVER w ELSE score END AS c FROM outcomes WINDOW w AS (PARTITION BY uid)) SELECT uid, price, part, round((c - (SELECT avg(c) FROM c)) / sqrt((SELECT var_samp(c) FROM c) + 1e-8), 4) + 0.0 AS advantage FROM c")
def a06(s, d):
    return G.rfpp_baseline(outcomes(s, d)).select("uid", "price", "part", r4(F.col("advantage")).alias("advantage"))


@register("a07_rloo", f"WITH {OUTCOMES} SELECT uid, price, part, round(CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE score END, 4) + 0.0 AS advantage FROM outcomes WINDOW w AS (PARTITION BY uid)")
def a07(s, d):
    return G.rloo(outcomes(s, d)).select("uid", "price", "part", r4(F.col("advantage")).alias("advantage"))


@register("a10_step_advantage", f"WITH {STEPS} SELECT row_id, round(CASE WHEN count(*) OVER w > 1 THEN (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-6) ELSE 0 END, 4) + 0.0 AS advantage FROM steps WINDOW w AS (PARTITION BY uid, anchor_obs)")
def a10(s, d):
    return steps(s, d).select("row_id", r4(G.centred(F.col("reward"), "uid", "anchor_obs", singleton="zero")).alias("advantage"))


@register("a12_anchor_groups", f"WITH {STEPS} SELECT uid, anchor_obs, count(*) AS n, min(row_id) AS group_id FROM steps GROUP BY 1, 2")
def a12(s, d):
    return steps(s, d).groupBy("uid", "anchor_obs").agg(F.count("*").alias("n"), F.min("row_id").alias("group_id"))


@register("a14_history_groups", f"""WITH {STEPS}, h AS (SELECT *, list(anchor_obs) OVER (PARTITION BY uid, traj_uid ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h FROM steps),
x AS (SELECT uid, traj_uid, step, reward, k, array_to_string(h[len(h) - k + 1 : len(h)], '|') AS key FROM h, range(1, 4) t(k) WHERE k <= len(h)),
a AS (SELECT uid, traj_uid, step, k + 1.0 AS w, CASE WHEN count(*) OVER g > 1 THEN (reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6) ELSE 0 END AS a FROM x WINDOW g AS (PARTITION BY uid, k, key))
SELECT uid, traj_uid, step, round(coalesce(sum(w * a) FILTER (a <> 0), 0) / (coalesce(sum(w) FILTER (a <> 0), 0) + 1e-6), 4) + 0.0 AS advantage FROM a GROUP BY 1, 2, 3""")
def a14(s, d):
    return G.history_groups(steps(s, d)).select("uid", "traj_uid", "step", r4(F.col("advantage")).alias("advantage"))


@register("a16_group_baseline", f"WITH {STEPS} SELECT row_id, round(CASE WHEN count(*) OVER w > 1 THEN (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) ELSE 0 END, 4) + 0.0 AS advantage FROM steps WINDOW w AS (PARTITION BY uid, anchor_obs)")
def a16(s, d):
    return steps(s, d).select("row_id", r4(G.centred(F.col("reward"), "uid", "anchor_obs", ddof=0, singleton="zero")).alias("advantage"))


@register("a18_groupability", f"WITH {OUTCOMES}, g AS (SELECT uid, avg(score) AS size, count(*) AS n FROM outcomes GROUP BY 1) SELECT uid, round((1 - exp(-size / 8)) * CASE WHEN n > 1 THEN 1 - exp(-(n - 1) / 8) ELSE 0 END, 4) AS gs FROM g")
def a18(s, d):
    g = outcomes(s, d).groupBy("uid").agg(F.avg("score").alias("size"), F.count("*").alias("n"))
    return g.select("uid", r4(G.groupability(F.col("size"), F.col("n"))).alias("gs"))


@register("a21_largest_per_row", f"WITH {OUTCOMES} SELECT uid, score, part FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, part, price) AS r FROM outcomes) WHERE r = 1")
def a21(s, d):
    b = outcomes(s, d).groupBy("uid").agg(F.max(F.struct("score", (-F.col("part")).alias("m"))).alias("b"))
    return b.select("uid", "b.score", (-F.col("b.m")).alias("part"))


@register("a26_group_sizes", f"WITH {OUTCOMES}, g AS (SELECT count(*) AS c FROM outcomes GROUP BY uid) SELECT count(*) AS n_groups, round(avg(c), 4) AS mean_size, median(c) AS median_size, round(avg(CASE WHEN c <= 1 THEN 1.0 ELSE 0.0 END), 4) AS singleton_rate FROM g")
def a26(s, d):
    g = G.group_size_summary(outcomes(s, d), "uid")
    return g.select("n_groups", r4(F.col("mean_size")).alias("mean_size"), "median_size", r4(F.col("singleton_rate")).alias("singleton_rate"))


@register("a27_group_size_histogram", f"WITH {OUTCOMES}, g AS (SELECT count(*) AS c FROM outcomes GROUP BY uid) SELECT CASE WHEN c <= 8 THEN CAST(c AS VARCHAR) WHEN c <= 16 THEN '9-16' ELSE '17+' END AS bucket, count(*) AS n_groups FROM g GROUP BY 1")
def a27(s, d):
    return G.group_size_histogram(outcomes(s, d), "uid")


@register("a28_rollup", f"WITH {STEPS} SELECT uid, anchor_obs, count(*) AS n, round(avg(reward), 4) AS mean_reward FROM steps GROUP BY ROLLUP (uid, anchor_obs)")
def a28(s, d):
    return steps(s, d).rollup("uid", "anchor_obs").agg(F.count("*").alias("n"), r4(F.avg("reward")).alias("mean_reward"))


@register("a30_size_distribution", f"WITH {OUTCOMES}, g AS (SELECT count(*) AS c FROM outcomes GROUP BY uid), m AS (SELECT max(c) AS m, count(*) AS t FROM g), z AS (SELECT c, count(*) AS n FROM g GROUP BY 1) SELECT r.range AS size, coalesce(n, 0) AS n_groups, round(coalesce(n, 0) / t, 4) AS share FROM m, range(1, 100) r LEFT JOIN z ON z.c = r.range WHERE r.range <= m")
def a30(s, d):
    sizes = outcomes(s, d).groupBy("uid").count().groupBy(F.col("count").alias("size")).agg(F.count("*").alias("n"))
    x = sizes.agg(F.max("size").alias("m"), F.sum("n").alias("t")).first()
    return s.range(1, x.m + 1).withColumnRenamed("id", "size").join(sizes, "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n_groups"), r4(F.coalesce("n", F.lit(0)) / x.t).alias("share"))


@register("a32_consecutive_rloo", f"WITH {EV} SELECT row_id, round(value - (sum(value) OVER w - value) / greatest(count(*) OVER w - 1, 1), 4) + 0.0 AS advantage FROM ev WINDOW w AS (PARTITION BY row_id // 4)")
def a32(s, d):
    return G.consecutive_rloo(_events(s, d), "value", 4).select("row_id", r4(F.col("advantage")).alias("advantage"))


@register("a33_ce_loss", "SELECT round(avg(-(y * ln(1 / (1 + exp(-x))) + (1 - y) * ln(1 - 1 / (1 + exp(-x))))), 4) AS loss FROM (SELECT value / 200 - 1 AS x, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y FROM events)")
def a33(s, d):
    return _events(s, d).agg(r4(F.avg(L.ce_loss(F.col("value") / 200 - 1, (F.col("event_type") == "click").cast("double")))).alias("loss"))


@register("a35_pairwise_accuracy", f"""WITH {EV}, p AS (SELECT a.row_id // 4 AS g, abs(CAST(a.t AS INT) - CAST(b.t AS INT)) AS gap, CASE WHEN (a.value - b.value) * (CAST(a.t AS INT) - CAST(b.t AS INT)) > 0 THEN 1.0 ELSE 0.0 END AS hit
 FROM (SELECT *, event_type = 'click' AS t FROM ev) a LEFT JOIN (SELECT *, event_type = 'click' AS t FROM ev) b ON a.row_id // 4 = b.row_id // 4 AND a.row_id < b.row_id)
SELECT g AS group_id, round(CASE WHEN coalesce(sum(gap), 0) = 0 THEN 0.5 ELSE sum(gap * hit) / sum(gap) END, 4) AS accuracy FROM p GROUP BY 1""")
def a35(s, d):
    e = _events(s, d).withColumn("acc", (F.col("event_type") == "click").cast("double"))
    return G.pairwise_accuracy(e, "value", "acc", 4).select("group_id", r4(F.col("accuracy")).alias("accuracy"))


@register("a36_sign_accuracy", "SELECT round(avg(CASE WHEN sign(value - 50) = sign(CASE WHEN event_type = 'click' THEN 0.5 ELSE -0.5 END) THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM events")
def a36(s, d):
    label = F.when(F.col("event_type") == "click", 0.5).otherwise(-0.5)
    return _events(s, d).agg(r4(F.avg((F.signum(F.col("value") - 50) == F.signum(label)).cast("double"))).alias("accuracy"))


@register("a37_soft_mean", "SELECT event_id AS row_id, round(value - (ln(avg(exp(0.05 * value - 25)) OVER ()) + 25) / 0.05, 4) + 0.0 AS advantage FROM events")
def a37(s, d):
    return G.soft_mean_baseline(_events(s, d), "value", 0.05).select("row_id", r4(F.col("advantage")).alias("advantage"))


@register("a38_preference_pairs", f"WITH {EV} SELECT row_id, row_number() OVER (PARTITION BY row_id // 2 ORDER BY value DESC, row_id) = 1 AS chosen FROM ev")
def a38(s, d):
    return G.preference_pairs(_events(s, d), "value").select("row_id", "chosen")


@register("a39_dpo_loss", f"WITH {TOKENS}, p AS (SELECT row_id, 0.5 * ((list_sum(old) - list_sum(new)) - (list_sum(ref) - list_sum(old))) AS x FROM tokens) SELECT round(avg(-ln(1 / (1 + exp(-x))) * 0.9 - ln(1 / (1 + exp(x))) * 0.1), 4) AS loss FROM p")
def a39(s, d):
    t = tokens(s, d)
    o, n, r = (L.asum(F.col(c)) for c in ("old", "new", "ref"))
    return t.agg(r4(F.avg(L.dpo_loss(o, n, r, o, 0.5, 0.1))).alias("loss"))


@register("a40_sequence_logps", f"WITH {TOKENS} SELECT row_id, round(sum(old * m), 4) + 0.0 AS total, round(sum(old * m) / sum(m), 4) + 0.0 AS mean FROM tok GROUP BY 1")
def a40(s, d):
    x = L.masked_sum(F.col("old"), F.col("mask"))
    return tokens(s, d).select("row_id", r4(x).alias("total"), r4(x / L.asum(F.col("mask").cast("array<double>"))).alias("mean"))


@register("a01_masked_mean", f"WITH {TOKENS} SELECT row_id, round(sum(old * m) / (sum(m) + 1e-8), 4) + 0.0 AS mean, round(sum(m * power(old - mu, 2)) / (sum(m) - 1), 4) AS var FROM (SELECT *, sum(old * m) OVER (PARTITION BY row_id) / sum(m) OVER (PARTITION BY row_id) AS mu FROM tok) GROUP BY 1")
def a01(s, d):
    n, x, m = L.asum(F.col("mask").cast("array<double>")), F.col("old"), F.col("mask")
    t = tokens(s, d).withColumn("mu", L.masked_sum(x, m) / n)
    return t.select("row_id", r4(L.masked_sum(x, m) / (n + 1e-8)).alias("mean"), r4(L.masked_sum(F.transform(x, lambda v: (v - F.col("mu")) ** 2), m) / (n - 1)).alias("var"))


@register("a03_whiten", "SELECT event_id AS row_id, round((value - avg(value) OVER ()) / sqrt(var_samp(value) OVER () + 1e-8), 4) + 0.0 AS whitened FROM events")
def a03(s, d):
    return G.whiten(_events(s, d), "value").select("row_id", r4(F.col("whitened")).alias("whitened"))


for _mode, _sql in {
    "token-mean": "sum(x) / (sum(n) + 1e-8)", "seq-mean-token-sum": "avg(x)", "seq-mean-token-mean": "avg(x / (n + 1e-8))", "seq-mean-token-sum-norm": "sum(x) / 32",
}.items():

    @register(f"a41_loss_{_mode.replace('-', '_')}", f"WITH {TOKENS}, q AS (SELECT row_id, sum(old * m) AS x, sum(m) AS n FROM tok GROUP BY 1) SELECT round({_sql}, 6) AS loss FROM q")
    def a41(s, d, mode=_mode):
        t = tokens(s, d)
        return t.agg(F.round(L.token_loss(t, F.col("old"), F.col("mask"), mode), 6).alias("loss"))


@register("a42_ppo_loss", f"""WITH {TOKENS}, t AS (SELECT m, old - new AS kl, advantage AS a, exp(new - old) AS r FROM tok), p AS (SELECT *, -a * r AS p, -a * greatest(least(r, 1.2), 0.8) AS c, -a * 3 AS f FROM t), w AS (SELECT *, greatest(p, c) AS w FROM p)
SELECT round(sum(m * CASE WHEN a < 0 THEN least(w, f) ELSE w END) / (sum(m) + 1e-8), 4) AS pg_loss, round(sum(m * CASE WHEN c > p THEN 1.0 ELSE 0 END) / (sum(m) + 1e-8), 4) AS clip_frac, round(sum(m * CASE WHEN w > f AND a < 0 THEN 1.0 ELSE 0 END) / (sum(m) + 1e-8), 4) AS clip_frac_low, round(sum(m * kl) / (sum(m) + 1e-8), 4) + 0.0 AS approx_kl FROM w""")
def a42(s, d):
    x = L.ppo_loss(tokens(s, d))
    return x.select(*(r4(F.col(c)).alias(c) for c in x.columns))


@register("a43_gspo_loss", f"WITH {TOKENS}, q AS (SELECT row_id, any_value(advantage) AS a, exp(sum((new - old) * m) / sum(m)) AS r FROM tok GROUP BY 1) SELECT round(avg(greatest(-a * r, -a * greatest(least(r, 1 + 4e-4), 1 - 3e-4))), 4) AS pg_loss FROM q")
def a43(s, d):
    return L.gspo_loss(tokens(s, d)).select(r4(F.col("pg_loss")).alias("pg_loss"))


@register("a44_value_loss", f"WITH {TOKENS}, c AS (SELECT m, power(new - ref, 2) AS p, power(greatest(least(new, old + 0.1), old - 0.1) - ref, 2) AS c FROM tok) SELECT round(sum(m * greatest(p, c)) / (sum(m) + 1e-8), 4) AS vf_loss, round(sum(m * CASE WHEN c > p THEN 1.0 ELSE 0 END) / (sum(m) + 1e-8), 4) AS clip_frac FROM c")
def a44(s, d):
    x = L.value_loss(tokens(s, d), "new", "old", "ref", "mask", 0.1)
    return x.select(*(r4(F.col(c)).alias(c) for c in x.columns))


@register("a45_entropy", f"WITH {TOKENS} SELECT row_id, round(ln(sum(exp(old))) - sum(exp(old) * old) / sum(exp(old)), 4) AS entropy FROM tok GROUP BY 1")
def a45(s, d):
    return tokens(s, d).select("row_id", r4(L.entropy(F.col("old"))).alias("entropy"))


@register("a46_kl", f"WITH {TOKENS} SELECT row_id, round(sum(new - ref), 4) + 0.0 AS k1, round(sum(abs(new - ref)), 4) AS abs, round(sum(0.5 * power(new - ref, 2)), 4) AS k2, round(sum(exp(ref - new) - (ref - new) - 1), 4) AS k3 FROM tok GROUP BY 1")
def a46(s, d):
    return tokens(s, d).select("row_id", *(r4(L.asum(L.zipped(lambda a, b, k=k: L.kl(a, b, k), F.col("new"), F.col("ref")))).alias(k) for k in ("k1", "abs", "k2", "k3")))


@register("a47_kl_in_reward", f"WITH {TOKENS} SELECT row_id, round(sum(old - 0.1 * (new - ref) * m), 4) AS total, round(sum((new - ref) * m) / (sum(m) + 1e-8), 4) + 0.0 AS mean_kl FROM tok GROUP BY 1")
def a47(s, d):
    x = L.kl_in_reward(tokens(s, d), 0.1, "old", "new", "ref", "mask")
    return x.select("row_id", r4(L.asum(F.col("token_rewards"))).alias("total"), r4(F.col("mean_kl")).alias("mean_kl"))


@register("a48_invalid_penalty", f"WITH {TOKENS} SELECT row_id, round(sum(old) - CASE WHEN row_id % 3 = 0 THEN 0.1 ELSE 0 END, 4) + 0.0 AS total FROM tok GROUP BY 1")
def a48(s, d):
    n = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    return tokens(s, d).select("row_id", r4(L.asum(L.penalise_invalid(F.col("old"), n, F.col("row_id") % 3 != 0, 0.1))).alias("total"))


@register("a49_resampling_weights", "SELECT event_id AS row_id, round(1e6 * power(abs(value), 2) / sum(power(abs(value), 2)) OVER (), 4) AS weight FROM events")
def a49(s, d):
    return G.weights_pf(_events(s, d), "value").select("row_id", r4(1e6 * F.col("weight")).alias("weight"))


@register("p34_mixed_groups", f"WITH {OUTCOMES} SELECT uid, price, part FROM (SELECT *, min(score) OVER (PARTITION BY uid) < max(score) OVER (PARTITION BY uid) AS k FROM outcomes) WHERE k")
def p34(s, d):
    return G.keep_mixed_groups(outcomes(s, d), "score").select("uid", "price", "part")


@register("p35_mixed_or_single", f"WITH {OUTCOMES} SELECT uid, price, part FROM (SELECT *, min(score) OVER (PARTITION BY uid) < max(score) OVER (PARTITION BY uid) OR count(*) OVER (PARTITION BY uid) = 1 AS k FROM outcomes) WHERE k")
def p35(s, d):
    return G.keep_mixed_groups(outcomes(s, d), "score", keep_single=True).select("uid", "price", "part")


@register("p33_accuracy_band", f"WITH {STEPS}, g AS (SELECT traj_uid, avg(CASE WHEN reward > 50 THEN 1.0 ELSE 0 END) AS a FROM steps GROUP BY 1), t AS (SELECT traj_uid FROM g ORDER BY CASE WHEN a >= 0.2 AND a <= 0.4 THEN 1 ELSE 0 END DESC, traj_uid LIMIT 40) SELECT row_id FROM steps WHERE traj_uid IN (SELECT traj_uid FROM t)")
def p33(s, d):
    e = steps(s, d).withColumn("acc", (F.col("reward") > 50).cast("double"))
    return G.filter_by_band(e, "acc", "traj_uid", 0.2, 0.4, 40).select("row_id")


# ---- returns and windows ----
@register("w01_return_to_go", f"WITH {STEPS} SELECT a.row_id, round(sum(b.reward * power(0.9, b.step - a.step)), 3) AS ret FROM steps a JOIN steps b ON a.traj_uid = b.traj_uid AND b.step >= a.step GROUP BY 1")
def w01(s, d):
    return R.return_to_go(steps(s, d), 0.9).select("row_id", F.round("ret", 3).alias("ret"))


@register("w02_reverse_cumsum", f"WITH {TOKENS} SELECT row_id, round(sum(old * i), 4) + 0.0 AS digest FROM tok GROUP BY 1")
def w02(s, d):
    return tokens(s, d).select("row_id", r4(L.asum(R.reverse_cumsum(F.col("old")))).alias("digest"))


@register("w03_masked_returns", f"WITH {TOKENS}, p AS (SELECT a.row_id, a.i, sum(b.old * power(0.9, b.i - a.i)) AS g FROM tok a JOIN tok b ON a.row_id = b.row_id AND b.i >= a.i AND b.m = 1 WHERE a.m = 1 GROUP BY 1, 2) SELECT row_id, round(sum(g), 4) + 0.0 AS digest FROM p GROUP BY 1")
def w03(s, d):
    return tokens(s, d).select("row_id", r4(L.asum(R.masked_returns(F.col("old"), F.col("mask"), 0.9))).alias("digest"))


@register("w04_gae", f"WITH {TOKENS}, dl AS (SELECT row_id, i, old + 0.9 * coalesce(lead(new) OVER (PARTITION BY row_id ORDER BY i), 0) - new AS dl FROM tok), p AS (SELECT a.row_id, a.i, sum(b.dl * power(0.9 * 0.8, b.i - a.i)) AS g FROM dl a JOIN dl b ON a.row_id = b.row_id AND b.i >= a.i GROUP BY 1, 2) SELECT row_id, round(sum(g), 4) + 0.0 AS digest FROM p GROUP BY 1")
def w04(s, d):
    return tokens(s, d).select("row_id", r4(L.asum(R.gae(F.col("old"), F.col("new"), 0.9, 0.8))).alias("digest"))


@register("w07_position", f"WITH {STEPS} SELECT row_id, step FROM steps")
def w07(s, d):
    return steps(s, d).select("row_id", "step")


@register("w08_first_per_key", f"WITH {STEPS} SELECT traj_uid, row_id, reward FROM steps WHERE step = 0")
def w08(s, d):
    return R.first_per_key(steps(s, d), "step", "traj_uid").select("traj_uid", "row_id", "reward")


@register("w09_rank_percentile", f"WITH {STEPS} SELECT row_id, round(CASE WHEN count(*) OVER w > 1 THEN (rank() OVER (PARTITION BY uid ORDER BY round(reward)) + (count(*) OVER (PARTITION BY uid, round(reward)) - 1) / 2 - 1) / (count(*) OVER w - 1) ELSE 0.5 END, 4) AS pct FROM steps WINDOW w AS (PARTITION BY uid)")
def w09(s, d):
    return R.rank_percentile(steps(s, d).withColumn("v", F.round("reward")), "v", "uid").select("row_id", r4(F.col("pct")).alias("pct"))


@register("w11_rolling", f"WITH {STEPS} SELECT row_id, round(avg(reward) OVER w, 4) AS roll_mean, min(reward) OVER w AS roll_min, max(reward) OVER w AS roll_max, round(coalesce(stddev_samp(reward) OVER w, 0), 4) AS roll_std FROM steps WINDOW w AS (PARTITION BY traj_uid ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def w11(s, d):
    return R.rolling(steps(s, d), "reward", 5, "step", "traj_uid").select("row_id", r4(F.col("roll_mean")).alias("roll_mean"), "roll_min", "roll_max", r4(F.col("roll_std")).alias("roll_std"))


@register("w12_ema", f"WITH RECURSIVE {STEPS}, e AS (SELECT traj_uid, step, reward AS y FROM steps WHERE step = 0 UNION ALL SELECT s.traj_uid, s.step, 0.3 * s.reward + 0.7 * e.y FROM e JOIN steps s ON s.traj_uid = e.traj_uid AND s.step = e.step + 1) SELECT traj_uid, round(sum(y), 3) AS digest, round(arg_max(y, step), 4) AS last FROM e GROUP BY 1")
def w12(s, d):
    g = steps(s, d).groupBy("traj_uid").agg(F.sort_array(F.collect_list(F.struct("step", "reward"))).alias("s"))
    g = g.withColumn("e", R.ema(F.transform("s", lambda x: x["reward"]), 0.3))
    return g.select("traj_uid", F.round(L.asum(F.col("e")), 3).alias("digest"), r4(F.element_at("e", -1)).alias("last"))


@register("w14_prefix_rate", f"WITH {STEPS} SELECT row_id, round(coalesce(avg(CASE WHEN reward > 50 THEN 1.0 ELSE 0 END) OVER (PARTITION BY traj_uid ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS prefix_rate FROM steps")
def w14(s, d):
    e = steps(s, d).withColumn("hit", F.col("reward") > 50)
    return R.prefix_rate(e, "hit", "step", "traj_uid").select("row_id", r4(F.col("prefix_rate")).alias("prefix_rate"))


@register("w16_longest_run", f"WITH {STEPS}, g AS (SELECT traj_uid, anchor_obs, step - row_number() OVER (PARTITION BY traj_uid, anchor_obs ORDER BY step) AS i FROM steps) SELECT traj_uid, max(c) AS longest_run FROM (SELECT traj_uid, count(*) AS c FROM g GROUP BY traj_uid, anchor_obs, i) GROUP BY 1")
def w16(s, d):
    return R.longest_run(steps(s, d), "anchor_obs", "step", "traj_uid")


@register("w17_history", f"WITH {STEPS} SELECT row_id, array_to_string(list('[step ' || step || '] ' || anchor_obs) OVER (PARTITION BY traj_uid ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' ') AS history FROM steps")
def w17(s, d):
    return R.history_text(steps(s, d), "anchor_obs", 3, "step", "traj_uid", sep=" ").select("row_id", "history")


@register("w18_changed", f"WITH {STEPS} SELECT row_id, coalesce(lag(next_obs) OVER w <> next_obs, lag(next_obs) OVER w IS NULL) AS changed FROM steps WHERE next_obs IS NOT NULL WINDOW w AS (PARTITION BY traj_uid, anchor_obs ORDER BY step)")
def w18(s, d):
    return R.changed_since_last(steps(s, d).filter("next_obs IS NOT NULL"), "next_obs", "step", "traj_uid", "anchor_obs").select("row_id", "changed")


@register("w19_running_offsets", "SELECT conv_id, turn, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start_at, CAST(sum(length(text)) OVER w AS BIGINT) AS end_at FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w19(s, d):
    c = table(s, d, "conversations").withColumn("n", F.length("text"))
    return R.running_offsets(c, "n", "turn", "conv_id").select("conv_id", "turn", "start_at", "end_at")


@register("w20_modal_first_state", f"WITH {STEPS}, c AS (SELECT uid, anchor_obs, count(*) AS n FROM steps WHERE step = 0 GROUP BY 1, 2) SELECT uid, anchor_obs AS first_state FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, anchor_obs) AS r FROM c) WHERE r = 1")
def w20(s, d):
    return R.modal_first_state(steps(s, d), "anchor_obs", "step", "traj_uid", "uid")


@register("w22_last_per_key", f"WITH {STEPS} SELECT uid, anchor_obs, max(row_id) AS row_id FROM steps GROUP BY 1, 2")
def w22(s, d):
    return R.last_per_key(steps(s, d), "row_id", "uid", "anchor_obs").select("uid", "anchor_obs", "row_id")


@register("w23_stitch", "SELECT event_id AS step, value FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id % 100 = 77) UNION ALL SELECT event_id, -value FROM events WHERE event_id % 100 = 77")
def w23(s, d):
    e = _events(s, d).select(F.col("row_id").alias("step"), "value")
    return R.stitch(e, e.filter("step % 100 = 77").withColumn("value", -F.col("value")))


@register("w25_error_spread", f"WITH {STEPS}, x AS (SELECT *, CASE WHEN anchor_obs = 'error' AND reward > 100 THEN -4 ELSE 1 END AS st FROM steps) SELECT row_id, CASE WHEN coalesce(max(CASE WHEN st = -4 THEN 1 ELSE 0 END) OVER (PARTITION BY traj_uid ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN -4 ELSE st END AS status FROM x")
def w25(s, d):
    e = steps(s, d).withColumn("status", F.when((F.col("anchor_obs") == "error") & (F.col("reward") > 100), -4).otherwise(1))
    return R.error_spread(e, "status", "step", "traj_uid").select("row_id", "status")
