"""Queries of metrics, reports, joins, graphs, limits and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import corpus as C
from millrace.operators import graph as GR
from millrace.operators import groupstats as G
from millrace.operators import joins as J
from millrace.operators import metrics as M
from millrace.operators import returns as R
from millrace.plans.registry import register
from millrace.plans.views import OUTCOMES, STEPS, outcomes, steps
from millrace.session import table


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


def _graded(s, d):
    """Labels as outcomes of documents, by source."""
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")


GRADED = "graded AS (SELECT l.doc_id, quality, toxic, source, lang, n_chars FROM labels l JOIN documents d USING (doc_id))"


# ---- metrics ----
@register("a50_data_metrics", f"WITH {STEPS}, t AS (SELECT traj_uid, sum(reward) AS total, count(*) AS n FROM steps GROUP BY 1) SELECT round(avg(reward), 4) AS reward_mean, max(reward) AS reward_max, min(reward) AS reward_min, (SELECT round(avg(total), 4) FROM t) AS episode_mean, (SELECT max(n) FROM t) AS length_max, (SELECT min(n) FROM t) AS length_min FROM steps")
def a50(s, d):
    e = steps(s, d)
    t = e.groupBy("traj_uid").agg(F.sum("reward").alias("total"), F.count("*").alias("n"), F.sum("reward").alias("r"), F.max("reward").alias("hi"), F.min("reward").alias("lo"))
    return t.agg(r4(F.sum("r") / F.sum("n")).alias("reward_mean"), F.max("hi").alias("reward_max"), F.min("lo").alias("reward_min"), r4(F.avg("total")).alias("episode_mean"), F.max("n").alias("length_max"), F.min("n").alias("length_min"))


@register("a51_explained_variance", "SELECT round(1 - var_samp(o_totalprice - o_totalprice * 0.9 - o_custkey) / (var_samp(o_totalprice) + 1e-5), 4) AS ev FROM orders")
def a51(s, d):
    o = table(s, d, "orders").select(F.col("o_totalprice").alias("ret"), (F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("val"))
    return o.agg(r4(M.explained_variance("ret", "val")).alias("ev"))


@register("a53_timing_per_token", "SELECT event_type, round(sum(value), 4) AS seconds, round(1000 * sum(value) / count(*), 4) AS ms_per_row FROM events GROUP BY 1")
def a53(s, d):
    return table(s, d, "events").groupBy("event_type").agg(r4(F.sum("value")).alias("seconds"), r4(1000 * F.sum("value") / F.count("*")).alias("ms_per_row"))


@register("a54_throughput", "SELECT round(sum(n_chars) / 12.5 / 8, 4) AS per_second_and_device FROM documents")
def a54(s, d):
    return table(s, d, "documents").agg(r4(F.sum("n_chars") / 12.5 / 8).alias("per_second_and_device"))


@register("a55_bootstrap")
def a55(s, d):
    return M.bootstrap(table(s, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v")), "v", 3, "user_id")


@register("a55_expected_best_of", f"WITH {OUTCOMES}, r AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS n FROM outcomes) SELECT uid, round(sum(score * (power(i / n, 4) - power((i - 1) / n, 4))), 4) AS expected FROM r GROUP BY 1")
def a55b(s, d):
    return M.expected_best_of(outcomes(s, d), "score", 4, "uid").select("uid", r4(F.col("expected")).alias("expected"))


@register("a56_majority", f"WITH {STEPS}, v AS (SELECT traj_uid, anchor_obs, count(*) AS n, min(step) AS pos, arg_min(reward, step) AS v FROM steps GROUP BY 1, 2) SELECT traj_uid, v AS maj FROM (SELECT *, row_number() OVER (PARTITION BY traj_uid ORDER BY n DESC, pos) AS r FROM v) WHERE r = 1")
def a56(s, d):
    return M.majority(steps(s, d), "anchor_obs", "reward", "step", "traj_uid")


@register("a57_validation_mean", f"WITH {STEPS}, p AS (SELECT uid, traj_uid, avg(reward) AS m FROM steps GROUP BY 1, 2) SELECT uid, round(avg(m), 4) AS mean, count(*) AS n FROM p GROUP BY 1")
def a57(s, d):
    return M.two_level_mean(steps(s, d), "reward", ["traj_uid"], ["uid"]).select("uid", r4(F.col("mean")).alias("mean"), "n")


@register("a58_reduce_by_name", "SELECT 'step_max/' || event_type AS metric, max(value) AS value FROM events GROUP BY event_type UNION ALL SELECT 'min/' || event_type, min(value) FROM events GROUP BY event_type UNION ALL SELECT 'loss/' || event_type, round(avg(value), 4) FROM events GROUP BY event_type")
def a58(s, d):
    e = table(s, d, "events").select("event_type", "value", F.explode(F.array(F.lit("step_max/"), F.lit("min/"), F.lit("loss/"))).alias("p"))
    return M.reduce_by_name(e.select(F.concat("p", "event_type").alias("metric"), "value")).select("metric", r4(F.col("value")).alias("value"))


@register("a59_score_by_source", f"WITH {GRADED} SELECT source, round(avg(quality), 4) AS score FROM graded GROUP BY 1")
def a59(s, d):
    return _graded(s, d).groupBy("source").agg(r4(F.avg("quality")).alias("score"))


@register("a60_offline_eval", f"WITH {GRADED}, p AS (SELECT source, lang, avg(quality) AS m FROM graded GROUP BY 1, 2) SELECT source, round(avg(m), 4) AS mean, count(*) AS n FROM p GROUP BY 1")
def a60(s, d):
    return M.two_level_mean(_graded(s, d), "quality", ["lang"], ["source"]).select("source", r4(F.col("mean")).alias("mean"), "n")


@register("a61_success_rate", f"WITH {STEPS} SELECT uid, round(avg(CASE WHEN w THEN 1.0 ELSE 0 END), 4) AS success FROM (SELECT uid, traj_uid, arg_max(reward > 50, step) AS w FROM steps GROUP BY 1, 2) GROUP BY 1")
def a61(s, d):
    t = steps(s, d).groupBy("uid", "traj_uid").agg(F.max_by(F.col("reward") > 50, "step").alias("w"))
    return t.groupBy("uid").agg(r4(F.avg(F.col("w").cast("double"))).alias("success"))


@register("a62_episode_totals", f"WITH {STEPS} SELECT traj_uid, round(sum(CASE WHEN anchor_obs <> 'error' THEN reward ELSE 0 END), 4) AS reward, count(*) FILTER (anchor_obs <> 'error') AS length FROM steps GROUP BY 1")
def a62(s, d):
    on = F.col("anchor_obs") != "error"
    return steps(s, d).groupBy("traj_uid").agg(r4(F.sum(F.when(on, F.col("reward")).otherwise(0))).alias("reward"), F.count(F.when(on, 1)).alias("length"))


@register("a63_outcome_summary", "WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE 'error' END AS o FROM orders) SELECT count(*) AS n, count(*) FILTER (o IN ('won', 'lost')) AS graded, count(*) FILTER (o = 'error') AS errors, count(*) FILTER (o = 'won') AS won, count(*) FILTER (o = 'lost') AS lost, round(count(*) FILTER (o = 'won') / count(*), 4) AS win_rate, round(count(*) FILTER (o = 'won') / count(*) FILTER (o IN ('won', 'lost')), 4) AS win_rate_graded FROM o")
def a63(s, d):
    o = table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "O", "lost").otherwise("error").alias("outcome"))
    x = M.outcome_summary(o)
    return x.select("n", "graded", "errors", "won", "lost", r4(F.col("win_rate")).alias("win_rate"), r4(F.col("win_rate_graded")).alias("win_rate_graded"))


@register("a64_turn_summary", "WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT round(avg(n), 4) AS mean, median(n) AS median FROM t")
def a64(s, d):
    t = table(s, d, "conversations").groupBy("conv_id").count()
    return t.agg(r4(F.avg("count")).alias("mean"), F.median("count").alias("median"))


@register("a65_rate_by_difficulty", f"WITH {GRADED} SELECT lang, CAST(sum(quality) AS BIGINT) AS hits, count(*) AS n, round(avg(quality), 4) AS rate FROM graded GROUP BY 1")
def a65(s, d):
    return M.rate_by(_graded(s, d), F.col("quality") == 1, "lang").select("lang", "hits", "n", r4(F.col("rate")).alias("rate"))


@register("a67_frequency_top", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def a67(s, d):
    return M.frequency(table(s, d, "orders"), "o_orderpriority", top=3)


@register("a68_describe", "SELECT count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, max(value) AS max FROM events")
def a68(s, d):
    x = M.describe(table(s, d, "events"), "value")
    return x.select(*((r4(F.col(c)).alias(c) if c in ("mean", "std", "p25", "p50", "p75") else F.col(c)) for c in x.columns))


@register("a69_describe_by", "SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.9), 4) AS p90, max(value) AS max FROM events GROUP BY 1")
def a69(s, d):
    x = M.describe(table(s, d, "events"), "value", "event_type", percentiles=[0.9])
    return x.select(*((r4(F.col(c)).alias(c) if c in ("mean", "std", "p90") else F.col(c)) for c in x.columns))


@register("a70_step_totals", f"WITH {STEPS} SELECT traj_uid, round(sum(reward), 4) AS sum_reward, max(reward) AS max_reward FROM steps GROUP BY 1")
def a70(s, d):
    g = steps(s, d).groupBy("traj_uid").agg(F.sort_array(F.collect_list(F.struct("step", "reward"))).alias("s"))
    return C.step_totals(g, "s", "traj_uid", ["reward"]).select("traj_uid", r4(F.col("sum_reward")).alias("sum_reward"), "max_reward")


@register("a71_best_of_n_probability", f"WITH {OUTCOMES} SELECT uid, part, price FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY price DESC, part) AS r FROM outcomes) WHERE r = 1")
def a71(s, d):
    return M.best_by(outcomes(s, d), [F.desc("price"), F.col("part")], "uid").select("uid", "part", "price")


@register("a72_best_of_n_tests", f"WITH {OUTCOMES} SELECT uid, part, price FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, price DESC, part) AS r FROM outcomes) WHERE r = 1")
def a72(s, d):
    return M.best_by(outcomes(s, d), [F.desc("score"), F.desc("price"), F.col("part")], "uid").select("uid", "part", "price")


@register("a73_best_of_n_hybrid", f"WITH {OUTCOMES}, h AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY price DESC, part) AS r, greatest(count(*) OVER (PARTITION BY uid) // 2, 1) AS h FROM outcomes) SELECT uid, part, price FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, step DESC, price DESC, part) AS q FROM h WHERE r <= h) WHERE q = 1")
def a73(s, d):
    return M.best_hybrid(outcomes(s, d), "price", "score", "step", "part", "uid").select("uid", "part", "price")


@register("a74_mass_share", "SELECT user_id AS step, round(coalesce(sum(value) FILTER (event_type = 'click'), 0) / sum(value), 4) AS click, round(coalesce(sum(value) FILTER (event_type = 'view'), 0) / sum(value), 4) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def a74(s, d):
    e = table(s, d, "events").filter(F.col("event_type").isin("click", "view")).withColumnRenamed("user_id", "step")
    return M.mass_share(e, "step", "event_type", "value", ["click", "view"]).select("step", r4(F.col("click")).alias("click"), r4(F.col("view")).alias("view"))


@register("a76_build_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def a76(s, d):
    return table(s, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@register("a77_partial_final", "SELECT round(avg(value), 4) AS mean, max(value) AS max, min(value) AS min, round(stddev_samp(value), 4) AS std FROM events")
def a77(s, d):
    return table(s, d, "events").agg(r4(F.avg("value")).alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), r4(F.stddev_samp("value")).alias("std"))


@register("a78_length_imbalance", "WITH p AS (SELECT doc_id % 8 AS part, sum(n_chars) AS s FROM documents GROUP BY 1) SELECT CAST(min(s) AS BIGINT) AS least, CAST(max(s) AS BIGINT) AS most, round(avg(s), 4) AS mean FROM p")
def a78(s, d):
    x = M.length_imbalance(table(s, d, "documents").withColumn("part", F.col("doc_id") % 8), "n_chars", "part")
    return x.select("least", "most", r4(F.col("mean")).alias("mean"))


@register("a79_balanced_parts")
def a79(s, d):
    o = table(s, d, "orders").select((F.col("o_orderkey") / 64).cast("long").alias("batch"), F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).cast("long").alias("n"))
    return M.balanced_parts(o, "n", 4, "batch")


@register("a80_parts_of_batches", """WITH RECURSIVE r AS (SELECT l_orderkey AS uid, l_linenumber * 1000000 + l_partkey AS item, l_quantity AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey, l_quantity) AS i FROM lineitem),
f AS (SELECT DISTINCT uid, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS item, CAST(NULL AS INT) AS part, CAST(0 AS DOUBLE) AS s0, CAST(0 AS DOUBLE) AS s1, CAST(0 AS DOUBLE) AS s2 FROM r
 UNION ALL SELECT uid, i, item, part, s0 + CASE WHEN part = 0 THEN n ELSE 0 END, s1 + CASE WHEN part = 1 THEN n ELSE 0 END, s2 + CASE WHEN part = 2 THEN n ELSE 0 END
 FROM (SELECT f.uid, r.i, r.item, r.n, CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS part, s0, s1, s2 FROM f JOIN r ON r.uid = f.uid AND r.i = f.i + 1))
SELECT uid, item, part FROM f WHERE i > 0""")
def a80b(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("uid"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("item"), "l_quantity")
    return M.greedy_parts(li, "l_quantity", 3, "item", "uid")


@register("a81_micro_batch_count", "SELECT source, CAST(least(count(*), ceil(sum(n_chars) / 5000)) AS BIGINT) AS n_micro FROM documents GROUP BY 1")
def a81(s, d):
    return M.micro_batch_count(table(s, d, "documents"), "n_chars", 5000, "source")


@register("a82_probability_drift", "SELECT round(max(x), 4) AS drift_max, round(avg(x), 4) AS drift_mean, round(stddev_samp(x), 4) AS drift_std FROM (SELECT abs(exp(-value / 100) - exp(-(value + event_id % 7) / 100)) AS x FROM events)")
def a82(s, d):
    x = F.abs(F.exp(-F.col("value") / 100) - F.exp(-(F.col("value") + F.col("event_id") % 7) / 100))
    return table(s, d, "events").agg(r4(F.max(x)).alias("drift_max"), r4(F.avg(x)).alias("drift_mean"), r4(F.stddev_samp(x)).alias("drift_std"))


@register("a85_best_metric", "SELECT max(value) AS best FROM events WHERE event_type = 'purchase'")
def a85(s, d):
    return table(s, d, "events").filter("event_type = 'purchase'").agg(F.max("value").alias("best"))


@register("a86_square_sum", "SELECT round(sum(value * value), 2) AS total FROM events")
def a86(s, d):
    return table(s, d, "events").agg(F.round(F.sum(F.col("value") ** 2), 2).alias("total"))


@register("a87_flops", "SELECT CAST(sum(n_chars) AS BIGINT) AS tokens, CAST(sum(n_chars * n_chars) AS BIGINT) AS squares FROM documents")
def a87(s, d):
    return table(s, d, "documents").agg(F.sum("n_chars").alias("tokens"), F.sum(F.col("n_chars") * F.col("n_chars")).alias("squares"))


# ---- joins ----
@register("j02_group_stats_back", f"WITH {OUTCOMES} SELECT uid, price, part, round(price - m, 4) + 0.0 AS delta FROM outcomes JOIN (SELECT uid, avg(price) AS m FROM outcomes GROUP BY 1) USING (uid)")
def j02(s, d):
    return outcomes(s, d).select("uid", "price", "part", r4(G.centred(F.col("price"), "uid", ddof=None, singleton="zero")).alias("delta"))


@register("j03_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j03(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.strict_lookup(table(s, d, "orders"), c, "o_custkey").select("o_orderkey", "c_name")


@register("j04_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j04(s, d):
    return table(s, d, "documents").join(table(s, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


@register("j05_block_lists", "SELECT doc_id FROM documents d WHERE sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) NOT IN (SELECT sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) FROM documents WHERE doc_id % 10 = 0) AND md5(left(text, 200)) NOT IN (SELECT md5(left(text, 200)) FROM documents WHERE doc_id % 10 = 1)")
def j05(s, d):
    from millrace.functions.text import question_hash

    docs = table(s, d, "documents").select("doc_id", question_hash(F.col("text")).alias("q"), F.md5(F.left("text", F.lit(200))).alias("p"))
    return J.not_blocked(docs, (docs.filter("doc_id % 10 = 0"), "q"), (docs.filter("doc_id % 10 = 1"), "p")).select("doc_id")


@register("j06_greedy_dedup")
def j06(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 50).cast("long").alias("price"))
    return J.greedy_dedup(o, "o_orderkey", "o_custkey", "price")


@register("j06_dedup_single_key", "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY 2")
def j06b(s, d):
    return J.dedup_first(table(s, d, "orders"), "o_orderkey", "o_custkey").select("o_orderkey", "o_custkey")


@register("j07_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def j07(s, d):
    return table(s, d, "documents").select("doc_id").exceptAll(table(s, d, "labels").select("doc_id").distinct()).distinct()


@register("j08_left_default", "SELECT doc_id, coalesce(quality, 0) AS quality, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS present FROM documents LEFT JOIN labels USING (doc_id)")
def j08(s, d):
    x = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("quality").isNotNull().cast("int").alias("present"))


@register("j09_pairs_in_group", f"WITH {OUTCOMES} SELECT a.uid, count(*) AS pairs FROM outcomes a JOIN outcomes b ON a.uid = b.uid AND a.price < b.price GROUP BY 1")
def j09(s, d):
    return J.pairs_within(outcomes(s, d), "uid", "price").groupBy(F.col("a.uid").alias("uid")).agg(F.count("*").alias("pairs"))


@register("j10_contrast", f"WITH {OUTCOMES}, f AS (SELECT *, score > 25 AS f FROM outcomes) SELECT a.uid, a.part, a.price, round(avg(b.score), 4) AS contrast FROM f a LEFT JOIN f b ON a.uid = b.uid AND a.f <> b.f GROUP BY 1, 2, 3")
def j10(s, d):
    o = outcomes(s, d).withColumn("f", F.col("score") > 25)
    return J.contrast_mean(o, "uid", "score", "f").select("uid", "part", "price", r4(F.col("contrast")).alias("contrast"))


@register("j11_pairs_of_groups", f"""WITH r AS (SELECT l_orderkey AS uid, l_linenumber * 1000000 + l_partkey AS item, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey)),
p AS (SELECT a.uid, a.item AS a, b.item AS b, row_number() OVER (PARTITION BY a.uid ORDER BY a.i, b.i) AS k, a.i, a.n FROM r a JOIN r b ON a.uid = b.uid AND a.i < b.i)
SELECT uid, a, b FROM p WHERE n * (n - 1) / 2 <= 10 OR (i < least(n - 1, 4) AND k <= 10)""")
def j11b(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("uid"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("item"))
    return J.budgeted_pairs(li, "item", 10, "uid")


@register("j13_interval_overlap", "WITH p AS (SELECT conv_id, turn AS pos, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS a, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), s AS (SELECT DISTINCT conv_id, 50 AS s, 400 AS e FROM conversations) SELECT s.conv_id, CAST(coalesce(min(pos) FILTER (b > s AND a < e), -1) AS BIGINT) AS first_piece, CAST(coalesce(max(pos) FILTER (b > s AND a < e) + 1, -1) AS BIGINT) AS past_piece FROM s LEFT JOIN p USING (conv_id) GROUP BY 1")
def j13(s, d):
    c = table(s, d, "conversations")
    p = R.running_offsets(c.withColumn("n", F.length("text")), "n", "turn", "conv_id").select("conv_id", F.col("turn").alias("pos"), "start_at", "end_at")
    spans = c.select("conv_id", F.lit(50).alias("s"), F.lit(400).alias("e")).distinct()
    return J.interval_overlap(spans, p, "conv_id").select("conv_id", "first_piece", "past_piece")


@register("j14_range_fill", f"WITH {OUTCOMES}, x AS (SELECT uid, part, score, price, unnest(range(step, step + 3)) AS place FROM outcomes) SELECT uid, place, part FROM (SELECT *, row_number() OVER (PARTITION BY uid, place ORDER BY score DESC, price) AS r FROM x) WHERE r = 1")
def j14(s, d):
    o = outcomes(s, d).withColumn("e", F.col("step") + 3)
    return J.range_fill(o, "uid", "step", "e", "part", "score", "price").select("uid", F.col("place").cast("long").alias("place"), "part")


@register("j16_as_of", "SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'click'")
def j16(s, d):
    e = table(s, d, "events")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("last_purchase"))
    return J.as_of(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, "ts", "p_ts", "last_purchase", "user_id").select("event_id", "last_purchase")


@register("j16_stage_lookup", "SELECT event_id, CASE WHEN event_id < 100 THEN 'easy' WHEN event_id < 1000 THEN 'easy,medium' ELSE 'hard' END AS stage FROM events")
def j16b(s, d):
    return table(s, d, "events").select("event_id", J.stage_of(F.col("event_id"), C.parse_schedule("100:easy,1000:easy+medium,5000:hard"), "all").alias("stage"))


@register("j19_status_diff", "WITH b AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'PASSED' ELSE 'FAILED' END AS st FROM part WHERE p_partkey % 5 <> 0), a AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN 'PASSED' ELSE 'FAILED' END AS st FROM part WHERE p_partkey % 7 <> 0) SELECT k, CASE WHEN b.st IS NULL THEN 'new' WHEN a.st IS NULL THEN 'missing' WHEN b.st = a.st THEN 'same' WHEN a.st = 'PASSED' THEN 'fixed' ELSE 'broken' END AS kind FROM b FULL JOIN a USING (k)")
def j19(s, d):
    p = table(s, d, "part")
    mk = lambda m, n: p.filter(F.col("p_partkey") % n != 0).select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % m == 0, "PASSED").otherwise("FAILED").alias("st"))
    return J.status_diff(mk(2, 5), mk(3, 7), "k", "st").select("k", "kind")


@register("a13_similar_groups")
def a13(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    return J.similar_groups(c, "text", "turn", 0.6, "conv_id")


@register("j15_schedule_intervals")
def j15(s, d):
    o = outcomes(s, d).select("uid", F.col("step").alias("a"), (F.col("step") + F.col("part") % 4 + 1).cast("int").alias("b"), "score", "price")
    return J.schedule_intervals(o, "a", "b", "score", "price", "uid")


# ---- graphs ----
@register("g01_edges", f"WITH {STEPS}, e AS (SELECT uid, traj_uid, step, anchor_obs AS u, CASE WHEN step = max(step) OVER w AND sum(reward) OVER w > 0 THEN 'success' ELSE next_obs END AS v FROM steps WINDOW w AS (PARTITION BY uid, traj_uid)) SELECT uid, u, v, traj_uid, step FROM e WHERE v IS NOT NULL")
def g01(s, d):
    return GR.edges(steps(s, d))


@register("g03_distances", f"""WITH RECURSIVE {STEPS}, e AS (SELECT DISTINCT uid, u, v FROM (SELECT uid, anchor_obs AS u, CASE WHEN step = max(step) OVER w THEN 'success' WHEN reward > 400 THEN next_obs END AS v FROM steps WINDOW w AS (PARTITION BY uid, traj_uid)) WHERE v IS NOT NULL),
r AS (SELECT DISTINCT uid, 'success' AS state, 0 AS d FROM e UNION SELECT e.uid, e.u, r.d + 1 FROM e JOIN r ON e.uid = r.uid AND e.v = r.state WHERE r.d < 8), b AS (SELECT uid, state, min(d) AS d FROM r GROUP BY 1, 2), st AS (SELECT uid, u AS state FROM e UNION SELECT uid, v FROM e)
SELECT uid, state, CAST(coalesce(d, max(d) OVER (PARTITION BY uid) + 1) AS DOUBLE) AS d FROM st LEFT JOIN b USING (uid, state)""")
def g03(s, d):
    e = GR.edges(steps(s, d).withColumn("next_obs", F.when(F.col("reward") > 400, F.col("next_obs"))))
    return GR.distances_to(e)


@register("g06_mandatory_states")
def g06(s, d):
    return GR.mandatory_states(GR.edges(steps(s, d)), "view", GR.SUCCESS)


@register("g05_simple_paths")
def g05(s, d):
    return GR.simple_paths(GR.edges(steps(s, d)), "view", GR.SUCCESS)


@register("g07_trajectory_paths", f"WITH {STEPS} SELECT uid, traj_uid, array_to_string(list(anchor_obs ORDER BY step), '>') || '>success' AS path FROM steps GROUP BY 1, 2")
def g07(s, d):
    return GR.trajectory_paths(GR.edges(steps(s, d))).select("uid", "traj_uid", F.array_join("path", ">").alias("path"))


@register("g08_success_states", f"WITH {STEPS} SELECT uid, traj_uid, array_to_string(list(anchor_obs ORDER BY step), ',') AS states FROM steps GROUP BY 1, 2 HAVING sum(reward) > 3000")
def g08(s, d):
    return GR.success_states(steps(s, d), threshold=3000).select("uid", "traj_uid", F.array_join("states", ",").alias("states"))


@register("g09_parallel_edges", f"WITH {STEPS}, e AS (SELECT uid, traj_uid, step, anchor_obs AS u, CASE WHEN step = max(step) OVER w AND sum(reward) OVER w > 0 THEN 'success' ELSE next_obs END AS v FROM steps WINDOW w AS (PARTITION BY uid, traj_uid)) SELECT uid, u, v, traj_uid, step, row_number() OVER (PARTITION BY uid, u, v ORDER BY traj_uid, step) - 1 AS slot, EXISTS (SELECT 1 FROM e b WHERE b.uid = e.uid AND b.u = e.v AND b.v = e.u) AS has_reverse FROM e WHERE v IS NOT NULL")
def g09(s, d):
    return GR.parallel_edges(GR.edges(steps(s, d))).select("uid", "u", "v", "traj_uid", "step", F.col("slot").cast("long").alias("slot"), "has_reverse")


@register("g10_neighbours", f"WITH {STEPS} SELECT DISTINCT uid, anchor_obs AS u, next_obs AS v FROM steps WHERE next_obs IS NOT NULL UNION SELECT uid, arg_max(anchor_obs, step), 'success' FROM steps GROUP BY uid, traj_uid")
def g10(s, d):
    return GR.neighbours(GR.edges(steps(s, d)))


def _trade(s, d):
    """Graph of each supplier: parts that follow one another in an order, weighed by the quantity of the second."""
    li = table(s, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    e = li.select((F.col("l_suppkey") % 16).alias("uid"), (F.col("l_partkey") % 97).alias("u"), (F.lead("l_partkey").over(w) % 97).alias("v"), F.lead("l_quantity").over(w).alias("weight")).filter("v IS NOT NULL AND u <> v AND (u + v) % 5 = uid % 5")
    ends = e.groupBy("uid").agg(F.min("u").alias("low"), F.max("u").alias("high")).select("uid", F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("target")), F.struct(F.col("high").alias("source"), F.col("low").alias("target")), F.struct(F.col("low").alias("source"), F.lit(98).cast("long").alias("target")))).alias("x")).select("uid", "x.*")
    return e, ends


#: The same graph and the relaxation for the oracle; the caller names the weight of an edge.
TRADE = """t AS (SELECT l_suppkey % 16 AS uid, l_partkey % 97 AS u, lead(l_partkey) OVER w % 97 AS v, lead(l_quantity) OVER w AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
e AS (SELECT uid, u, v, min(WEIGHT) AS w FROM t WHERE v IS NOT NULL AND u <> v AND (u + v) % 5 = uid % 5 GROUP BY 1, 2, 3),
m AS (SELECT uid, min(u) AS low, max(u) AS high FROM e GROUP BY uid), ends AS (SELECT uid, low AS source, high AS target FROM m UNION SELECT uid, high, low FROM m UNION SELECT uid, low, 98 FROM m),
r(uid, source, state, d, hops, pred) USING KEY (uid, source, state) AS (SELECT DISTINCT uid, source, source, CAST(0 AS DOUBLE), 0, CAST(NULL AS BIGINT) FROM ends
 UNION SELECT n.uid, n.source, n.state, n.b.d, n.b.hops, n.b.pred FROM (SELECT r.uid, r.source, e.v AS state, min({'d': r.d + e.w, 'hops': r.hops + 1, 'pred': r.state}) AS b FROM r JOIN e ON e.uid = r.uid AND e.u = r.state GROUP BY 1, 2, 3) n
 LEFT JOIN recurring.r o ON o.uid = n.uid AND o.source = n.source AND o.state = n.state WHERE o.d IS NULL OR n.b.d < o.d OR (n.b.d = o.d AND n.b.hops < o.hops) OR (n.b.d = o.d AND n.b.hops = o.hops AND n.b.pred < o.pred)),
p AS (SELECT ends.*, r.d, r.pred AS node, [target] AS path FROM ends JOIN r ON r.uid = ends.uid AND r.source = ends.source AND r.state = ends.target
 UNION ALL SELECT p.uid, p.source, p.target, p.d, r.pred, list_prepend(p.node, p.path) FROM p JOIN r ON r.uid = p.uid AND r.source = p.source AND r.state = p.node)
SELECT ends.uid, ends.source, ends.target, array_to_string(path, '>') AS path, coalesce(d, MISSING) AS d FROM ends LEFT JOIN (SELECT * FROM p WHERE node IS NULL) p ON p.uid = ends.uid AND p.source = ends.source AND p.target = ends.target"""


def _shown(paths):
    return paths.withColumn("path", F.array_join("path", ">"))


@register("g02_shortest_paths", f"WITH RECURSIVE {TRADE.replace('WEIGHT', '1').replace('MISSING', 'NULL')}")
def g02(s, d):
    e, ends = _trade(s, d)
    return _shown(GR.shortest_paths(e, ends, missing=None))


@register("g04_lightest_paths", f"WITH RECURSIVE {TRADE.replace('WEIGHT', 'q').replace('MISSING', '51')}")
def g04(s, d):
    e, ends = _trade(s, d)
    return _shown(GR.shortest_paths(e, ends, "weight"))


@register("w05_segment_returns", f"WITH {STEPS}, g AS (SELECT *, sum(CASE WHEN reward > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY uid, traj_uid ORDER BY step DESC) AS sg FROM steps) SELECT row_id, round(CASE WHEN sg = 0 THEN 0 ELSE 10 * power(0.95, max(step) OVER (PARTITION BY uid, traj_uid, sg) - step) END, 4) AS ret FROM g")
def w05(s, d):
    return GR.segment_returns(steps(s, d).withColumn("golden", F.col("reward") > 150), "golden").select("row_id", r4(F.col("ret")).alias("ret"))


@register("w06_path_returns", f"""WITH RECURSIVE {STEPS}, a AS (SELECT uid, traj_uid, step, anchor_obs AS u, CASE WHEN step = max(step) OVER w AND sum(reward) OVER w > 0 THEN 'success' ELSE next_obs END AS v FROM steps WINDOW w AS (PARTITION BY uid, traj_uid)),
e AS (SELECT DISTINCT uid, u, v FROM a WHERE v IS NOT NULL), r AS (SELECT DISTINCT uid, 'success' AS state, 0 AS d FROM e UNION SELECT e.uid, e.u, r.d + 1 FROM e JOIN r ON e.uid = r.uid AND e.v = r.state WHERE r.d < 8),
b AS (SELECT uid, state, min(d) AS d FROM r GROUP BY 1, 2), st AS (SELECT uid, u AS state FROM e UNION SELECT uid, v FROM e), f AS (SELECT uid, state, coalesce(d, max(d) OVER (PARTITION BY uid) + 1) AS d FROM st LEFT JOIN b USING (uid, state))
SELECT a.uid, a.traj_uid, a.step, 10.0 * power(0.95, g.d - f.d + 1) AS ret FROM a JOIN f ON a.uid = f.uid AND a.u = f.state JOIN f g ON a.uid = g.uid AND a.v = g.state WHERE a.v IS NOT NULL""")
def w06(s, d):
    e = steps(s, d)
    return GR.path_returns(e, GR.edges(e))


# ---- limits, samples and sets ----
@register("l02_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def l02(s, d):
    return C.seeded_sample(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


@register("l04_order_by_difficulty", "SELECT o_orderkey FROM orders ORDER BY CASE lower(o_orderpriority) WHEN '1-urgent' THEN 0 WHEN '2-high' THEN 1 ELSE 2 END, o_orderkey LIMIT 500")
def l04(s, d):
    return C.order_by_difficulty(table(s, d, "orders"), "o_orderpriority", ["1-urgent", "2-high"], "o_orderkey").limit(500).select("o_orderkey")


@register("l05_head", "SELECT event_id FROM events ORDER BY event_id LIMIT 50")
def l05(s, d):
    return table(s, d, "events").select("event_id").orderBy("event_id").limit(50)


@register("l06_percent_split", "SELECT event_id AS row_id FROM events WHERE event_id >= (SELECT count(*) - CAST(floor(count(*) * 25 / 100) AS BIGINT) FROM events)")
def l06(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("row_id"))
    return C.head_percent(e, "row_id", 25, e.count(), tail=True)


@register("l07_ratio_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) <= least(greatest(1, CAST(floor(count(*) OVER () * 0.1) AS BIGINT)), greatest(count(*) OVER () - 1, 0)) THEN 'val' ELSE 'train' END AS part FROM orders")
def l07(s, d):
    return C.split_by_ratio(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 0.1, 3)


@register("l08_top_two", f"WITH {OUTCOMES} SELECT uid, price FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY price DESC, part) AS r FROM outcomes) WHERE r <= 2")
def l08(s, d):
    from pyspark.sql import Window

    return outcomes(s, d).withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("price"), "part"))).filter("r <= 2").select("uid", "price")


@register("l15_renumber", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS n FROM orders")
def l15(s, d):
    from millrace.operators.batch import with_row_id

    o = table(s, d, "orders").select("o_orderkey", (-F.col("o_orderkey")).alias("k"))
    return with_row_id(o, "k", name="n").select("o_orderkey", "n")


@register("u05_unpivot_pairs", "SELECT c_custkey, 'chosen' AS kind, c_name AS response FROM customer UNION ALL SELECT c_custkey, 'rejected', c_mktsegment FROM customer")
def u05(s, d):
    return C.sft_pairs(table(s, d, "customer"), "c_custkey", "c_name", "c_mktsegment")


@register("u06_intersect", "SELECT user_id AS k FROM events INTERSECT SELECT c_custkey FROM customer")
def u06(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("k")).intersect(table(s, d, "customer").select(F.col("c_custkey").alias("k")))


@register("u09_distinct_in_order", f"WITH {STEPS} SELECT anchor_obs, min(row_id) AS first_at FROM steps GROUP BY 1")
def u09(s, d):
    return C.distinct_in_order(steps(s, d), "anchor_obs", "row_id")
