"""Queries of selection, merging, anchors, agent texts and the remaining group statistics on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import agent as G
from millrace.functions import scoring as S
from millrace.functions import text as T
from millrace.operators import anchors as A
from millrace.operators import corpus as C
from millrace.operators import groupstats as GS
from millrace.operators import joins as J
from millrace.operators import runtime as U
from millrace.operators import selection as N
from millrace.operators.state import shared_folder
from millrace.plans.registry import register
from millrace.plans.views import OUTCOMES, STEPS, outcomes, steps
from millrace.session import table
from millrace.sources import readers, writers


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


def _orders(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderpriority").alias("difficulty"), "o_orderstatus", "o_custkey", "o_totalprice")


INST = "inst AS (SELECT o_orderkey AS instance_id, o_orderpriority AS difficulty, o_orderstatus, o_custkey, o_totalprice FROM orders)"


# ---- selection ----
@register("p24_select_instances", f"""WITH {INST}, f AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || instance_id), instance_id) - 1 AS r FROM inst WHERE lower(difficulty) IN ('1-urgent', '2-high') AND CAST(instance_id AS VARCHAR) LIKE '1%')
SELECT instance_id, difficulty FROM (SELECT *, row_number() OVER (ORDER BY r) - 1 AS n FROM f WHERE r >= 3 AND r < 90 AND (r - 3) % 2 = 0) WHERE n < 20""")
def p24(s, d):
    x = N.select_instances(_orders(s, d), allowed=["1-URGENT", "2-high"], seed=7, pattern="1", spec="3:90:2", first=20)
    return x.select("instance_id", "difficulty")


@register("p24_easy_first", f"WITH {INST} SELECT instance_id, row_number() OVER (ORDER BY CASE lower(difficulty) WHEN '5-low' THEN 0 WHEN '3-medium' THEN 1 ELSE 2 END, instance_id) - 1 AS row_id FROM inst")
def p24b(s, d):
    return N.select_instances(_orders(s, d), easy_first=["5-low", "3-medium"]).select("instance_id", "row_id")


@register("p28_labelled", "SELECT doc_id FROM documents WHERE length(text) > 0")
def p28(s, d):
    return N.labelled(table(s, d, "documents"), "text").select("doc_id")


@register("p30_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def p30(s, d):
    return N.since(table(s, d, "orders"), "o_orderdate", "1996-01-01").select("o_orderkey")


@register("f84_date_cut", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01 00:00:00'")
def f84(s, d):
    return N.since(table(s, d, "orders"), "o_orderdate", "1997-06-01 00:00:00", strict=True).select("o_orderkey")


def _done(s, d):
    return table(s, d, "orders").filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("instance_id"), F.when(F.col("o_orderstatus") == "F", "won").otherwise("lost").alias("outcome"), (F.col("o_orderstatus") == "F").cast("int").alias("reward"))


DONE = "done AS (SELECT o_orderkey AS instance_id, CASE WHEN o_orderstatus = 'F' THEN 'won' ELSE 'lost' END AS outcome FROM orders WHERE o_custkey % 3 = 0)"


@register("p36_exclude_won", f"WITH {INST}, {DONE} SELECT instance_id FROM inst WHERE instance_id NOT IN (SELECT instance_id FROM done WHERE outcome = 'won')")
def p36(s, d):
    return N.exclude_done(_orders(s, d), _done(s, d), "instance_id").select("instance_id")


@register("p36_exclude_all", f"WITH {INST}, {DONE} SELECT instance_id FROM inst WHERE instance_id NOT IN (SELECT instance_id FROM done)")
def p36b(s, d):
    return N.exclude_done(_orders(s, d), _done(s, d), "instance_id", "all").select("instance_id")


@register("p39_eligible_snippets", "SELECT l_orderkey AS row_id, l_linenumber AS pos FROM lineitem WHERE l_linenumber % 2 = 1 AND l_returnflag <> 'R' AND l_linestatus <> 'F'")
def p39(s, d):
    li = table(s, d, "lineitem")
    snip = F.struct(F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") % 2).alias("level"), (F.col("l_returnflag") != "R").alias("changed"), F.when(F.col("l_linestatus") == "F", "root").otherwise("part").alias("origin"))
    rows = li.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.collect_list(snip).alias("snippets"))
    return N.eligible_snippets(rows, 1).select("row_id", "pos")


@register("p53_tool_arguments", "SELECT o_orderkey, true AS need, CAST(o_custkey AS VARCHAR) AS truth FROM orders")
def p53(s, d):
    o = table(s, d, "orders").withColumn("extra_info", F.struct(F.col("o_orderkey").alias("index")))
    x = N.with_tool_arguments(o, "extra_info", F.col("o_custkey").cast("string"), "sandbox")
    return x.select("o_orderkey", F.col("extra_info.need_tools_kwargs").alias("need"), F.col("extra_info.tools_kwargs.sandbox.create_kwargs.ground_truth").alias("truth"))


@register("p54_position_range", f"WITH {INST}, {DONE}, o AS (SELECT instance_id, row_number() OVER (ORDER BY md5('42:' || instance_id), instance_id) - 1 AS r FROM inst) SELECT instance_id, r AS row_id FROM o WHERE r BETWEEN 10 AND 309 AND instance_id NOT IN (SELECT instance_id FROM done WHERE outcome = 'won')")
def p54(s, d):
    return N.position_range(_orders(s, d), "instance_id", 42, 10, 300, _done(s, d), only_rewarded=True).select("instance_id", "row_id")


@register("j18_matched_cases", "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber) AS ins FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2) GROUP BY 1")
def j18(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("l_suppkey"), F.max("l_partkey").alias("l_partkey"))
    pair = lambda v: F.struct(F.col("l_linenumber").cast("string").alias("k"), F.col(v).cast("string").alias("v"))
    g = li.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(pair("l_suppkey"))).alias("i"), F.map_from_entries(F.array_append(F.collect_list(F.when(F.col("l_linenumber") != 2, pair("l_partkey"))), F.struct(F.lit("extra").alias("k"), F.lit("").alias("v")))).alias("o"))
    return g.select("l_orderkey", F.array_join(N.matched_cases(F.col("i"), F.col("o"))["inputs"], ",").alias("ins")).filter("ins <> ''")


@register("j11_pair_budget", "SELECT o_custkey, count(*) AS n, CAST(least(count(*) * (count(*) - 1) // 2, 64) AS BIGINT) AS pairs FROM orders GROUP BY 1")
def j11(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey")
    pairs = J.budgeted_pairs(o, "o_orderkey", 64, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("pairs"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n")).join(pairs, "o_custkey", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))


@register("l03_slice_spec", "SELECT r_regionkey FROM (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS r FROM region) WHERE r >= 1 AND r < 5 AND (r - 1) % 2 = 0")
def l03(s, d):
    return N.merge_sliced({"r": table(s, d, "region")}, {"r": "1:5:2"}, "r_regionkey").select("r_regionkey")


@register("l11_weighted_draws", f"""WITH {OUTCOMES}, w AS (SELECT uid, step, traj_uid, part, price, CASE WHEN row_number() OVER o = count(*) OVER (PARTITION BY uid) THEN 1.0 ELSE sum(score) OVER o / sum(score) OVER (PARTITION BY uid) END AS upto FROM outcomes
 WINDOW o AS (PARTITION BY uid ORDER BY step, traj_uid, part, price ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY uid ORDER BY step, traj_uid, part, price), 0) AS low FROM w),
u AS (SELECT uid, draw, CAST(('0x' || substr(md5('5:' || uid || ':' || draw), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM (SELECT DISTINCT uid FROM outcomes), (SELECT range AS draw FROM range(1, 5)))
SELECT b.uid, b.step, b.part, CAST(draw AS INT) AS draw FROM b JOIN u ON b.uid = u.uid AND u.u >= b.low AND u.u < b.upto""")
def l11(s, d):
    return N.draw_weighted(outcomes(s, d), "score", 4, 5, "uid", "step", "traj_uid", "part", "price").select("uid", "step", "part", "draw")


@register("l12_draw_instances", """WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY CASE c_custkey WHEN 11 THEN 0 WHEN 5 THEN 1 ELSE 2 END, md5('3:' || c_custkey), c_custkey) - 1 AS place FROM customer)
SELECT c_custkey, place, CAST(copy AS INT) AS copy FROM o, (SELECT range AS copy FROM range(0, 3)) WHERE place < 40""")
def l12(s, d):
    return N.draw_instances(table(s, d, "customer").select("c_custkey"), "c_custkey", [11, 5], 40, 3, 3)


@register("l12_small_pool", """WITH o AS (SELECT r_regionkey, row_number() OVER (ORDER BY md5('3:' || r_regionkey), r_regionkey) - 1 AS r, count(*) OVER () AS n FROM region)
SELECT r_regionkey, r + n * k AS place, 0 AS copy FROM o, (SELECT range AS k FROM range(0, 3)) WHERE r + n * k < 12""")
def l12b(s, d):
    return N.draw_instances(table(s, d, "region").select("r_regionkey"), "r_regionkey", [], 12, 1, 3)


@register("l13_sample_order", "SELECT c_custkey, row_number() OVER (ORDER BY md5('9:' || c_custkey), c_custkey) - 1 AS row_id FROM customer")
def l13(s, d):
    return N.sample_order(table(s, d, "customer").select("c_custkey"), "c_custkey", 9)


@register("l14_shard", "SELECT r AS row_id, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) WHERE r % 7 = 3 AND r < n // 7 * 7")
def l14(s, d):
    return N.shard(N.sample_order(table(s, d, "customer").select("c_custkey"), "c_custkey", None), 3, 7)


@register("l16_until_target", f"WITH {OUTCOMES}, g AS (SELECT uid, count(*) AS n FROM outcomes GROUP BY 1), s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT uid, n FROM s WHERE before < 1000")
def l16(s, d):
    return N.until_target(outcomes(s, d).groupBy("uid").agg(F.count("*").alias("n")), "n", "uid", 1000)


@register("u03_merge_sliced", """SELECT r_regionkey AS id, 'region' AS _source FROM region WHERE r_regionkey < 3 UNION ALL
SELECT id, 'nation' FROM (SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r >= 20""")
def u03(s, d):
    sources = {"region": table(s, d, "region").select(F.col("r_regionkey").alias("id")), "nation": table(s, d, "nation").select(F.col("n_nationkey").alias("id"))}
    return N.merge_sliced(sources, {"region": ":3", "nation": "20:"}, "id").select("id", "_source")


@register("u04_merge_accepted", "SELECT c_custkey AS k, c_name AS name, NULL AS extra, 'base' AS _source FROM customer UNION ALL SELECT s_suppkey, s_name, 'x', 'new' FROM supplier")
def u04(s, d):
    base = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return N.merge_accepted(base, table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("x").alias("extra")), "base", "new")


@register("u10_overlay", "SELECT c_custkey AS k, 'live' AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'early' FROM customer WHERE c_custkey % 2 = 1")
def u10(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return N.overlay(c.withColumn("v", F.lit("early")), c.filter("k % 2 = 0").withColumn("v", F.lit("live")), "k")


@register("s12_load_benchmark", "SELECT instance_id, _source FROM (SELECT o_orderkey AS instance_id, 'first' AS _source, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT o_orderkey, 'second', row_number() OVER (ORDER BY o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1996-01-01') WHERE r <= 25")
def s12(s, d):
    for name, status in (("first", "F"), ("second", "P")):
        N.benchmark(name)(lambda spark, root, status=status: table(spark, root, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderdate").alias("date")))
    return N.load_benchmark(s, "first+second", d, ":25", min_date="1996-01-01").select("instance_id", "_source")


# ---- anchors ----
def _roots(s, d):
    """Turns of a conversation as responses of one prompt, a sentence a line."""
    c = table(s, d, "conversations")
    lines = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return c.select(F.pmod("conv_id", F.lit(50)).alias("uid"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.lit(0).alias("root"), F.col("role").alias("edit_type"), lines.alias("lines")).filter("row_id IS NOT NULL")


@register("a19_find_anchors")
def a19(s, d):
    return A.find_anchors(_roots(s, d), similar=0.9)


@register("a25_anchor_credit")
def a25(s, d):
    found = A.find_anchors(_roots(s, d), similar=1.0)
    rewards = _roots(s, d).groupBy("row_id").agg(F.max((F.size("lines") % 2).cast("double")).alias("reward"))
    return A.anchor_credit(found, rewards)


@register("a17_fallback_groups", "SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, md5(text)) AS group_id FROM documents WHERE text IS NOT NULL")
def a17(s, d):
    x = table(s, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("row_id"), "lang", F.lit(1).alias("level"), F.lit(True).alias("changed"), F.lit("part").alias("origin"), F.col("text").alias("source"))
    return A.fallback_groups(x, 1, "lang").select(F.col("row_id").alias("doc_id"), "group_id")


@register("a24_rescore", f"WITH {OUTCOMES}, g AS (SELECT uid, count(*) AS n, avg(score) AS mean_size FROM outcomes GROUP BY 1) SELECT uid, n, round(mean_size, 4) AS mean_size, round((1 - exp(-mean_size / 8)) * (1 - exp(-(n - 1) / 8)), 4) AS gs FROM g WHERE n > 1")
def a24(s, d):
    return A.rescore(outcomes(s, d), "uid", size="score").select("uid", "n", r4(F.col("mean_size")).alias("mean_size"), r4(F.col("gs")).alias("gs"))


@register("a25_spread_credit", """WITH t AS (SELECT vec_id AS row_id, i, CASE WHEN i < 8 + vec_id % 24 THEN 1 ELSE 0 END AS m FROM embeddings, (SELECT range AS i FROM range(0, 32)))
SELECT row_id, round(CAST(sum(m * (1.0 + 0.5 * CASE WHEN i >= 4 AND i < 9 THEN 2.0 WHEN i >= 0 AND i < 6 THEN -1.0 ELSE 0 END)) AS DOUBLE), 4) + 0.0 AS total FROM t GROUP BY 1""")
def a25b(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.lit(1.0).alias("advantage"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i < 8 + F.col("vec_id") % 24).cast("int")).alias("mask"))
    spans = e.select("row_id").withColumn("x", F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(g).alias("gs"), F.lit(c).alias("credit")) for a, b, g, c in ((0, 6, 0.3, -1.0), (4, 9, 0.7, 2.0)))))).select("row_id", "x.*")
    x = A.spread_credit(e, spans, 0.5)
    return x.select("row_id", r4(F.aggregate("token_advantage", F.lit(0.0), lambda a, v: a + v)).alias("total"))


# ---- group statistics ----
@register("a15_history_base", f"""WITH {STEPS}, e AS (SELECT *, sum(reward) OVER (PARTITION BY traj_uid) AS total FROM steps),
b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY uid) > 1 THEN (total - avg(total) OVER (PARTITION BY uid)) / (stddev_samp(total) OVER (PARTITION BY uid) + 1e-6) ELSE total END AS base FROM e),
h AS (SELECT *, list(anchor_obs) OVER (PARTITION BY uid, traj_uid ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS h FROM b),
x AS (SELECT uid, traj_uid, step, reward, k, array_to_string(h[len(h) - k + 1 : len(h)], '|') AS key FROM h, range(1, 3) t(k) WHERE k <= len(h)),
a AS (SELECT uid, traj_uid, step, k + 1.0 AS w, CASE WHEN count(*) OVER g > 1 THEN (reward - avg(reward) OVER g) / (stddev_pop(reward) OVER g + 1e-6) ELSE 0 END AS a FROM x WINDOW g AS (PARTITION BY uid, k, key)
 UNION ALL SELECT uid, traj_uid, step, 1.0, base FROM b)
SELECT uid, traj_uid, step, round(coalesce(sum(w * a) FILTER (a <> 0), 0) / (coalesce(sum(w) FILTER (a <> 0), 0) + 1e-6), 4) + 0.0 AS advantage FROM a GROUP BY 1, 2, 3""")
def a15(s, d):
    e = steps(s, d)
    total = e.groupBy("traj_uid").agg(F.sum("reward").alias("total"))
    base = e.join(total, "traj_uid").withColumn("base", GS.centred(F.col("total"), "uid"))
    return GS.history_groups(base, k=2, base="base").select("uid", "traj_uid", "step", r4(F.col("advantage")).alias("advantage"))


@register("a31_graph_advantage", f"""WITH {STEPS}, e AS (SELECT *, sum(reward) OVER (PARTITION BY traj_uid) AS total FROM steps)
SELECT row_id, round(0.5 * CASE WHEN count(*) OVER (PARTITION BY uid, anchor_obs) > 1 THEN reward - avg(reward) OVER (PARTITION BY uid, anchor_obs) ELSE 0 END + 2.0 * CASE WHEN count(*) OVER (PARTITION BY uid) > 1 THEN total - avg(total) OVER (PARTITION BY uid) ELSE total END, 4) + 0.0 AS advantage FROM e""")
def a31(s, d):
    e = steps(s, d)
    total = e.groupBy("traj_uid").agg(F.sum("reward").alias("total"))
    x = GS.weighted_joint(e.join(total, "traj_uid"), "total", "reward", 0.5, 2.0)
    return x.select("row_id", r4(F.col("advantage")).alias("advantage"))


@register("a34_detached_loss", f"""WITH {OUTCOMES}, p AS (SELECT uid, step, part, price, score / 50.0 AS q, CASE WHEN part % 2 = 0 THEN 1.0 ELSE 0.0 END AS acc FROM outcomes),
o AS (SELECT a.uid, a.step, a.part, a.q * 0.5 AS cur, a.acc, coalesce(avg(b.q) FILTER (CASE WHEN a.acc > 0 THEN b.acc < a.acc ELSE b.acc > a.acc END) * 0.5, 0) AS other, count(*) * power(avg(CASE WHEN b.acc <= a.acc THEN 1.0 ELSE 0.0 END), count(*) - 1) AS w FROM p a JOIN p b ON a.uid = b.uid GROUP BY a.uid, a.step, a.part, a.price, a.q, a.acc)
SELECT uid, step, part, round(ln(1 + exp(-(cur - other) * CASE WHEN acc > 0 THEN 1 ELSE -1 END)), 4) + 0.0 AS loss, round(w, 4) + 0.0 AS weight FROM o""")
def a34(s, d):
    p = outcomes(s, d).select("uid", "step", "part", (F.col("score") / 50.0).alias("q"), F.when(F.col("part") % 2 == 0, 1.0).otherwise(0.0).alias("acc"))
    return GS.detached_loss(p, "q", "acc", 0.5).select("uid", "step", "part", r4(F.col("loss")).alias("loss"), r4(F.col("weight")).alias("weight"))


@register("a75_size_shares", f"""WITH {STEPS}, g AS (SELECT uid AS instance, traj_uid % 10 AS step, anchor_obs, count(*) AS size FROM steps GROUP BY 1, 2, 3),
k AS (SELECT instance, CASE WHEN size >= 21 THEN '21+' ELSE CAST(size AS VARCHAR) END AS bucket, size FROM g WHERE size >= 2 AND step BETWEEN 2 AND 7),
s AS (SELECT instance, bucket, 100.0 * sum(size) / sum(sum(size)) OVER (PARTITION BY instance) AS pct FROM k GROUP BY 1, 2), n AS (SELECT count(DISTINCT instance) AS n FROM k)
SELECT bucket, round(sum(pct) / any_value(n), 4) + 0.0 AS pct FROM s, n GROUP BY 1""")
def a75(s, d):
    g = steps(s, d).groupBy(F.col("uid").alias("instance"), (F.col("traj_uid") % 10).alias("step"), "anchor_obs").agg(F.count("*").alias("size"))
    return GS.size_shares(g, 2, 7, by_mass=True, macro=True).select("bucket", r4(F.col("pct")).alias("pct"))


@register("a75_count_shares", f"""WITH {STEPS}, g AS (SELECT uid AS instance, traj_uid % 10 AS step, anchor_obs, count(*) AS size FROM steps GROUP BY 1, 2, 3)
SELECT CASE WHEN size >= 21 THEN '21+' ELSE CAST(size AS VARCHAR) END AS bucket, round(100.0 * count(*) / sum(count(*)) OVER (), 4) + 0.0 AS pct FROM g WHERE size >= 2 AND step BETWEEN 0 AND 5 GROUP BY 1""")
def a75b(s, d):
    g = steps(s, d).groupBy(F.col("uid").alias("instance"), (F.col("traj_uid") % 10).alias("step"), "anchor_obs").agg(F.count("*").alias("size"))
    return GS.size_shares(g, 0, 5, by_mass=False, macro=False).select("bucket", r4(F.col("pct")).alias("pct"))


@register("w10_edge_rank", f"""WITH {OUTCOMES}, x AS (SELECT uid, step, score, (rank() OVER (PARTITION BY uid ORDER BY score) + (count(*) OVER (PARTITION BY uid, score) - 1) / 2.0 - 1) AS r, count(*) OVER (PARTITION BY uid) AS n, min(score) OVER (PARTITION BY uid) AS lo, max(score) OVER (PARTITION BY uid) AS hi FROM outcomes)
SELECT uid, step, round(CASE WHEN lo = hi THEN CASE WHEN lo > 0 THEN 1.0 WHEN lo < 0 THEN 0.0 ELSE 0.5 END ELSE r / (n - 1) END, 4) + 0.0 AS pct FROM x""")
def w10(s, d):
    return GS.edge_rank(outcomes(s, d), "score", "uid").select("uid", "step", r4(F.col("pct")).alias("pct"))


# ---- answers and agent texts ----
#: Forms of an answer and what is left of each: {n} is a part's key, {d} its last digit, {c} and {t} a number over 999 with and without commas.
ANSWERS = ["x = \\frac{d}2", "\\text{m} {c} square feet", "${n} \\$ $", "\\boxed{\\sqrt{d}}", "an apple{n}", "\\overline{AB{n}}", "{n}^\\circ", "{c}", "a = b = {n} dollars", "\\textbf{q{n}}\\dots"]
FINAL = ["\\frac{{d}}{2}", "{t}", "{n}", "\\sqrt{{d}}", "apple{n}", "AB{n}", "{n}", "{t}", "{n}", "q{n}"]


def _filled(form, k):
    n = lambda c: c.cast("string")
    for mark, value in (("{n}", n(k)), ("{d}", n(k % 10)), ("{c}", F.format_number(k % 9000 + 1000, 0)), ("{t}", n(k % 9000 + 1000))):
        form = F.replace(form, F.lit(mark), value)
    return form


@register("f09_answer_forms", "SELECT p_partkey, replace(replace(replace([" + ", ".join("'" + x + "'" for x in FINAL) + "][p_partkey % 10 + 1], '{n}', CAST(p_partkey AS VARCHAR)), '{d}', CAST(p_partkey % 10 AS VARCHAR)), '{t}', CAST(p_partkey % 9000 + 1000 AS VARCHAR)) AS a FROM part")
def f09(s, d):
    k = F.col("p_partkey")
    form = F.get(F.array(*(F.lit(x) for x in ANSWERS)), (k % 10).cast("int"))
    return table(s, d, "part").select("p_partkey", S.final_answer(_filled(form, k)).alias("a"))


@register("f10_minerva", "SELECT o_orderkey, o_custkey % 3 = 0 AS correct, CASE WHEN o_custkey % 3 = 1 THEN '[INVALID]' ELSE CAST(o_custkey AS VARCHAR) END AS pred FROM orders")
def f10(s, d):
    k = F.col("o_custkey")
    text = F.when(k % 3 == 1, "no line").otherwise(F.concat(F.lit("Answer: 1\nso ANSWER : n = "), F.format_number(k, 0), F.lit(" units\nend")))
    x = table(s, d, "orders").select("o_orderkey", S.minerva(text, F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" cm"))).otherwise("other")).alias("x"))
    return x.select("o_orderkey", "x.*")


@register("f11_strict_box", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE -1 END AS score, CASE WHEN o_custkey % 4 = 2 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS pred FROM orders")
def f11(s, d):
    k = F.col("o_custkey")
    text = F.concat(F.lit("\\boxed{1} then \\boxed{"), k.cast("string"), F.lit("}"), F.when(k % 4 == 2, F.lit(" far " * 40)).otherwise(" end"))
    x = table(s, d, "orders").select("o_orderkey", S.strict_box(text, F.when(k % 4 == 0, k.cast("string")).otherwise("none")).alias("x"))
    return x.select("o_orderkey", "x.*")


@register("f15_grade", """SELECT p_partkey, CASE WHEN p_partkey % 12 IN (1, 9) THEN false WHEN p_partkey % 12 IN (8, 10) THEN p_partkey % 50 + 1 = p_size ELSE p_size % 2 = 0 END AS ok FROM part""")
def f15(s, d):
    """Twelve forms, by key: tuples, intervals, fractions, percent signs, shares, multiples of pi, commas, letters, swapped tuples, nothing, numbers and degrees."""
    n, m, off = F.col("p_partkey") % 50 + 1, F.col("p_size"), F.col("p_size") % 2
    t = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    forms = [
        (t("(", n, ", ", m, ")"), t("(", n, ",", m + off, ")")), (t("[0,", n, ")"), t("[0,", n, "]")), (t("\\frac{", n, "}{2}"), t(n / 2 + off)), (t(n, "%"), t(n / 100 + off)), (t(n), t(n / 100 + off)), (t(n, "\\pi"), t(F.round(n * 3.141592653589793, 4) + off)),
        (t("1,", n + 100), t(1100 + n + 100 * off, ".0")), (t("x+", n), t("X+", n + off)), (t("(", n, ",", m, ")"), t("(", m, ",", n, ")")), (F.lit(""), t(n)), (t(n), t(m)), (t(n, "^\\circ"), t(n + off)),
    ]
    pick = lambda side: F.get(F.array(*(f[side] for f in forms)), (F.col("p_partkey") % 12).cast("int"))
    return table(s, d, "part").select("p_partkey", G.grade(pick(0), pick(1)).alias("ok"))


ACTIONS = [
    ("<think>t</think><edit path='a.py'><search>x</search><replace>y</replace></edit>", "edit", "patch", 1), ("<edit path=\"a.py\"><old>x</old><new></new></edit>", "edit", "patch", 0), ("Thought: t\n<edit path='b.py'><insert>z</insert></edit>", "edit", "insert", 1),
    ("<think></think><edit path='c.py'><code>\nq\n</code></edit>", "edit", "overwrite", 1), ("<think>t</think><execute_bash> ls </execute_bash>", "bash", None, 1), ("<think>t</think><execute_bash></execute_bash>", "bash", None, 0), ("<finish/>", "finish", None, 0), ("<think>a</think><finish>", "finish", None, 1),
    ("<think>t</think>edit file `m.py`\n```python\nx=1\n```", "edit", "overwrite", 1), ("Thought: a\n```bash\nls -l\n```", "bash", None, 1), ("Action: `pwd`", "bash", None, 0), ("nothing", "noop", None, 0), ("<think>t</think><edit path=''><code>q</code></edit>", "edit", "overwrite", 0),
]


@register("f23_parse_action", "SELECT p_partkey, [" + ", ".join(f"'{k}'" for _, k, _, _ in ACTIONS) + "][p_partkey % 13 + 1] AS type, [" + ", ".join(f"'{m}'" if m else "NULL" for _, _, m, _ in ACTIONS) + "][p_partkey % 13 + 1] AS mode, [" + ", ".join(str(v) for *_, v in ACTIONS) + "][p_partkey % 13 + 1] AS valid FROM part")
def f23(s, d):
    """Thirteen forms, by key; paths and commands hold the key."""
    forms = F.array(*(F.lit(t.replace(".py", "{n}.py").replace("ls", "ls {n}")) for t, *_ in ACTIONS))
    text = F.replace(F.get(forms, (F.col("p_partkey") % 13).cast("int")), F.lit("{n}"), F.col("p_partkey").cast("string"))
    return table(s, d, "part").select("p_partkey", G.parse_action(text).alias("a")).select("p_partkey", "a.type", "a.mode", "a.valid")


@register("f15_grades_of_orders", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 7 = o_orderkey % 7 WHEN 1 THEN true WHEN 2 THEN false ELSE o_custkey % 3 = 0 END AS ok FROM orders""")
def f15b(s, d):
    """Pairs of numbers in brackets, whole numbers with a zero fraction, open against closed intervals, and plain numbers."""
    o, c, k = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 4
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    given = F.when(k == 0, text("(", c, ", ", c % 7, ")")).when(k == 1, text(c, ".0")).when(k == 2, text("[1, ", c + 1, "]")).otherwise(text(c % 3))
    truth = F.when(k == 0, text("(", c, ",", o % 7, ")")).when(k == 1, text(c)).when(k == 2, text("(1, ", c + 1, ")")).otherwise(F.lit("0"))
    return table(s, d, "orders").select("o_orderkey", G.grade(given, truth).alias("ok"))


@register("f23_actions_of_documents", """SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN 'bash' WHEN 5 THEN 'noop' ELSE 'edit' END AS type, CASE doc_id % 6 WHEN 0 THEN 'patch' WHEN 1 THEN 'insert' WHEN 2 THEN 'overwrite' WHEN 4 THEN 'patch' END AS mode,
CASE WHEN doc_id % 6 < 4 AND regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> '' THEN 1 ELSE 0 END AS valid, CASE WHEN doc_id % 6 IN (0, 4) THEN md5(coalesce(text, '')) WHEN doc_id % 6 IN (1, 2) THEN md5(coalesce(text, '') || '!') END AS payload FROM documents""")
def f23b(s, d):
    """Whole texts as what a response searches for, inserts, writes, runs, does without a thought, or just says."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 6
    edit = lambda *body: F.concat(F.lit("<edit path='d"), F.col("doc_id").cast("string"), F.lit(".py'>"), *(F.lit(b) if isinstance(b, str) else b for b in body), F.lit("</edit>"))
    patch = edit("<search>", t, "</search><replace>y</replace>")
    said = F.when(k == 0, patch).when(k == 1, edit("<insert>", t, "</insert>")).when(k == 2, edit("<code>", t, "</code>")).when(k == 3, F.concat(F.lit("<execute_bash>"), t, F.lit("</execute_bash>"))).when(k == 4, patch).otherwise(F.concat(F.lit("said "), t))
    a = G.parse_action(F.when(k == 4, said).otherwise(F.concat(F.lit("<think>t</think>"), said)))
    payload = F.when(k.isin(0, 4), F.md5(F.col("a.search"))).when(k == 1, F.md5(F.concat(F.col("a.insert"), F.lit("!")))).when(k == 2, F.md5(F.concat(F.col("a.content"), F.lit("!"))))
    return table(s, d, "documents").withColumn("a", a).select("doc_id", "a.type", "a.mode", "a.valid", payload.alias("payload"))


@register("f24_apply_edit", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(replace(text, 'zqzqx', 'y')) WHEN 1 THEN md5(CASE WHEN text = '' OR right(text, 1) = chr(10) THEN text || 'tail' ELSE text || chr(10) || 'tail' END) WHEN 2 THEN md5('new') ELSE md5(text) END AS h,
CASE WHEN doc_id % 4 = 0 AND text NOT LIKE '%zqzqx%' THEN 'search text not found' WHEN doc_id % 4 = 3 THEN 'empty insert' END AS error FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def f24(s, d):
    k = F.col("doc_id") % 4
    a = F.struct(F.when(k == 0, "patch").when(k == 2, "overwrite").otherwise("insert").alias("mode"), F.lit("zqzqx").alias("search"), F.lit("y").alias("replace"), F.when(k == 3, " \n").otherwise("tail").alias("insert"), F.lit("new").alias("content"))
    x = table(s, d, "documents").select("doc_id", S.apply_edit(F.col("text"), a).alias("x"))
    return x.select("doc_id", F.md5("x.content").alias("h"), "x.error")


def _trajectories(s, d):
    """Order lines as calls: viewers, editors and commands by line number."""
    li = table(s, d, "lineitem")
    n, path = F.col("l_linenumber"), F.concat(F.lit("/testbed/m"), (F.col("l_partkey") % 5).cast("string"), F.when(F.col("l_suppkey") % 2 == 0, ".py").otherwise(".txt"))
    arg = lambda name, v: F.concat(F.lit(f"<parameter={name}>"), v, F.lit("</parameter>"))
    call = (
        F.when(n % 4 == 0, F.concat(F.lit("<function=file_viewer>"), arg("path", path)))
        .when(n % 4 == 1, F.concat(F.lit("<function=file_editor>"), arg("command", F.lit("str_replace")), arg("path", path)))
        .when(n % 4 == 2, F.concat(F.lit("<function=execute_bash>"), arg("cmd", F.lit("ls /testbed/testbed"))))
        .otherwise(F.concat(F.lit("<function=file_editor>"), arg("command", F.lit("create")), arg("path", path)))
    )
    seen = F.array_join(F.array_repeat(F.lit("o"), (n + 1).cast("int")), "\n")
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", call.alias("action"), seen.alias("observation")))).alias("steps"))


TRAJ = "traj AS (SELECT l_orderkey, l_linenumber AS n, 'm' || l_partkey % 5 || CASE WHEN l_suppkey % 2 = 0 THEN '.py' ELSE '.txt' END AS path, CASE WHEN l_suppkey % 2 = 0 THEN 'py' ELSE 'txt' END AS ext FROM lineitem)"


@register("f81_edited_files", f"WITH {TRAJ} SELECT l_orderkey, coalesce(string_agg(path, ',' ORDER BY n, path) FILTER (n % 4 = 1), '') AS edited, coalesce(string_agg(path, ',' ORDER BY n, path) FILTER (n % 4 = 3), '') AS created, coalesce(string_agg('/testbed/' || path, ',' ORDER BY n, path) FILTER (n % 4 = 0), '') AS viewed, coalesce(string_agg(DISTINCT ext, ',' ORDER BY ext) FILTER (n % 4 = 1), '') AS ext FROM traj GROUP BY 1")
def f81(s, d):
    t, c = _trajectories(s, d), F.col("steps")
    return t.select("l_orderkey", F.array_join(G.edited_files(c), ",").alias("edited"), F.array_join(G.created_files(c), ",").alias("created"), F.array_join(G.viewed_files(c), ",").alias("viewed"), F.array_join(G.extensions(G.edited_files(c)), ",").alias("ext"))


@register("f82_bad_paths", f"WITH {TRAJ} SELECT l_orderkey, false AS editor, bool_or(n % 4 = 2) AS anywhere FROM traj GROUP BY 1")
def f82(s, d):
    t, c = _trajectories(s, d), F.col("steps")
    return t.select("l_orderkey", G.has_bad_editor_path(c).alias("editor"), G.has_bad_path(c).alias("anywhere"))


@register("f83_output_lines", f"WITH {TRAJ} SELECT l_orderkey, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (n % 4 = 2), '') AS breaks FROM traj GROUP BY 1")
def f83(s, d):
    return _trajectories(s, d).select("l_orderkey", F.array_join(F.transform(G.command_output_lines(F.col("steps")), lambda x: x.cast("string")), ",").alias("breaks"))


@register("f31_pytest_status", "SELECT o_orderkey, o_orderstatus = 'F' AS failed, CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'PASSED' END AS status, CAST(2 AS INT) AS n FROM orders")
def f31(s, d):
    line = F.concat(F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("PASSED"), F.lit(" t.py::K::test_a"), F.when(F.col("o_orderstatus") == "F", " - AssertionError").otherwise(""))
    log = F.concat(F.lit("FAILED x.py::early\n=== short test summary info ===\nPASSED t.py::test_b\n"), line, F.lit("\n1 failed"))
    x = table(s, d, "orders").select("o_orderkey", T.pytest_status(log).alias("m"))
    return x.select("o_orderkey", (F.col("m")["K.test_a"] == "FAILED").alias("failed"), F.col("m")["K.test_a"].alias("status"), F.size("m").alias("n"))


@register("f36_io_fingerprint", """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN sha256('not json ' || o_custkey) WHEN o_custkey % 3 = 1 THEN NULL ELSE sha256('{"i":["' || o_custkey || '"],"o":["7"]}') END AS h FROM orders""")
def f36(s, d):
    k = F.col("o_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("not json "), k.cast("string"))).when(k % 3 == 1, F.lit('{"inputs": [], "outputs": []}')).otherwise(F.concat(F.lit('{"inputs": ['), k.cast("string"), F.lit('], "outputs": ["7", "8"]}')))
    return table(s, d, "orders").select("o_orderkey", T.io_fingerprint(text).alias("h"))


@register("f38_preview_family", "SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'stub' WHEN 1 THEN 'harness' WHEN 2 THEN CASE WHEN o_orderkey % 16 >= 8 THEN 'block' ELSE 'fragment' END ELSE 'fragment' END AS family FROM orders")
def f38(s, d):
    k = F.col("o_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("x\\n  return"), F.lit(" None"))).when(k == 1, "a = input ()").when(k == 2, "y = 1").otherwise(F.lit(None))
    return table(s, d, "orders").select("o_orderkey", S.preview_family(text, F.when(k == 2, F.col("o_orderkey") % 16).otherwise(1)).alias("family"))


@register("f41_condense_thoughts", "SELECT o_orderkey, CASE WHEN o_custkey % 30 + 15 > 32 THEN 'i [ASSISTANT]b <function> [ASSISTANT]<Thought condensed for saving context><function> e' ELSE 'i [ASSISTANT]b <function> [ASSISTANT]' || repeat('w ', o_custkey % 30 + 10) || '<function> e' END AS t FROM orders")
def f41(s, d):
    text = F.concat(F.lit("i [ASSISTANT]b <function> [ASSISTANT]"), F.repeat(F.lit("w "), (F.col("o_custkey") % 30 + 10).cast("int")), F.lit("<function> e"))
    return table(s, d, "orders").select("o_orderkey", G.condense_thoughts(32)(text).alias("t"))


@register("f32_failure_blocks", "SELECT o_orderkey, 'test_' || (k + 1) AS test, 'E  ' || o_custkey AS message FROM orders, (SELECT range AS k FROM range(0, 2)) WHERE o_orderkey % 5 = 0")
def f32(s, d):
    block = lambda n: F.concat(F.lit(f"_____ test_{n} _____\n\n"), F.lit("E  "), F.col("o_custkey").cast("string"), F.lit("\n"))
    log = F.concat(F.lit("x\n==== FAILURES ====\n"), block(1), block(2), F.lit("==== short test summary info ====\nFAILED a"))
    x = table(s, d, "orders").filter("o_orderkey % 5 = 0").select("o_orderkey", F.explode(G.failure_blocks(log)).alias("b"))
    return x.select("o_orderkey", "b.test", "b.message")


@register("f89_call_results", "SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'true,true' WHEN 1 THEN 'false' ELSE 'true,false' END AS r FROM orders")
def f89(s, d):
    k = F.col("o_custkey") % 3
    got = F.array(F.when(k == 1, "2").otherwise("[1, 2]"), F.when(k == 2, '{"2": 1}').otherwise('{"1": 1}'))
    x = table(s, d, "orders").select("o_orderkey", G.call_results_match(got, F.array(F.lit("[[1, 2]]"), F.lit('{"1": 1}'))).alias("r"))
    return x.select("o_orderkey", F.array_join(F.transform("r", lambda v: v.cast("string")), ",").alias("r"))


# ---- functions that had no query ----
@register("f13_format_and_accuracy", "SELECT o_orderkey, round(CAST(0.9 AS DOUBLE) * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END + 0.1 * CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END, 4) AS score FROM orders")
def f13(s, d):
    k = F.col("o_custkey")
    return table(s, d, "orders").select("o_orderkey", r4(S.format_and_accuracy(F.when(k % 3 == 0, "<think>a</think> so \\boxed{1}").otherwise("\\boxed{1}"), k % 2 == 0)).alias("score"))


@register("f29_test_path", "SELECT p_partkey, p_partkey % 3 = 0 AS t FROM part")
def f29(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", T.is_test_path(F.when(k % 3 == 0, "a/tests/test_x.py").otherwise("a/src/contest.py")).alias("t"))


@register("f33_strip_ansi", "SELECT p_partkey, p_name AS n FROM part")
def f33(s, d):
    return table(s, d, "part").select("p_partkey", T.strip_ansi(F.concat(F.lit("\u001b[31m"), F.col("p_name"), F.lit("\u001b[0m"))).alias("n"))


@register("f43_passages", "SELECT r_regionkey, 'Doc 1 (Title: ' || r_name || ') a' || chr(10) || 'Doc 2 (Title: T) ' || r_name AS t FROM region")
def f43(s, d):
    doc = lambda a, b: F.struct(a.alias("title"), b.alias("text"))
    return table(s, d, "region").select("r_regionkey", S.passages(F.array(doc(F.col("r_name"), F.lit("a")), doc(F.lit("T"), F.col("r_name")))).alias("t"))


@register("f57_episode_score", "SELECT l_orderkey, l_linenumber, round(l_quantity / l_linenumber, 4) AS score FROM lineitem")
def f57(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", r4(S.episode_score(F.col("l_quantity"), F.col("l_linenumber"), True)).alias("score"))


@register("p48_preference_layout", "SELECT l_orderkey, l_partkey, CAST(greatest(l_linenumber, 3) AS INT) AS width, CAST(greatest(3 - l_linenumber, 0) AS INT) AS chosen_zeros, CAST(greatest(l_linenumber - 3, 0) AS INT) AS rejected_zeros, CAST(l_linenumber + 3 AS INT) AS tokens FROM lineitem")
def p48(s, d):
    li = table(s, d, "lineitem")
    x = li.select("l_orderkey", "l_partkey", C.preference_layout(F.sequence(F.lit(1), F.col("l_linenumber")), F.sequence(F.lit(5), F.lit(7))).alias("x"))
    zeros = lambda k: F.size(F.filter(F.col("x.ids")[k], lambda v: v == 0))
    return x.select("l_orderkey", "l_partkey", F.size(F.col("x.ids")[0]).alias("width"), zeros(0).alias("chosen_zeros"), zeros(1).alias("rejected_zeros"), F.aggregate(F.flatten("x.mask"), F.lit(0), lambda a, v: a + v).alias("tokens"))


# ---- readers and writers ----
def _round(s, d, suffix: str, kind: str, **options):
    at = shared_folder(s, "round") + suffix
    writers.write(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), at)
    return at


@register("k03_dump_by_step", "SELECT c_custkey, c_name, CAST(c_nationkey AS INT) AS step FROM customer")
def k03(s, d):
    at = shared_folder(s, "steps")
    writers.write_by_step(table(s, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("step")), at)
    return s.read.schema("c_custkey long, c_name string, step int").json(at)


@register("k05_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def k05(s, d):
    return s.read.option("header", True).schema("c_custkey long, c_name string, c_acctbal double").csv(_round(s, d, ".csv", "csv"))


@register("k01_parquet_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def k01(s, d):
    return readers.read(s, "parquet", _round(s, d, ".parquet", "parquet"))


@register("s06_jsonl_blank_lines", "SELECT c_custkey, c_name FROM customer")
def s06(s, d):
    at = shared_folder(s, "lines")
    c = table(s, d, "customer").select(F.explode(F.array(F.to_json(F.struct("c_custkey", "c_name")), F.lit("  "), F.lit("{broken"))).alias("value"))
    c.write.text(at)
    return readers.read(s, "jsonl", at, schema="c_custkey long, c_name string").filter("c_custkey IS NOT NULL")


@register("s13_json_document", "SELECT r_regionkey, r_name FROM region")
def s13(s, d):
    at = shared_folder(s, "json")
    table(s, d, "region").agg(F.collect_list(F.struct("r_regionkey", "r_name")).alias("per_instance")).select(F.to_json(F.struct("per_instance")).alias("value")).write.text(at)
    return readers.read(s, "json", at).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@register("s17_column_logs", "SELECT r_regionkey AS index, CAST(r_regionkey * 2 AS DOUBLE) AS a, CAST(r_regionkey * 3 AS DOUBLE) AS b FROM region")
def s17(s, d):
    at = shared_folder(s, "columns")
    for name, k in (("a", 2.0), ("b", 3.0)):
        table(s, d, "region").select(F.to_json(F.struct(F.col("r_regionkey").alias("index"), (F.col("r_regionkey") * k).alias("data"))).alias("value")).coalesce(1).write.text(f"{at}/{name}")
    return readers.read_column_logs(s, at, "*.txt").select("index", "a", "b")


@register("s08_cached_read", "SELECT r_regionkey, r_name FROM region")
def s08(s, d):
    at, url = shared_folder(s, "cache"), "https://example.org/data.parquet"
    table(s, d, "region").write.parquet(f"{at}/{N.cached_name(url)}")
    return N.read_cached(s, url, at)


@register("s15_first_files", "SELECT min(r_regionkey) AS k FROM region")
def s15(s, d):
    at = shared_folder(s, "commits")
    table(s, d, "region").orderBy("r_regionkey").limit(1).select(F.to_json(F.struct(F.col("r_regionkey").alias("k"))).alias("value")).coalesce(1).write.text(at)
    return N.first_files(s, at, 1).select(F.col("k").cast("int").alias("k"))


@register("t05_resample_until", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_orderstatus = 'F' ORDER BY 1 LIMIT 10")
def t05(s, d):
    o = table(s, d, "orders")
    need = lambda k: o.filter(F.col("o_orderkey") % 4 == k)
    enough = need(0).filter("o_orderstatus = 'F'").select("o_custkey").distinct().count() >= 10
    both = (lambda k: o.filter(F.col("o_orderkey") % 4 <= 1)) if enough else need
    return U.resample_until(both, lambda x: x.filter("o_orderstatus = 'F'"), "o_custkey", 10, 2).select("o_custkey").distinct()
