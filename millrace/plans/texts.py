"""Queries of text functions, corpus preparation, readers, writers and streams on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import corpus as C
from millrace.operators import registry as X
from millrace.operators import returns as R
from millrace.operators.state import shared_folder
from millrace.plans.registry import register
from millrace.plans.views import STEPS, steps
from millrace.session import table
from millrace.sources import readers, writers
from millrace.streaming import events as S
from millrace.streaming import keyed as K


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


def _orders(s, d):
    """Order lines of text with numbers in them."""
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.concat(F.lit("total "), F.col("o_custkey").cast("string"), F.lit(" so\n#### "), F.col("o_custkey").cast("string"), F.lit(","), F.col("o_orderkey").cast("string")).alias("t"), F.concat("o_custkey", "o_orderkey").alias("truth"), "o_orderstatus", "o_orderpriority")


ORD = "ord AS (SELECT o_orderkey, 'total ' || o_custkey || ' so' || chr(10) || '#### ' || o_custkey || ',' || o_orderkey AS t, o_custkey || '' || o_orderkey AS truth, o_orderstatus, o_orderpriority FROM orders)"


@register("f01_strict_answer", f"WITH {ORD} SELECT o_orderkey, replace(replace(regexp_extract(t, '#### (-?[0-9.,]+)', 1), ',', ''), '$', '') AS a FROM ord")
def f01(s, d):
    return _orders(s, d).select("o_orderkey", T.strict_answer(F.col("t")).alias("a"))


@register("f01_flexible_answer", f"WITH {ORD} SELECT o_orderkey, list_last(list_filter(regexp_extract_all(t, '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.'))) AS a FROM ord")
def f01b(s, d):
    return _orders(s, d).select("o_orderkey", T.flexible_answer(F.col("t")).alias("a"))


@register("f02_answer_score", f"WITH {ORD} SELECT o_orderkey, CASE WHEN replace(regexp_extract(t, '#### (-?[0-9.,]+)', 1), ',', '') = truth THEN 1.0 ELSE 0.1 END AS score FROM ord")
def f02(s, d):
    return _orders(s, d).select("o_orderkey", T.answer_score(T.strict_answer(F.col("t")), F.col("truth"), 1.0, 0.1).alias("score"))


@register("f03_normal_answer", r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')) AS h FROM documents WHERE lang = 'en'""")
def f03(s, d):
    return table(s, d, "documents").filter("lang = 'en'").select("doc_id", F.md5(T.normal_answer(F.col("text"))).alias("h"))


@register("f04_exact_match", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 1.0 ELSE 0.0 END AS em, CASE WHEN lower(o_orderpriority) LIKE '%high%' THEN 1.0 ELSE 0.0 END AS sub FROM orders")
def f04(s, d):
    o = _orders(s, d)
    return o.select("o_orderkey", T.exact_match(F.col("o_orderstatus"), F.array(F.lit("f!"), F.lit("the O"))).alias("em"), T.contains_match(F.col("o_orderpriority"), F.array(F.lit("High"))).alias("sub"))


@register("f05_last_tagged", "SELECT page_id, trim(list_last(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1))) AS a FROM pages")
def f05(s, d):
    return table(s, d, "pages").select("page_id", T.last_tagged(F.col("html"), "li").alias("a"))


@register("f06_tag_counts", "SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS INT) AS n FROM pages")
def f06(s, d):
    return table(s, d, "pages").select("page_id", T.count_of(F.col("html"), "<p>").alias("n"))


@register("f16_same_output", "SELECT conv_id, turn, trim(text) = trim(text || ' ') AS same FROM conversations")
def f16(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.same_output(F.col("text"), F.concat("text", F.lit(" "))).alias("same"))


@register("f18_normal_source", r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+#.*$', ''), '\s+$', '')), lambda x: trim(x) <> ''), chr(10))) AS h FROM documents")
def f18(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.normal_source(F.col("text"))).alias("h"))


@register("f22_edit_hint", "SELECT page_id, regexp_matches(html, '(?i)<edit\\b|<code>|```') AS hint FROM pages")
def f22(s, d):
    return table(s, d, "pages").select("page_id", T.has_edit_hint(F.col("html")).alias("hint"))


@register("f25_parse_call", "SELECT o_orderkey, 'edit' AS name, CAST(o_custkey AS VARCHAR) AS path, o_orderstatus AS mode FROM orders")
def f25(s, d):
    o = table(s, d, "orders")
    t = F.concat(F.lit("<function=edit><parameter=path>0</parameter><parameter=path>"), F.col("o_custkey").cast("string"), F.lit("</parameter><parameter=mode> "), "o_orderstatus", F.lit("\n</parameter></function>"))
    c = o.select("o_orderkey", T.parse_call(t).alias("c"))
    return c.select("o_orderkey", "c.name", F.col("c.parameters")["path"].alias("path"), F.col("c.parameters")["mode"].alias("mode"))


@register("f30_message_kind", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%fix%' OR lower(p_name) LIKE '%bug%' THEN 'bugfix' WHEN lower(p_name) LIKE '%feature%' OR lower(p_name) LIKE '%add%' THEN 'feature' WHEN lower(p_name) LIKE '%refactor%' THEN 'refactor' ELSE 'other' END AS kind FROM part")
def f30(s, d):
    return table(s, d, "part").select("p_partkey", T.message_kind(F.col("p_name")).alias("kind"))


@register("f34_linked_numbers", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS n FROM orders")
def f34(s, d):
    return table(s, d, "orders").select("o_orderkey", T.linked_numbers(F.concat(F.lit("fixes #"), F.col("o_custkey").cast("string"), F.lit(".")))[0].alias("n"))


@register("f35_question_hash", r"SELECT doc_id, sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS h FROM documents")
def f35(s, d):
    return table(s, d, "documents").select("doc_id", T.question_hash(F.col("text")).alias("h"))


@register("f37_short_hash", "SELECT doc_id, substr(md5(text), 1, 10) AS h FROM documents")
def f37(s, d):
    return table(s, d, "documents").select("doc_id", T.short_hash(F.col("text")).alias("h"))


@register("f39_clean_title", r"SELECT doc_id, md5(replace(regexp_replace(replace(trim(text), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ')) AS h FROM documents")
def f39(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.clean_title(F.col("text"))).alias("h"))


@register("f40_truncate", "SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN left(text, 50) || right(text, 50) ELSE text END) AS h FROM documents")
def f40(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.truncate_text(F.col("text"), 100)).alias("h"))


@register("f46_digit_sequence", "SELECT event_id, array_to_string(list_transform(range(1, 5), lambda i: (event_id % 9 + 3 + 3 * i) % 50), ',') AS seq FROM events")
def f46(s, d):
    e = F.col("event_id") % 9
    return table(s, d, "events").select("event_id", T.digit_sequence(F.concat(e.cast("string"), F.lit(","), (e + 3).cast("string"), F.lit(":50,4"))).alias("seq"))


@register("f53_ceil_div", "SELECT event_id, CAST(ceil(event_id / 7.0) AS BIGINT) AS q, CAST(ceil(event_id / 7.0) * 7 AS BIGINT) AS up FROM events")
def f53(s, d):
    q = F.ceil(F.col("event_id") / 7)
    return table(s, d, "events").select("event_id", q.alias("q"), (q * 7).alias("up"))


@register("f55_overlong_penalty", "SELECT doc_id, round(least(-(n_chars - 1500) / 500 * 0.5, 0), 4) + 0.0 AS penalty FROM documents")
def f55(s, d):
    from millrace.operators.losses import overlong_penalty

    return table(s, d, "documents").select("doc_id", r4(overlong_penalty(F.col("n_chars"), 2000, 500, 0.5)).alias("penalty"))


@register("f62_numeric_equal", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - l_tax * 100) <= 1e-4 * greatest(l_quantity, l_tax * 100) OR abs(l_quantity - l_tax) <= 1e-4 * greatest(l_quantity, l_tax) OR abs(l_quantity - l_tax / 100) <= 1e-4 * greatest(l_quantity, l_tax / 100) AS eq FROM lineitem")
def f62(s, d):
    li = table(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", T.numeric_equal(F.concat(F.lit("$"), F.col("l_quantity").cast("string")), F.col("l_tax").cast("string")).alias("eq"))


@register("f71_last_user_text", "SELECT conv_id, md5(coalesce(arg_max(text, turn) FILTER (role = 'user'), arg_max(text, turn))) AS h FROM conversations GROUP BY 1")
def f71(s, d):
    return C.messages(table(s, d, "conversations")).select("conv_id", F.md5(C.last_user_text(F.col("messages"))).alias("h"))


@register("f75_first_truthy", "SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END), ''), 'none') AS v FROM events")
def f75(s, d):
    return table(s, d, "events").select("event_id", T.first_truthy(F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")), F.lit("none")).alias("v"))


@register("f78_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f78(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("f80_view_range", "SELECT event_id, user_id + 1 AS n FROM events")
def f80(s, d):
    return table(s, d, "events").select("event_id", T.view_range_length(F.concat(F.lit("[10, "), (F.col("user_id") + 10).cast("string"), F.lit("]"))).cast("long").alias("n"))


@register("f86_reward_dispatch", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value ELSE 0 END AS score FROM events")
def f86(s, d):
    v = F.col("value")
    return table(s, d, "events").select("event_id", X.dispatch_score(F.col("event_type"), {"click": v, "view": v, "error": F.lit(0), "signup": F.lit(0), "purchase": F.lit(0)}).alias("score"))


@register("f88_substring_search", "SELECT source, count(*) AS n FROM documents WHERE contains(text, 'the ') GROUP BY 1")
def f88(s, d):
    return table(s, d, "documents").filter(F.col("text").contains("the ")).groupBy("source").agg(F.count("*").alias("n"))


@register("f07_last_boxed", r"""SELECT o_orderkey, regexp_extract('so \boxed{\frac{1}{' || o_custkey || '}}', '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1) AS a FROM orders""")
def f07(s, d):
    return table(s, d, "orders").select("o_orderkey", T.last_boxed(F.concat(F.lit("so \\boxed{\\frac{1}{"), F.col("o_custkey").cast("string"), F.lit("}}"))).alias("a"))


@register("f08_normal_latex")
def f08(s, d):
    return table(s, d, "orders").select("o_orderkey", T.normal_latex(F.concat(F.lit("\\dfrac1"), (F.col("o_custkey") % 10).cast("string"))).alias("a"))


@register("f27_parse_diff")
def f27(s, d):
    t = F.concat(F.lit("--- a/x.py\n+++ b/x.py\n@@ -"), F.col("o_orderkey").cast("string"), F.lit(",2 +3,2 @@\n context\n-old\n+new"))
    return table(s, d, "orders").select("o_orderkey", F.explode(T.parse_diff(t)).alias("l")).select("o_orderkey", "l.*")


@register("f91_source_entities")
def f91(s, d):
    t = F.concat(F.lit("import os\nclass A:\n    def f"), F.col("o_orderkey").cast("string"), F.lit("(self):\n        return 1\n"))
    return table(s, d, "orders").select("o_orderkey", F.explode(T.source_entities(t)).alias("e")).select("o_orderkey", "e.*")


@register("j12_similarity")
def j12(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.left("text", F.lit(200)).alias("t"))
    a, b = c.alias("a"), c.alias("b")
    p = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 2 == F.col("b.turn")))
    return p.select("a.conv_id", "a.turn", T.similarity(F.col("b.t"), F.col("a.t")).alias("ratio"))


# ---- corpus ----
@register("p25_episode_filter", "SELECT conv_id AS instance_id, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6 AND min(length(text)) > 30")
def p25(s, d):
    t = F.struct(F.col("text").alias("user_prompt"), F.col("text").alias("assistant_response"), (F.length("text") > 30).alias("valid_action"))
    e = table(s, d, "conversations").groupBy(F.col("conv_id").alias("instance_id")).agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(t)).alias("transcript")).withColumn("outcome", F.lit("won"))
    return C.episode_filter(e, ["won"], 2, 6).select("instance_id", "turns")


@register("p40_prompt_rows", "SELECT item_id AS idx, text AS question, sha256(text) AS answer FROM benchmark")
def p40(s, d):
    b = table(s, d, "benchmark")
    r = b.select(*C.prompt_row(F.lit("bench"), F.col("text"), F.sha2("text", 256), F.col("item_id"), "test"))
    return r.select(F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("question"), F.col("reward_model.ground_truth").alias("answer"))


@register("p47_assistant_spans", "SELECT conv_id, turn, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS start_at, CAST(sum(length(text)) OVER w AS BIGINT) AS end_at, role = 'assistant' AS trained FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def p47(s, d):
    return C.assistant_spans(table(s, d, "conversations"), F.length("text"))


@register("p22_difficulty_filter", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '5-low')")
def p22(s, d):
    return C.filter_difficulty(table(s, d, "orders"), F.col("o_orderpriority"), "1-URGENT, 5-low").select("o_orderkey")


@register("p21_length_filter", r"SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) <= 200")
def p21(s, d):
    return table(s, d, "documents").filter(F.size(F.split("text", " ")) <= 200).select("doc_id")


@register("p29_date_range", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1997-01-01'")
def p29(s, d):
    t = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(s, d, "orders").filter((t >= "1996-01-01") & (t < "1997-01-01")).select("o_orderkey")


@register("p38_stable_ids", "SELECT c_name FROM customer WHERE c_name <> '' AND NOT regexp_matches(c_name, '^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$') ORDER BY c_custkey LIMIT 30")
def p38(s, d):
    return S.first_ids(table(s, d, "customer"), "c_custkey", "c_name", 30).select("c_name")


@register("u07_set_relation", f"WITH {STEPS}, g AS (SELECT traj_uid, list(DISTINCT anchor_obs) FILTER (reward > 100) AS a, list(DISTINCT anchor_obs) FILTER (reward < 30) AS b FROM steps GROUP BY 1) SELECT traj_uid, CASE WHEN list_has_all(b, a) AND list_has_all(a, b) THEN 'equal' WHEN list_has_all(b, a) THEN 'subset' WHEN list_has_all(a, b) THEN 'superset' WHEN list_has_any(a, b) THEN 'overlap' ELSE 'disjoint' END AS rel FROM g WHERE a IS NOT NULL AND b IS NOT NULL")
def u07(s, d):
    g = steps(s, d).groupBy("traj_uid").agg(F.collect_set(F.when(F.col("reward") > 100, F.col("anchor_obs"))).alias("a"), F.collect_set(F.when(F.col("reward") < 30, F.col("anchor_obs"))).alias("b"))
    return g.filter((F.size("a") > 0) & (F.size("b") > 0)).select("traj_uid", C.set_relation(F.col("a"), F.col("b")).alias("rel"))


# ---- readers and writers: through the shared checkpoint folder ----
def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "query")


@register("s01_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1000")
def s01(s, d):
    return readers.read(s, "parquet", f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"]).filter("o_orderkey < 1000")


@register("s09_glob_scan", "SELECT count(*) AS n FROM region")
def s09(s, d):
    return readers.read(s, "parquet", f"{d}/regio*.parquet").agg(F.count("*").alias("n"))


@register("s16_metric_log", "SELECT user_id AS step, 'mean/value' AS metric, round(avg(value), 3) AS value FROM events GROUP BY 1 UNION ALL SELECT user_id, 'n', count(*) FROM events GROUP BY 1")
def s16(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").alias("step")).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    long = e.select("step", F.expr("stack(2, 'mean/value', m, 'n', CAST(n AS DOUBLE)) AS (metric, value)"))
    at = _folder(s)
    writers.console_lines(long).select("line").write.text(at)
    return readers.read(s, "metric_log", at)


@register("s22_synthetic", "SELECT range AS index, 'text' AS data_source FROM range(100)")
def s22(s, d):
    return readers.read(s, "synthetic", 100).select("index", "data_source")


@register("k02_jsonl_round_trip", "SELECT doc_id, text, lang FROM documents")
def k02(s, d):
    at = _folder(s) + ".jsonl"
    writers.write(table(s, d, "documents").select("doc_id", "text", "lang"), at)
    return readers.read(s, "jsonl", at, schema="doc_id long, text string, lang string")


@register("k04_latest_view", f"WITH {STEPS} SELECT traj_uid, max(row_id) AS row_id FROM steps GROUP BY 1")
def k04(s, d):
    return writers.latest(steps(s, d).select("traj_uid", "row_id", "reward"), "row_id", "traj_uid").select("traj_uid", "row_id")


@register("k11_wide_samples", f"WITH {STEPS} SELECT traj_uid, max(anchor_obs) FILTER (step = 0) AS anchor_obs_1, max(anchor_obs) FILTER (step = 1) AS anchor_obs_2 FROM steps GROUP BY 1")
def k11(s, d):
    return writers.wide_samples(steps(s, d), "traj_uid", "step", ["anchor_obs"], 2)


@register("k13_console_lines", "WITH e AS (SELECT user_id, avg(value) AS m, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) SELECT user_id AS step, 'step:' || user_id || ' - n:' || printf('%.3f', n) AS line FROM e")
def k13(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").alias("step")).agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("n"))
    return writers.console_lines(e)


# ---- streams ----
def _stream(s: SparkSession, d: str) -> DataFrame:
    return S.read_stream(s, d, s.read.parquet(f"{d}/events.parquet").schema, pattern="events.parquet")


@register("t00_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t00(s, d):
    w = S.tumbling(table(s, d, "events"), "1 hour", [F.count("*").alias("n"), r4(F.sum("value")).alias("total")], "event_type")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@register("t00_sliding", "WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS window_start, value FROM events, range(2) t(k)) SELECT window_start, count(*) AS n FROM w GROUP BY 1")
def t00b(s, d):
    w = S.sliding(table(s, d, "events"), "1 hour", "30 minutes", [F.count("*").alias("n")])
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@register("t00_sessions", "WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts <= p + INTERVAL 2 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) SELECT user_id, min(ts) AS window_start, count(*) AS n FROM g GROUP BY user_id, k")
def t00c(s, d):
    w = S.sessions(table(s, d, "events"), "2 hours", [F.count("*").alias("n")], "user_id")
    return w.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@register("t01_rollouts_batch", f"WITH {STEPS}, e AS (SELECT traj_uid, min(step) FILTER (anchor_obs = 'error') AS e FROM steps GROUP BY 1) SELECT traj_uid, count(*) AS n_steps, round(sum(reward), 4) AS total FROM steps JOIN e USING (traj_uid) WHERE step <= coalesce(e, 1000000) AND step < 8 GROUP BY 1")
def t01(s, d):
    return S.rollouts_batch(steps(s, d), 8, "error").select("traj_uid", "n_steps", r4(F.col("total")).alias("total"))


@register("t01_rollouts_stream", f"WITH {STEPS}, e AS (SELECT traj_uid, min(step) FILTER (anchor_obs = 'error') AS e FROM steps GROUP BY 1) SELECT traj_uid, count(*) AS n_steps, round(sum(reward), 4) AS total FROM steps JOIN e USING (traj_uid) WHERE step <= coalesce(e, 1000000) AND step < 8 GROUP BY 1")
def t01b(s, d):
    at = _folder(s)
    steps(s, d).select("traj_uid", "step", "anchor_obs", "reward").write.parquet(at)
    stream = s.readStream.schema("traj_uid long, step int, anchor_obs string, reward double").parquet(at)
    out = S.rollouts(stream, 8, _is_error)
    done = S.run_to_memory(out, "rollouts_" + uuid.uuid4().hex, "update", _folder(s))
    return R.last_per_key(done, "n_steps", "traj_uid").select("traj_uid", "n_steps", r4(F.col("total")).alias("total"))


def _is_error(obs: str) -> bool:
    return obs == "error"


@register("t02_windowed_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def t02(s, d):
    w = S.tumbling(_stream(s, d), "1 hour", [F.count("*").alias("n")], "event_type")
    return S.run_to_memory(w, "windows_" + uuid.uuid4().hex, "complete", _folder(s)).groupBy("event_type").agg(F.sum("n").alias("n"))


@register("t07_beta_sequence", "WITH RECURSIVE k AS (SELECT row_number() OVER (ORDER BY event_id) AS i, value / 100 AS kl FROM events WHERE event_id < 60), b AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0.2 AS DOUBLE) AS beta UNION ALL SELECT k.i, beta * (1 + greatest(least(kl / 2 - 1, 0.2), -0.2) * 64 / 1000) FROM b JOIN k ON k.i = b.i + 1) SELECT i, round(beta, 6) AS beta FROM b WHERE i > 0")
def t07(s, d):
    from millrace.operators.losses import beta_sequence

    e = table(s, d, "events").filter("event_id < 60").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") / 100).alias("k")))).alias("s"))
    b = e.select(F.posexplode(beta_sequence(F.col("s")["k"], 0.2, 2.0, 1000, 64)).alias("i", "beta"))
    return b.select((F.col("i") + 1).cast("long").alias("i"), F.round("beta", 6).alias("beta"))


@register("t03_gate_stream", "SELECT CAST(user_id AS VARCHAR) AS traj, event_id AS place, event_type AS name, coalesce(lag(CAST(floor(value / 100) AS INT)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) <> CAST(floor(value / 100) AS INT), true) AS changed FROM events")
def t03(s, d):
    source = F.floor(F.col("value") / 100).cast("string")
    with K.state_store(s):
        return S.run_to_files(K.gate_changes(_stream(s, d), "user_id", "event_id", F.col("event_type"), source, F.lit(False)), _folder(s), _folder(s))


@register("t06_locked_ids", """WITH f AS (SELECT event_type AS run, 'u' || user_id AS id, min(event_id) AS place FROM events GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY place, id) - 1 AS INT) AS rank FROM f)
SELECT run, rank, id FROM r WHERE rank < 5""")
def t06(s, d):
    rows = _stream(s, d).withColumn("id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    with K.state_store(s):
        return S.run_to_memory(K.lock_ids(rows, "event_type", "event_id", "id", 5), "lock_" + uuid.uuid4().hex, "append", _folder(s))


@register("t08_late_rewards", "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 90 <= 60 THEN value END AS reward FROM events")
def t08(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    end = e.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(None).cast("double").alias("value"))  # the last watermark
    steps, rewards = _folder(s), _folder(s)
    e.unionByName(end).select("event_id", "ts").write.parquet(steps)
    late = e.filter("event_id % 3 <> 0").withColumn("ts", F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int")))
    late.unionByName(end).select("event_id", F.col("ts").alias("rewarded_at"), F.col("value").alias("reward")).write.parquet(rewards)
    joined = K.with_late_rewards(s.readStream.schema("event_id long, ts timestamp").parquet(steps), s.readStream.schema("event_id long, rewarded_at timestamp, reward double").parquet(rewards), "event_id", "ts", "rewarded_at", "60 MINUTES")
    with K.state_store(s):  # all steps and rewards wait in state: on the executors' disks, not on their heaps
        return S.run_to_files(joined, _folder(s), _folder(s)).filter("event_id >= 0").select("event_id", "reward")


@register("t10_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderstatus = 'F'")
def t10(s, d):
    o = table(s, d, "orders")
    prior = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "timeout").alias("error"))
    return S.resume(o, prior, "o_orderkey").select("o_orderkey")


@register("t12_request_states", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'tool' WHEN 'signup' THEN 'reply' WHEN 'purchase' THEN 'finish' ELSE event_type END AS event FROM events),
t(a, b, c) AS (VALUES TRANSITION_ROWS),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'pending' AS state FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT f.user_id, e.n, coalesce(t.c, f.state) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1 LEFT JOIN t ON t.a = f.state AND t.b = e.event)
SELECT user_id, arg_max(state, n) AS state FROM f GROUP BY user_id""".replace("TRANSITION_ROWS", ", ".join(str((a, b, c)) for (a, b), c in S.TRANSITIONS.items())))
def t12(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.create_map(*(F.lit(x) for x in ("view", "start", "click", "tool", "signup", "reply", "purchase", "finish", "error", "error")))[F.col("event_type")].alias("event"))
    return S.request_states(e, "event_id", "event", "user_id")


@register("x03_vector_scorer", "SELECT event_id, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS score FROM events")
def x03(s, d):
    score = X.vector_scorer(_equal)
    return table(s, d, "events").select("event_id", score(F.col("event_type"), F.lit("click")).alias("score"))


def _equal(responses: list[str], truths: list[str]) -> list[float]:
    return [float(a == b) for a, b in zip(responses, truths)]


@register("x08_estimator_dispatch", "SELECT o_orderkey, round(CASE WHEN count(*) OVER w > 1 THEN (o_totalprice - avg(o_totalprice) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE o_totalprice END, 2) + 0.0 AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def x08(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"), F.col("o_totalprice").alias("score"))
    return X.advantage(o, "rloo").select("o_orderkey", (F.round("advantage", 2) + 0.0).alias("advantage"))


@register("q03_on_partitions", "SELECT event_id, value * 2 AS value FROM events")
def q03(s, d):
    return X.on_partitions(table(s, d, "events").select("event_id", "value"), _double, "event_id long, value double", 4)


def _double(pdf):
    return pdf.assign(value=pdf["value"] * 2)
