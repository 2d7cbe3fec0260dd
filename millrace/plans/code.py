"""Queries of source code made from the test tables' texts, of validation metrics, similar texts and trajectory logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import syntax as Y
from millrace.operators import similar as SM
from millrace.operators import validation as V
from millrace.operators.state import shared_folder
from millrace.plans.registry import register
from millrace.session import table
from millrace.sources import trajectories as TR


def _code(s, d):
    """A function a message: one assignment a line of its text, and what it returns."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("    line_"), i.cast("string"), F.lit(" = "), F.length(x).cast("string")))
    head, tail = F.concat(F.lit("def turn_"), F.col("turn").cast("string"), F.lit("(a, b=0):")), F.concat(F.lit("    return "), F.size(F.split("text", "\n")).cast("string"))
    return table(s, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.array_join(F.concat(F.array(head), lines, F.array(tail)), "\n").alias("code"))


#: The same code as a list of lines, with where each line starts.
CODE = r"""c AS (SELECT conv_id, turn, list_concat(['def turn_' || turn || '(a, b=0):'], list_transform(string_split(text, chr(10)), lambda x, i: '    line_' || (i - 1) || ' = ' || length(x)), ['    return ' || len(string_split(text, chr(10)))]) AS ls FROM conversations WHERE text IS NOT NULL),
l AS (SELECT conv_id, turn, len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM c),
p AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INT) AS upto, CAST(sum(length(line) + 1) OVER (PARTITION BY conv_id, turn) - 1 AS INT) AS whole FROM l),
u AS (SELECT conv_id, turn, 0 AS level, 'fn::turn_' || turn || '::pos2::kw0::va0::kwa0::ret1' AS signature, 0 AS a, whole AS b, 5 + 4 * (n - 2) + 2 AS size, NULL AS line FROM p WHERE i = 1
 UNION ALL SELECT conv_id, turn, 1, CASE WHEN i = n THEN 'stmt::Return' ELSE 'stmt::Assign::line_' || (i - 2) END, upto - length(line) + 4, upto, CASE WHEN i = n THEN 2 ELSE 4 END, line FROM p WHERE i > 1)"""


@register("f20_syntax_units", f"WITH {CODE} SELECT conv_id, turn, level, signature, a AS unit_start, b AS unit_end, CAST(size AS INT) AS size FROM u")
def f20(s, d):
    return Y.syntax_units(_code(s, d), "code").select("conv_id", "turn", "level", "signature", "unit_start", "unit_end", "size")


@register("x12_response_snippets", f"""WITH {CODE}, e AS (SELECT conv_id, turn, whole, n, 24 + length(CAST(conv_id AS VARCHAR)) AS o FROM p WHERE i = 1),
r AS (SELECT conv_id, turn, 'root::none::c' || conv_id || '.py::' || substr(md5(array_to_string(ls, chr(10))), 1, 10) AS signature FROM c)
SELECT conv_id, turn, 'root' AS origin, 0 AS level, signature, CAST(o AS INT) AS char_start, CAST(o + whole AS INT) AS char_end, CAST(n AS INT) AS size FROM e JOIN r USING (conv_id, turn)
UNION ALL SELECT conv_id, turn, 'fallback', level, signature, CAST(o + a AS INT), CAST(o + b AS INT), CAST(size AS INT) FROM u JOIN e USING (conv_id, turn)""")
def x12(s, d):
    c = _code(s, d).withColumn("id", F.struct("conv_id", "turn")).withColumn("response", F.concat(F.lit("<edit path='c"), F.col("conv_id").cast("string"), F.lit(".py'><code>"), "code", F.lit("</code></edit>")))
    return Y.response_snippets(c, "id", "response").select("id.*", "origin", "level", "signature", "char_start", "char_end", "size")


# ---- validation metrics: turns of a conversation as the responses to one prompt ----
def _turns(s, d):
    c = table(s, d, "conversations").filter("text IS NOT NULL")
    return c.select((F.col("conv_id") % 3).alias("source"), "conv_id", "turn", F.length("text").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("words"), (F.length("text") % 3).cast("string").alias("vote"))


#: The tables of indices for up to ten responses, a digit an index; they follow from the seed.
DRAWS = ", ".join(f"({n}, {k}, '{''.join(map(str, V.draw_indices(n, k).ravel()))}')" for n in range(2, 9) for k in V.subset_sizes(n))
METRICS_SQL = f"""WITH c AS (SELECT conv_id % 3 AS source, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, CAST(length(text) AS DOUBLE) AS chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS words, length(text) % 3 AS vote FROM conversations WHERE text IS NOT NULL),
l AS (SELECT source, conv_id, i, n, vote, 'chars' AS variable, chars AS v FROM c UNION ALL SELECT source, conv_id, i, n, vote, 'words', words FROM c),
m(n, k, s) AS (VALUES {DRAWS}), e AS (SELECT n, k, s, unnest(range(0, CAST(length(s) AS BIGINT))) AS j FROM m), d AS (SELECT n, k, j // k AS draw, j % k AS pos, CAST(substr(s, CAST(j + 1 AS INT), 1) AS INT) AS i FROM e),
x AS (SELECT l.source, l.conv_id, l.variable, d.k, d.draw, d.pos, l.v, l.vote FROM l JOIN d ON d.n = l.n AND d.i = l.i),
b AS (SELECT source, conv_id, variable, k, draw, max(v) AS best, min(v) AS worst FROM x GROUP BY ALL), t AS (SELECT source, conv_id, variable, k, draw, vote, count(*) AS votes, min(pos) AS pos, arg_min(v, pos) AS v FROM x GROUP BY ALL),
j AS (SELECT source, conv_id, variable, k, draw, v AS maj FROM (SELECT *, row_number() OVER (PARTITION BY source, conv_id, variable, k, draw ORDER BY votes DESC, pos) AS r FROM t) WHERE r = 1),
p AS (SELECT source, conv_id, variable, 'mean@' || n AS metric, avg(v) AS value FROM l GROUP BY source, conv_id, variable, n UNION ALL SELECT source, conv_id, variable, 'std@' || n, stddev_pop(v) FROM l WHERE n > 1 GROUP BY source, conv_id, variable, n
 UNION ALL SELECT source, conv_id, variable, 'best@' || k || '/mean', avg(best) FROM b GROUP BY source, conv_id, variable, k UNION ALL SELECT source, conv_id, variable, 'best@' || k || '/std', stddev_pop(best) FROM b GROUP BY source, conv_id, variable, k
 UNION ALL SELECT source, conv_id, variable, 'worst@' || k || '/mean', avg(worst) FROM b GROUP BY source, conv_id, variable, k UNION ALL SELECT source, conv_id, variable, 'worst@' || k || '/std', stddev_pop(worst) FROM b GROUP BY source, conv_id, variable, k
 UNION ALL SELECT source, conv_id, variable, 'maj@' || k || '/mean', avg(maj) FROM j GROUP BY source, conv_id, variable, k UNION ALL SELECT source, conv_id, variable, 'maj@' || k || '/std', stddev_pop(maj) FROM j GROUP BY source, conv_id, variable, k)
SELECT source, variable, metric, round(avg(value), 7) AS value FROM p GROUP BY source, variable, metric"""


@register("a57_validation_metrics", METRICS_SQL)
def a57b(s, d):
    m = V.validation_metrics(_turns(s, d), "source", "conv_id", "turn", ["chars", "words"], vote="vote")
    return m.select("source", "variable", "metric", (F.round("value", 7) + 0.0).alias("value"))


# ---- similar texts: whole messages of one role ----
def _messages(s, d):
    return table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "role", "text")


@register("j12_text_classes", "SELECT role, conv_id * 1000 + turn AS row_id, min(conv_id * 1000 + turn) OVER (PARTITION BY role, text) AS representative FROM conversations")
def j12c(s, d):
    return SM.text_classes(_messages(s, d), "row_id", "text", "role")


@register("j12_similar_pairs")
def j12b(s, d):
    """Whole messages, and each without its last word, by conversation and role."""
    m = table(s, d, "conversations").select("conv_id", "role", F.col("turn").alias("row_id"), "text")
    cut = m.select("conv_id", "role", (F.col("row_id") + 1000).alias("row_id"), F.regexp_replace("text", "[ \n][^ \n]*$", "").alias("text"))
    return SM.similar_pairs(m.unionByName(cut), "row_id", "text", 0.95, "conv_id", "role")


# ---- trajectory logs with bad lines: events as JSON lines, of which every seventh is cut short ----
def _log(s, d):
    e = table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("traj_id"), F.col("event_id").alias("step"), F.col("event_type").alias("action"), F.col("value").alias("reward"))).alias("line"))
    at = shared_folder(s, "query")
    e.select(F.when(F.col("event_id") % 7 == 0, F.left("line", F.length("line") - 3)).otherwise(F.col("line")).alias("value")).write.text(at)
    return at


@register("s14_records", "SELECT user_id AS traj_id, event_id AS step, event_type AS action, value AS reward FROM events WHERE event_id % 7 <> 0")
def s14(s, d):
    return TR.read_records(s, _log(s, d), "traj_id bigint, step bigint, action string, reward double")[0]


@register("s14_bad_lines", "SELECT count(*) AS lines, count(*) FILTER (event_id % 7 = 0) AS bad FROM events")
def s14b(s, d):
    return TR.read_records(s, _log(s, d), "traj_id bigint, step bigint, action string, reward double")[1].agg(F.sum("lines").alias("lines"), F.sum("bad").alias("bad"))


@register("x06_custom_source", "SELECT CASE WHEN event_id % 7 <> 0 THEN event_type END AS action, count(*) AS n, round(sum(CASE WHEN event_id % 7 <> 0 THEN value END), 4) AS total FROM events GROUP BY 1")
def x06(s, d):
    TR.register(s)
    return s.read.format("trajectory_log").load(_log(s, d)).groupBy("action").agg(F.count("*").alias("n"), F.round(F.sum("reward"), 4).alias("total"))
