"""Queries of commits, root edits, smoothing, golden states, conversions, and whole-table forms on the test tables."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import scoring as S
from millrace.functions import snippets as R
from millrace.functions import text as T
from millrace.operators import batch as B
from millrace.operators import commits as K
from millrace.operators import corpus as C
from millrace.operators import graph as GR
from millrace.operators import joins as J
from millrace.operators import metrics as M
from millrace.operators import registry as X
from millrace.operators import selection as N
from millrace.operators import smoothing as H
from millrace.operators.losses import beta_sequence
from millrace.operators.state import shared_folder
from millrace.plans.registry import register
from millrace.session import table
from millrace.sources import readers, writers


# ---- commits: order lines as changed lines and as changed entities ----
def _path():
    folder = F.when(F.col("l_suppkey") % 4 == 0, "tests/").otherwise("src/")
    return F.concat(folder, F.lit("f"), (F.col("l_partkey") % 5).cast("string"), F.when(F.col("l_partkey") % 11 == 0, ".md").otherwise(".py"))


def _change(a: str, r: str, n: str):
    return F.when(F.col("l_returnflag") == "A", a).when(F.col("l_returnflag") == "R", r).otherwise(n)


def _lines(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("commit_id"), _path().alias("path"), F.col("l_linenumber").alias("hunk"), _change("added", "deleted", "context").alias("kind"), F.col("l_partkey").cast("string").alias("content"))


def _entities(s, d):
    li, text = table(s, d, "lineitem"), lambda c, k: (F.col(c) % k).cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("function", "method", "class", "statement"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    name = F.concat(F.when(F.col("l_partkey") % 37 == 0, "issue_").otherwise("n"), text("l_partkey", 9))
    return li.select(F.col("l_orderkey").alias("commit_id"), _path().alias("path"), kind.alias("kind"), name.alias("name"), F.concat(F.lit("x = n"), text("l_suppkey", 9), F.lit("(1)")).alias("content"), _change("added", "deleted", "modified").alias("change"))


PATH = "CASE WHEN l_suppkey % 4 = 0 THEN 'tests/' ELSE 'src/' END || 'f' || (l_partkey % 5) || CASE WHEN l_partkey % 11 = 0 THEN '.md' ELSE '.py' END AS path"
LINES = f"ln AS (SELECT l_orderkey AS commit_id, {PATH}, l_linenumber AS hunk, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'context' END AS kind, CAST(l_partkey AS VARCHAR) AS content FROM lineitem)"
LINE_STATS = """hs AS (SELECT commit_id, bool_and(a = 0 OR r = 0) AS all_one_way FROM (SELECT commit_id, path, hunk, count(*) FILTER (kind = 'added') AS a, count(*) FILTER (kind = 'deleted') AS r FROM ln GROUP BY ALL) GROUP BY 1),
ls AS (SELECT commit_id, count(DISTINCT path) AS files, count(DISTINCT path) FILTER (path LIKE 'tests/%') AS test_files, count(DISTINCT path) FILTER (path LIKE 'src/%') AS non_test_files, count(DISTINCT path || ' ' || hunk) AS hunks,
 count(*) FILTER (kind <> 'context') AS edited_lines, count(*) FILTER (kind <> 'context' AND path LIKE 'src/%') AS non_test_edited_lines, count(*) FILTER (kind <> 'context' AND path LIKE '%.py') AS python_edited_lines,
 CAST(sum(length(content) + 2) AS BIGINT) AS patch_chars, bool_and(path LIKE '%.py') AS only_python, false AS mypy_test, count(*) FILTER (kind = 'deleted') = 0 AS all_insert, count(*) FILTER (kind = 'added') = 0 AS all_delete, any_value(all_one_way) AS all_one_way
 FROM ln JOIN hs USING (commit_id) GROUP BY 1)"""
ENTITIES = f"""en AS (SELECT l_orderkey AS commit_id, {PATH}, ['function', 'method', 'class', 'statement'][l_linenumber % 4 + 1] AS kind, CASE WHEN l_partkey % 37 = 0 THEN 'issue_' ELSE 'n' END || (l_partkey % 9) AS name,
 'x = n' || (l_suppkey % 9) || '(1)' AS content, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS change FROM lineitem)"""
ENTITY_STATS = """ed AS (SELECT commit_id, path LIKE 'tests/%' AS test, path || ' ' || kind || ' ' || name AS id, kind, name, content, change FROM en),
tm AS (SELECT commit_id, true AS hit FROM ed t WHERE test AND kind <> 'statement' AND change <> 'deleted' AND name LIKE '%issue%' UNION SELECT t.commit_id, true FROM ed t WHERE test AND kind <> 'statement'
 AND EXISTS (SELECT 1 FROM ed x WHERE x.commit_id = t.commit_id AND x.id = t.id AND x.change <> 'deleted') AND EXISTS (SELECT 1 FROM ed m WHERE m.commit_id = t.commit_id AND NOT m.test AND m.kind IN ('function', 'method') AND m.change = 'modified' AND (contains(t.name, m.name) OR contains(t.content, m.name || '(')))),
es AS (SELECT commit_id, count(DISTINCT id) FILTER (NOT test AND kind <> 'statement' AND change = 'added') AS added_entities, count(DISTINCT id) FILTER (NOT test AND kind <> 'statement' AND change = 'modified') AS modified_entities,
 count(DISTINCT id) FILTER (NOT test AND kind <> 'statement' AND change = 'deleted') AS deleted_entities, count(DISTINCT id) FILTER (NOT test AND kind <> 'statement') AS edited_entities, count(DISTINCT id) FILTER (kind = 'function') AS function_entities,
 count(DISTINCT id) FILTER (kind = 'method') AS method_entities, count(DISTINCT id) FILTER (kind = 'class') AS class_entities, count(DISTINCT id) FILTER (kind = 'statement') AS statement_entities,
 count(DISTINCT id) FILTER (test AND kind <> 'statement' AND change <> 'deleted') AS test_entities, coalesce(any_value(hit), false) AS test_match FROM ed LEFT JOIN tm USING (commit_id) GROUP BY 1)"""
SMALL = "(non_test_files > 0 AND hunks > 0 AND non_test_edited_lines > 0 AND non_test_files < 3 AND non_test_edited_lines < 4 AND patch_chars < 30)"
BUG = "(deleted_entities = 0 AND added_entities <= 1 AND edited_entities BETWEEN 1 AND 3 AND statement_entities <= 1)"


def _stats(s, d):
    return K.line_stats(_lines(s, d)).join(K.entity_stats(_entities(s, d)), "commit_id")


def _predicates():
    return K.commit_predicates(max_files=3, max_lines=4, max_chars=30)


@register("a83_line_stats", f"WITH {LINES}, {LINE_STATS} SELECT * FROM ls")
def a83(s, d):
    return K.line_stats(_lines(s, d))


@register("a83_entity_stats", f"WITH {ENTITIES}, {ENTITY_STATS} SELECT * FROM es")
def a83b(s, d):
    return K.entity_stats(_entities(s, d))


@register("p26_commit_predicates", f"""WITH {LINES}, {LINE_STATS}, {ENTITIES}, {ENTITY_STATS} SELECT commit_id, {SMALL} AS small, NOT {SMALL} AS "long", only_python AS python, NOT only_python AS other, {BUG} AS bug_edit, test_entities > 0 AS test_entity, test_match, mypy_test AS mypy FROM ls JOIN es USING (commit_id)""")
def p26(s, d):
    return _stats(s, d).select("commit_id", *(c.alias(name) for name, c in _predicates().items()))


@register("p27_predicate_counts", f"""WITH {LINES}, {LINE_STATS}, {ENTITIES}, {ENTITY_STATS}, x AS (SELECT * FROM ls JOIN es USING (commit_id))
SELECT 0 AS place, 'python' AS predicate, count(*) FILTER (only_python) AS kept FROM x UNION ALL SELECT 1, 'small', count(*) FILTER (only_python AND {SMALL}) FROM x UNION ALL SELECT 2, 'bug_edit', count(*) FILTER (only_python AND {SMALL} AND {BUG}) FROM x""")
def p27(s, d):
    return K.filter_counted(_stats(s, d), _predicates(), ["python", "small", "bug_edit"])[1]


@register("p27_filtered_commits", f"WITH {LINES}, {LINE_STATS}, {ENTITIES}, {ENTITY_STATS} SELECT commit_id FROM ls JOIN es USING (commit_id) WHERE only_python AND {SMALL} AND {BUG}")
def p27b(s, d):
    return K.filter_counted(_stats(s, d), _predicates(), ["python", "small", "bug_edit"])[0].select("commit_id")


@register("f28_patch_text", f"WITH {LINES} SELECT commit_id, coalesce(string_agg(content, chr(10) ORDER BY hunk, content) FILTER (path LIKE 'src/%'), '') AS patch FROM ln GROUP BY 1")
def f28(s, d):
    file = F.struct("hunk", F.col("content").alias("patch"), "path")
    g = _lines(s, d).groupBy("commit_id").agg(F.sort_array(F.collect_list(file)).alias("files"))
    return g.select("commit_id", C.patch_text(F.col("files"), tests=False).alias("patch"))


@register("j24_line_entities", "SELECT a.l_orderkey AS commit_id, a.l_linenumber AS line, b.l_linenumber AS owner FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber BETWEEN b.l_linenumber AND b.l_linenumber + b.l_partkey % 3")
def j24(s, d):
    li = table(s, d, "lineitem")
    lines = li.select(F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("line"))
    owners = li.select(F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("owner"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("end"))
    return J.line_entities(lines, owners, "commit_id").select("commit_id", "line", "owner")


# ---- root edits: turns as responses of six forms ----
@register("f19_root_edits", r"""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS m, length(translate(coalesce(text, ''), '<`', '(''')) AS n, 'x = ' || turn || '  # note' || chr(10) || chr(10) || 'y = 1' AS a, 'x = ' || turn || chr(10) || 'y = 1' AS na, 'z = ' || conv_id AS z FROM conversations),
u AS (SELECT conv_id, turn, 'del' AS t, na AS src, n + 26 AS p, length(a) AS l, 'a.py' AS path FROM c WHERE m = 0 UNION ALL SELECT conv_id, turn, 'add', z, n + 26 + length(a) + 18, length(z), 'a.py' FROM c WHERE m = 0
 UNION ALL SELECT conv_id, turn, 'add', z, n + 26, length(z), 'b.py' FROM c WHERE m = 1 UNION ALL SELECT conv_id, turn, 'none', na, n + 24, length(a), 'c.py' FROM c WHERE m = 2
 UNION ALL SELECT conv_id, turn, 'none', z, n + 18, length(z), 'd.py' FROM c WHERE m = 3 UNION ALL SELECT conv_id, turn, 'none', na, n + 10, length(a), '' FROM c WHERE m = 4 UNION ALL SELECT conv_id, turn, 'add', z, n + 35, length(z), 'e.py' FROM c WHERE m = 5)
SELECT conv_id, turn, t AS edit_type, src AS source, 'root::' || t || '::' || path || '::' || substr(md5(src), 1, 10) AS signature, CASE WHEN src LIKE 'x%' THEN 2 ELSE 1 END AS size, p AS char_start, p + l AS char_end, path FROM u""")
def f19(s, d):
    pre, m = F.translate(F.coalesce("text", F.lit("")), "<`", "('"), (F.col("conv_id") + F.col("turn")) % 6
    a, z = F.concat(F.lit("x = "), F.col("turn").cast("string"), F.lit("  # note\n\ny = 1")), F.concat(F.lit("z = "), F.col("conv_id").cast("string"))
    forms = [
        (F.lit('<edit path="a.py"><search>'), a, F.lit("</search><replace>"), z, F.lit("</replace></edit>")), (F.lit("<edit path='b.py'><INSERT>"), z, F.lit("</INSERT></edit>")),
        (F.lit('<edit path="c.py"><code>'), a, F.lit("</code></edit>")), (F.lit('<edit path="d.py">'), z, F.lit("</edit>")), (F.lit("```python\n"), a, F.lit("```")),
        (F.lit('<edit path="e.py"><old> </old><new>'), z, F.lit("</new></edit>")),
    ]
    response = F.lit("")
    for k, form in enumerate(forms):
        response = F.when(m == k, F.concat(pre, *form)).otherwise(response)
    return table(s, d, "conversations").select("conv_id", "turn", F.inline(R.root_edits(response)))


@register("f17_code_span", "SELECT conv_id, turn, 'z = ' || conv_id AS code, length(translate(coalesce(text, ''), '<`', '(''')) + CASE turn % 3 WHEN 0 THEN 6 WHEN 1 THEN 8 ELSE 6 END AS \"offset\" FROM conversations")
def f17(s, d):
    pre, z = F.translate(F.coalesce("text", F.lit("")), "<`", "('"), F.concat(F.lit("z = "), F.col("conv_id").cast("string"))
    third = F.col("turn") % 3
    fence = F.concat(pre, F.lit("```py\n"), z, F.lit("```"))
    text = F.when(third == 0, F.concat(pre, F.lit("<code>"), z, F.lit("</code><action>no</action>"))).when(third == 1, F.concat(pre, F.lit("<action>"), z, F.lit("</action>"))).otherwise(fence)
    return table(s, d, "conversations").select("conv_id", "turn", F.inline(F.array(R.code_span(text))))


# ---- graphs and smoothing ----
def _walks(s, d):
    """Turns of a conversation in a row; a turn of even length may also skip the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").select(F.col("conv_id").alias("uid"), (F.row_number().over(w) - 1).alias("pos"), (F.length(F.coalesce("text", F.lit(""))) % 2 == 0).alias("skips"))
    last = F.max("pos").over(Window.partitionBy("uid"))
    hops = F.filter(F.array(F.lit(1), F.when(F.col("skips"), 2)), lambda h: h.isNotNull())
    e = c.withColumn("last", last).withColumn("h", F.explode(hops)).filter("pos + h <= last").select("uid", F.col("pos").cast("string").alias("u"), (F.col("pos") + F.col("h")).cast("string").alias("v"), F.col("uid").alias("traj_uid"), F.col("pos").alias("step"))
    return c, e


WALKS = "c AS (SELECT conv_id AS uid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, length(coalesce(text, '')) % 2 = 0 AS skips FROM conversations), w AS (SELECT *, max(pos) OVER (PARTITION BY uid) AS top, lag(skips) OVER (PARTITION BY uid ORDER BY pos) AS over_it FROM c)"


@register("g06_golden_states", f"WITH {WALKS} SELECT uid, pos, CAST(pos AS VARCHAR) AS state FROM w WHERE pos IN (0, top) OR NOT over_it")
def g06(s, d):
    c, e = _walks(s, d)
    return GR.golden_states(c.select("uid", "pos", F.col("pos").cast("string").alias("state")), e).select("uid", F.col("pos").cast("long").alias("pos"), "state")


@register("g06_mandatory_between", f"WITH {WALKS} SELECT uid, CAST(pos AS VARCHAR) AS mid FROM w WHERE pos > 0 AND pos < top AND NOT over_it")
def g06b(s, d):
    c, e = _walks(s, d)
    return GR.mandatory_between(e, c.groupBy("uid").agg(F.lit("0").alias("source"), F.max("pos").cast("string").alias("target")))


@register("w21_smooth_shares", """WITH pts AS (SELECT event_type AS kind, user_id % 20 AS step, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT kind, range AS place, CAST(range * 0.25 AS DOUBLE) AS x FROM (SELECT DISTINCT kind FROM pts), range(0, 77)),
n AS (SELECT g.kind, g.place, g.x, p.step AS s0, p.v AS v0, q.step AS s1, q.v AS v1 FROM g ASOF LEFT JOIN pts p ON g.kind = p.kind AND g.x >= p.step ASOF LEFT JOIN pts q ON g.kind = q.kind AND g.x <= q.step),
dn AS (SELECT kind, place, x, CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL OR s0 = s1 THEN v0 ELSE v0 + (v1 - v0) * (x - s0) / (s1 - s0) END AS v FROM n),
o AS (SELECT range AS k, exp(-0.5 * power(range / 8.0, 2)) AS w FROM range(-32, 33)),
b AS (SELECT a.kind, a.place, a.x, greatest(sum(o.w * z.v) / sum(o.w), 0) AS v FROM dn a CROSS JOIN o JOIN dn z ON z.kind = a.kind AND z.place = greatest(0, least(76, a.place + o.k)) GROUP BY 1, 2, 3)
SELECT kind, place, x, round(v / sum(v) OVER (PARTITION BY place), 6) AS share FROM b""")
def w21(s, d):
    e = table(s, d, "events").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 20).alias("step")).agg(F.sum("value").alias("value"))
    x = H.smooth_shares(e, 0, 19)
    return x.select("kind", F.col("place").cast("long").alias("place"), "x", F.round("share", 6).alias("share"))


# ---- whole-table forms of scans, orders and controllers ----
@register("s01_whole_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def s01_whole(s, d):
    return readers.read(s, "parquet", f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"])


@register("l04_difficulty_places", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE lower(o_orderpriority) WHEN '1-urgent' THEN 0 WHEN '2-high' THEN 1 ELSE 2 END, o_orderkey) - 1 AS n FROM orders")
def l04_whole(s, d):
    o = table(s, d, "orders").select("o_orderkey", C.difficulty_rank("o_orderpriority", ["1-urgent", "2-high"]).alias("level"))
    return B.with_row_id(o, "level", "o_orderkey", name="n").select("o_orderkey", "n")


@register("t07_beta_by_user", "SELECT user_id, event_id, round(0.2 * exp(sum(ln(1 + greatest(least(value / 100 / 2 - 1, 0.2), -0.2) * 64 / 1000)) OVER (PARTITION BY user_id ORDER BY event_id)), 6) AS beta FROM events")
def t07_whole(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") / 100).alias("k")))).alias("s"))
    b = e.select("user_id", F.inline(F.arrays_zip(F.col("s")["event_id"].alias("event_id"), beta_sequence(F.col("s")["k"], 0.2, 2.0, 1000, 64).alias("beta"))))
    return b.select("user_id", "event_id", F.round("beta", 6).alias("beta"))


# ---- batches, lookups and dispatch ----
@register("p18_rows_to_columns", "SELECT array_to_string(list(r_regionkey ORDER BY r_regionkey), ',') AS keys, array_to_string(list(r_name ORDER BY r_regionkey), ',') AS names FROM region")
def p18(s, d):
    r = B.with_row_id(table(s, d, "region"), "r_regionkey")
    return B.rows_to_columns(r, "r_regionkey", "r_name").select(F.array_join(F.col("r_regionkey").cast("array<string>"), ",").alias("keys"), F.array_join("r_name", ",").alias("names"))


@register("p19_balance_copy", "SELECT count(*) + (7 - count(*) % 7) % 7 AS n, count(*) AS different FROM events")
def p19(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("row_id"))
    return B.balance_to(e, 7, "copy", 3).agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("different"))


@register("p19_balance_delete", "SELECT count(*) - count(*) % 7 AS n FROM events")
def p19b(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("row_id"))
    return B.balance_to(e, N.common_divisor(7, 1), "delete", 3).agg(F.count("*").alias("n"))


@register("p23_stage_levels", "SELECT o_orderkey, CASE WHEN o_custkey < 50 THEN 'easy' WHEN o_custkey < 100 THEN 'easy,hard' ELSE 'hard' END AS levels FROM orders")
def p23(s, d):
    stages = C.parse_schedule("50:easy,100:easy+hard,900:hard")
    return table(s, d, "orders").select("o_orderkey", J.stage_of(F.col("o_custkey"), stages, "all").alias("levels"))


@register("j17_strict_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j17(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.strict_lookup(table(s, d, "customer"), n, "c_nationkey").select("c_custkey", "n_name")


@register("a80_greedy_parts", """WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(length(text), 0)) AS i FROM conversations),
g AS (SELECT conv_id, turn, i, 0 AS part, n AS s0, 0 AS s1, 0 AS s2 FROM r WHERE i = 1 UNION ALL
SELECT conv_id, turn, i, part, s0 + CASE WHEN part = 0 THEN n ELSE 0 END, s1 + CASE WHEN part = 1 THEN n ELSE 0 END, s2 + CASE WHEN part = 2 THEN n ELSE 0 END
FROM (SELECT r.conv_id, r.turn, r.i, r.n, s0, s1, s2, CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS part FROM g JOIN r ON r.conv_id = g.conv_id AND r.i = g.i + 1))
SELECT conv_id, turn, part FROM g""")
def a80(s, d):
    c = table(s, d, "conversations").filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return c.groupBy("conv_id").applyInPandas(_greedy, "conv_id long, turn long, part int")


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    own = pdf.sort_values(["turn", "n"])
    return own.assign(part=M.greedy_partition(own["n"].tolist(), 3))[["conv_id", "turn", "part"]]


@register("q01_replicated", "SELECT r_regionkey, CAST(range AS INT) AS rank FROM region, range(0, 3)")
def q01(s, d):
    return X.replicated(table(s, d, "region").select("r_regionkey"), 3)


@register("q04_metric_of_parts", "SELECT count(*) AS n, round(sum(value), 2) AS total FROM events")
def q04(s, d):
    parts = X.on_partitions(table(s, d, "events").select("value"), _part_sum, "n long, total double", 4)
    return parts.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def _part_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [len(pdf)], "total": [pdf["value"].sum()]})


# ---- texts and conversions ----
@register("f14_choice_letter", "SELECT o_orderkey, CASE WHEN o_custkey % 5 < 4 THEN chr(CAST(65 + o_custkey % 5 AS INT)) END AS letter FROM orders")
def f14(s, d):
    letter = F.char(65 + F.col("o_custkey") % 5)
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "so\nAnswer: ").otherwise("ANSWER :\t$"), letter, F.when(F.col("o_orderkey") % 2 == 0, " then Answer: D").otherwise("$"))
    return table(s, d, "orders").select("o_orderkey", T.choice_letter(F.when(letter == "E", "Answer: E").otherwise(text)).alias("letter"))


@register("f42_transcript", "SELECT conv_id, string_agg('[step ' || n || ']' || chr(10) || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS trace FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1")
def f42(s, d):
    step = F.struct("turn", F.col("role").alias("action"), F.coalesce("text", F.lit("")).alias("observation"))
    g = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return g.select("conv_id", C.render_transcript(F.col("steps")).alias("trace"))


@register("f45_same_code", "SELECT p_partkey, p_partkey % 3 < 2 AS same FROM part")
def f45(s, d):
    k = F.col("p_partkey") % 3
    other = F.when(k == 0, "def f(a):\n    # note\n    return a\n").when(k == 1, "def f(a):\n    'doc'\n    return (a)").otherwise("def f(a):\n    return b")
    return table(s, d, "part").select("p_partkey", T.same_code(F.lit("def f(a):\n    return a"), other).alias("same"))


def _episodes(s, d):
    turn = F.struct("l_linenumber", F.concat(F.lit("ask "), F.col("l_partkey").cast("string")).alias("user_prompt"), F.when(F.col("l_suppkey") % 9 == 0, " ").otherwise(F.col("l_suppkey").cast("string")).alias("assistant_response"))
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id")).agg(F.sort_array(F.collect_list(turn)).alias("transcript"))


@register("f76_episode_messages", "SELECT l_orderkey AS instance_id, 2 * count(*) AS n, string_agg('ask ' || l_partkey || '|' || l_suppkey, '|' ORDER BY l_linenumber, 'ask ' || l_partkey, CAST(l_suppkey AS VARCHAR)) AS contents FROM lineitem GROUP BY 1 HAVING bool_and(l_suppkey % 9 <> 0)")
def f76(s, d):
    m = C.episode_messages(_episodes(s, d))
    return m.select("instance_id", F.size("messages").cast("long").alias("n"), F.array_join(F.col("messages")["content"], "|").alias("contents"))


@register("f77_step_samples", "SELECT l_orderkey AS instance_id, 'ask ' || l_partkey AS prompt, CASE WHEN l_suppkey % 9 = 0 THEN ' ' ELSE CAST(l_suppkey AS VARCHAR) END AS response FROM lineitem")
def f77(s, d):
    return C.step_samples(_episodes(s, d)).select("instance_id", "prompt", "response")


@register("f79_call_stdin", "SELECT o_orderkey, '\"' || o_orderpriority || '\"' || chr(10) || '\"' || o_custkey || '\"' || chr(10) AS stdin FROM orders")
def f79(s, d):
    return table(s, d, "orders").select("o_orderkey", S.call_stdin(F.array("o_orderpriority", F.col("o_custkey").cast("string"))).alias("stdin"))


@register("l09_top_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def l09(s, d):
    return M.frequency(table(s, d, "orders"), "o_custkey", top=5).select("o_custkey", "n")


# ---- readers and writers ----
@register("s19_paired_tests", "SELECT r_name AS stem, 'in ' || r_regionkey AS input, 'out ' || r_regionkey AS output FROM region WHERE r_regionkey <> 2")
def s19(s, d):
    at = shared_folder(s, "pairs")
    for r in table(s, d, "region").collect():
        _put(s, f"{at}/{r.r_name}.in", f"in {r.r_regionkey}".encode())
        if r.r_regionkey != 2:
            _put(s, f"{at}/{r.r_name}.{'ans' if r.r_regionkey % 2 else 'out'}", f"out {r.r_regionkey}".encode())
    return readers.read(s, "paired_tests", at)


@register("s20_zip_tests", "SELECT r_name AS stem, 'in ' || r_regionkey AS input, 'out ' || r_regionkey AS output FROM region")
def s20(s, d):
    at, data = shared_folder(s, "zips"), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for r in table(s, d, "region").collect():
            z.writestr(f"{r.r_name}.in", f"in {r.r_regionkey}")
            z.writestr(f"{r.r_name}.out", f"out {r.r_regionkey}")
    _put(s, f"{at}/tests.zip", data.getvalue())
    return readers.read(s, "zip_tests", at).select("stem", "input", "output")


def _put(spark, path: str, data: bytes) -> None:
    """A small file in the shared folder, by the cluster's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(data))
    out.close()


@register("k06_manifest", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def k06(s, d):
    told = json.loads(writers.manifest(table(s, d, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))))
    return s.createDataFrame([(told["n"], told["customers"])], "n long, customers long")


@register("k09_submission", "SELECT CAST(c_custkey AS BIGINT) AS instance_id, c_name AS model_patch FROM customer")
def k09(s, d):
    at = shared_folder(s, "submission")
    writers.best_of_n_submission(table(s, d, "customer"), "c_custkey", "c_name", at)
    return s.read.schema("instance_id long, model_patch string").json(at)


@register("k12_flat_config", "SELECT c_custkey, unnest(['a/b', 'a/c/list_len', 'a/c/0', 'a/c/1', 'd']) AS k, unnest([CAST(c_nationkey AS VARCHAR), '2', c_name, CAST(c_custkey AS VARCHAR), c_mktsegment]) AS v FROM customer")
def k12(s, d):
    return table(s, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment").mapInPandas(_flat, "c_custkey long, k string, v string")


def _flat(parts):
    for part in parts:
        rows = [(key, k, None if v is None else str(v)) for key, nation, name, segment in part.itertuples(index=False) for k, v in writers.flatten_config({"a": {"b": nation, "c": [name, key]}, "d": segment}).items()]
        yield pd.DataFrame(rows, columns=["c_custkey", "k", "v"])
