"""Golden states without a path, root edits of odd texts, call input, and smoothing at the edges."""

import math

from pyspark.sql import functions as F

from millrace.functions import scoring, snippets
from millrace.operators import graph, smoothing


def edits(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(F.inline(snippets.root_edits(F.col("t")))).collect()


def test_root_edits_of_odd_texts(spark):
    assert edits(spark, None) == [] and edits(spark, "  # only a note") == []
    (bare,) = edits(spark, "no tags at all")
    assert (bare.edit_type, bare.path, bare.char_start, bare.char_end) == ("none", "", 0, 14)
    text = 'ü <edit path="a.py"><insert> </insert><code>b = 1</code></edit>'
    (code,) = edits(spark, text)
    assert code.edit_type == "none" and text[code.char_start : code.char_end] == "b = 1"
    (first,) = edits(spark, '<edit path="a"><search>x</search></edit><edit path="b">y</edit>')
    assert first.path == "a" and first.source == "<search>x</search>"


def test_golden_states_without_a_path(spark):
    e = spark.createDataFrame([(1, "a", "b", 1, 0), (1, "c", "d", 1, 1)], "uid long, u string, v string, traj_uid long, step long")
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "d")], "uid long, pos long, state string")
    assert sorted(r.state for r in graph.golden_states(c, e).collect()) == ["a", "b", "d"]


def test_call_input_is_json_by_line(spark):
    df = spark.createDataFrame([([1, 2],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(scoring.call_stdin(F.col("a"))).collect()] == ["1\n2\n", ""]


def test_smoothing_keeps_constants_and_fills_ends(spark):
    df = spark.createDataFrame([("a", 2, 3.0), ("b", 2, 1.0), ("b", 3, None)], "kind string, step int, value double")
    rows = smoothing.smooth_shares(df, 0, 4).collect()
    assert len(rows) == 34 and all(math.isclose(r.share, 0.75 if r.kind == "a" else 0.25) for r in rows)
