"""Diffs and patches whose texts look like markup of their own."""

from pyspark.sql import functions as F

from millrace.functions import scoring, text
from millrace.operators import batch

DIFF = """diff --git a/x.sql b/x.sql
--- a/x.sql
+++ b/x.sql
@@ -1,3 +1,3 @@ head
 keep
--- old comment
+++ plus
 end
\\ No newline at end of file
@@ -9 +9,2 @@
-a
+b
+c
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-last"""


def test_lines_are_counted_by_the_header(spark):
    rows = spark.createDataFrame([(DIFF,), (None,), ("",)], "t string").select(F.explode(text.parse_diff("t")).alias("l")).select("l.*").collect()
    assert [(r.path, r.kind, r.content, r.line) for r in rows] == [
        ("x.sql", "context", "keep", 1), ("x.sql", "deleted", "-- old comment", 2), ("x.sql", "added", "++ plus", 2), ("x.sql", "context", "end", 3),
        ("x.sql", "deleted", "a", 9), ("x.sql", "added", "b", 9), ("x.sql", "added", "c", 10), ("gone.py", "deleted", "last", 1),
    ]


def test_searches_are_plain_text(spark):
    rows = [(r"a \E b", r"\E", "x"), (r"\Q\E(", r"\Q\E(", "ok"), ("a.a.a", "a.", "z"), ("abc", "", "x"), ("abc", "q", "x"), ("aaa", "aa", "b"), ("$1", "$1", r"\0")]
    df = spark.createDataFrame(rows, "c string, s string, r string")
    got = [(r.x.content, r.x.error) for r in df.select(scoring.apply_patch(F.col("c"), F.col("s"), F.col("r")).alias("x")).collect()]
    assert got == [("a x b", None), ("ok", None), ("a.a.a", "search text is ambiguous"), ("abc", "empty search"), ("abc", "search text not found"), ("ba", None), (r"\0", None)]


def test_position_ids(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, 0, 1],), ([],), ([1],)], "m array<int>")
    assert [list(r.p) for r in df.select(batch.position_ids(F.col("m")).alias("p")).collect()] == [[0, 0, 0, 1, 1, 2], [], [0]]
