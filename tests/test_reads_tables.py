"""Queries that read a given table, not literals; and the literal cases they had before."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import agent, scoring
from millrace.operators.joins import pair_budget
from millrace.operators.metrics import greedy_partition
from millrace.plans import commits, instances, registry  # noqa: F401
from millrace.sources.writers import flatten_config

SF = "/root/testdata/sf0.001"
NAMES = ["a80_greedy_parts", "f09_answer_forms", "f15_grade", "f23_parse_action", "j11_pair_budget", "k12_flat_config"]


@pytest.mark.parametrize("name", NAMES)
def test_reads_a_table(spark, name):
    assert registry.queries()[name](spark, SF).inputFiles()  # literals have none


FORMS = ["x = \\frac12", "\\text{m} 12,000 square feet", "$5 \\$ $", "\\boxed{\\sqrt3}", "an apple", "\\overline{AB}", "3^\\circ", "1,000", "a = b = 7 dollars", "\\textbf{q}\\dots"]
FINAL = ["\\frac{1}{2}", "12000", "5", "\\sqrt{3}", "apple", "AB", "3", "1000", "7", "q"]
GRADED = [("(1, 2)", "(1,2)", True), ("[0,1)", "[0,1]", False), ("\\frac{1}{2}", "0.5", True), ("50%", "0.5", True), ("50", "0.5", True), ("2\\pi", "6.2832", True), ("1,234", "1234.0", True), ("x+1", "X+1", True), ("(1,2)", "(2,1)", False), ("", "1", False), ("3", "4", False), ("3^\\circ", "3", True)]


def test_literal_cases(spark):
    forms = spark.createDataFrame(list(enumerate(FORMS)), "i int, t string").select("i", scoring.final_answer(F.col("t")).alias("a"))
    assert [r.a for r in forms.orderBy("i").collect()] == FINAL
    graded = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(GRADED)], "i int, a string, b string").select("i", agent.grade("a", "b").alias("ok"))
    assert [r.ok for r in graded.orderBy("i").collect()] == [ok for *_, ok in GRADED]
    actions = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(instances.ACTIONS)], "i int, t string").select("i", agent.parse_action(F.col("t")).alias("a"))
    assert [(r.a.type, r.a.mode, r.a.valid) for r in actions.orderBy("i").collect()] == [tuple(x) for _, *x in instances.ACTIONS]
    assert greedy_partition([9, 4, 1, 2, 3, 8], 3) == [0, 1, 2, 2, 2, 1]
    assert [len(pair_budget(n, 64)) for n in range(1, 12)] == [n * (n - 1) // 2 for n in range(1, 12)]
    assert flatten_config({"a": {"b": 1, "c": ["x", "y"]}, "d": "z"}) == {"a/b": 1, "a/c/list_len": 2, "a/c/0": "x", "a/c/1": "y", "d": "z"}
