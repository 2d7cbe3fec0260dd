"""Commits as rows of lines and of entities: statistics, predicates, and filters with counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def line_stats(lines: DataFrame, commit: str = "commit_id") -> DataFrame:
    """One row a commit of lines (commit, path, hunk, kind, content): files, hunks, edited lines and what holds for all hunks.

    Lines are counted by hunk, hunks by file, files by commit: each step shuffles only the counts of the one before."""
    added, deleted = F.col("added"), F.col("deleted")
    hunks = lines.groupBy(commit, "path", "hunk").agg(_n(F.col("kind") == "added").alias("added"), _n(F.col("kind") == "deleted").alias("deleted"), F.sum(F.length("content") + 2).alias("chars"))
    one_way = F.bool_and((added == 0) | (deleted == 0)).alias("one_way")
    files = hunks.groupBy(commit, "path").agg(F.count("*").alias("hunks"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum("chars").alias("chars"), one_way)
    files = files.withColumn("test", T.is_test_path(F.col("path"))).withColumn("edited", added + deleted)
    python = F.col("path").endswith(".py")
    return files.groupBy(commit).agg(
        F.count("*").alias("files"), _n(F.col("test")).alias("test_files"), _n(~F.col("test")).alias("non_test_files"), F.sum("hunks").alias("hunks"),
        F.sum("edited").alias("edited_lines"), F.sum(F.when(F.col("test"), 0).otherwise(F.col("edited"))).alias("non_test_edited_lines"),
        F.sum(F.when(python, F.col("edited")).otherwise(0)).alias("python_edited_lines"), F.sum("chars").alias("patch_chars"),
        F.bool_and(python).alias("only_python"), F.bool_or(F.col("path").endswith(".test")).alias("mypy_test"),
        (F.sum("deleted") == 0).alias("all_insert"), (F.sum("added") == 0).alias("all_delete"), F.bool_and("one_way").alias("all_one_way"),
    )


def entity_stats(entities: DataFrame, commit: str = "commit_id") -> DataFrame:
    """One row a commit of entities (commit, path, kind, name, content, change): how many are added, modified, deleted and edited.

    An entity is a path, kind and name, counted once. Statements count only as statements; numbers are of files that are no tests.
    ``test_match``: an added or modified test names an issue, or holds a call or the name of a modified entity that is no class."""
    change = lambda kind: F.bool_or(F.col("change") == kind).alias(kind)
    e = entities.groupBy(commit, "path", "kind", "name").agg(change("added"), change("modified"), change("deleted"), F.collect_set("content").alias("contents"))
    test, real = T.is_test_path(F.col("path")), F.col("kind") != "statement"
    count = lambda c, name: _n(c).alias(name)
    touched = test & real & (F.col("added") | F.col("modified"))
    last = F.element_at(F.split("name", r"\."), -1)
    g = e.groupBy(commit).agg(
        *(count(~test & real & F.col(c), f"{c}_entities") for c in ("added", "modified", "deleted")), count(~test & real, "edited_entities"),
        *(count(F.col("kind") == k, f"{k}_entities") for k in ("function", "method", "class", "statement")), count(touched, "test_entities"),
        F.bool_or(touched & F.col("name").contains("issue")).alias("_issue"), F.collect_set(F.when(touched, last)).alias("_names"),
        F.flatten(F.collect_list(F.when(touched, F.col("contents")))).alias("_bodies"), F.collect_set(F.when(~test & real & F.col("modified") & (F.col("kind") != "class"), last)).alias("_mods"),
    )
    named = F.exists("_mods", lambda m: F.exists("_names", lambda n: n.contains(m)) | F.exists("_bodies", lambda b: b.contains(F.concat(m, F.lit("(")))))
    return g.withColumn("test_match", F.col("_issue") | named).drop("_issue", "_names", "_bodies", "_mods")


def commit_predicates(max_files: int = 5, max_lines: int = 200, max_chars: int = 2000, deleted: int = 0, added: int = 1, edited: int = 3, statements: int = 1) -> dict[str, Column]:
    """Predicates by name over columns of ``line_stats`` and ``entity_stats``."""
    c = F.col
    small = (c("non_test_files") > 0) & (c("hunks") > 0) & (c("non_test_edited_lines") > 0) & (c("non_test_files") < max_files) & (c("non_test_edited_lines") < max_lines) & (c("patch_chars") < max_chars)
    bug = (c("deleted_entities") == deleted) & (c("added_entities") <= added) & c("edited_entities").between(1, edited) & (c("statement_entities") <= statements)
    return {"small": small, "long": ~small, "python": c("only_python"), "other": ~c("only_python"), "bug_edit": bug, "test_entity": c("test_entities") > 0, "test_match": c("test_match"), "mypy": c("mypy_test")}


def filter_counted(df: DataFrame, predicates: Mapping[str, Column], enabled: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all enabled predicates, and (place, predicate, kept): how many pass up to each, in one pass over the rows."""
    upto, passed = F.lit(True), []
    for name in enabled:
        upto = upto & F.coalesce(predicates[name], F.lit(False))
        passed.append(upto)
    counts = df.agg(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("predicate"), _n(p).alias("kept")) for k, (name, p) in enumerate(zip(enabled, passed)))).alias("_c"))
    return df.filter(upto), counts.select(F.inline("_c"))
