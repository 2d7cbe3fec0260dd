"""Agent texts: actions, trajectories' files, condensed thoughts, failure blocks and answers that compare by value."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from millrace.functions.text import parse_call

#: Fixed patterns of actions.
THINK, THOUGHT_LINE = r"(?s)<think>(.*?)</think>", r"(?im)^\s*Thought\s*:"
EDIT = r"(?s)<edit\s+path=[\"'](.*?)[\"']\s*>(.*?)</edit>"
FINISH = r"<finish\s*/?>"
BASH_FENCE, PYTHON_FENCE, ACTION_LINE = r"(?s)```(?:bash|sh|shell)?\s*\n(.*?)```", r"(?s)```(?:python|py)?\s*\n(.*?)```", r"(?im)^\s*Action\s*:\s*(.+)$"
PATH_HINT = r"(?im)(?:edit|overwrite|write)\s+(?:file\s+)?[`\"']?([^\s`\"']+\.py)[`\"']?"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _tag(text: Column, tag: str) -> Column:
    """What stands in the first pair of tags; null without any."""
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def _group(text: Column, pattern: str, k: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k))


def _filled(c: Column) -> Column:
    return F.coalesce(_strip(c) != "", F.lit(False))


def parse_action(text: Column) -> Column:
    """{type, path, mode, search, replace, insert, content, cmd, valid} of a response.

    Edits come first (patch, insert, overwrite), then commands, then finishing; without tags, fenced code with a path, a
    fenced or announced command. Valid actions have a thought and say something; anything else is no action."""
    text = F.coalesce(text, F.lit(""))
    thought = text.rlike(THINK) | text.rlike(THOUGHT_LINE)
    path, body = _strip(_group(text, EDIT)), _group(text, EDIT, 2)
    search, new = F.coalesce(_tag(body, "search"), _tag(body, "old")), F.coalesce(_tag(body, "replace"), _tag(body, "new"))
    insert, content = _tag(body, "insert"), F.coalesce(_tag(body, "code"), body)
    code = _group(text, PYTHON_FENCE)
    hinted = F.when(code.isNotNull(), _group(text, PATH_HINT))
    first = _strip(F.element_at(F.split(_strip(code), "\n"), 1))
    fence, line = _strip(_group(text, BASH_FENCE)), _strip(F.regexp_replace(_strip(_group(text, ACTION_LINE)), "^`+|`+$", ""))
    guess = F.coalesce(F.when(_filled(fence), fence), F.when(_filled(line), line), F.when(first.startswith("python") | first.contains("solution.py"), first))
    command = _strip(_tag(text, "execute_bash"))

    def action(kind: str, ok: Column, **fields: Column) -> Column:
        names = ("path", "mode", "search", "replace", "insert", "content", "cmd")
        return F.struct(F.lit(kind).alias("type"), *(fields.get(n, F.lit(None)).cast("string").alias(n) for n in names), (thought & F.coalesce(ok, F.lit(False))).cast("int").alias("valid"))

    return (
        F.when(body.isNotNull() & search.isNotNull() & new.isNotNull(), action("edit", _filled(path) & _filled(search), path=path, mode=F.lit("patch"), search=search, replace=new))
        .when(body.isNotNull() & insert.isNotNull(), action("edit", _filled(path) & _filled(insert), path=path, mode=F.lit("insert"), insert=insert))
        .when(body.isNotNull(), action("edit", _filled(path) & _filled(content), path=path, mode=F.lit("overwrite"), content=content))
        .when(command.isNotNull(), action("bash", _filled(command), cmd=command))
        .when(text.rlike(FINISH), action("finish", F.lit(True)))
        .when(hinted.isNotNull(), action("edit", _filled(hinted) & _filled(code), path=_strip(hinted), mode=F.lit("overwrite"), content=code))
        .when(guess.isNotNull(), action("bash", F.lit(True), cmd=guess))
        .when(text.rlike(r"(?i)<finish\b") & thought, action("finish", F.lit(True)))
        .otherwise(action("noop", F.lit(False)))
    )


def _calls(steps: Column) -> Column:
    return F.transform(steps, lambda s: parse_call(s["action"]))


def _named_files(steps: Column, function: str, command: str | None = None) -> Column:
    """Paths with an extension in calls of a function (and of a command), without the workspace's prefix if there is a command."""

    def fits(c: Column) -> Column:
        ok = (c["name"] == function) & F.coalesce(F.element_at(F.split(c["parameters"]["path"], "/"), -1).contains("."), F.lit(False))
        return ok & (c["parameters"]["command"] == command) if command else ok

    paths = F.transform(F.filter(_calls(steps), fits), lambda c: c["parameters"]["path"])
    return F.transform(paths, lambda p: F.replace(p, F.lit("/testbed/"), F.lit(""))) if command else paths


def viewed_files(steps: Column) -> Column:
    return _named_files(steps, "file_viewer")


def edited_files(steps: Column) -> Column:
    return _named_files(steps, "file_editor", "str_replace")


def created_files(steps: Column) -> Column:
    return _named_files(steps, "file_editor", "create")


def extensions(paths: Column) -> Column:
    """Distinct extensions, in order."""
    return F.array_sort(F.array_distinct(F.transform(paths, lambda p: F.element_at(F.split(p, r"\."), -1))))


def has_bad_editor_path(steps: Column, bad: str = "/testbed/testbed") -> Column:
    return F.exists(_calls(steps), lambda c: (c["name"] == "file_editor") & F.coalesce(c["parameters"]["path"].contains(bad), F.lit(False)))


def has_bad_path(steps: Column, bad: str = "/testbed/testbed") -> Column:
    return F.exists(steps, lambda s: F.coalesce(s["action"].contains(bad), F.lit(False)))


def command_output_lines(steps: Column) -> Column:
    """Line breaks in the observation of each executed command."""
    return F.transform(F.filter(steps, lambda s: parse_call(s["action"])["name"] == "execute_bash"), lambda s: F.length(s["observation"]) - F.length(F.replace(s["observation"], F.lit("\n"), F.lit(""))))


CONDENSED = "<Thought condensed for saving context>"
_THOUGHTS = re.compile(r"(\[ASSISTANT\])(.*?)(<function)", re.DOTALL)


def condense_thoughts(budget: int, words_of=lambda text: len(text.split())):
    """A pandas UDF: while a text has more words than the budget, its longest thought is replaced by a placeholder; a lone one stays."""

    def shorter(text: str | None) -> str | None:
        while text is not None and words_of(text) > budget:
            found = list(_THOUGHTS.finditer(text))
            left = [m for m in found if m[2].strip() != CONDENSED]
            if len(found) < 2 or not left:
                break
            m = max(left, key=lambda m: len(m[2]))
            text = text[: m.start(2)] + CONDENSED + text[m.end(2) :]
        return text

    @F.pandas_udf(Y.StringType())
    def condense(texts: pd.Series) -> pd.Series:
        return texts.map(shorter, na_action="ignore")

    return condense


_FAILURES = Y.ArrayType(Y.StructType([Y.StructField("test", Y.StringType()), Y.StructField("message", Y.StringType())]))
_BLOCK = re.compile(r"^_{3,} (\S.*?) _{3,}$", re.MULTILINE)


@F.pandas_udf(_FAILURES)
def failure_blocks(logs: pd.Series) -> pd.Series:
    """Blocks under "____ test ____" in the failures section of a test log, up to the next block or section."""

    def blocks(log: str | None) -> list[dict] | None:
        if log is None:
            return None
        section = re.split(r"^=+ FAILURES =+$", log, maxsplit=1, flags=re.MULTILINE)
        if len(section) < 2:
            return []
        body = re.split(r"^=+ .* =+$", section[1], maxsplit=1, flags=re.MULTILINE)[0]
        found = list(_BLOCK.finditer(body))
        ends = [m.start() for m in found[1:]] + [len(body)]
        return [{"test": m[1], "message": body[m.end() : e].strip()} for m, e in zip(found, ends)]

    return logs.map(blocks)


def _number(text: str) -> float | None:
    x = text.strip().replace(",", "").replace("$", "").rstrip(".")
    scale = 0.01 if x.endswith(("%", "\\%")) else 1.0
    x = x.rstrip("%").rstrip("\\")
    if m := re.fullmatch(r"(-?)\\[dt]?frac\{(-?[0-9.]+)\}\{(-?[0-9.]+)\}", x):
        return float(m[1] + "1") * float(m[2]) / float(m[3]) * scale if float(m[3]) else None
    if m := re.fullmatch(r"(-?[0-9.]+)\s*/\s*(-?[0-9.]+)", x):
        return float(m[1]) / float(m[2]) * scale if float(m[2]) else None
    if m := re.fullmatch(r"(-?[0-9.]*)\s*\*?\s*(?:\\pi|pi|π)", x):
        return (float(m[1] + "1") if m[1] in ("", "-") else float(m[1])) * math.pi * scale
    try:
        return float(x) * scale
    except ValueError:
        return None


def _parts(text: str) -> tuple[str, list[str]] | None:
    """Brackets and comma-separated parts at the top level of a tuple or interval."""
    x = text.strip()
    if len(x) < 2 or x[0] not in "([{" or x[-1] not in ")]}":
        return None
    out, depth, at = [], 0, 1
    for k, c in enumerate(x[1:-1], 1):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(x[at:k])
            at = k + 1
    return (x[0] + x[-1], [*out, x[at:-1]]) if out else None


def answers_agree(given: str | None, truth: str | None, tolerance: float = 1e-4) -> bool:
    """Whether two answers are the same text, number (a truth may also be in percent), tuple or interval; no symbolic algebra."""
    if given is None or truth is None:
        return False
    clean = lambda t: re.sub(r"\s+|\\left|\\right|\\!|\\,|\;", "", t).replace("\\$", "").replace("^\\circ", "").replace("^{\\circ}", "")
    a, b = clean(given), clean(truth)
    if a == b:
        return True
    p, q = _parts(a), _parts(b)
    if p and q:
        return p[0] == q[0] and len(p[1]) == len(q[1]) and all(answers_agree(x, y, tolerance) for x, y in zip(p[1], q[1]))
    if p or q:
        return False
    x, y = _number(a), _number(b)
    if x is None or y is None:
        return a.lower() == b.lower() and a != ""
    return any(math.isclose(x, z, rel_tol=tolerance) for z in (y, y / 100, y * 100))


@F.pandas_udf(Y.BooleanType())
def grade(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([answers_agree(a, b) for a, b in zip(given, truth)])


def _plain(x):
    """Values as call results compare: tuples are lists, whole-number keys are numbers."""
    if isinstance(x, dict):
        return {int(k) if isinstance(k, str) and k.lstrip("-").isdigit() else k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


@F.pandas_udf(Y.ArrayType(Y.BooleanType()))
def call_results_match(got: pd.Series, wanted: pd.Series) -> pd.Series:
    """For each case whether the JSON result is the wanted one, or the wanted list's only element; stops after the first failure."""

    def same(a: str, b: str) -> bool:
        try:
            x, y = _plain(json.loads(a)), _plain(json.loads(b))
        except (TypeError, ValueError):
            return a == b
        return x == y or (isinstance(y, list) and len(y) == 1 and x == y[0])

    def results(a, b) -> list[bool]:
        out = []
        for x, y in zip(a if a is not None else [], b if b is not None else []):
            out.append(same(x, y))
            if not out[-1]:
                break
        return out

    return pd.Series([results(a, b) for a, b in zip(got, wanted)])
