"""String scoring and cleaning as columns; Python only where balance or syntax is not regular."""

from __future__ import annotations

import ast
import difflib
import re
import shlex
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strict_answer(text: Column) -> Column:
    """The number after the first "#### ", commas and dollar signs removed; null without one."""
    x = F.regexp_extract(text, r"#### (\-?[0-9\.,]+)", 1)
    return F.when(x != "", F.translate(x, ",$", ""))


def flexible_answer(text: Column) -> Column:
    """The last number that is more than a dot; if every hit is trivial, the first."""
    hits = F.regexp_extract_all(text, F.lit(r"(\-?[0-9\.,]+)"), F.lit(1))
    good = F.filter(hits, lambda h: ~h.isin("", "."))
    return F.when(F.size(good) > 0, F.element_at(good, -1)).otherwise(F.try_element_at(hits, F.lit(1)))


def answer_score(answer: Column, truth: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


def normal_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    x = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normal_answer(g) == normal_answer(prediction)).cast("double")


def contains_match(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normal_answer(prediction).contains(normal_answer(g))).cast("double")


def last_tagged(text: Column, tag: str = "answer") -> Column:
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1)))


def count_of(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def code_block(text: Column) -> Column:
    """<code>, else <action>, else a fenced block; null without any."""
    found = [F.regexp_extract(text, p, 1) for p in (r"(?s)<code>(.*?)</code>", r"(?s)<action>(.*?)</action>", r"(?s)```(?:\w+)?\n(.*?)```")]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))


def normal_source(source: Column) -> Column:
    """Lines without trailing comments and trailing space; blank ones dropped."""
    lines = F.transform(F.split(source, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+#.*$", ""), r"\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")


def has_edit_hint(text: Column) -> Column:
    return text.rlike(r"(?i)<edit\b|<code>|```")


def parse_call(text: Column) -> Column:
    """Struct of a function call's name and its parameters; the last of repeated parameters wins."""
    name = F.regexp_extract(text, r"<function=([^>]+)>", 1)
    keys, values = (F.regexp_extract_all(text, F.lit(r"(?s)<parameter=([^>]+)>(.*?)</parameter>"), F.lit(i)) for i in (1, 2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(0), F.size(keys)).alias("i")), lambda e: e["k"].isNotNull() & ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["k"]))
    return F.struct(name.alias("name"), F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], strip(e["v"])))).alias("parameters"))


def question_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 256)


def io_fingerprint(text: Column, pairs: int = 3) -> Column:
    """Hash of the first input-output pairs of a JSON text, values as text; of its first 8,192 characters if it isn't JSON; null without pairs."""
    io = F.from_json(text, "inputs array<string>, outputs array<string>")
    n = F.least(F.lit(pairs), F.size(io["inputs"]), F.size(io["outputs"]))
    blob = F.to_json(F.struct(F.slice(io["inputs"], 1, n).alias("i"), F.slice(io["outputs"], 1, n).alias("o")))
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNull(), F.sha2(F.substring(text, 1, 8192), 256)).when(n > 0, F.sha2(blob, 256))


def short_hash(text: Column, n: int = 10) -> Column:
    return F.substring(F.md5(text), 1, n)


def clean_title(text: Column) -> Column:
    """Bracketed parts and title marks removed, double spaces collapsed."""
    x = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def is_test_path(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.endswith("_test.py") | name.startswith("test_") | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("tests", "Tests", "test", "Test"))))


def message_kind(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.contains("fix") | m.contains("bug"), "bugfix").when(m.contains("feature") | m.contains("add"), "feature").when(m.contains("refactor"), "refactor").otherwise("other")


def pytest_status(log: Column) -> Column:
    """test -> status of the lines after "short test summary info": names after the file, joined by dots, without reasons; the last of equal names counts."""
    part = F.element_at(F.split(log, "short test summary info"), 2)
    lines = F.filter(F.split(F.when(log.contains("short test summary info"), part), "\n"), lambda x: x.rlike("PASSED|FAILED|ERROR"))

    def entry(x: Column) -> Column:
        status = F.when(x.contains("PASSED"), "PASSED").when(x.contains("FAILED"), "FAILED").otherwise("ERROR")
        name = F.array_join(F.slice(F.split(x, "::"), 2, 1000), ".")
        return F.struct(F.when(status == "PASSED", name).otherwise(F.element_at(F.split(name, " - "), 1)).alias("k"), status.alias("v"))

    found = F.transform(lines, entry)
    last = F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda o: o["k"] == e["k"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[\\d+m", "")


def linked_numbers(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(r"#(\d+)"), F.lit(1))


def truncate_text(text: Column, n: int, side: str = "middle") -> Column:
    half = n // 2
    cut = {"left": F.right(text, F.lit(n)), "right": F.left(text, F.lit(n)), "middle": F.concat(F.left(text, F.lit(half)), F.right(text, F.lit(n - half)))}[side]
    return F.when(F.length(text) > n, cut).otherwise(text)


def first_truthy(*columns: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def numeric_text(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[,%$]", "").try_cast("double")


def numeric_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Equal within a relative tolerance to b, b/100 or 100 b; null if either is no number."""
    x, y = numeric_text(a), numeric_text(b)
    close = lambda v: F.abs(x - v) <= tolerance * F.greatest(F.abs(x), F.abs(v))
    return close(y) | close(y / 100) | close(y * 100)


def choice_letter(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1), F.lit(""))


def same_output(a: Column, b: Column) -> Column:
    norm = lambda c: F.trim(F.regexp_replace(c, "\r\n", "\n"))
    return norm(a) == norm(b)


def view_range_length(text: Column) -> Column:
    r = F.from_json(text, "array<int>")
    return F.when(F.size(r) == 2, r[1] - r[0] + 1)


def digit_sequence(prompt: Column) -> Column:
    """ "a,b:m,k" gives the next k numbers of the sequence modulo m."""
    part = lambda i: F.regexp_extract(prompt, r"^(\d+),(\d+):(\d+),(\d+)$", i).try_cast("int")
    a, b, m, k = (part(i) for i in range(1, 5))
    return F.array_join(F.transform(F.sequence(F.lit(1), k), lambda i: ((b + (b - a) * i) % m + m) % m), ",")


# ---- Python where a grammar is needed ----
@F.pandas_udf(T.StringType())
def last_boxed(text: pd.Series) -> pd.Series:
    r"""Content of the last \boxed{...} or \fbox{...}, braces matched; null if unbalanced or missing."""

    def one(s: str | None) -> str | None:
        at = max((s or "").rfind("\\boxed{"), (s or "").rfind("\\fbox{"))
        if at < 0:
            return None
        start = s.index("{", at)
        depth = 0
        for i in range(start, len(s)):
            depth += (s[i] == "{") - (s[i] == "}")
            if depth == 0:
                return s[start + 1 : i]
        return None

    return text.map(one)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (candidate first, representative second); asymmetric by nature."""
    return pd.Series([0.0 if x is None or y is None else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def shell_quote(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else shlex.quote(s))


@F.pandas_udf(T.StringType())
def normal_latex(text: pd.Series) -> pd.Series:
    """Common spellings of an answer in LaTeX brought to one: fractions, roots, units, degrees, spaces."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        for a, b in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("\\%", ""), ("%", "")):
            s = s.replace(a, b)
        s = re.sub(r"\\text\{\s[^}]*\}$", "", s)
        s = re.sub(r"\\sqrt(\w)", r"\\sqrt{\1}", s)
        s = re.sub(r"\\frac(\w)(\w)", r"\\frac{\1}{\2}", s).replace(" ", "")
        s = re.sub(r"^(-?\d+)/(-?\d+)$", r"\\frac{\1}{\2}", s)
        s = re.sub(r"^\.", "0.", s)
        return "\\frac{1}{2}" if s == "0.5" else s

    return text.map(one)


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


ENTITIES = _rows(kind=T.StringType(), name=T.StringType(), start=T.IntegerType(), end=T.IntegerType())


@F.pandas_udf(ENTITIES)
def source_entities(source: pd.Series) -> pd.Series:
    """Functions, classes, methods and imports of Python source with their lines; empty if it can't be parsed."""

    def one(s: str | None) -> list[dict]:
        try:
            tree = ast.parse(s or "")
        except (SyntaxError, ValueError):
            return []
        out = []

        def visit(body: Sequence[ast.stmt], inside: str | None) -> None:
            for n in body:
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.append(("method" if inside else "function", f"{inside}.{n.name}" if inside else n.name, n))
                elif isinstance(n, ast.ClassDef):
                    out.append(("class", n.name, n))
                    visit(n.body, n.name)
                elif isinstance(n, (ast.Import, ast.ImportFrom)) and not inside:
                    out.append(("import", ast.unparse(n), n))
                elif not inside:
                    out.append(("statement", type(n).__name__, n))

        visit(tree.body, None)
        return [{"kind": k, "name": n, "start": x.lineno, "end": x.end_lineno} for k, n, x in out]

    return source.map(one)


@F.pandas_udf(T.BooleanType())
def same_code(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal but for comments and doc strings; unparsable sources compare as text."""

    def bare(s: str) -> str:
        try:
            tree = ast.parse(s)
        except (SyntaxError, ValueError):
            return s
        for n in ast.walk(tree):
            if isinstance(n, (ast.Module, ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
                n.body = n.body[1:] or [ast.Pass()]
        return ast.dump(tree)

    return pd.Series([x is not None and y is not None and bare(x) == bare(y) for x, y in zip(a, b)])


DIFF = _rows(path=T.StringType(), old_start=T.IntegerType(), new_start=T.IntegerType(), kind=T.StringType(), content=T.StringType(), line=T.IntegerType())


@F.pandas_udf(DIFF)
def parse_diff(text: pd.Series) -> pd.Series:
    """Lines of a unified diff: path, hunk starts, kind (added, deleted, context) and number on its own side.

    A hunk's header says how many lines it has on either side, so its lines may look like file headers. A deleted file has its old path."""

    def one(s: str | None) -> list[dict]:
        out, path, before = [], "", ""
        old = new = o = n = o_left = n_left = 0
        for x in (s or "").split("\n"):
            kind = {"+": "added", "-": "deleted", " ": "context"}.get(x[:1]) if o_left > 0 or n_left > 0 else None
            if kind:
                out.append({"path": path, "old_start": old, "new_start": new, "kind": kind, "content": x[1:], "line": o if kind == "deleted" else n})
                was, now = int(kind != "added"), int(kind != "deleted")
                o, n, o_left, n_left = o + was, n + now, o_left - was, n_left - now
            elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", x):
                old, new = o, n = int(m[1]), int(m[3])
                o_left, n_left = int(m[2] or 1), int(m[4] or 1)
            elif x.startswith(("--- ", "+++ ")):
                name = x[4:].split("\t")[0]
                if x[0] == "-":
                    before = name
                elif name == "/dev/null":
                    name = before
                path = re.sub(r"^[ab]/", "", name)
                o_left = n_left = 0
        return out

    return text.map(one)
