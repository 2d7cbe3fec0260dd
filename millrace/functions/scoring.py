"""Scores, shaped rewards, edits, diffs and nested records as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import last_boxed

#: Fixed values of final-answer normalisation, in the order they apply.
ANSWER_REPLACEMENTS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
ANSWER_REMOVALS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
    "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
#: Fixed patterns: what is between dollars, then what is inside commands, then short forms of fractions and roots.
ANSWER_PATTERNS = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"), (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", r"frac{$2}{$3}"), (r"(sqrt)([^{])", r"sqrt{$2}"),
]


def final_answer(text: Column) -> Column:
    """The part after the last "=": replacements, removals and patterns in order, no dollars, plain thousands without commas."""
    x = F.element_at(F.split(text, "="), -1)
    for a, b in ANSWER_REPLACEMENTS:
        x = F.replace(x, F.lit(a), F.lit(b))
    for a in ANSWER_REMOVALS:
        x = F.replace(x, F.lit(a), F.lit(""))
    for pattern, new in ANSWER_PATTERNS:
        x = F.regexp_replace(x, pattern, new)
    x = F.replace(x, F.lit("$"), F.lit(""))
    bare = F.replace(x, F.lit(","), F.lit(""))
    return F.regexp_replace(F.when(bare.rlike(r"^\d+$"), bare).otherwise(x), r"^\s+|\s+$", "")


def minerva(text: Column, truth: Column) -> Column:
    """{correct, pred}: the last answer line against the truth, both in final form."""
    pred = final_answer(last_answer_line(text))
    return F.struct((pred == final_answer(truth)).alias("correct"), pred.alias("pred"))


def strict_box(text: Column, truth: Column, tail: int = 100) -> Column:
    """{score, pred}: 1 if the last boxed part of the tail is the truth itself, else -1."""
    pred = last_boxed(F.right(text, F.lit(tail)))
    return F.struct(F.when(pred == truth, 1).otherwise(-1).alias("score"), pred.alias("pred"))


def last_answer_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1)), F.lit("[INVALID]"))


def answer_struct(text: Column, truth: Column, tail: int = 300) -> Column:
    """{score, acc, pred} of the last answer in the tail; score is 1 or -1."""
    pred = final_answer(last_answer_line(F.right(text, F.lit(tail))))
    ok = pred == truth
    return F.struct(F.when(ok, 1.0).otherwise(-1.0).alias("score"), F.coalesce(ok, F.lit(False)).alias("acc"), pred.alias("pred"))


def format_and_accuracy(text: Column, correct: Column, weight: float = 0.9) -> Column:
    """Weighted accuracy and whether the whole text is thought and boxed answer."""
    return weight * correct.cast("double") + (1 - weight) * text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")


def pass_fraction(results: Column) -> Column:
    """Share of passed cases, 0 without any; what is not true fails."""
    n = F.size(results)
    return F.when(n > 0, F.size(F.filter(results, lambda r: F.coalesce(r, F.lit(False)))) / n).otherwise(0.0)


def pass_score(results: Column, first: int = 10) -> Column:
    """1 if all pass, else the share of the first cases."""
    return F.when(F.forall(results, lambda r: F.coalesce(r, F.lit(False))), 1.0).otherwise(pass_fraction(F.slice(results, 1, first)))


def shaped_reward(fraction: Column, terminal: Column, coefficient: float, success: float = 10.0, failure: float = 0.0) -> Column:
    """Partial credit plus the terminal reward; without a coefficient the terminal one alone."""
    return terminal if coefficient <= 0 else coefficient * (success - failure) * fraction + terminal


def improvement_reward(new: Column, best: Column, penalty: float = -0.05) -> Column:
    return F.when(new > best, 0.0).otherwise(penalty)


def yes_probability(yes: Column, no: Column, missing: float = -10000.0) -> Column:
    """Probability of yes from two log-probabilities; a missing one counts as very unlikely, both missing gives a half."""
    return 1 / (1 + F.exp(F.least(F.coalesce(no, F.lit(missing)) - F.coalesce(yes, F.lit(missing)), F.lit(700.0))))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


def kl_reward(score: Column, logp: Column, ref: Column, ratio: float) -> Column:
    return score - (logp - ref) * ratio


def episode_score(reward: Column, length: Column, by_length: bool = False) -> Column:
    return F.try_divide(reward, length) if by_length else reward


def apply_patch(content: Column, search: Column, replacement: Column) -> Column:
    """{content, error}: replaces a search text that occurs exactly once."""
    n = F.try_divide(F.length(content) - F.length(F.replace(content, search, F.lit(""))), F.length(search))
    error = F.when(search == "", "empty search").when(n == 0, "search text not found").when(n > 1, "search text is ambiguous")
    return F.struct(F.when(error.isNull(), F.replace(content, search, replacement)).otherwise(content).alias("content"), error.alias("error"))


def apply_edit(content: Column, action: Column) -> Column:
    """{content, error} of an edit: patch a unique text, insert at the end on a line of its own, or else overwrite."""
    now = F.coalesce(content, F.lit(""))
    patched = apply_patch(now, F.coalesce(action["search"], F.lit("")), F.coalesce(action["replace"], F.lit("")))
    extra, whole = F.coalesce(action["insert"], F.lit("")), F.coalesce(action["content"], F.lit(""))
    joined = F.when((now == "") | now.endswith("\n"), F.concat(now, extra)).otherwise(F.concat(now, F.lit("\n"), extra))
    empty = F.regexp_replace(extra, r"\s", "") == ""
    inserted = F.struct(F.when(empty, now).otherwise(joined).alias("content"), F.when(empty, "empty insert").alias("error"))
    nothing = (whole == "") & (now == "")
    written = F.struct(whole.alias("content"), F.when(nothing, "empty content").alias("error"))
    return F.when(action["mode"] == "patch", patched).when(action["mode"] == "insert", inserted).otherwise(written)


#: Fixed values of preview classes.
HARNESS = r"__main__|stdin|stdout|json\.loads|\binput\s*\(|\bprint\s*\(|from typing"
BLOCK_SIZE = 8


def preview_family(preview: Column, mean_size: Column) -> Column:
    """Class of a code preview, read in one line; the first rule that fits counts."""
    line = F.trim(F.regexp_replace(F.replace(F.coalesce(preview, F.lit("")), F.lit("\\n"), F.lit("\n")), r"\s+", " "))
    stub = line.contains("return None") | line.isin("pass", "return", "...")
    return F.when(stub, "stub").when(line.rlike(HARNESS), "harness").when(mean_size >= BLOCK_SIZE, "block").otherwise("fragment")


def image_reference(name: Column, prefix: str = "docker.io/") -> Column:
    """Lower-case image name with a registry and a tag."""
    x = F.lower(F.replace(name, F.lit("__"), F.lit("_1776_")))
    x = F.when(x.contains("/"), x).otherwise(F.concat(F.lit(prefix), x))
    return F.when(F.element_at(F.split(x, "/"), -1).contains(":"), x).otherwise(F.concat(x, F.lit(":latest")))


def passages(docs: Column) -> Column:
    """ "Doc i (Title: ...) text" of structs of title and text."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), d["title"], F.lit(") "), d["text"])), "\n")


def proportional_span(start: Column, end: Column, text_length: Column, tokens: Column) -> tuple[Column, Column]:
    """Token span of a character span by proportion; at least one token."""
    a = F.least((start * tokens / F.greatest(text_length, F.lit(1))).cast("int"), tokens - 1)
    return a, F.greatest(F.least(F.ceil(end * tokens / F.greatest(text_length, F.lit(1))).cast("int"), tokens), a + 1)


def call_stdin(args: Column) -> Column:
    """One JSON value a line, each line ended; no arguments give an empty text."""
    values = F.transform(args, lambda a: F.regexp_replace(F.to_json(F.array(a), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", "$1\n"))
    return F.array_join(values, "")


def canonical_map(m: Column) -> Column:
    """A map as JSON of its sorted entries: equal maps give equal keys."""
    return F.to_json(F.array_sort(F.map_entries(m)))


def parse_io(text: Column) -> Column:
    """{inputs, outputs} of a JSON text; null unless both are lists of the same, positive length."""
    x = F.from_json(text, "inputs array<string>, outputs array<string>", {"mode": "PERMISSIVE"})
    return F.when((F.size(x["inputs"]) > 0) & (F.size(x["inputs"]) == F.size(x["outputs"])), x)


def test_names(text: Column) -> Column:
    """Names of a JSON list, or else of a comma list."""
    listed = F.from_json(text, "array<string>")
    return F.filter(F.transform(F.when(text.startswith("["), listed).otherwise(F.split(text, ",")), lambda x: F.trim(x)), lambda x: x != "")


def selected(name: Column, wanted: Column) -> Column:
    """A wanted name is the name, or its ending after "::"."""
    return F.exists(wanted, lambda w: (name == w) | name.endswith(F.concat(F.lit("::"), w)))


def line_kinds(lines: Column, kinds: Sequence[str] = ("added", "deleted", "context")) -> list[Column]:
    """Numbers of lines of each kind in a hunk."""
    return [F.size(F.filter(lines, _is(kind))).alias(f"n_{kind}") for kind in kinds]


def _is(kind: str):
    return lambda x: x["kind"] == kind


def time_limit_free(reason: Column) -> Column:
    return ~F.coalesce(reason.isin("traj_time_limit"), F.lit(False))


def special_judge(*flags: Column) -> Column:
    """Whether any flag is set: true, or a text that isn't blank, 0 or false."""
    out = F.lit(False)
    for f in flags:
        t = F.lower(F.trim(f.cast("string")))
        out = out | F.coalesce(~t.isin("", "0", "false", "none", "null"), F.lit(False))
    return out


def needs_rollout(outcome: Column, turns: Column, limit: int) -> Column:
    return outcome.isNull() | (outcome == "error") | ((outcome != "won") & (turns < limit))
