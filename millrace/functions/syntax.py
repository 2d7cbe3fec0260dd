"""Functions and statements of source code as rows: a table function in a lateral join."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import singledispatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import snippets as S
from millrace.functions import text as T

#: Fixed values of unit levels and origins.
FUNCTION, STATEMENT = 0, 1
ROOT, SPLIT = "root", "fallback"

UNIT = "level int, kind string, signature string, payload string, size int, unit_start int, unit_end int"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


# ---- names of what a statement does; the formats are fixed values ----
@singledispatch
def target(node: ast.AST) -> str:
    """What is assigned or called: a name, or the kind of expression."""
    return type(node).__name__


target.register(ast.Name, lambda node: node.id)
target.register(ast.Attribute, lambda node: node.attr)
target.register(ast.Subscript, lambda node: "subscript")
target.register(ast.Tuple, lambda node: "tuple")
target.register(ast.List, lambda node: "tuple")

_SHAPES = {ast.Compare: "compare", ast.BoolOp: "boolop", ast.BinOp: "binop"}


def shape(node: ast.AST) -> str:
    """Kind of an expression, and of a call also what is called."""
    return f"call:{target(node.func)}" if isinstance(node, ast.Call) else _SHAPES.get(type(node), type(node).__name__)


def detail(node: ast.stmt) -> list[str]:
    """What tells statements of one kind apart."""
    match node:
        case ast.Assign():
            return ["+".join(map(target, node.targets))]
        case ast.AugAssign() | ast.AnnAssign() | ast.For():
            return [target(node.target)]
        case ast.If() | ast.While():
            return [shape(node.test)]
        case ast.Expr():
            return [shape(node.value)]
    return []


def statement_signature(node: ast.stmt) -> str:
    return "::".join(["stmt", type(node).__name__, *detail(node)])


def function_signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = node.args
    gives = any(isinstance(x, ast.Return) and x.value is not None for x in ast.walk(node))
    flags = {"pos": len(a.args), "kw": len(a.kwonlyargs), "va": int(a.vararg is not None), "kwa": int(a.kwarg is not None), "ret": int(gives)}
    return "::".join(["fn", node.name, *(f"{k}{v}" for k, v in flags.items())])


class Places:
    """Offsets in characters of the parser's lines and bytes."""

    def __init__(self, code: str):
        self.code = code
        self.lines = [0] + [m.end() for m in re.finditer(r"\r\n|\r|\n", code)]

    def at(self, line: int, byte: int) -> int:
        start = self.lines[line - 1]
        end = self.lines[line] if line < len(self.lines) else len(self.code)
        text = self.code[start:end]
        return start + (byte if text.isascii() else len(text.encode()[:byte].decode(errors="ignore")))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def line_of(self, offset: int) -> int:
        return bisect_right(self.lines, offset)


def split_units(code: str | None) -> Iterator[tuple[int, str, str, str, int, int, int]]:
    """(level, kind, signature, payload, size, start, end): functions with the statements of their bodies, and the
    statements of the module and of its classes. Size counts syntax nodes, ends are exclusive.

    Code that can't be parsed is one unit of kind "opaque", whose size is its number of words; null and blank code have none."""
    if not code or not code.strip():
        return
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield FUNCTION, "opaque", "opaque", code, max(1, len(code.split())), 0, len(code)
        return
    places = Places(code)
    sizes: dict[int, int] = {}
    order: list[ast.AST] = []
    queue = deque([tree])
    while queue:  # breadth first, without recursion
        order.append(node := queue.popleft())
        queue.extend(ast.iter_child_nodes(node))
    for node in reversed(order):
        sizes[id(node)] = 1 + sum(sizes[id(x)] for x in ast.iter_child_nodes(node))

    def unit(level: int, node: ast.AST) -> tuple:
        start, end = places.span(node)
        return level, type(node).__name__, (statement_signature if level else function_signature)(node), code[start:end], sizes[id(node)], start, end

    for node in order:
        if isinstance(node, _FUNCTIONS):
            yield unit(FUNCTION, node)
            yield from (unit(STATEMENT, x) for x in node.body)
    for node in tree.body:
        inner = node.body if isinstance(node, ast.ClassDef) else [node]
        yield from (unit(STATEMENT, x) for x in inner if not isinstance(x, _FUNCTIONS))


class _Units:
    def eval(self, code: str):
        yield from split_units(code)


def _table_function():
    return F.udtf(_Units, returnType=UNIT)


def syntax_units(df: DataFrame, code: str) -> DataFrame:
    """A row for each unit of each row's ``code``: level, kind, signature, source, lines, size, unit_start, unit_end.

    Rows whose unit is blank without comments are left out. ``df`` keeps its columns; a row without units gives none."""
    units = df.lateralJoin(_table_function()(F.col(code).outer()))
    source = T.normal_source(F.col("payload"))
    opaque = F.concat(F.lit("opaque::"), F.substring(F.md5("source"), 1, 8))
    return units.withColumn("source", source).filter("source <> ''").withColumn("signature", F.when(F.col("kind") == "opaque", opaque).otherwise(F.col("signature"))).withColumn("lines", F.split("source", "\n")).drop("payload")


def response_snippets(df: DataFrame, key: str, text: str, edits_only: bool = False) -> DataFrame:
    """All snippets of responses: the edits that they make, and the units of syntax in each edit.

    Spans count from the response's start. A response without a usable edit is split as it is. ``edits_only`` leaves out the
    units, and responses without a sign of an edit (an <edit>, <code> or fence)."""
    hint = F.col(text).rlike(r"(?i)<edit\b|<code>|```")
    rows = df.filter(hint).select(key, text).withColumn("_e", S.root_edits(F.col(text)))
    roots = rows.select(key, text, F.explode("_e").alias("e")).select(key, text, "e.*")
    edits = roots.select(key, F.lit(FUNCTION).alias("level"), "signature", "source", F.col("size").cast("int").alias("size"), "char_start", "char_end", "edit_type", F.lit(ROOT).alias("origin"), "path")
    if edits_only:
        return edits
    bare = rows.filter(F.size("_e") == 0).withColumn("_c", S.code_span(F.col(text))).select(key, F.col("_c.code").alias("_code"), F.col("_c.offset").cast("int").alias("_from"), F.lit(S.WHOLE).alias("edit_type"), F.lit("").alias("path"))
    payloads = roots.select(key, F.substr(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("_code"), F.col("char_start").alias("_from"), "edit_type", "path").unionByName(bare)
    units = syntax_units(payloads, "_code").select(key, "level", "signature", "source", "size", (F.col("_from") + F.col("unit_start")).alias("char_start"), (F.col("_from") + F.col("unit_end")).alias("char_end"), "edit_type", F.lit(SPLIT).alias("origin"), "path")
    return edits.unionByName(units)
