"""Units of syntax: spans rebuild the source, sizes are node counts, what can't be parsed is one unit."""

import ast

from millrace.functions import syntax

CODE = '''import os

class Käse(Base):
    größe: int = 3
    def wiegen(self, *rest, laut=False, **mehr):
        """Gewicht."""
        if self.größe > 2 and laut:
            return "schwer — é"
        for a, b in rest:
            self.summe[a] += b

        def innen():
            pass

x, y = 1, 2
wiegen(x)
async def spaeter():
    await x
'''


def test_spans_rebuild_the_source():
    units = list(syntax.split_units(CODE))
    tree = ast.parse(CODE)
    by_span = {ast.get_source_segment(CODE, n): n for n in ast.walk(tree) if hasattr(n, "lineno")}
    for _, kind, _, payload, size, start, end in units:
        assert CODE[start:end] == payload
        assert type(by_span[payload]).__name__ == kind or kind in ("Expr", "Pass")
        if kind != "Expr":
            assert size == sum(1 for _ in ast.walk(by_span[payload]))
    assert [u[2] for u in units if u[0] == syntax.FUNCTION] == ["fn::spaeter::pos0::kw0::va0::kwa0::ret0", "fn::wiegen::pos1::kw1::va1::kwa1::ret1", "fn::innen::pos0::kw0::va0::kwa0::ret0"]
    assert [u[2] for u in units if u[0] == syntax.STATEMENT] == [
        "stmt::Expr::Await", "stmt::Expr::Constant", "stmt::If::boolop", "stmt::For::tuple", "stmt::FunctionDef", "stmt::Pass",
        "stmt::Import", "stmt::AnnAssign::größe", "stmt::Assign::tuple", "stmt::Expr::call:wiegen",
    ]


def test_line_ends():
    for end in ("\n", "\r\n", "\r"):
        code = end.join(["a = 1", "def f(x):", "    y = 'ü'; z = x", "    return y"])
        for _, _, _, payload, _, start, stop in syntax.split_units(code):
            assert code[start:stop] == payload
        assert [u[3] for u in syntax.split_units(code)][1:4] == ["y = 'ü'", "z = x", "return y"]


def test_what_cannot_be_parsed():
    assert [(u[1], u[4:]) for u in syntax.split_units("if x:: y")] == [("opaque", (3, 0, 8))]
    assert list(syntax.split_units("a\0b"))[0][1] == "opaque"
    assert list(syntax.split_units("(" * 5000))[0][1] == "opaque"
    assert list(syntax.split_units(None)) == list(syntax.split_units(" \n ")) == []


def test_as_a_table_function(spark):
    rows = [(1, "x = 1  # one\ny = f(x)"), (2, None), (3, ""), (4, "# only a comment"), (5, "def broken("), (1, "x = 1  # one\ny = f(x)")]
    df = spark.createDataFrame(rows, "k int, code string")
    got = sorted((r.k, r.signature, r.source, r["size"]) for r in syntax.syntax_units(df, "code").collect())
    assert got[:4] == [(1, "stmt::Assign::x", "x = 1", 4)] * 2 + [(1, "stmt::Assign::y", "y = f(x)", 8)] * 2
    assert len(got) == 5 and got[4][0] == 5 and got[4][1].startswith("opaque::")
    assert syntax.syntax_units(df.limit(0), "code").count() == 0


def test_snippets_of_responses(spark):
    old, new = "a = 1", "def g(q):\n    return q + 1"
    responses = [(1, f"I think.<edit path=\"m.py\"><search>{old}</search><replace>{new}</replace></edit>"), (2, "no code at all"), (3, "```python\nz = [1]\n```"), (4, None)]
    df = spark.createDataFrame(responses, "k int, text string")
    texts = dict(responses)
    got = syntax.response_snippets(df, "k", "text").collect()
    assert {(r.k, r.origin, r.edit_type, texts[r.k][r.char_start : r.char_end]) for r in got} == {
        (1, "root", "del", old), (1, "root", "add", new), (1, "fallback", "del", old), (1, "fallback", "add", new), (1, "fallback", "add", "return q + 1"),
        (3, "root", "none", "z = [1]\n"), (3, "fallback", "none", "z = [1]"),
    }
    assert {r.origin for r in syntax.response_snippets(df, "k", "text", edits_only=True).collect()} == {"root"}
