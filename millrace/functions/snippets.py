"""Root edits of a response, with their places in it, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Fixed values of edit types.
ADDED, DELETED, WHOLE = "add", "del", "none"

UNIT = "struct<edit_type:string,payload:string,char_start:int,path:string>"


def _tagged(text: Column, name: str, any_case: bool = True) -> tuple[Column, Column, Column]:
    """Whether <name>...</name> occurs, what the first one holds, and where that starts (from 0)."""
    pattern = rf"(?{'i' if any_case else ''}s)<{name}>(.*?)</{name}>"
    whole = F.regexp_extract(text, pattern, 0)
    return whole != "", F.regexp_extract(text, pattern, 1), F.instr(text, whole) + len(name) + 1


def code_span(text: Column) -> Column:
    """{code, offset} of <code>, else <action>, else a Python fence, else the whole text; the offset counts from 0."""
    fence = r"(?s)(```(?:python|py)?\n)(.*?)```"
    whole = F.regexp_extract(text, fence, 0)
    fenced = F.struct(F.regexp_extract(text, fence, 2).alias("code"), (F.instr(text, whole) - 1 + F.length(F.regexp_extract(text, fence, 1))).alias("offset"))
    out = F.when(whole != "", fenced).otherwise(F.struct(text.alias("code"), F.lit(0).alias("offset")))
    for name in ("action", "code"):
        found, inner, at = _tagged(text, name, any_case=False)
        out = F.when(found, F.struct(inner.alias("code"), at.alias("offset"))).otherwise(out)
    return out


def root_edits(response: Column) -> Column:
    """Array of {edit_type, source, signature, size, char_start, char_end, path}: the first <edit> of a response.

    A search and a replacement give a deletion and an addition, an insert an addition, code or a bare body an overwrite; without
    an <edit>, the code block is an overwrite. Units that are blank once comments are gone are left out; null counts as empty."""
    text = F.coalesce(response, F.lit(""))
    edit = r"""(?s)(<edit\s+path=["'](.*?)["']\s*>)(.*?)</edit>"""
    whole, path, body = F.regexp_extract(text, edit, 0), T.strip(F.regexp_extract(text, edit, 2)), F.regexp_extract(text, edit, 3)
    start = F.instr(text, whole) - 1 + F.length(F.regexp_extract(text, edit, 1))
    unit = lambda kind, payload, at, where: F.struct(F.lit(kind).alias("edit_type"), payload.alias("payload"), at.cast("int").alias("char_start"), where.alias("path"))

    def first_of(*names: str) -> tuple[Column, Column, Column]:
        (a, a_in, a_at), (b, b_in, b_at) = (_tagged(body, n) for n in names)
        return a | b, F.when(a, a_in).otherwise(b_in), start + F.when(a, a_at).otherwise(b_at)

    old, old_text, old_at = first_of("search", "old")
    new, new_text, new_at = first_of("replace", "new")
    ins, ins_text, ins_at = _tagged(body, "insert")
    code, code_text, code_at = _tagged(body, "code", any_case=False)
    bare = code_span(text)
    units = (
        F.when(whole == "", F.array(unit(WHOLE, bare["code"], bare["offset"], F.lit(""))))
        .when(old & new, F.array(unit(DELETED, old_text, old_at, path), unit(ADDED, new_text, new_at, path)))
        .when(ins & (T.strip(ins_text) != ""), F.array(unit(ADDED, ins_text, start + ins_at, path)))
        .when(code, F.array(unit(WHOLE, code_text, start + code_at, path)))
        .otherwise(F.array(unit(WHOLE, body, start, path)))
    ).cast(f"array<{UNIT}>")

    def described(u: Column) -> Column:
        source = T.normal_source(u["payload"])
        signature = F.concat_ws("::", F.lit("root"), u["edit_type"], u["path"], T.short_hash(source))
        return F.struct(u["edit_type"].alias("edit_type"), source.alias("source"), signature.alias("signature"), F.size(F.split(source, "\n")).alias("size"), u["char_start"].alias("char_start"), (u["char_start"] + F.length(u["payload"])).alias("char_end"), u["path"].alias("path"))

    return F.filter(F.transform(units, described), lambda u: u["source"] != "")
