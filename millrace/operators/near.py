"""Near texts: all pairs of texts of one part whose ratio reaches a threshold, in either direction, without losing any.

Texts of a part are dealt to bands of length and a band to pieces of bounded size; two pieces whose lengths allow the threshold
meet in one tile. In a tile, pairs are ruled out by upper bounds, the cheap ones first: lengths, characters and then q-grams that both
have, counted by hash buckets, and the longest common subsequence of first parts: matching blocks are one, and where a ratio is
reached, few characters are unmatched before any place. (Long texts of one language have most q-grams in common, but no such
subsequence.) Only what all of them allow is aligned. A tile's memory is bounded, whatever the part holds; the number of pairs whose
lengths and characters are compared grows with the square of a band."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q, CHARS, GRAMS, PIECE_ROWS, PIECE_CHARS = 3, 64, 960, 2000, 4_000_000


#: First parts of a text by which partners are ruled out, before whole texts are.
FIRST_PARTS = (0.15, 0.35)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of characters, then of q-grams; and the q-grams' hashes."""
    code = codes(text).astype(np.uint64)
    grams = code[: max(0, len(code) - Q + 1)].copy()
    for k in range(1, Q):
        grams = grams * np.uint64(1000003) + code[k : k + len(grams)]
    grams = grams * np.uint64(0x9E3779B97F4A7C15)
    counts = [np.bincount((x % np.uint64(n)).astype(np.int64), minlength=n) for x, n in ((code, CHARS), (grams >> np.uint64(40), GRAMS))]
    return np.concatenate(counts), grams


def numbered(grams: np.ndarray) -> np.ndarray:
    """Hashes told apart where they repeat, in order."""
    grams = np.sort(grams)
    return np.sort(grams + np.arange(len(grams), dtype=np.uint64) - np.searchsorted(grams, grams).astype(np.uint64))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def common_subsequences(text: np.ndarray, others: Sequence[np.ndarray]) -> np.ndarray:
    """Length of the longest common subsequence of a text with each of some others: rows of the table are bits of one long integer, in
    which each of the others has a field with a spare bit behind it."""
    sizes = np.array([len(x) for x in others], np.int64)
    ends = np.cumsum(sizes + 1)
    flat, used = np.zeros(int(ends[-1]), np.uint32), np.ones(int(ends[-1]), bool)
    used[ends - 1] = False
    flat[used] = np.concatenate(others)
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    places = {c: number((flat == c) & used) for c in np.unique(text).tolist()}
    keep = row = number(used)
    for c in text.tolist():
        new = row & places[c]
        row = ((row + new) | (row - new)) & keep
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(flat) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(flat)]
    return sizes - np.add.reduceat(bits, np.concatenate([[0], ends[:-1]]), dtype=np.int64)


def subsequence_allows(text: np.ndarray, others: Sequence[np.ndarray], least: float) -> np.ndarray:
    """Places of the others whose ratio to the text may reach ``least``, by common subsequences."""
    left = np.arange(len(others))
    for part in (*FIRST_PARTS, 1.0):
        if not len(left):
            break
        sizes = np.array([len(others[k]) for k in left], np.int64)
        matched = least * (len(text) + sizes) / 2
        n = math.ceil(part * len(text))
        ends = np.minimum(sizes, np.floor(n + sizes - matched + 1e-6).astype(np.int64))  # partners of the first n characters lie before it
        some = ends > 0
        common = np.zeros(len(left), np.int64)
        if n and some.any():
            common[some] = common_subsequences(text[:n], [others[k][:e] for k, e in zip(left[some], ends[some])])
        left = left[common >= n - (len(text) - matched) - 1e-6]
    return left


def least_shared(total, least: float):
    """Characters and q-grams that two texts of so many characters in all share at the ratio (see ``similar.least_common``)."""
    return least * total / 2, least * total / 2 - (Q - 1) * (total * (1 - least) + 1)


def common_grams(a: np.ndarray, b: np.ndarray) -> int:
    """How many of a's numbered q-grams b has."""
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) and len(b) else 0


def may_reach(a: str, b: str, least: float) -> bool:
    """Whether lengths, characters and common subsequences allow the ratio."""
    chars, _ = least_shared(len(a) + len(b), least)
    if min(len(a), len(b)) < chars - 1e-9 or sum((Counter(a) & Counter(b)).values()) < chars - 1e-9:
        return False
    return len(subsequence_allows(codes(a), [codes(b)], least)) > 0


def reaches(a: str, b: str, least: float) -> bool:
    return SequenceMatcher(None, a, b).ratio() >= least


class _Piece:
    """Texts by length, with their counts."""

    def __init__(self, part: pd.DataFrame):
        self.size = part["size"].to_numpy(np.int64)
        order = np.argsort(self.size, kind="stable")
        self.size = self.size[order]
        self.ids, self.new = part["id"].to_numpy(np.int64)[order], np.flatnonzero(part["new"].to_numpy(bool)[order])
        self.texts = part["text"].to_numpy()[order]
        self.chars, self.cells = np.zeros((CHARS, len(order)), np.uint16), np.zeros((len(order), GRAMS), np.uint8)
        self.lost, self.codes = np.zeros((2, len(order)), np.int64), [codes(text) for text in self.texts]
        for n, text in enumerate(self.texts):
            counts, _ = counted(text)
            cut = np.minimum(counts, 255)  # what is cut is allowed for
            self.chars[:, n], self.cells[n] = cut[:CHARS], cut[CHARS:]
            self.lost[:, n] = (counts - cut)[:CHARS].sum(), (counts - cut)[CHARS:].sum()


def _near_of(one: _Piece, two: _Piece, least: float) -> list[tuple[int, int, bool, bool]]:
    """(a, b, ratio of a's text to b's reached, of b's to a's) of a tile, where one of both texts is new."""
    fresh = two.chars[:, two.new]
    is_new = np.zeros(len(one.ids), bool)
    is_new[one.new] = True
    found = []
    for n, size in enumerate(one.size):
        places, chars = (np.arange(len(two.ids)), two.chars) if is_new[n] else (two.new, fresh)
        sizes = two.size if is_new[n] else two.size[two.new]
        low = np.searchsorted(sizes, size * least / (2 - least) - 1e-6)
        high = np.searchsorted(sizes, size * (2 - least) / max(least, 1e-9) + 1e-6, "right")
        if one is two:
            low = max(low, np.searchsorted(places, n + 1))
        if low >= high:
            continue
        matched, grams = least_shared(size + sizes[low:high], least)
        both = np.minimum(chars[:, low:high], one.chars[:, n, None]).sum(0, dtype=np.uint16)
        ok = np.flatnonzero(both + one.lost[0, n] >= matched - 1e-9)
        if not len(ok):
            continue
        at = places[low + ok]
        both = np.minimum(two.cells[at], one.cells[n]).sum(1, dtype=np.int32)
        at = at[both + one.lost[1, n] >= grams[ok] - 1e-9]
        for m in at[subsequence_allows(one.codes[n], [two.codes[k] for k in at], least)].tolist():
            a, b = one.texts[n], two.texts[m]
            there, back = reaches(a, b, least), reaches(b, a, least)
            if there or back:
                found.append((int(one.ids[n]), int(two.ids[m]), there, back))
    return found


def near_texts(texts: DataFrame, least: float) -> DataFrame:
    """(part, a, b, ab, ba) of texts (part, id, text, new), no text twice in a part: whether the ratio of a's text to b's, and of b's to a's,
    is at least ``least``. Pairs of which neither is new are left out; a pair comes once, in any order."""
    reach = (2 - least) / max(least, 1e-9)
    wide = max(2.0, reach * 1.001)  # a band's texts reach into the next one at most
    sized = texts.withColumn("size", F.length("text")).filter("size > 0").withColumn("band", F.floor(F.log("size") / F.lit(math.log(wide))).cast("int"))
    pieces = sized.groupBy("part", "band").agg(F.greatest(F.ceil(F.count("*") / PIECE_ROWS), F.ceil(F.sum("size") / PIECE_CHARS)).cast("int").alias("n"))
    later = pieces.select("part", (F.col("band") - 1).alias("band"), F.col("n").alias("n_up"))
    before = pieces.select("part", (F.col("band") + 1).alias("band"), F.col("n").alias("n_down"))
    x = sized.join(pieces, ["part", "band"]).join(later, ["part", "band"], "left").join(before, ["part", "band"], "left")
    x = x.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    up = F.coalesce("n_up", F.lit(0))
    down = F.coalesce("n_down", F.lit(0))
    edge = F.pow(F.lit(wide), F.col("band"))
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda band, a, band2, b, side: F.struct(band.alias("band"), a.alias("a"), band2.alias("band2"), b.alias("b"), F.lit(side).alias("side"))
    band, piece = F.col("band"), F.col("piece")
    own = F.transform(to(F.col("n")), lambda o: F.when(o >= piece, tile(band, piece, band, o, 0)).otherwise(tile(band, o, band, piece, 1)))
    higher = F.when(F.col("size") * reach * 1.001 >= edge * wide, F.transform(to(up), lambda o: tile(band, piece, band + 1, o, 0)))
    lower = F.when(F.col("size") <= edge * reach * 1.001, F.transform(to(down), lambda o: tile(band - 1, o, band, piece, 1)))
    none = F.slice(own, 1, 0)
    dealt = x.select("part", "id", "text", "new", "size", F.explode(F.concat(own, F.coalesce(higher, none), F.coalesce(lower, none))).alias("t")).select("part", "id", "text", "new", "size", "t.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        if pdf["new"].any():
            one = _Piece(pdf[pdf["side"] == 0])
            alone = pdf["band"].iloc[0] == pdf["band2"].iloc[0] and pdf["a"].iloc[0] == pdf["b"].iloc[0]
            found = _near_of(one, one if alone else _Piece(pdf[pdf["side"] == 1]), least)
        out = pd.DataFrame(found, columns=["a", "b", "ab", "ba"])
        return out.assign(part=pdf["part"].iloc[0])[["part", "a", "b", "ab", "ba"]]

    return dealt.groupBy("part", "band", "a", "band2", "b").applyInPandas(run, "part long, a long, b long, ab boolean, ba boolean")
