"""Runs of words that repeat with a period: harmonic grid, hashed common extensions, exact verification.

A run of period p that spans two periods holds two neighbouring points of the grid 0, p, 2p, ..., so all runs are found from
the pairs (i, i + p) of all periods: n/1 + n/2 + ... = n ln n pairs for n words. The pairs of all texts of a slice are
taken together (``PAIRS`` at a time). Pairs of unequal words can't lie in a run of their period and go first; for the others
the longest common extension to either side is searched by bisection, all pairs at once, over prefix hashes. Equal words
have equal hashes, so an extension is never too short; if it is too long, the verification by words fails and the text is
searched again with another hash. Runs found from several points or from multiples of their period have the same ends:
the smallest period of each (start, end) is kept.

Texts are worked on in slices of about 1 MB in one narrow pass; a text is never cut. Memory follows the longest text (its
words and prefix hashes) and ``PAIRS``, not the number of pairs.

Cases: a null or empty text has no words and no runs; rows without an id or with repeated ids are each worked on by
themselves; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import ranges
from millrace.llm.slices import slices, small_batches, tidy

LEAST_WORDS = 12
PAIRS = 1 << 19
#: Base of the fast hash (modulo 2^64), and the modulus of the hashes that are tried where it fails.
BASE, PRIME = 0x9E3779B97F4A7C15, (1 << 31) - 1
U = np.uint64
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    x = ids.astype(U) + U((seed * 2 + 1) * BASE % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Fast:
    """Prefix hashes modulo 2^64."""

    def __init__(self, ids: np.ndarray, seed: int):
        self.power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(ids), U(BASE), U)]))
        self.sums = np.concatenate([[U(0)], np.cumsum(_mixed(ids, seed) * self.power[:-1], dtype=U)])

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray, power: np.ndarray) -> np.ndarray:
        s = self.sums
        return (s[i + size] - s[i]) * power == s[j + size] - s[j]


class Sure(Fast):
    """Prefix hashes modulo a prime: for texts made to fool powers of two."""

    def __init__(self, ids: np.ndarray, seed: int):
        base = int(np.random.default_rng(seed).integers(1 << 20, PRIME - 1))
        self.power = np.ones(1, U)
        while len(self.power) <= len(ids):
            self.power = np.concatenate([self.power, self.power * U(pow(base, len(self.power), PRIME)) % U(PRIME)])
        self.power = self.power[: len(ids) + 1]
        self.sums = np.concatenate([[U(0)], np.cumsum(_mixed(ids, seed) % U(PRIME) * self.power[:-1] % U(PRIME), dtype=U)])

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray, power: np.ndarray) -> np.ndarray:
        s = self.sums
        return (s[i + size] - s[i]) % U(PRIME) * power % U(PRIME) == (s[j + size] - s[j]) % U(PRIME)


def _extension(same, most: np.ndarray) -> np.ndarray:
    """For each pair the largest size in 0..most at which ``same(pairs, size)`` holds; size 0 always does."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live] + 1) >> 1
        ok = same(live, middle)
        low[live[ok]] = middle[ok]
        high[live[~ok]] = middle[~ok] - 1
        live = live[low[live] < high[live]]
    return low


def _verified(ids: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether words ``period`` apart are the same in all of [start, end)."""
    ok, size = np.ones(len(start), bool), end - start - period
    at = 0
    ends = np.cumsum(size)
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        i = ranges(start[at:to], size[at:to])
        differs = np.flatnonzero(ids[i] != ids[i + np.repeat(period[at:to], size[at:to])])
        ok[at + np.searchsorted(ends[at:to] - (ends[at - 1] if at else 0), differs, side="right")] = False
        at = to
    return ok


def find_runs(ids: np.ndarray, first: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; text k is ids[first[k]:first[k + 1]].

    A run has at least ``LEAST_WORDS`` words and two periods, and no neighbouring word of its text extends it."""
    hashed = (Sure if seed else Fast)(ids, seed)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), np.where(n >= LEAST_WORDS, n // 2, 0))
    period = np.arange(len(text)) - np.searchsorted(text, text) + 1
    points = (n[text] - 1) // period
    total = np.cumsum(points)
    found: list[np.ndarray] = []
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        own = np.repeat(np.arange(at, to), points[at:to])
        p = period[own]
        i = first[text[own]] + (np.arange(len(own)) - np.repeat(total[at:to] - points[at:to] - (total[at - 1] if at else 0), points[at:to])) * p
        hit = np.flatnonzero(ids[i] == ids[i + p])
        at = to
        if not len(hit):
            continue
        i, p, t = i[hit], p[hit], text[own[hit]]
        j, power = i + p, hashed.power[p]
        right = _extension(lambda k, size: hashed.same(i[k], j[k], size, power[k]), first[t + 1] - j)
        left = _extension(lambda k, size: hashed.same(i[k] - size, j[k] - size, size, power[k]), i - first[t])
        start, end = i - left, j + right
        ok = end - start >= np.maximum(LEAST_WORDS, 2 * p)
        if ok.any():
            found.append(_smallest(np.stack([start[ok], end[ok], p[ok]])))
    start, end, period = _smallest(np.concatenate(found, axis=1)) if found else np.empty((3, 0), np.int64)
    bad = ~_verified(ids, start, end, period)
    if bad.any():
        texts = np.searchsorted(first, start, side="right") - 1
        again = np.unique(texts[bad])
        keep = ~np.isin(texts, again)
        parts = [np.stack([start, end, period])[:, keep]]
        for t in again.tolist():
            r = np.stack(find_runs(ids[first[t] : first[t + 1]], np.array([0, n[t]]), seed + 1))
            parts.append(r + np.array([[first[t]], [first[t]], [0]]))
        start, end, period = np.concatenate(parts, axis=1)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of the runs with the same ends the one of the smallest period."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    return runs[:, np.append(True, (np.diff(runs[:2], axis=1) != 0).any(axis=0))] if runs.shape[1] else runs


def _work(texts: list[bytes | None]) -> tuple[list[int], list[int], list[np.ndarray], list[bytes]]:
    """Words and runs of each text, the runs (start, length, period) of all texts, and the texts without repeats."""
    each = [(t or b"").split() for t in texts]
    code: dict[bytes, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for ws in each for w in ws], np.int64)
    first = np.cumsum([0] + [len(ws) for ws in each])
    start, end, period = find_runs(ids, first)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    dropped = np.cumsum(edge)[:-1] > 0
    owner = np.searchsorted(first, start, side="right") - 1
    n_runs = np.bincount(owner, minlength=len(each))
    kept = [b" ".join(ws if not c else [w for w, d in zip(ws, dropped[f : f + len(ws)].tolist()) if not d]) for ws, f, c in zip(each, first.tolist(), n_runs.tolist())]
    return [len(ws) for ws in each], n_runs.tolist(), [start - first[owner], end - start, period], kept


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each whole text by start, then period, and its words, joined by one space,
    without those that any run holds after its first period."""
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1)):
            n_words, n_runs, runs, kept = _work(batch.column(1).cast(pa.binary()).to_pylist())
            struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_runs]), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(tidy(run), SCHEMA)
