"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows of items, exact edit verification.

The CGK walk reads a string with a pointer; at each step it writes the character under the pointer and moves on or
not by a random bit that depends on step and character. Strings at a small edit distance mostly fall in step again,
so their walks agree in most places: edit distance becomes Hamming distance. Windows start at every word of items and
of documents, and at every character of runs without a space, so each window of a copied passage has its fellow.
Each repetition keys a window by sampled places of its walk; equal keys are candidates. The number of repetitions
follows from the recall wanted at the rate of edits that verification accepts and from the windows that the poorest
item itself has: an item of many windows is in the first tables only, so later tables are sparse. Candidates are pruned twice,
all at once and a machine word each. First the piece of up to 64 characters about the agreeing window must lie within
``drift`` of its place with no more edits than four standard deviations above the rate allow (this is part of the sampling
that the recall is measured for). Then a bound that loses nothing: the least distances of all pieces of an item near their
places add up to no more than the item's. What is left is verified by the exact edit distance of the item to the best
stretch of the document (on whole integers): a copy may have one edit in ``ONE_IN`` characters of the item, rounded down.

Items of under ``MIN_WINDOWS`` windows are searched for exactly: cut into one piece more than the edits they may
have, one piece stands unchanged in every copy; its places are verified.

Items are gathered in parts of at most ``PART_BYTES``, whose tables take some 60 times as much; a larger benchmark is
matched part by part, each in a pass of its own, so a worker holds the tables of one part. Documents are read in one narrow
pass per part: no shuffle, no pairs between documents.

Cases: null or empty texts match nothing; case and runs of white space are ignored; items that repeat are searched once and
each reported; rows without an id are reported with a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.durable import checkpoint
from millrace.llm.slices import slices, small_batches, tidy

#: A copy may have one edit in so many characters of an item; the recall that repetitions are reckoned for at that rate.
ONE_IN, RECALL = 5, 0.95
#: Items of fewer windows than FEW have no slack in that reckoning; their tables are sparse, so a higher recall costs little.
FEW, FEW_RECALL = 16, 0.99
MIN_WINDOWS, LONG_RUN, SEED = 4, 20, 9
KEY_STEPS, KEY_PLACES, PIECE = 24, 15, 64
#: Tables of fewer windows than this drop walks after a quarter of the steps, too.
SPARSE = 3000
PART_BYTES = 2 << 20
BATCH_BYTES = 1 << 18
U = np.uint64
MIX = U(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def best_distance(pattern: str, text: str, limit: int) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and where that ends (Myers' bit vectors)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    pv, mv, score, best, where = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, where = score, j + 1
            if best == 0:
                break
    return best, where


def edits_allowed(size: int) -> int:
    """Edits that a copy of an item of so many characters may have."""
    return size // ONE_IN


def repetitions(windows: int, rate: float = 1 / ONE_IN, recall: float = RECALL) -> int:
    """Repetitions so that a passage of this many windows is found at this rate of edits.

    A walk of KEY_STEPS reads about half as many characters; a window is in step if none of them is edited.
    Repetitions share the characters, but differ in how far they read and what they sample, so each counts half."""
    one = (1 - rate) ** (KEY_STEPS / 2)
    return max(1, math.ceil(math.log(1 - recall) / (0.5 * windows * math.log(1 - one))))


def window_starts(buf: np.ndarray) -> np.ndarray:
    """Starts of words, and of all characters in runs of over LONG_RUN bytes without a space; ``buf`` ends with zeros."""
    apart = (buf == 32) | (buf == 0)
    starts = np.flatnonzero(np.append(True, apart[:-1]) & ~apart)
    gaps = np.flatnonzero(apart)
    size = gaps[np.searchsorted(gaps, starts)] - starts
    long = size > LONG_RUN
    if not long.any():
        return starts
    inner = blocks.ranges(starts[long] + 1, size[long] - 1)
    return np.sort(np.concatenate([starts, inner[(buf[inner] & 0xC0) != 0x80]]))


@dataclass
class Benchmark:
    """LSH tables of one part of the items."""

    #: Of each text the first item's id.
    ids: list
    texts: list[str]
    #: Per repetition and character: the character, and from bit 8 on whether each step moves on.
    signs: np.ndarray
    places: np.ndarray
    bits: int
    keys: list[np.ndarray]
    owners: list[np.ndarray]
    #: Which leading bits of keys exist after some steps, packed.
    maps: list[dict[int, np.ndarray]]
    #: Offsets of windows in characters.
    offsets: np.ndarray
    item_of: np.ndarray
    #: Per item: first of its pieces, and edits it may have. Per piece: offset, size, and places of each low byte of a character.
    first_piece: np.ndarray
    limits: np.ndarray
    piece_at: np.ndarray
    piece_size: np.ndarray
    piece_bits: np.ndarray
    #: Per window: the piece of its item about it.
    piece_of: np.ndarray
    #: Pieces of items that are searched for exactly, by length: piece to (item, offset).
    pieces: dict[int, dict[str, list[tuple[int, int]]]]
    #: Of each text the ids of all items that have it.
    shared: list[list]

    @staticmethod
    def build(rows: list[tuple], rate: float = 1 / ONE_IN, recall: float = RECALL) -> Benchmark | None:
        by_text: dict[str, list] = {}
        for i, t in rows:
            if t := normal(t):
                by_text.setdefault(t, []).append(i)
        rows = [(ids, t) for t, ids in by_text.items()]
        if not rows:
            return None
        data = [t.encode() for _, t in rows]
        buf = np.frombuffer(b"\0".join(data) + b"\0" * (KEY_STEPS + 1), np.uint8)
        first = np.cumsum([0] + [len(d) + 1 for d in data])
        starts = window_starts(buf)
        item = np.searchsorted(first, starts, side="right") - 1
        left = first[item] + np.array([len(d) for d in data])[item] - starts
        windows = np.bincount(item[left >= KEY_STEPS * 3 // 4], minlength=len(rows))
        exact = windows < MIN_WINDOWS
        keep = (left >= KEY_STEPS // 3) & ~exact[item]
        starts, item = starts[keep], item[keep]
        pieces: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for k in np.flatnonzero(exact).tolist():
            t = rows[k][1]
            n = edits_allowed(len(t)) + 1
            cuts = [len(t) * i // n for i in range(n + 1)]
            for p, q in zip(cuts, cuts[1:]):
                pieces.setdefault(q - p, {}).setdefault(t[p:q], []).append((k, p))
        need = np.array([0 if e else repetitions(max(1, n), rate, max(recall, FEW_RECALL) if n < FEW else recall) for n, e in zip(windows.tolist(), exact)])
        reps = int(need.max())
        rng = np.random.default_rng(SEED)
        moves = rng.integers(0, 2, (reps, KEY_STEPS, 256)).astype(np.uint64)
        signs = np.arange(256, dtype=np.uint64) + (moves << np.arange(8, 8 + KEY_STEPS, dtype=np.uint64)[:, None]).sum(axis=1, dtype=np.uint64)
        places = np.array([np.isin(np.arange(KEY_STEPS), rng.choice(KEY_STEPS, KEY_PLACES, replace=False)) for _ in range(reps)])
        bits = min(22, max(16, len(starts).bit_length() + 4))
        place = np.cumsum((buf & 0xC0) != 0x80)
        cut = [(k, p, t[p : p + PIECE]) for k, (_, t) in enumerate(rows) for p in range(0, len(t), PIECE)]
        masks = np.zeros((len(cut), 256), np.uint64)
        for k, (_, _, t) in enumerate(cut):
            for at, c in enumerate(t):
                masks[k, ord(c) & 255] |= U(1 << at)
        first_piece = np.searchsorted([k for k, _, _ in cut], np.arange(len(rows) + 1))
        limits = np.array([edits_allowed(len(t)) for _, t in rows])
        sizes = np.array([len(t) for _, _, t in cut])
        offsets = place[starts] - place[first[item]]
        near = np.minimum(first_piece[item] + (offsets + KEY_STEPS // 4) // PIECE, first_piece[item + 1] - 1) if len(starts) else starts
        near = np.where((sizes[near] < PIECE // 2) & (near > first_piece[item]), near - 1, near) if len(starts) else near
        b = Benchmark([ids[0] for ids, _ in rows], [t for _, t in rows], signs, places, bits, [], [], [], offsets, item, first_piece, limits, np.array([p for _, p, _ in cut]), sizes, masks, near, pieces, [ids for ids, _ in rows])
        for r in range(reps):
            own = np.flatnonzero(need[item] > r)
            _, k = b.walk_keys(buf, starts[own], r, KEY_STEPS)
            order = np.argsort(k, kind="stable")
            b.keys.append(k[order])
            b.owners.append(own[order])
            after = (KEY_STEPS // 4, KEY_STEPS // 2) if len(own) < SPARSE else (KEY_STEPS // 2,)
            b.maps.append({j: b.packed(b.walk_keys(buf, starts[own], r, j)[1]) for j in (*after, KEY_STEPS)})
        return b

    def packed(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << self.bits, bool)
        out[self.leading(keys)] = True
        return np.packbits(out)

    def leading(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MIX >> U(64 - self.bits)).astype(np.int64)

    def walk_keys(self, buf: np.ndarray, at: np.ndarray, rep: int, steps: int, maps: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``at`` that are still walked, and their keys; after a step with a map only those go on whose key it has.

        Each character stands with the moves of all steps after it, in one word."""
        signs = self.signs[rep].take(buf)
        which, at, key = np.arange(len(at)), at.copy(), np.zeros(len(at), np.uint64)
        c = np.empty(len(at), np.uint64)
        for j in range(steps):
            if maps and j in maps:
                live = np.flatnonzero(maps[j].take(self.leading(key)))
                which, at, key, c = which[live], at[live], key[live], c[: len(live)]
            np.take(signs, at, out=c, mode="clip")
            if self.places[rep, j]:
                np.multiply(key, MIX, out=key)
                np.bitwise_xor(key, c, out=key)
            np.right_shift(c, U(8 + j), out=c)
            np.bitwise_and(c, U(1), out=c)
            at += c.view(np.int64)
        return which, key

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the (item, edits, start, end) found; texts are in normal form."""
        out: list[list] = [[] for _ in texts]
        data = [t.encode() for t in texts]
        i = size = 0
        for j, d in enumerate(data + [b""]):
            if j == len(data) or (size and size + len(d) > BATCH_BYTES):
                if size:
                    self._search(texts, data, i, j, out)
                i, size = j, 0
            size += len(d) + 1
        return out

    def _search(self, texts: list[str], data: list[bytes], i: int, j: int, out: list[list]) -> None:
        done: dict[tuple[int, int], list[int]] = {}
        for length, table in self.pieces.items():
            for d in range(i, j):
                text = texts[d]
                for p in range(len(text) - length + 1):
                    if hit := table.get(text[p : p + length]):
                        for item, offset in hit:
                            self._verify(text, d, item, p - offset, done, out)
        if not self.keys:
            return
        buf = np.frombuffer(b"\0".join(data[i:j]) + b"\0" * (KEY_STEPS + 1), np.uint8)
        first = np.cumsum([0] + [len(d) + 1 for d in data[i:j]])
        starts = window_starts(buf)
        doc = np.searchsorted(first, starts, side="right") - 1
        whose, which = [], []
        for r, (keys, owners) in enumerate(zip(self.keys, self.owners)):
            maps = self._maps(r)
            walked, k = self.walk_keys(buf, starts, r, KEY_STEPS, maps)
            maybe = np.flatnonzero(maps[KEY_STEPS].take(self.leading(k)))
            a, b = np.searchsorted(keys, k[maybe]), np.searchsorted(keys, k[maybe], side="right")
            n = b - a
            whose.append(np.repeat(walked[maybe], n))
            which.append(owners[np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)])
        place = np.cumsum((buf & 0xC0) != 0x80) - 1
        at, window = np.concatenate(whose), np.concatenate(which)
        begin = place[starts[at]] - self.offsets[window]
        if not len(window):
            return
        margin = PIECE + 2 * max(len(t) for t in self.texts)
        codes = np.pad(np.frombuffer("\0".join(texts[i:j]).encode("utf-32-le"), np.uint32).astype(np.uint8), margin)
        low, span, n_pieces = int(begin.min()), int(begin.max() - begin.min()) + 1, len(self.piece_size)
        together, begin = np.divmod(np.unique((doc[at] * n_pieces + self.piece_of[window]) * span + begin - low), span)
        (d, piece), begin = np.divmod(together, n_pieces), begin + low
        ok = np.concatenate([k + np.flatnonzero(self._is_near(codes, piece[k : k + 4096], begin[k : k + 4096] + margin)) for k in range(0, len(d), 4096)])
        if not len(ok):
            return
        item = np.searchsorted(self.first_piece, piece[ok], side="right") - 1
        n_items = len(self.texts)
        together, begin = np.divmod(np.unique((d[ok] * n_items + item) * span + begin[ok] - low), span)
        (d, item), begin = np.divmod(together, n_items), begin + low
        for k in range(0, len(d), 4096):
            part = slice(k, k + 4096)
            ok = k + np.flatnonzero(self._may_hold(codes, item[part], begin[part] + margin))
            for x, y, z in zip(d[ok].tolist(), item[ok].tolist(), (begin[ok] - place[first[d[ok]]]).tolist()):
                self._verify(texts[i + x], i + x, y, z, done, out)

    def _least(self, codes: np.ndarray, piece: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
        """Least edits between each piece and any stretch that ends within ``steps`` characters from ``start``.

        Characters count as equal if their low bytes are, which only lowers the number."""
        size = self.piece_size[piece]
        bits, row, top = self.piece_bits.ravel(), piece * 256, (size - 1).astype(np.uint64)
        pv, mv, score = np.full(len(piece), ~U(0)), np.zeros(len(piece), np.uint64), size.copy()
        least = score.copy()
        for j in range(steps):
            eq = bits.take(row + codes.take(start + j))
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += (ph >> top & U(1)).view(np.int64)
            score -= (mh >> top & U(1)).view(np.int64)
            ph, mh = ph << U(1), mh << U(1)
            pv, mv = mh | ~(xv | ph), ph & xv
            np.minimum(least, score, out=least)
        return least

    def _is_near(self, codes: np.ndarray, piece: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether the piece about an agreeing window stands near its place, at up to four deviations above the rate of edits."""
        size = self.piece_size[piece]
        drift = PIECE // 6
        rate = 1 / ONE_IN
        most = rate * size + 4 * np.sqrt(rate * (1 - rate) * size)
        return self._least(codes, piece, begin + self.piece_at[piece] - drift, int(size.max()) + 2 * drift) <= most

    def _may_hold(self, codes: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether the least distances of an item's pieces, each near its place after ``begin``, add up to what the item may have.

        A piece may end in a neighbour, which only lowers the sum."""
        total, limit = np.zeros(len(item), np.int64), self.limits[item]
        live, step = np.arange(len(item)), 0
        while len(live):
            live = live[self.first_piece[item[live]] + step < self.first_piece[item[live] + 1]]
            if not len(live):
                break
            piece, near = self.first_piece[item[live]] + step, limit[live]
            steps = int((self.piece_size[piece] + 2 * near).max())
            total[live] += self._least(codes, piece, begin[live] + self.piece_at[piece] - near, steps)
            live, step = live[total[live] <= near], step + 1
        return total <= limit

    def _verify(self, text: str, d: int, item: int, begin: int, done: dict[tuple[int, int], list[int]], out: list[list]) -> None:
        """Adds the item to what text ``d`` holds if a stretch about ``begin`` is within the edits allowed."""
        own = done.setdefault((d, item), [])
        if any(f[0] == item for f in out[d]):
            return
        pattern = self.texts[item]
        slack, limit = len(pattern) // 4 + 4, edits_allowed(len(pattern))
        if any(abs(begin - x) <= slack - limit for x in own):
            return
        own.append(begin)
        low = max(0, begin - slack)
        stretch = text[low : max(0, begin + len(pattern) + slack)]
        edits, end = best_distance(pattern, stretch, limit)
        if edits <= limit:
            out[d].append((item, edits, max(0, low + end - len(pattern)), low + end))

    def _maps(self, r: int) -> dict[int, np.ndarray]:
        cache = self.__dict__.setdefault("_unpacked", {})
        if r not in cache:
            cache[r] = {j: np.unpackbits(x).astype(bool) for j, x in self.maps[r].items()}
        return cache[r]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_unpacked"}


def benchmark_parts(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Benchmark]:
    """Tables of the items, in parts whose texts are at most about PART_BYTES."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first().b
    parts = max(1, math.ceil(total / PART_BYTES))
    for k in range(parts):
        part = items.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k)
        if b := Benchmark.build([(r.i, r.t) for r in part.orderBy("i", "t").collect()]):
            yield b


LEAK = "doc_id long, item_id long, edits long, start long, end long"


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, edits, start, end): items of which a document holds a copy within a fifth of edits.

    start and end are characters of the document in normal form; an item's ids are each a row."""
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], LEAK)
    for b in benchmark_parts(items):

        def run(batches: Iterator[pa.RecordBatch], b: Benchmark = b) -> Iterator[pa.RecordBatch]:
            for batch in (s for b_ in batches for s in slices(b_, 1)):
                ids = batch.column(0).to_pylist()
                hits = b.search([normal(x) for x in batch.column(1).to_pylist()])
                rows = [(ids[k], i, *rest) for k, own in enumerate(hits) for item, *rest in own for i in b.shared[item]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "item_id", "edits", "start", "end"])

        found = found.unionByName(rows.mapInArrow(tidy(run), LEAK))
    return found


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any leak, with their columns as they are: decided in place, without a join.

    What one part of a large benchmark leaves is written before the next is matched, so that their tables don't stand side by side."""
    small_batches(docs)
    for k, b in enumerate(benchmark_parts(items)):
        if k:
            docs = checkpoint(docs)

        def run(batches: Iterator[pa.RecordBatch], b: Benchmark = b) -> Iterator[pa.RecordBatch]:
            for batch in (s for b_ in batches for s in slices(b_, text)):
                hits = b.search([normal(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
