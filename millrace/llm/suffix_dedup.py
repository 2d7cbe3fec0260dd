"""Removal of repeated byte strings by blockwise suffix sorting over a difference cover.

The cover sample: of every 13 positions of a text the four of a difference cover, so that any two suffixes meet two
sampled ones after the same shift of under 13 bytes. First the sampled suffixes are sorted, one bucket of leading
fingerprint bits at a time, to a depth of 38 bytes; the rank found for a sampled suffix is whether it ties with
another document's. Two suffixes that share 50 bytes share 38 from the sampled pair within their first 13, so a
suffix whose sampled neighbours all have ranks of their own is settled without a comparison. Only the others, the
long ties, go on: their 50-byte keys are sorted, again one bucket at a time, in order of documents, which tells
which suffixes repeat an earlier document's. Memory is bounded by a block of texts and by a bucket of keys.

Whole copies are settled before: a text that a smaller id has too is all repeats, and what it could give to others
its original gives. They are found by digests, so texts are moved once, to their block.

Keys are 64-bit fingerprints of the bytes (the sample's are shorter, and only prune), so order inside a bucket is
that of fingerprints, not of bytes; equality, which is all that removal needs, is the same.

Cases: null texts are empty; texts of under 50 bytes lose nothing; rows without an id are compared with nothing;
rows that share an id are not earlier than each other; a cut may fall inside a UTF-8 character, so what is kept is
bytes. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import blocks
from millrace.llm.blocks import U, Texts
from millrace.llm.slices import tidy_pair

LENGTH = 50
#: A difference cover modulo 13.
PERIOD, COVER = 13, np.array([0, 1, 3, 9])
#: Low bits left out of the sample's keys: they only prune.
SAMPLE_DROP = 24
#: Notes of a block to itself: runs of suffixes that are not settled, and ids, then heads of digests, of whole copies.
LIVE, COPIES = 1, 2


def _rolled(texts: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per batch: offset in the block, first and last position of each document in the batch, prefix sums and powers."""
    base = 0
    for i, j in texts.batches():
        buf = np.frombuffer(b"".join(texts.data[i:j]), np.uint8)
        end = np.cumsum([len(d) for d in texts.data[i:j]])
        sums, up = blocks.prefix_sums(blocks.BYTE_VALUE[buf])
        yield base, np.append(0, end[:-1]), end, sums, up
        base += len(buf)


def _keys(sums: np.ndarray, up: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return blocks.finish((sums[at + length] - sums[at]) * up[at])


def sample(texts: Texts, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions in the block of all sampled suffixes of at least ``depth`` bytes."""
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, first, end, sums, up in _rolled(texts):
        lengths = np.maximum(end - first - depth + 1, 0)
        periods = -(-lengths // PERIOD)
        step = np.arange(int(periods.sum())) - np.repeat(np.cumsum(periods) - periods, periods)
        at = ((np.repeat(first, periods) + PERIOD * step)[:, None] + COVER).ravel()
        at = at[at < np.repeat(first + lengths, len(COVER) * periods)]
        keys.append(_keys(sums, up, at, depth) >> U(SAMPLE_DROP))
        places.append(at + base)
    return np.concatenate(keys), np.concatenate(places)


def suffix_keys(texts: Texts, live: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of those of the (sorted) positions where ``length`` bytes of a document follow."""
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, _, end, sums, up in _rolled(texts):
        a, b = np.searchsorted(live, (base, base + len(sums) - 1))
        at = live[a:b] - base
        at = at[at + length <= end[np.searchsorted(end, at, side="right")]] if len(at) else at
        keys.append(_keys(sums, up, at, length))
        places.append(at + base)
    return np.concatenate(keys), np.concatenate(places)


def _groups(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys; in it the distinct keys, group of each, and lowest and highest owner of each group."""
    order = np.argsort(keys)
    ordered = keys[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
    low = np.minimum.reduceat(owners[order], start) if len(keys) else start
    high = np.maximum.reduceat(owners[order], start) if len(keys) else start
    return order, ordered[start], group, low, high


def _owners(texts: Texts, places: np.ndarray) -> np.ndarray:
    """Rank of the document at each position of the block."""
    return texts.rank[np.searchsorted(np.cumsum([len(d) for d in texts.data]), places, side="right")]


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", block_bytes: int = 4 << 20, in_place: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``in_place`` the documents come back instead, all columns as they are but the text (its broken characters
    dropped) and n_chars. A document that consists of repeats stays, with an empty text.

    A byte goes if a string of ``length`` bytes covers it that also starts in a document of a smaller id."""
    depth = length - PERIOD + 1
    dealt = blocks.plan(docs, text, key, block_bytes, 0.31, 1 << 20)
    carry = docs.columns if in_place else []
    rows, bits = blocks.deal(docs, dealt, text, key, [c for c in carry if c not in (text, "n_chars")]), dealt.bits

    def blanked(texts: Texts, copies: bytes) -> Texts:
        """Without the texts of whole copies."""
        n = len(copies) // 16
        gone = set(zip(np.frombuffer(copies, np.int64, n).tolist(), (copies[k : k + 8] for k in range(8 * n, 16 * n, 8))))
        ids = {i for i, _ in gone}
        return replace(texts, data=[b"" if i in ids and (i, sha256(d).digest()[:8]) in gone else d for i, d in zip(texts.ids, texts.data)])

    def send_sample(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left.column("block")[0].as_py() < 0:
            return blocks.to_table([])
        copies = right.column("doc_id").to_numpy().astype(np.int64).tobytes() + b"".join(right.column("head").to_pylist())
        texts = blanked(Texts.of(left), copies)
        note = (texts.block, texts.block % (1 << bits), 0, COPIES, copies)
        return blocks.to_table([note, *blocks.cells(texts.block, blocks.distinct(sample(texts, depth)[0]) << U(SAMPLE_DROP), bits, SAMPLE_DROP)])

    def tied(asked: list[tuple[np.ndarray, bytes]]) -> list[np.ndarray]:
        """Which sampled keys another block has too."""
        keys = np.concatenate([k for k, _ in asked])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        out = np.zeros(len(keys), bool)
        out[order] = np.append(same, False) | np.append(False, same)
        return np.split(out, np.cumsum([len(k) for k, _ in asked])[:-1])

    def send_suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left.column("block")[0].as_py() < 0:
            return blocks.to_table([])
        bit, notes = blocks.replies(right)
        texts = blanked(Texts.of(left), notes[COPIES])
        keys, places = sample(texts, depth)
        order, _, group, low, high = _groups(keys, _owners(texts, places))
        ties = np.zeros(len(keys), bool)
        ties[order] = ((low != high) | bit)[group]
        at = places[ties]
        first = np.maximum(at - PERIOD + 1, np.append(0, at[:-1] + 1)) if len(at) else at
        live = blocks.ranges(first, at + 1 - first)
        edges = np.flatnonzero(np.append(True, np.diff(live) != 1)) if len(live) else live
        runs = np.concatenate([live[edges], np.diff(np.append(edges, len(live)))]).astype(np.uint32)
        own = [(texts.block, texts.block % (1 << bits), 0, kind, data) for kind, data in ((LIVE, runs.tobytes()), (COPIES, notes[COPIES]))]
        return blocks.to_table([*own, *blocks.cells(texts.block, blocks.distinct(suffix_keys(texts, live, length)[0]), bits)])

    def earlier(asked: list[tuple[np.ndarray, bytes]]) -> list[np.ndarray]:
        """Which keys an earlier block has."""
        keys = np.concatenate([k for k, _ in asked])
        order = np.argsort(keys, kind="stable")
        out = np.zeros(len(keys), bool)
        out[order] = np.append(False, keys[order][1:] == keys[order][:-1])
        return np.split(out, np.cumsum([len(k) for k, _ in asked])[:-1])

    schema = docs.schema if in_place else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return blocks.to_table([], arrow) if not in_place else pa.table({c: pa.array([]) for c in carry})
        whole = Texts.of(left)
        bit, notes = blocks.replies(right)
        texts = blanked(whole, notes.get(COPIES, b""))
        runs = np.frombuffer(notes[LIVE], np.uint32).astype(np.int64).reshape(2, -1) if notes else np.zeros((2, 0), np.int64)
        keys, places = suffix_keys(texts, blocks.ranges(runs[0], runs[1]), length)
        owners = _owners(texts, places)
        order, _, group, low, _ = _groups(keys, owners)
        gone = np.zeros(len(keys), bool)
        gone[order] = (bit[group] if len(bit) else np.zeros(len(group), bool)) | (owners[order] > low[group])
        at = places[gone]
        ends = np.cumsum([len(d) for d in texts.data])
        cuts = np.searchsorted(at, np.append(0, ends))
        out = []
        for k, data in enumerate(whole.data):
            own = at[cuts[k] : cuts[k + 1]] - (ends[k] - len(texts.data[k]))
            kept, spans = data, 0
            if len(data) >= length and not texts.data[k]:
                kept, spans = b"", 1
            elif len(own):
                new = np.flatnonzero(np.append(True, np.diff(own) > length))
                starts, stops = own[new], own[np.append(new[1:] - 1, len(own) - 1)] + length
                spans = len(new)
                kept = b"".join([data[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(data)])])
            out.append((texts.ids[k], len(data), len(data) - len(kept), spans, sha256(kept).hexdigest()))
            if in_place:
                whole.data[k] = kept
        if not in_place:
            return blocks.to_table(out, arrow)
        kept_texts = [d.decode(errors="ignore") for d in whole.data]
        own = {text: pa.array(kept_texts, pa.string()), "n_chars": pa.array([len(t) for t in kept_texts], pa.int64())}
        rest = iter(whole.carried)
        return pa.table({c: own[c] if c in own else next(rest) for c in carry})

    copies = blocks.later_copies(docs, dealt, text, key)
    ranks = blocks.exchange(rows.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(tidy_pair(send_sample), blocks.CELL), tied)
    repeats = blocks.exchange(rows.groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(tidy_pair(send_suffixes), blocks.CELL), earlier)
    return rows.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(tidy_pair(cut), schema)
