"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits are cut into five segments on a ring. If two differ in at most four bits, some segment
starts a chain whose first l segments differ in at most 4l/5 bits together, for every l: none in the first, one in
the first two, two in three, three in four. So a fingerprint is filed, for each start, under that segment and the
next one with none or one bit changed (26 bits of key); members of a bucket pass the rest of the chain condition
before the full Hamming check.

Copies of a fingerprint are collapsed first. Inside a bucket, groups of up to 32 are checked pairwise in one
vectorised step; larger ones by a search that takes every fingerprint out once it is reached, so a dense group costs
about its size, and emits a spanning forest, not all pairs. Links become components by star contraction.

Cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; rows
without an id are fingerprinted, but do not name a component; repeated rows are linked. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.durable import checkpoint, components, hot_keys, join_split
from millrace.llm.slices import small_batches, tidy

WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(len(WIDTHS)))
DISTANCE = 4
PAIRWISE = 32
U = np.uint64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the hashes of a text's word shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for k in range(0, n, 4096):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(a[k : k + 4096], b[k : k + 4096])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > n)
    return int(sum(1 << int(k) for k in bits))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _segment(x: np.ndarray, i: int) -> np.ndarray:
    return (x >> U(STARTS[i])) & U((1 << WIDTHS[i]) - 1)


def _mask(start: int, count: int) -> np.uint64:
    return U(sum(((1 << WIDTHS[i % 5]) - 1) << STARTS[i % 5] for i in range(start, start + count)))


CHAIN = [[_mask(i, c) for c in (3, 4)] for i in range(5)]


def _filed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys and fingerprints of all places where fingerprints are filed."""
    keys, members = [], []
    for i in range(5):
        nxt = (i + 1) % 5
        own, head = _segment(x, nxt), (U(i) << U(32)) | (_segment(x, i) << U(13))
        for flip in [0, *(1 << b for b in range(WIDTHS[nxt]))]:
            keys.append(head | (own ^ U(flip)))
            members.append(x)
    return np.concatenate(keys), np.concatenate(members)


def _passes(start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rest of the chain condition from the bucket's start, then the full Hamming check."""
    d = a ^ b
    chain = np.array(CHAIN, np.uint64)
    ok = np.bitwise_count(d & chain[start, 0]) <= 2
    ok[ok] = np.bitwise_count(d[ok] & chain[start[ok], 1]) <= 3
    ok[ok] = np.bitwise_count(d[ok]) <= DISTANCE
    return ok


def bucket_links(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets; ``keys`` are sorted. Pairs count where one member is filed under its own next segment."""
    start = (keys >> U(32)).astype(np.int64)
    own = np.choose((start + 1) % 5, [_segment(members, i) for i in range(5)]) == (keys & U(0x1FFF))
    edge = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    first, size = edge[:-1], np.diff(edge)
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = (size > 1) & (size <= PAIRWISE)
    if small.any():
        s, n = first[small], size[small]
        a = np.repeat(np.repeat(s, n) + _within(n), np.repeat(n, n))
        b = np.repeat(np.repeat(s, n), np.repeat(n, n)) + _within(np.repeat(n, n))
        keep = (members[a] < members[b]) & (own[a] | own[b])
        a, b = a[keep], b[keep]
        ok = _passes(start[a], members[a], members[b])
        left.append(members[a[ok]])
        right.append(members[b[ok]])
    for k in np.flatnonzero(size > PAIRWISE).tolist():
        x, mine, i = members[first[k] : edge[k + 1]], own[first[k] : edge[k + 1]], int(start[first[k]])
        for a, b in _forest(x, mine, i):
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _within(n: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, concatenated."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _forest(x: np.ndarray, own: np.ndarray, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of a large bucket: what a fingerprint reaches leaves the rest to be searched.

    Those filed under their own segment come first; the others are compared with these only."""
    rest, others = x[own], x[~own]
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue:
            block = queue.pop()
            for at in range(0, len(block), 64):
                part = block[at : at + 64]
                for which, pool in (("own", rest), ("other", others)):
                    if not len(pool):
                        continue
                    d = part[:, None] ^ pool[None, :]
                    near = np.bitwise_count(d & CHAIN[i][0]) <= 2
                    near &= np.bitwise_count(d & CHAIN[i][1]) <= 3
                    near &= np.bitwise_count(d) <= DISTANCE
                    hit = near.any(0)
                    if hit.any():
                        found = pool[hit]
                        yield part[near[:, hit].argmax(0)], found
                        if which == "own":
                            rest = rest[~hit]
                            queue.append(found)


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all those within the distance."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(x), 2048):
                keys, members = _filed(x[k : k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(members.view(np.int64))], names=["bucket", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            u, v = bucket_links(np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held]))
            pairs = np.unique(np.stack([u.view(np.int64), v.view(np.int64)]), axis=1) if len(u) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, members = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:  # the last bucket may go on in the next batch
                held.append((keys[:cut], members[:cut]))
                yield flush()
                held = []
            elif held and held[-1][0][-1] != keys[0]:
                yield flush()
                held = []
            held.append((keys[cut:], members[cut:]))
        if held:
            yield flush()

    filed = fps.select("fp").mapInArrow(tidy(file), "bucket long, fp long")
    return filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(link), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest id that links reach)."""
    each = checkpoint(fingerprints(docs, text, key, shingle, seed))
    fps = checkpoint(each.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(fps))
    placed = checkpoint(fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = join_split(placed, lowest, "root", "fp", hot_keys(placed, "root")).select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
