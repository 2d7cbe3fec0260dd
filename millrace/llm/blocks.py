"""Exchange of window fingerprints between blocks of documents.

Documents are dealt to blocks by ranges of their id, so "a smaller id" is "an earlier block" or decided inside one
block. A block sends each distinct fingerprint of its windows once, in sorted, delta-coded cells by leading bits
(buckets), and gets one bit back for each. So a text that fills a third of all rows costs its bucket no more than
one entry a block, nothing is collected, and a bucket's task holds a bounded number of fingerprints: the number of
buckets follows the input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.slices import small_batches, tidy_group

U = np.uint64
BATCH_BYTES = 1 << 17
#: Parts of a group of copies when their digests are joined.
SALTS = 64
#: Odd multiplier, 3 modulo 8, of the rolling fingerprints, and the finisher's; fixed so that runs agree.
BASE, FINISH = 0x9E3779B97F4A7C1B, 0xD6E8FEB86659FD93
_random = np.random.default_rng(20)
BYTE_VALUE = _random.integers(1, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        step = U(pow(base, k, 2**64))
        out[k : 2 * k] = out[: min(k, n - k)] * step
        k *= 2
    return out


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.n = base, 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * BATCH_BYTES)
            self.up, self.down = _powers(self.base, self.n), _powers(pow(self.base, -1, 2**64), self.n)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> U(32)
    x *= U(FINISH)
    x ^= x >> U(32)
    return x


def prefix_sums(values: np.ndarray, powers: Powers = POWERS) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values over falling powers (one more than values), and the powers that lift them back."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[:-1], out=sums[1:])
    return sums, up


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return np.zeros(0, np.int64)
    out = np.ones(int(lengths.sum()), np.int64)
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    s = np.sort(values)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def starts(ordered: np.ndarray) -> np.ndarray:
    """Places where another value begins in an array whose equal values stand together."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def stable_order(values: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes whose ``free`` low bits are zero, sorted, and their places before, equal ones in order: what a stable argsort gives.

    Places ride in the low bits through plain sorts, which are several times faster. Parts by the eight leading bits,
    which then needn't be kept, are sorted one by one. Where places don't fit, it is a stable argsort."""
    room = max(0, len(values) - 1).bit_length()
    if room > free + 8 or room > 63:
        order = np.argsort(values, kind="stable")
        return values[order], order
    lead = (values >> U(56)).astype(np.uint8)
    dealt = np.argsort(lead, kind="stable")
    packed = (values[dealt] << U(8)) | np.arange(len(values), dtype=U)
    ends = np.cumsum(np.bincount(lead, minlength=256)).tolist()
    for a, b in zip([0, *ends], ends):
        packed[a:b].sort()
    order = dealt[(packed & U((1 << room) - 1)).view(np.int64)]
    return values[order], order


@dataclass
class Plan:
    """How documents are dealt: range bounds of ids, bytes in all, leading bits that choose a bucket."""

    bounds: np.ndarray
    bits: int


def plan(docs: DataFrame, text: str, key: str, block_bytes: int, items_per_byte: float, bucket_items: int = 1 << 21) -> Plan:
    """One pass of counts; to the driver come one bound for each ``block_bytes`` of text."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    total = docs.agg(F.sum(size).alias("b"), F.count("*").alias("n")).first()
    n = max(1, math.ceil((total.b or 0) / block_bytes))
    bounds: list[int] = []
    if n > 1:
        fractions = [float(k) / n for k in range(1, n)]
        bounds = sorted(set(docs.agg(F.percentile_approx(F.col(key).cast("long"), fractions, max(10_000, 20 * n)).alias("q")).first().q or []))
    return Plan(np.array(bounds, np.int64), max(5, math.ceil(math.log2(max(1.0, (total.b or 0) * items_per_byte / bucket_items)))))


def block_number(dealt: Plan):
    """Column function: block of an id; rows without an id go to negative blocks."""
    bounds = dealt.bounds
    spread = len(bounds) + 1

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        missing = ids.isna()
        found = np.searchsorted(bounds, ids.fillna(0).astype("int64").to_numpy(), side="right").astype("int32")
        return pd.Series(np.where(missing, -1 - np.arange(len(ids)) % spread, found)).astype("int32")

    return block_of


def later_copies(docs: DataFrame, dealt: Plan, text: str, key: str) -> DataFrame:
    """(block, doc_id, head of the text's SHA-256) of rows whose whole text a document of a smaller id has: digests are grouped, texts stay where they are.

    The head tells rows that share an id apart."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("salt"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("digest")).filter("doc_id IS NOT NULL")
    first = d.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("digest", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return d.join(first, ["digest", "salt"]).filter("doc_id > low").select(block_number(dealt)("doc_id").alias("block"), "doc_id", F.unhex(F.substring("digest", 1, 16)).alias("head")).distinct()


def deal(docs: DataFrame, dealt: Plan, text: str, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """(block int, doc_id long, text string), and the columns to carry as carry_0, carry_1, ... Rows without an id go to negative blocks: they are compared with nothing."""
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)))
    return rows.select(block_number(dealt)("doc_id").alias("block"), "*")


CELL = "block int, bucket int, n int, kind int, data binary"
CELL_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def huffman(data: bytes) -> bytes:
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(data) + coder.flush()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as the byte planes of their differences: the lengths of eight planes, then the planes.

    Planes of zeros are left out; the two highest others hold few bits each and are Huffman-coded if that is shorter."""
    planes = np.diff(values, prepend=U(0)).view(np.uint8).reshape(-1, 8).T
    used = [k for k in range(8) if planes[k].any()]
    parts = [b""] * 8
    for k in used:
        parts[k] = planes[k].tobytes()
        if k in used[-2:]:
            parts[k] = min(parts[k], huffman(parts[k]), key=len)
    return np.array([len(x) for x in parts], "<u4").tobytes() + b"".join(parts)


def pack_runs(values: np.ndarray, cuts: list[int]) -> Iterator[tuple[tuple[int, int, int], bytes]]:
    """((k, a, b), ``pack_sorted`` of values[a:b]) of each run between cuts k and k + 1 that isn't empty; the planes are made for all runs at once."""
    runs = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    if not runs:
        return
    first = np.array([a for _, a, _ in runs])
    steps = np.diff(values, prepend=U(0))
    steps[first] = values[first]
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    used = np.array([np.maximum.reduceat(p, first) > 0 if p.any() else np.zeros(len(first), bool) for p in planes])
    for (k, a, b), in_use in zip(runs, used.T):
        at = np.flatnonzero(in_use).tolist()
        parts = [b""] * 8
        for p in at:
            parts[p] = planes[p, a:b].tobytes()
        for p in at[-2:]:
            parts[p] = min(parts[p], huffman(parts[p]), key=len)
        yield (k, a, b), np.array([len(x) for x in parts], "<u4").tobytes() + b"".join(parts)


def unpack_sorted(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """The values, and what follows them in the data."""
    sizes = np.frombuffer(data, "<u4", 8).tolist()
    planes, at = np.zeros((n, 8), np.uint8), 32
    for k, size in enumerate(sizes):
        if size:
            part = data[at : at + size]
            planes[:, k] = np.frombuffer(part if size == n else zlib.decompress(part, -15), np.uint8)
            at += size
    return np.cumsum(planes.view(np.uint64).ravel()), data[at:]


def cells(block: int, values: np.ndarray, bits: int, drop: int = 0, extra: np.ndarray | None = None) -> list[tuple]:
    """Cells of a block's sorted distinct fingerprints; the bucket's bits, and ``drop`` low ones, stay out of the data."""
    cuts = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)).tolist() + [len(values)]
    body = (values << U(bits)) >> U(bits + drop)
    return [(block, k, b - a, 0, pack_sorted(body[a:b]) + (extra[a:b].tobytes() if extra is not None else b"")) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def to_table(rows: list[tuple], schema: pa.Schema = CELL_ARROW) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def exchange(sent: DataFrame, decide: Callable[[list[tuple[np.ndarray, bytes]]], list[np.ndarray]]) -> DataFrame:
    """Replies to cells: per bucket, ``decide`` gets (fingerprints, rest of the data) of each block in order and returns a bit for each fingerprint.

    Cells of another kind than 0 are a block's notes to itself and come back as they are."""

    def answer(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in CELL_ARROW.names)), key=lambda r: r[0])
        notes, ask = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        bits = decide([unpack_sorted(r[4], r[2]) for r in ask]) if ask else []
        return to_table(notes + [(r[0], r[1], r[2], 0, np.packbits(b).tobytes()) for r, b in zip(ask, bits)])

    return sent.groupBy("bucket").applyInArrow(tidy_group(answer), CELL)


def replies(t: pa.Table) -> tuple[np.ndarray, dict[int, bytes]]:
    """A block's bits in the order of its sorted fingerprints, and its notes by kind."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("kind", "bucket", "n", "data"))), key=lambda r: r[:2])
    bits = [np.unpackbits(np.frombuffer(d, np.uint8), count=n) for k, _, n, d in rows if not k]
    return (np.concatenate(bits) if bits else np.zeros(0, np.uint8)).astype(bool), {k: d for k, _, _, d in rows if k}


@dataclass
class Texts:
    """A block's documents in order of id: bytes, id, and rank of the id (equal ids share it)."""

    ids: list
    data: list[bytes]
    rank: np.ndarray
    block: int
    #: Carried columns, in the same order.
    carried: list[pa.ChunkedArray]

    @staticmethod
    def of(t: pa.Table) -> Texts:
        ids, data = t.column("doc_id").to_pylist(), t.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, data[i]))
        ids, data = [ids[i] for i in order], [data[i] for i in order]
        ranks = np.cumsum([0] + [a != b for a, b in zip(ids, ids[1:])]) if ids else np.zeros(0, np.int64)
        carried = [t.column(c).take(pa.array(order, pa.int64())) for c in t.column_names if c.startswith("carry_")]
        return Texts(ids, data, ranks, t.column("block")[0].as_py(), carried)

    def batches(self) -> Iterator[tuple[int, int]]:
        """Runs [i, j) of documents of about BATCH_BYTES, so that arrays stay in the processor's caches."""
        i = size = 0
        for j, d in enumerate(self.data):
            if size and size + len(d) > BATCH_BYTES:
                yield i, j
                i, size = j, 0
            size += len(d)
        if i < len(self.data):
            yield i, len(self.data)
