"""Substring dedup over windows of words, with a log-structured fingerprint index.

A window is 20 consecutive words. The index keeps fingerprints of all windows seen so far in sorted immutable
runs. A new batch (a sorted run of a block of documents) is merge-joined with each run, hits are verified by an
independent check value of 32 bits (96 bits in all), and the batch becomes a run; runs of similar size are compacted
into one, so there are at most log n of them. Batches go in order of document ids, so a hit is an earlier window.
The index is sharded by leading bits of the fingerprint; :class:`RunIndex` is one shard while a batch is ingested.

:class:`WindowIndex` keeps an index in a folder between crawls: a run is a Parquet table of packed cells, written once; a
manifest says which runs are live, and a version of it is added when a run is written or runs are compacted. A later
crawl is deduplicated against all that came before, and adds the windows that are new. Runs that no version of interest
names can be deleted by whoever owns the folder. One writer at a time.

Cases: null and empty texts have no words; fewer words than a window lose nothing; rows without an id are compared
with nothing and keep their text; rows that share an id come in order of their text, and are one document's
windows in that order; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.blocks import U, Texts
from millrace.llm.durable import checkpoint
from millrace.llm.slices import tidy, tidy_group, tidy_pair

WORDS = 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A second rolling base, for check values.
CHECK_POWERS = blocks.Powers(0xA24BAED4963EE403)


class RunIndex:
    """Sorted immutable runs of (fingerprint, check value); the newest and smallest last."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.runs = runs or []

    def probe(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Which of the sorted keys some run holds with the same check value."""
        hit = np.zeros(len(keys), bool)
        for k, c in self.runs:
            at = np.searchsorted(k, keys)
            at[at == len(k)] = 0
            hit |= (k[at] == keys) & (c[at] == checks)
        return hit

    def append(self, keys: np.ndarray, checks: np.ndarray) -> None:
        """Adds a run and compacts while the last run is no less than half of the one before."""
        if len(keys):
            self.runs.append((keys, checks))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) >= len(self.runs[-2][0]):
            (k1, c1), (k2, c2) = self.runs[-2:]
            k, c = np.concatenate([k1, k2]), np.concatenate([c1, c2])
            order = np.argsort(k, kind="stable")
            self.runs[-2:] = [(k[order], c[order])]

    def ingest(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Probes with a sorted batch, then adds what is new in it."""
        hit = self.probe(keys, checks)
        self.append(keys[~hit], checks[~hit])
        return hit


#: Block of cells that come from stored runs, before all others; kind of a batch's new windows.
HISTORY, RUN = -(1 << 30), 9
CHECK = np.dtype("<u4")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, checks = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    return keys[order], checks[order]


class WindowIndex:
    """Windows of all crawls so far, as sorted immutable runs in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def runs(self) -> list[tuple[str, int, int]]:
        """(name, items, leading bits of its buckets) of the live runs, oldest first; the logarithm of all in number."""
        try:
            manifest = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e.getCondition()):
                return []
            raise
        last = manifest.agg(F.max("version")).first()[0]
        return [(r.run, r["items"], r.bits) for r in manifest.filter(F.col("version") == last).orderBy("place").collect() if r.run]

    def _declare(self, version: int, runs: list[tuple[str, int, int]]) -> None:
        rows = [(version, k, *r) for k, r in enumerate(runs)]
        self.spark.createDataFrame(rows, "version long, place int, run string, items long, bits int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def cells(self, bits: int, names: list[str] | None = None) -> DataFrame | None:
        """Cells of the live runs (or of those named), cut anew where they were written with fewer leading bits."""
        out = None
        for name, _, had in self.runs():
            if names is not None and name not in names:
                continue

            def cut(batches, had: int = had):
                for b in batches:
                    rows = []
                    for bucket, n, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 4))):
                        body, rest = blocks.unpack_sorted(data, n)
                        whole = body | (U(bucket) << U(64 - had)) if had else body
                        rows += blocks.cells(HISTORY, whole, bits, extra=np.frombuffer(rest, CHECK))
                    yield from blocks.to_table(rows).to_batches()

            stored = self.spark.read.parquet(f"{self.path}/{name}").select("block", "bucket", "n", "kind", "data")
            part = stored if had == bits else stored.mapInArrow(tidy(cut), blocks.CELL)
            out = part if out is None else out.unionByName(part)
        return out

    def add(self, found: DataFrame, bits: int) -> None:
        """Writes a run of cells and compacts while the last run is no less than half of the one before."""
        runs, version = self.runs(), self._version() + 1
        name = f"run-{version:08d}"
        found.write.parquet(f"{self.path}/{name}")
        runs.append((name, self.spark.read.parquet(f"{self.path}/{name}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], bits))
        self._declare(version, runs)
        while len(runs) > 1 and 2 * runs[-1][1] >= runs[-2][1]:
            version += 1
            name, items = f"run-{version:08d}", runs[-1][1] + runs[-2][1]

            def merge(t: pa.Table) -> pa.Table:
                parts = []
                for n, data in zip(t.column("n").to_pylist(), t.column("data").to_pylist()):
                    keys, rest = blocks.unpack_sorted(data, n)
                    parts.append((keys, np.frombuffer(rest, CHECK)))
                keys, checks = _merged(parts)
                return blocks.to_table([(HISTORY, t.column("bucket")[0].as_py(), len(keys), 0, blocks.pack_sorted(keys) + checks.tobytes())])

            both = self.cells(bits, [r[0] for r in runs[-2:]])
            both.groupBy("bucket").applyInArrow(tidy_group(merge), blocks.CELL).write.parquet(f"{self.path}/{name}")
            runs[-2:] = [(name, items, bits)]
            self._declare(version, runs)


def _word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def windows(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and check values of all windows of a block in order, and per document its number of words and of windows."""
    found, checks, n_words = [], [], np.zeros(len(texts.data), np.int64)
    for i, j in texts.batches():
        buf = np.frombuffer(b"\n".join(texts.data[i:j]), np.uint8)
        start, end = _word_bounds(buf)
        offset = np.cumsum([0] + [len(d) + 1 for d in texts.data[i:j]])
        n_words[i:j] = np.diff(np.searchsorted(start, offset))
        sums, up = blocks.prefix_sums(blocks.BYTE_VALUE[buf])
        word = blocks.finish((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))
        sums, up = blocks.prefix_sums(word)
        first = np.cumsum(n_words[i:j]) - n_words[i:j]
        at = blocks.ranges(first, n_words[i:j] - size + 1)
        found.append(blocks.finish((sums[at + size] - sums[at]) * up[at]))
        sums, up = blocks.prefix_sums(word ^ (word >> U(23)), CHECK_POWERS)
        checks.append((blocks.finish((sums[at + size] - sums[at]) * up[at]) >> U(32)).astype(CHECK))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *found]), np.concatenate([none.astype(CHECK), *checks]), n_words, np.maximum(n_words - size + 1, 0)


def remove_repeated_windows(docs: DataFrame, size: int = WORDS, text: str = "text", key: str = "doc_id", block_bytes: int = 6 << 20, with_text: bool = False, index: WindowIndex | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and the kept words as ``text`` if asked for.

    A word goes if a window covers it whose words also start earlier (a smaller id, or the same document), or that
    ``index`` holds; the windows of these documents are then added to it at once, before the result is read."""
    dealt = blocks.plan(docs, text, key, block_bytes, 0.16)
    rows, bits = blocks.deal(docs, dealt, text, key), dealt.bits
    if index and (had := sum(n for _, n, _ in index.runs())):
        bits = max(bits, *(b for _, _, b in index.runs()), (had >> 21).bit_length())

    def send(t: pa.Table) -> pa.Table:
        texts = Texts.of(t)
        if texts.block < 0:
            return blocks.to_table([])
        found, checks, _, _ = windows(texts, size)
        values, first = np.unique(found, return_index=True)
        return blocks.to_table(blocks.cells(texts.block, values, bits, extra=checks[first]))

    keep_new = index is not None

    def answer(t: pa.Table) -> pa.Table:
        shard, new, out = RunIndex(), [], []
        bucket = t.column("bucket")[0].as_py()
        for at in np.argsort(t.column("block").to_numpy(), kind="stable").tolist():
            block, n = t.column("block")[at].as_py(), t.column("n")[at].as_py()
            keys, rest = blocks.unpack_sorted(t.column("data")[at].as_py(), n)
            checks = np.frombuffer(rest, CHECK)
            if block == HISTORY:
                shard.append(keys, checks)
                continue
            hit = shard.ingest(keys, checks)
            out.append((block, bucket, n, 0, np.packbits(hit).tobytes()))
            if keep_new and not hit.all():
                new.append((keys[~hit], checks[~hit]))
        if new:
            keys, checks = _merged(new)
            out.append((HISTORY, bucket, len(keys), RUN, blocks.pack_sorted(keys) + checks.tobytes()))
        return blocks.to_table(out)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("text", pa.string())] * with_text)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return blocks.to_table([], arrow)
        texts = Texts.of(left)
        found, _, n_words, n_windows = windows(texts, size)
        _, first, which = np.unique(found, return_index=True, return_inverse=True)
        bit, _ = blocks.replies(right)
        seen = (bit[which] if len(bit) else np.zeros(len(which), bool)) | (first[which] != np.arange(len(which)))
        if texts.block < 0:
            seen[:] = False
        out, at = [], 0
        for k, data in enumerate(texts.data):
            w = np.flatnonzero(seen[at : at + n_windows[k]])
            at += n_windows[k]
            words = data.split()
            if len(w):
                edge = np.zeros(len(words) + 1, np.int32)
                edge += np.bincount(w, minlength=len(edge))
                edge -= np.bincount(w + size, minlength=len(edge))
                keep = np.cumsum(edge[:-1]) == 0
                words = [x for x, y in zip(words, keep.tolist()) if y]
            kept = b" ".join(words)
            out.append((texts.ids[k], int(n_words[k]), int(n_words[k]) - len(words), sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
        return blocks.to_table(out, arrow)

    sent = rows.groupBy("block").applyInArrow(tidy_group(send), blocks.CELL)
    if index and (stored := index.cells(bits)) is not None:
        sent = sent.unionByName(stored)
    answers = sent.groupBy("bucket").applyInArrow(tidy_group(answer), blocks.CELL)
    if index:
        answers = checkpoint(answers)
        index.add(answers.filter(F.col("kind") == RUN).withColumn("kind", F.lit(0)), bits)
        answers = answers.filter(F.col("kind") != RUN)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_pair(cut), schema)
