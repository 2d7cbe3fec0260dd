"""LM scoring by masked pseudo-likelihood: a bidirectional window network in numpy, with the corpus as its evidence.

Every word is predicted from the two words on each side. The network maps the four neighbours' embeddings through a
hidden layer to a two-step softmax over words: first one of 65 classes, then a word of the class. Its vocabulary is the
``VOCABULARY`` most frequent words, counted exactly over all documents; every other word is one of 64 kinds by its ending
and length, shared evenly among the kind's distinct words. Training is one pass over all documents: each task masks a
quarter of the positions of all of its texts and takes minibatch steps on them; the tasks' weights are averaged by the
positions trained on (sums of chunks in groups of tasks, so only ``GROUPS`` partial sums come to the driver).

The network is the prior. The evidence is the whole corpus: how often each window (left word, word, right word) and each
pair of neighbours stands in *other* documents, p = (windows + PRIOR * network) / (pairs + PRIOR). These counts grow with
the input. They are exchanged by blocks: a block of texts sends each distinct fingerprint once with its count, a bucket
adds up and replies; the width of fingerprints follows the number of windows, so that about 2**-14 of them collide at any
size. A document's own windows are left out, so a text that occurs once is judged by what others write, and one that
occurs twice is known.

Cases: null and empty texts, and texts without words, have no tokens, a sum of 0 and a null mean; an empty corpus gives
the untrained network; ends of a text are a word of their own; repeated rows count each time, and each other; rows
without an id are scored like any other. Rows that are the same in id and text are dealt to one block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import blocks
from millrace.llm.blocks import U
from millrace.llm.durable import checkpoint
from millrace.llm.slices import slices, small_batches, tidy, tidy_group, tidy_pair
from millrace.llm.window_dedup import _word_bounds

VOCABULARY, KINDS, SLOTS = 4096, 64, 64
CLASSES = VOCABULARY // SLOTS + 1
EDGE = VOCABULARY + KINDS
EMBED, HIDDEN, BATCH, RATE, MASKED, SEED = 16, 32, 2048, 0.1, 0.25, 4
PRIOR = 2.0
CHUNKS, GROUPS = 16, 16
#: Rows that the network judges at once, so that arrays stay in the processor's caches.
ROWS = 4096
BLOCK_BYTES, SPARE_BITS = 3 << 20, 14
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fixed words of the hashes: the end of a text, and what tells pairs from windows.
END_HASH, PAIR = U(0x5BD1E9955BD1E995), U(0xC2B2AE3D27D4EB4F)


def words(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and kind of each word of texts in order (A-Z lower-cased), and the number of words of each text."""
    at = np.cumsum([0] + [len(d) for d in data]) // blocks.BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at[:-1])) + 1).tolist(), len(data)]
    return tuple(np.concatenate(x) for x in zip(*(_words_of(data[a:b]) for a, b in zip(cuts, cuts[1:]))))


def _words_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words`` of texts of about BATCH_BYTES, so that arrays stay in the processor's caches."""
    data = [d.translate(LOWER) for d in data]
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    start, end = _word_bounds(buf)
    offset = np.cumsum([0] + [len(d) + 1 for d in data])
    sums, up = blocks.prefix_sums(blocks.BYTE_VALUE[buf])
    hashed = blocks.finish((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))
    back = np.maximum(end - 3, start)
    tail = blocks.finish((sums[end] - sums[back]) * up[back] + np.minimum(end - start, 9).astype(np.uint64))
    return hashed, (tail % U(KINDS)).astype(np.int64), np.diff(np.searchsorted(start, offset))


def around(values: np.ndarray, n_words: np.ndarray, edge, reach: int = 2) -> list[np.ndarray]:
    """Values 2 and 1 to the left and 1 and 2 to the right of each word (as many as ``reach``); ``edge`` beyond a text's ends."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    out = []
    for shift in [*range(-reach, 0), *range(1, reach + 1)]:
        at = np.arange(len(values)) + shift
        inside = (at >= 0) & (at < len(values))
        at = np.clip(at, 0, max(0, len(values) - 1))
        inside &= doc[at] == doc if len(values) else inside
        out.append(np.where(inside, values[at], edge) if len(values) else values)
    return out


@dataclass
class Vocabulary:
    """Sorted hashes of the words kept and their numbers (0 the most frequent), and distinct other words of each kind."""

    hashes: np.ndarray
    numbers: np.ndarray
    types: np.ndarray

    def numbered(self, hashed: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return VOCABULARY + kind
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, self.numbers[at], VOCABULARY + kind)


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Exact counts of all words; to the driver come the VOCABULARY most frequent and KINDS numbers of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for b in batches for s in slices(b, 0, 4 << 20)):
            hashed, kind, _ = words([x or b"" for x in part.column(0).cast(pa.binary()).to_pylist()])
            order = np.argsort(hashed)  # not stable: any place of a word has its kind
            own = hashed[order]
            first = blocks.starts(own)
            yield pa.RecordBatch.from_arrays([pa.array(own[first].view(np.int64)), pa.array(kind[order[first]].astype(np.int32)), pa.array(np.diff(np.append(first, len(own))))], names=["word", "kind", "n"])

    counts = small_batches(docs).select(F.col(text).cast("string")).mapInArrow(tidy(run), "word long, kind int, n long").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))
    counts = checkpoint(counts)
    # only words of the powers of two that the vocabulary reaches are sorted
    powers, least = {r.power: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()}, 1
    for power in sorted(powers, reverse=True):
        if sum(n for p, n in powers.items() if p >= power) >= VOCABULARY:
            least = 1 << power
            break
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    own = top.column("word").to_numpy().view(np.uint64)
    types = np.zeros(KINDS)
    for r in counts.groupBy("kind").count().collect():
        types[r["kind"]] = r["count"]
    types -= np.bincount(top.column("kind").to_numpy(), minlength=KINDS)
    order = np.argsort(own)
    return Vocabulary(own[order], order.astype(np.int64), np.maximum(1, types))


class WindowNetwork:
    """Weights as float32 arrays; ``flat`` joins them for averaging."""

    SHAPES = {"embed": (EDGE + 1, EMBED), "hidden": (4 * EMBED + 1, HIDDEN), "classes": (HIDDEN + 1, CLASSES), "inside": (CLASSES, HIDDEN + 1, SLOTS)}

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        for name, shape in self.SHAPES.items():
            setattr(self, name, (rng.standard_normal(shape) * (0.3 if name == "hidden" else 0.1)).astype(np.float32))
        self.seen = {name: np.full(shape, 0.01, np.float32) for name, shape in self.SHAPES.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.SHAPES])

    def load(self, flat: np.ndarray) -> WindowNetwork:
        at = 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return self

    @staticmethod
    def _softmax(z: np.ndarray, bounded: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """exp(z) over a row's largest (or as it is, if z is known to be bounded), and the rows' sums; z is overwritten."""
        if not bounded:
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], z.dtype)

    def _bounded(self) -> tuple[bool, bool]:
        """Whether the outputs' weights are so small that no exponential can overflow (hidden values lie within 1)."""
        return bool(np.abs(self.classes).sum(0).max() < 60), bool(np.abs(self.inside).sum(1).max() < 60)

    @staticmethod
    def _by_class(word: np.ndarray) -> np.ndarray:
        """Order of words by class, those of a class as they were."""
        return np.argsort((word // SLOTS).astype(np.min_scalar_type(CLASSES)), kind="stable")

    @staticmethod
    def _runs(cls: np.ndarray) -> list[tuple[int, int, int]]:
        """(class, first row, end) of rows in order of class."""
        first = blocks.starts(cls)
        return list(zip(cls[first].tolist(), first.tolist(), [*first[1:].tolist(), len(cls)]))

    def log_probability(self, context: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        """log p(word | two words at each side); words are numbers."""
        out = np.zeros(len(word))
        flat, deep = self._bounded()
        # what each word adds to the hidden layer from each place, so that a row is a sum of four
        added = [self.embed @ self.hidden[k * EMBED : (k + 1) * EMBED] for k in range(4)]
        order = self._by_class(word)
        for at in range(0, len(word), ROWS):
            part = order[at : at + ROWS]
            h = np.ones((len(part), HIDDEN + 1), np.float32)
            total = np.repeat(self.hidden[-1:], len(part), 0)
            for c, table in zip(context, added):
                total += table.take(c.take(part), 0)
            np.tanh(total, out=h[:, :-1])
            cls, slot = np.divmod(word.take(part), SLOTS)
            e, total = self._softmax(h @ self.classes, flat)
            own = e[np.arange(len(cls)), cls] / total
            z = np.empty((len(part), SLOTS), np.float32)
            for c, a, b in self._runs(cls):
                np.matmul(h[a:b], self.inside[c], out=z[a:b])
            e, total = self._softmax(z, deep)
            own *= e[np.arange(len(cls)), slot] / total
            out[part] = np.log(np.maximum(own, 1e-37))
        return out

    def step(self, context: list[np.ndarray], word: np.ndarray) -> float:
        """One step of AdaGrad on a minibatch; returns the mean loss before it."""
        n, order = np.float32(len(word)), self._by_class(word)
        context, word = np.stack(context, 1)[order], word[order]
        x = np.ones((len(word), 4 * EMBED + 1), np.float32)
        x[:, :-1] = self.embed.take(context.ravel(), 0).reshape(len(word), -1)
        h = np.ones((len(word), HIDDEN + 1), np.float32)
        np.tanh(x @ self.hidden, out=h[:, :-1])
        row, (cls, slot) = np.arange(len(word)), np.divmod(word, SLOTS)
        runs = self._runs(cls)
        flat, total = self._softmax(h @ self.classes)
        flat /= total[:, None]
        deep = np.empty((len(word), SLOTS), np.float32)
        for c, a, b in runs:
            np.matmul(h[a:b], self.inside[c], out=deep[a:b])
        deep, total = self._softmax(deep)
        deep /= total[:, None]
        loss = -float(np.log(np.maximum(flat[row, cls], 1e-37)).sum() + np.log(np.maximum(deep[row, slot], 1e-37)).sum())
        flat[row, cls] -= 1
        deep[row, slot] -= 1
        inside = np.zeros_like(self.inside)  # of classes that don't occur it stays zero, which changes nothing
        back = np.empty_like(h)
        for c, a, b in runs:
            np.matmul(h[a:b].T, deep[a:b], out=inside[c])
            np.matmul(deep[a:b], self.inside[c].T, out=back[a:b])
        back += flat @ self.classes.T
        dh = back[:, :-1] * (1 - h[:, :-1] ** 2)
        dx = (dh @ self.hidden[:-1].T).reshape(-1, EMBED)
        order = np.argsort(context.ravel().astype(np.min_scalar_type(EDGE)), kind="stable")
        near = context.ravel()[order]
        first = blocks.starts(near)
        for name, rows, g in [("classes", slice(None), h.T @ flat), ("hidden", slice(None), x.T @ dh), ("embed", near[first], np.add.reduceat(dx.take(order, 0), first, 0)), ("inside", slice(None), inside)]:
            g /= n
            self.seen[name][rows] += g * g
            g *= RATE
            g /= np.sqrt(self.seen[name][rows])
            getattr(self, name)[rows] -= g
        return loss / float(n)

    def train_on(self, numbers: np.ndarray, n_words: np.ndarray) -> int:
        """Steps on a quarter of the positions of texts, drawn at random; returns how many."""
        rng = np.random.default_rng([SEED, len(numbers)])
        masked = rng.permutation(np.flatnonzero(rng.random(len(numbers)) < MASKED))
        context = around(numbers, n_words, EDGE)
        for at in range(0, len(masked), BATCH):
            part = masked[at : at + BATCH]
            self.step([c[part] for c in context], numbers[part])
        return len(masked)


@dataclass
class Model:
    vocabulary: Vocabulary
    network: WindowNetwork

    def prior(self, hashed: np.ndarray, kind: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """The network's log-probability of each word."""
        numbers = self.vocabulary.numbered(hashed, kind)
        own = self.network.log_probability(around(numbers, n_words, EDGE), numbers)
        return own - np.where(numbers >= VOCABULARY, np.log(self.vocabulary.types)[kind], 0.0)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words and summed log-probability of each text by the network alone."""
        hashed, kind, n = words([(t or "").encode() for t in texts])
        sums = np.append(0, np.cumsum(self.prior(hashed, kind, n)))
        ends = np.cumsum(n)
        return n, sums[ends] - sums[ends - n]


def train(docs: DataFrame, text: str = "text") -> Model:
    """One pass that counts words and one that trains, over all documents."""
    kept = vocabulary(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, n = WindowNetwork(), 0
        for part in (s for b in batches for s in slices(b, 0)):
            hashed, kind, n_words = words([x or b"" for x in part.column(0).cast(pa.binary()).to_pylist()])
            n += network.train_on(kept.numbered(hashed, kind), n_words)
        if n:
            group = int(np.random.default_rng(n).integers(GROUPS))
            chunks = np.array_split(network.flat() * np.float32(n), CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([group] * CHUNKS, pa.int32()), pa.array([float(n)] * CHUNKS), pa.array([c.astype("<f4").tobytes() for c in chunks])], names=["chunk", "part", "n", "data"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_py(), "<f4").astype(float) for d in t.column("data"))
        n = float(np.sum(t.column("n").to_numpy()))
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "part": t.column("part").slice(0, 1), "n": pa.array([n]), "data": pa.array([total.astype("<f8").tobytes()])})

    schema = "chunk int, part int, n double, data binary"
    sums = small_batches(docs).select(F.col(text).cast("string")).mapInArrow(tidy(run), schema).groupBy("chunk", "part").applyInArrow(tidy_group(add), schema).collect()
    network = WindowNetwork()
    if sums:
        own = [[r for r in sums if r.chunk == k] for k in range(CHUNKS)]
        network.load(np.concatenate([sum(np.frombuffer(r.data, "<f8") for r in rows) / sum(r.n for r in rows) for rows in own]))
    network.seen = {}
    return Model(kept, network)


def fingerprints(hashed: np.ndarray, n_words: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its pair of neighbours and its window, as fingerprints without ``drop`` low bits."""
    left, right = around(hashed, n_words, END_HASH, 1)
    pair = blocks.finish(left * U(0x9E3779B97F4A7C15) + (right ^ PAIR) * U(0xC4CEB9FE1A85EC53))
    window = blocks.finish(pair + hashed * U(0xFF51AFD7ED558CCD))
    return (pair >> U(drop)) << U(drop), (window >> U(drop)) << U(drop)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts as Huffman-coded bytes; those of 255 and more follow in full."""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    small = coder.compress(np.minimum(n, 255).astype(np.uint8).tobytes()) + coder.flush()
    return len(small).to_bytes(4, "little") + small + n[n >= 255].astype("<i8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    n = np.frombuffer(zlib.decompress(data[4 : 4 + size], -15), np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(data[4 + size :], "<i8")
    return n


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every document, the other documents being the evidence."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    items = max(1.0, 0.4 * total)
    bits = max(5, math.ceil(math.log2(items / (1 << 20))))
    drop = max(0, 64 - max(32, math.ceil(math.log2(items)) + SPARE_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.pmod(F.xxhash64(F.col(key), whole), F.lit(n_blocks)).cast("int").alias("block"), F.col(key).cast("long").alias("doc_id"), whole.alias("text"))

    def found(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hashed, kind, n = words(t.column("text").cast(pa.binary()).to_pylist())
        pair, window = fingerprints(hashed, n, drop)
        return hashed, kind, n, pair, window

    def send(t: pa.Table) -> pa.Table:
        *_, pair, window = found(t)
        values, n = np.unique(np.concatenate([pair, window]), return_counts=True)
        cuts = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)).tolist() + [len(values)]
        body = (values << U(bits)) >> U(bits + drop)
        block = t.column("block")[0].as_py()
        return blocks.to_table([(block, k, b - a, 0, packed + pack_counts(n[a:b])) for (k, a, b), packed in blocks.pack_runs(body, cuts)])

    def add(t: pa.Table) -> pa.Table:
        asked = sorted(zip(*(t.column(c).to_pylist() for c in ("block", "bucket", "n", "data"))))
        parts = [(k, unpack_counts(rest)) for _, _, n, data in asked for k, rest in [blocks.unpack_sorted(data, n)]]
        ordered, order = blocks.stable_order(np.concatenate([k for k, _ in parts]) << U(bits + drop), bits + drop)
        first = blocks.starts(ordered)
        sums = np.empty(len(ordered), np.int64)
        sums[order] = np.repeat(np.add.reduceat(np.concatenate([n for _, n in parts])[order], first), np.diff(np.append(first, len(ordered))))
        replies = np.split(sums, np.cumsum([len(k) for k, _ in parts])[:-1])
        return blocks.to_table([(block, bucket, n, 0, pack_counts(own)) for (block, bucket, n, _), own in zip(asked, replies)])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c in names[:2] else pa.float64()) for c in names})
        hashed, kind, n, pair, window = found(left)
        replies = sorted(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()))
        totals = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(d) for _, d in replies)])
        both, doc = np.concatenate([pair, window]), np.tile(np.repeat(np.arange(len(n)), n), 2)
        ordered, order = blocks.stable_order(both, drop)  # equal fingerprints stay in order of documents
        docs_of = doc[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(both)]
        edge = np.flatnonzero(fresh | np.append(True, docs_of[1:] != docs_of[:-1])[: len(both)])
        size = np.diff(np.append(edge, len(both)))
        others = np.empty(len(both), np.int64)
        others[order] = totals[np.cumsum(fresh) - 1] - np.repeat(size, size)
        pairs, windows = np.split(others, 2)
        prior = np.exp(np.maximum(shared.value.prior(hashed, kind, n), -60.0))
        logp = np.log((windows + PRIOR * prior) / (pairs + PRIOR))
        sums = np.append(0, np.cumsum(logp))
        ends = np.cumsum(n)
        s = sums[ends] - sums[ends - n]
        return pa.table({"doc_id": left.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "log_likelihood": pa.array(s, pa.float64()), "mean_log_likelihood": pa.array(s / np.maximum(n, 1), pa.float64(), mask=n == 0)})

    answers = rows.groupBy("block").applyInArrow(tidy_group(send, cycles=False), blocks.CELL).groupBy("bucket").applyInArrow(tidy_group(add, cycles=False), blocks.CELL)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_pair(judge, cycles=False), "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
