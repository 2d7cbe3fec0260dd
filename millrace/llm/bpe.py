"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be merged across, so a text may be cut
between the two for certain; white space and the ends of pre-tokens are such cuts by the rules of the tokenizer.
Each fragment between cuts is encoded independently and the ids are concatenated, which gives exactly the ids of
encoding the whole. Fragments and white-space-free chunks are cached within a bound, so the cost of merging is
paid once for what recurs.

Cases: null and empty texts have no ids; special tokens written out in a text are single ids, as in the library;
very long texts are streamed chunk by chunk in one pass. The operator has no shuffle at all.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.slices import slices, small_batches, tidy

CACHE_ENTRIES = 200_000
#: Bytes of documents encoded together: what they need at once stays small beside the caches.
SLICE = 1 << 18
#: Fragments of more bytes than this are encoded one by one.
LONG = 64
#: Fixed values of the byte-level alphabet: bytes that stand for themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: What the pre-tokenizer keeps, and white space as it sees it.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Where Python's white space differs from the tokenizer's.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters whose class depends on the version of Unicode lie outside these ranges.
UNSURE = re.compile("[^\x00-\u052f\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """Character for each byte: printable ones stand for themselves, the others follow from 256 on."""
    others = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(others)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of a word-end BPE vocabulary in the tokenizers library's file format."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_string = {str(i): t for t, i in (vocab | self.specials).items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.inner, self.final = (np.array([vocab[c + end] for c in alphabet], np.int64) for end in ("", suffix))
        #: joined[a, b]: byte b follows byte a inside some token, so there may be no cut between them.
        self.joined = np.zeros((256, 256), bool)
        for t in vocab:
            at = [self.byte_of[c] for c in (t.removesuffix(suffix) if suffix else t)]
            self.joined[at[:-1], at[1:]] = True
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[x] * self.size + vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of, self.none = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, 0).astype(np.int64), len(pairs)
        self.merged = np.array([vocab["".join(p)] for p in pairs], np.int64)
        self.entries, self.pieces, self.chunks = cache_entries, {}, {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``none`` where they don't merge or one is missing (-1)."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], self.none)

    def _merge(self, rows: np.ndarray) -> list[list[int]]:
        """Ids of fragments of similar length, a row each, padded by -1: the lowest rank first, leftmost first, one merge in each row at a time."""
        out: list = [None] * len(rows)
        who, ranks = np.arange(len(rows)), self._ranks(rows[:, :-1], rows[:, 1:])
        while len(who):
            lowest = ranks.min(1) if ranks.shape[1] else np.full(len(who), self.none)
            if (over := lowest == self.none).any():
                for k, ids in zip(who[over].tolist(), rows[over].tolist()):
                    out[k] = [i for i in ids if i >= 0]
                who, rows, ranks, lowest = who[~over], rows[~over], ranks[~over], lowest[~over]
                if not len(who):
                    break
            at, line = ranks.argmin(1)[:, None], np.arange(len(who))[:, None]
            rows[line, at] = self.merged[lowest][:, None]
            columns = np.arange(rows.shape[1] - 1)[None, :]
            rows = rows[line, columns + (columns > at)]
            columns = columns[:, : ranks.shape[1] - 1]
            ranks = ranks[line, columns + (columns >= at)]
            if ranks.shape[1]:
                for k in (at - 1, at):
                    ok = (k >= 0) & (k < ranks.shape[1])
                    i, j = line[ok], k[ok]
                    ranks[i, j] = self._ranks(rows[i, j], rows[i, j + 1])
        return out

    def _merge_long(self, syms: list[int]) -> list[int]:
        """The same for one long fragment in n log n: neighbours in linked lists, pairs in a heap."""
        rank = dict(zip(self.keys.tolist(), self.rank_of.tolist())) if not hasattr(self, "_rank") else self._rank
        self._rank, size = rank, self.size
        n = len(syms)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, syms[i], syms[i + 1]) for i in range(n - 1) if (r := rank.get(syms[i] * size + syms[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if syms[i] == a else -1
            if j < 0 or syms[j] != b:
                continue
            syms[i], syms[j] = int(self.merged[r]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank.get(syms[x] * size + syms[y])) is not None:
                    heapq.heappush(heap, (r, x, syms[x], syms[y]))
        return [x for x in syms if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[str]:
        """Ids of pre-tokens, as decimal strings: cut at forced boundaries, each fragment encoded by itself, then concatenated."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        syms = self.inner[data]
        syms[ends - 1] = self.final[data[ends - 1]]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        cut[ends] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts)
        ids: list = [None] * len(sizes)
        low = 0
        for high in (1, 4, 6, 8, 10, 12, 16, 24, 40, LONG):
            which = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if len(which):
                columns = np.arange(high)[None, :]
                at = starts[which][:, None] + columns
                rows = np.where(columns < sizes[which][:, None], syms[np.minimum(at, len(syms) - 1)], -1)
                for k, found in zip(which.tolist(), self._merge(rows)):
                    ids[k] = found
        for k in np.flatnonzero(sizes > LONG).tolist():
            ids[k] = self._merge_long(syms[starts[k] : starts[k + 1]].tolist())
        firsts = np.searchsorted(starts, np.append(0, ends)).tolist()
        return [" ".join([str(i) for f in ids[a:b] for i in f]) for a, b in zip(firsts, firsts[1:])]

    def _learn(self, chunks: list[str]) -> None:
        """Fills the caches for chunks without white space that are not in them."""
        if len(self.chunks) + len(chunks) > self.entries:
            self.chunks.clear()
        if len(self.pieces) > self.entries:
            self.pieces.clear()
        found = [PIECE.findall(c) for c in chunks]
        new = list({p for f in found for p in f if p not in self.pieces})
        if new:
            self.pieces.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        known = self.pieces
        self.chunks.update(zip(chunks, [known[f[0]] if len(f) == 1 else " ".join([known[p] for p in f]) for f in found]))

    def _plain_chunks(self, text: str) -> list[str]:
        """Lower-cased chunks between white space of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lower-cases letter by letter, without final forms
        text = text.lower()
        return [c for c in regex.split(r"\s+", text) if c] if ODD_SPACE.search(text) else text.split()

    def _by_library_classes(self, text: str) -> list[str]:
        """For rare scripts: the library says what a letter is; fragments are cut and encoded as always."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return self.encode_pieces([bytes(self.byte_of[c] for c in p) for p, _ in found]) if found else []

    def encode_batch(self, texts: list[str | None]) -> list[str]:
        """Each text's ids in decimal, joined by one space."""
        #: For each text a list of either chunks (str) or ready ids (tuple).
        split: list[list] = []
        for text in texts:
            parts: list = []
            for part in self.special_cut.split(text) if text and self.special_cut and "<|" in text else [text or ""]:
                if part in self.specials:
                    parts.append((str(self.specials[part]),))
                elif UNSURE.search(part):
                    parts.append(tuple(self._by_library_classes(part)))
                else:
                    parts.append(self._plain_chunks(part))
            split.append(parts)
        out = []
        for k in range(0, len(split), 64):
            group = split[k : k + 64]
            wanted = {c for parts in group for p in parts if isinstance(p, list) for c in p}
            if new := [c for c in wanted if c not in self.chunks]:
                if len(self.chunks) + len(new) > self.entries:
                    self.chunks.clear()
                    new = list(wanted)
                self._learn(new)
            get = self.chunks.__getitem__
            out += [" ".join([x for p in parts for x in (map(get, p) if isinstance(p, list) else p) if x]) for parts in group]
        return out

    def forget(self) -> None:
        """Empties the caches: a worker that goes on to other work shouldn't hold them."""
        self.chunks, self.pieces = {}, {}

    def encode(self, text: str | None) -> str:
        return self.encode_batch([text])[0]

    def decode(self, ids: str) -> str:
        """The library's decode without a decoder: tokens joined by one space, special ones included."""
        return " ".join(map(self.by_string.__getitem__, ids.split(" "))) if ids else ""


@lru_cache(2)
def load(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Per document: key, n_tokens, sha256 of the ids and of the decoded text, and ids (array) if asked for in ``keep``.

    ``vocabulary`` is a file that every executor has at the same path (an installed package's data file)."""
    with_ids = "ids" in (keep or [])
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        try:
            for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
                all_ids = bpe.encode_batch(batch.column(1).to_pylist())
                counts = [ids.count(" ") + 1 if ids else 0 for ids in all_ids]
                columns = [
                    batch.column(0), pa.array(counts, pa.int64()), pa.array([sha256(ids.encode()).hexdigest() for ids in all_ids], pa.string()),
                    pa.array([sha256(bpe.decode(ids).encode()).hexdigest() for ids in all_ids], pa.string()),
                ]
                if with_ids:
                    flat = np.array(" ".join(filter(None, all_ids)).split(), dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            bpe.forget()

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), schema)
