"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Folding lower-cases, turns look-alike letters and digits used as letters into plain ones (i, l, 1 and | become
one), drops invisible characters and turns punctuation into spaces. The lexicon holds stems at the start of a word,
with the log-odds of documents that have them; a match inside an exception phrase does not count. A document's score
is a logistic of its weighted matches, also per root of its length in words. Stems, exceptions and the two
coefficients are learned from a bounded sample of labelled rows (``SAMPLE_ROWS``): an exception is a stem's word with the
next or the one before, if the pair stands in ``EXCEPTION_ROWS`` or more clean rows and in no toxic one.

Cases: null and empty texts score as a text without matches; nulls among labels are ignored; without labels the
score is 0 everywhere; repeated rows are scored one by one. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.slices import small_batches, tidy

SAMPLE_ROWS = 8000
EXCEPTION_ROWS = 2
THRESHOLD = 0.3
#: Characters read as other letters, and characters that are not seen.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "п": "n", "в": "b", "н": "h", "ӏ": "i",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "χ": "x", "ѵ": "v", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "i", "ⅰ": "i",
}
UNSEEN = "­​‌‍⁠﻿"
PUNCTUATION = "!\"#%&'()*+,-./:;<=>?[\\]^_`{}~\t\n\r\x0b\x0c«»“”‘’…–—¡¿ "
#: Phrases in which an insult's stem is something else, known without any label; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "stupidly simple", "loser bracket", "scumbag steve meme")


def _table() -> dict[int, str]:
    table = {ord(c): " " for c in PUNCTUATION} | {ord(c): "" for c in UNSEEN} | {ord(a): b for a, b in LOOKALIKES.items()}
    for i in range(26):
        table[0xFF41 + i] = LOOKALIKES.get(chr(97 + i), chr(97 + i))
        table[0x1D41A + i] = LOOKALIKES.get(chr(97 + i), chr(97 + i))
    return table


FOLD = _table()


def fold(text: str | None) -> str:
    """Words of a text in plain letters, with a space before each."""
    return " " + (text or "").lower().translate(FOLD) + " "


@dataclass
class Lexicon:
    stems: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for s, w in self.stems.items():
                a.add_word(" " + s, (w, len(s) + 1))
            for e in self.exceptions:
                p = " " + " ".join(fold(e).split())
                a.add_word(p, (None, len(p)))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def features(self, folded: str) -> tuple[float, float]:
        """Weighted matches of a folded text outside exceptions, damped; and the same by the root of the number of words."""
        if not self.stems:
            return 0.0, 0.0
        found, spared = [], []
        for end, (w, n) in self.automaton().iter(folded):
            (found if w is not None else spared).append((end - n + 1, end, w))
        if spared:
            found = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b, _ in spared)]
        if not found:
            return 0.0, 0.0
        total = sum(f[2] for f in found)
        return math.log1p(total), total / math.sqrt(max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        if not self.stems:
            return 0.0
        a, b = self.features(fold(text))
        c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * a + c[2] * b))))


def learn_exceptions(rows: list[tuple[str, int]], stems: Iterable[str]) -> tuple[str, ...]:
    """Pairs of words, one with a stem, that stand in clean rows only; rows are folded."""
    heads = tuple(stems)
    clean: Counter = Counter()
    toxic: set[str] = set()
    for folded, y in rows if heads else ():
        words = folded.split()
        pairs = {f"{words[k]} {words[k + 1]}" for i, w in enumerate(words) if w.startswith(heads) for k in (i - 1, i) if 0 <= k < len(words) - 1}
        if y:
            toxic |= pairs
        else:
            clean.update(pairs)
    return tuple(sorted(p for p, n in clean.items() if n >= EXCEPTION_ROWS and p not in toxic))


def learn(rows: Iterable[tuple[str | None, int]], min_docs: int = 6, max_stems: int = 200) -> Lexicon:
    """A lexicon from (text, label) rows: stems are chosen greedily by the toxic rows they newly explain."""
    rows = [(fold(t), int(y)) for t, y in rows]
    n_pos = sum(y for _, y in rows)
    n_neg = len(rows) - n_pos
    if not n_pos or not n_neg:
        return Lexicon({})

    def stems_in(folded: str) -> set[str]:
        return {w[:k] for w in set(folded.split()) if w[:1].isalpha() for k in range(4, min(len(w), 10) + 1)}

    pos: Counter = Counter()
    for folded, y in rows:
        if y:
            pos.update(stems_in(folded))
    pos = Counter({s: n for s, n in pos.items() if n >= min_docs})
    neg: Counter = Counter()
    for folded, y in rows:
        if not y:
            neg.update(stems_in(folded) & pos.keys())
    good = {s for s, n in pos.items() if n / n_pos > 15 * (neg[s] + 0.5) / n_neg}
    where: dict[str, set[int]] = {s: set() for s in good}
    for i, (folded, y) in enumerate(rows):
        for s in stems_in(folded) & good if y else ():
            where[s].add(i)
    stems: dict[str, float] = {}
    left = set().union(*where.values()) if where else set()
    while left and len(stems) < max_stems:
        best = max(sorted(where), key=lambda s: (len(where[s] & left) - neg[s], pos[s], len(s)), default=None)
        if best is None or len(where[best] & left) < max(2, min_docs // 2):
            break
        left -= where[best]
        stems[best] = math.log((pos[best] + 0.5) / (n_pos + 1)) - math.log((neg[best] + 0.5) / (n_neg + 1))
        del where[best]
    for s in sorted(where, key=lambda s: (-pos[s], s)):  # those that explain what others do too, by themselves
        if len(stems) >= max_stems:
            break
        if pos[s] >= 4 * min_docs and neg[s] == 0 and not any(s.startswith(x) or x.startswith(s) for x in stems):
            stems[s] = math.log((pos[s] + 0.5) / (n_pos + 1)) - math.log(0.5 / (n_neg + 1))
    lexicon = Lexicon(stems, EXCEPTIONS + learn_exceptions(rows, stems))
    x = np.array([[1.0, *lexicon.features(folded)] for folded, _ in rows])
    y = np.array([label for _, label in rows], float)
    c = np.array([math.log(n_pos / n_neg), 0.1, 0.1])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * c)
        c += step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.coefficients = tuple(float(v) for v in c)
    return lexicon


def held_out(key: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_from_tables(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learns from at most ``rows`` labelled documents outside the held-out part, chosen by a hash of the id."""
    labelled = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").orderBy(F.xxhash64("text"), "toxic").limit(rows).toPandas()
    return learn(zip(sample["text"], sample["toxic"]))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score double) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.score(x.as_py()) for x in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, learn_from_tables(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, with their columns as they are: scored in place, without a join."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(x.as_py()) < threshold for x in batch.column(batch.schema.get_field_index("text"))], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), schema)
