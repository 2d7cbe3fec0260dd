"""Personal data: strict patterns, and a semi-Markov conditional random field for spellings that no pattern holds.

The strict patterns (``base_spans``) find addresses, IP addresses, card and phone numbers as they are written in full. The
field adds what is veiled or formatted otherwise: ``jane (at) mail dot example dot com``, ``10[.]0[.]0[.]7``, numbers without a
country code or with other separators.

A segmentation of a stretch cuts it into entities and single tokens outside of any. Its score is the sum of the scores of
its segments; an entity's score is a weighted sum of features of the whole segment (number and grouping of digits, check digit,
octets, separators, form of the signs for "at" and "dot", neighbours, words before), so both boundaries and the type are chosen
together. Candidate segments are loose matches of at most ``MOST_TOKENS`` tokens; candidates that overlap form a stretch,
outside of which only one segmentation is possible, so the dynamic programme over each stretch is exact for the whole text.

The weights maximise the conditional likelihood of generated sentences (``TRAIN_SENTENCES`` of them, fixed seed), with the
gradient from forward and backward sums over the same lattice. They don't depend on the input, so results don't depend on
its layout. Training takes a few seconds on the driver; the weights (a few hundred numbers) go to the tasks.

Patterns are searched in linear time: an address from its ``@``, an IP address from the first digit of a number.

Cases: null and empty texts hold nothing; rows without an id or with repeated ids are each looked at; an empty table gives
no rows; other columns are not read. A candidate that overlaps a strict span is dropped, as strict spans stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.slices import slices, small_batches, tidy

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, TRAIN_SENTENCES, ROUNDS, SEED = 40, 1500, 12, 13
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
Span = tuple[int, int, int]  # start, place in KINDS, end

# Strict patterns, fixed by the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Strict spans by start, then kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if _FIRST_DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p) < 256 or int(p.lstrip("0")[:4] or 0) < 256 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


_FIRST_DIGIT = re.compile("[0-9]")

# Loose forms of candidates.
_AT = r"(?:\s{0,2}(?:@|[\[({<]\s?(?:at|@)\s?[\])}>])\s{0,2}|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s{0,2}[\[({<]\s?(?:dot|\.)\s?[\])}>]\s{0,2}|\s(?:dot|DOT)\s)"
_NAME = r"[A-Za-z0-9_%+-]{1,40}+"
_VEILED = re.compile(rf"(?<![A-Za-z0-9_%+-]){_NAME}(?:{_DOT}{_NAME}){{0,4}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}")
_AT_CUE = re.compile(r"@|[\[({<]\s?(?:at|@)\s?[\])}>]|\s(?:at|AT)\s[A-Za-z0-9-]+(?:\s(?:dot|DOT)\s|\s{0,2}[\[({<])")
_AT_SIGN, _DOT_SIGN, _ODD_DOT = re.compile(_AT), re.compile(_DOT), re.compile(r"\[\.\]|\(\.\)|[\[(]dot[\])]|\sdot\s", re.I)
_SEPARATOR = r"(?:[\x20.()/\- ‐-―·_]{1,3}|\s?[\[(](?:\.|dot)[\])]\s?|\sdot\s)"
_NUMBERS = re.compile(rf"[0-9]++(?:{_SEPARATOR}[0-9]++)*+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_GROUP = re.compile(r"[0-9]+")
_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,3}$")
#: Words before an entity that features tell apart; others are one class. Fixed values.
CUES = frozenset("tel phone call fon mobile cell fax telefon mail email e contact write card visa mastercard karte carte tarjeta ip host server address addr order invoice isbn version v ref id no nr page total amount date on from build section".split())


class Candidate:
    __slots__ = ("start", "end", "kind", "features")

    def __init__(self, start: int, end: int, kind: int, features: list[str]):
        self.start, self.end, self.kind, self.features = start, end, kind, features


def _side(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in ".,;:-/#$%@=+()[]\"'" else "other"


def _around(text: str, start: int, end: int) -> list[str]:
    m = _BEFORE.search(text, max(0, start - 24), start)
    cue = m[1].lower() if m else ""
    return ["<" + _side(text[start - 1 : start]), ">" + _side(text[end : end + 1]) + _side(text[end + 1 : end + 2]), "cue=" + (cue if cue in CUES else "other" if cue else "none")]


def _number_features(text: str, start: int, end: int, kind: int) -> list[str]:
    s = text[start:end]
    groups, between = _GROUP.findall(s), _GROUP.split(s)[1:-1]
    digits = "".join(groups)
    shape = "-".join(str(min(len(g), 9)) for g in groups) if len(groups) <= 6 else f"{len(groups)} groups"
    signs = {"gap" if b.isspace() else "word dot" if _ODD_DOT.search(b) else b.strip()[:1] or "gap" for b in between}
    # a separator that stands once between brackets or after a code counts as mixed
    signs_f = "signs=" + ("none" if not between else next(iter(signs)) if len(signs) == 1 else "mixed")
    out = ["shape=" + shape, f"n={len(digits)}", signs_f, "lead=" + (s[0] if not s[0].isdigit() else "00" if s.startswith("00") else "0" if s[0] == "0" else "digit")]
    if kind == 1:
        out += [f"octets={all(len(g) < 4 and int(g) < 256 for g in groups)}", f"zero={any(len(g) > 1 and g[0] == '0' for g in groups)}"]
    if kind == 2:
        out += [f"luhn={luhn(digits)}", f"issuer={digits[0] in '3456'}", f"fours={all(len(g) == 4 for g in groups[:-1]) and len(groups) > 1}{luhn(digits)}"]
    if kind == 3:
        out += [f"groups={min(len(groups), 6)}", f"brackets={'(' in s and ')' in s}", f"dated={bool(re.fullmatch(r'(19|20)[0-9][0-9]', groups[0])) and len(groups) == 3}", f"last={min(len(groups[-1]), 6)}"]
    return out


def _address_features(text: str, start: int, end: int, at: re.Match) -> list[str]:
    local, domain = text[start : at.start()], text[at.end() : end]
    labels = _DOT_SIGN.split(domain)
    sign = at[0].strip()
    dots = {"." if d == "." else "veiled" if d.strip()[:1] in "[({<" else "word" for d in _DOT_SIGN.findall(domain)}
    own = "bare" if sign.lower() == "at" else "@" if sign == "@" else "veiled"
    return [
        f"at={own}", f"dots={'+'.join(sorted(dots))}", f"at+dots={own}{'+'.join(sorted(dots))}", f"labels={min(len(labels), 4)}", f"tld={len(labels[-1]) if labels[-1].isalpha() and len(labels[-1]) < 7 else 'odd'}",
        f"tld lower={labels[-1].islower()}", f"local={min(len(local) // 3, 4)}", f"local dots={len(_DOT_SIGN.findall(local))}", f"gap={at[0] != sign}",
    ]


def candidates(text: str) -> list[Candidate]:
    """Loose matches of all kinds with the features of the whole segment, and all their admissible cuts."""
    out: list[Candidate] = []
    if _FIRST_DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            if m.end() - m.start() < 7 and m[0].count(".") < 3:
                continue
            groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
            for a, (start, _) in enumerate(groups):
                n = 0
                for b in range(a, min(len(groups), a + 8)):
                    end = groups[b][1]
                    n += end - groups[b][0]
                    if n > 19 or end - start > 3 * MOST_TOKENS:
                        break
                    kinds = [k for k, fits in ((1, b - a == 3 and n <= 12), (2, n >= 12), (3, 7 <= n <= 15)) if fits]
                    if not kinds:
                        continue
                    lead = start
                    if text[lead - 1 : lead] == "(":
                        lead -= 1
                    if text[lead - 1 : lead] == "+":
                        lead -= 1
                    around = {s: _around(text, s, end) for s in {start, lead}}
                    for k in kinds:
                        s = lead if k == 3 else start
                        out.append(Candidate(s, end, k, _number_features(text, s, end, k) + around[s]))
    if _AT_CUE.search(text):
        for m in _VEILED.finditer(text):
            signs = list(_AT_SIGN.finditer(text, m.start(), m.end()))
            at = signs[-1]
            starts = [m.start()] + [d.end() for d in _DOT_SIGN.finditer(text, m.start(), at.start())]
            ends = [d.start() for d in _DOT_SIGN.finditer(text, at.end(), m.end())][1:] + [m.end()]
            for s in starts:
                for e in ends:
                    if s < at.start() and e > at.end():
                        out.append(Candidate(s, e, 0, _address_features(text, s, e, at) + _around(text, s, e)))
    for c in out:
        c.features = [f"{KINDS[c.kind]} {f}" for f in c.features] + [KINDS[c.kind]]
    return sorted(out, key=lambda c: (c.start, c.end, c.kind))


def stretches(text: str, found: list[Candidate]) -> Iterator[tuple[list[tuple[int, int, list[str]]], list[Candidate]]]:
    """Candidates that overlap, with the tokens that they cover: (start, end, features of a token outside)."""
    k = 0
    while k < len(found):
        end, to = found[k].end, k + 1
        while to < len(found) and found[to].start < end:
            end, to = max(end, found[to].end), to + 1
        tokens = [(m.start(), m.end(), _token_features(m[0])) for m in _TOKEN.finditer(text, found[k].start, end)]
        yield tokens, found[k:to]
        k = to


def _token_features(t: str) -> list[str]:
    kind = f"digits {min(len(t), 12)}" if t.isdigit() else "at" if t.lower() == "at" else "dot" if t.lower() == "dot" else "word" if t.isalpha() else "gap" if t.isspace() else t if t in "@.+-()[]" else "sign"
    return ["out " + kind]


class Lattice:
    """Segments of one stretch between token boundaries, by their ends; features as numbers."""

    def __init__(self, tokens: list[tuple[int, int, list[str]]], found: list[Candidate], number):
        place = {s: i for i, (s, _, _) in enumerate(tokens)}
        last = {e: i + 1 for i, (_, e, _) in enumerate(tokens)}
        self.size = len(tokens)
        #: (from, to, candidate or None, features)
        self.edges = [(i, i + 1, None, number(f)) for i, (_, _, f) in enumerate(tokens)]
        self.edges += [(place[c.start], last[c.end], c, number(c.features)) for c in found if c.start in place and c.end in last]
        self.edges.sort(key=lambda e: e[1])

    def best(self, score) -> list[Candidate]:
        """Entities of the best segmentation; ties go to fewer and earlier segments."""
        value, back = [0.0] + [-math.inf] * self.size, [None] * (self.size + 1)
        for e in self.edges:
            v = value[e[0]] + score(e[3])
            if v > value[e[1]]:
                value[e[1]], back[e[1]] = v, e
        out, at = [], self.size
        while at:
            e = back[at]
            if e[2] is not None:
                out.append(e[2])
            at = e[0]
        return out[::-1]

    def expected(self, w: np.ndarray) -> tuple[float, list[float]]:
        """Log of the sum over all segmentations, and each segment's probability."""
        s = [float(w[e[3]].sum()) for e in self.edges]
        forward = [0.0] + [-math.inf] * self.size
        for e, v in zip(self.edges, s):
            forward[e[1]] = _log_add(forward[e[1]], forward[e[0]] + v)
        backward = [-math.inf] * self.size + [0.0]
        for e, v in sorted(zip(self.edges, s), key=lambda x: -x[0][0]):
            backward[e[0]] = _log_add(backward[e[0]], backward[e[1]] + v)
        total = forward[-1]
        return total, [math.exp(forward[e[0]] + v + backward[e[1]] - total) for e, v in zip(self.edges, s)]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Field:
    """Weights of features by name."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Entities of the best segmentation, without what overlaps a strict span."""
        taken = sorted((s, e) for s, _, e in base)
        found = _apart(candidates(text), taken)
        out = []
        for tokens, own in stretches(text, found):
            out += [(c.start, c.kind, c.end) for c in Lattice(tokens, own, lambda f: f).best(self.score)]
        return out


def _apart(found: list[Candidate], taken: list[tuple[int, int]]) -> list[Candidate]:
    """Candidates (by start) that overlap none of the spans; the furthest end of the spans before each start decides."""
    if not taken:
        return found
    starts = [s for s, _ in taken]
    furthest = np.maximum.accumulate([e for _, e in taken])
    before = np.searchsorted(starts, [c.end for c in found], side="left")
    return [c for c, k in zip(found, before.tolist()) if k == 0 or furthest[k - 1] <= c.start]


def train(sentences: int = TRAIN_SENTENCES, rounds: int = ROUNDS, seed: int = SEED, penalty: float = 0.02) -> Field:
    """Weights of the greatest penalised conditional likelihood of generated sentences (adaptive gradient steps)."""
    rng = np.random.default_rng(seed)
    names: dict[str, int] = {}

    def number(features: list[str]) -> np.ndarray:
        return np.array([names.setdefault(f, len(names)) for f in features])

    data = []
    for _ in range(sentences):
        text, gold = sentence(rng)
        wanted = set(gold)
        for tokens, own in stretches(text, candidates(text)):
            lattice = Lattice(tokens, own, number)
            inside = [(c.start, c.kind, c.end) in wanted if c is not None else False for _, _, c, _ in lattice.edges]
            covered = [(lattice.edges[k][0], lattice.edges[k][1]) for k, x in enumerate(inside) if x]
            true = [x or (e[2] is None and not any(a <= e[0] < b for a, b in covered)) for x, e in zip(inside, lattice.edges)]
            data.append((lattice, np.array(true, float)))
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-2)
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            lattice, true = data[k]
            _, p = lattice.expected(w)
            step = true - np.array(p)
            g = np.zeros(len(w))
            for d, e in zip(step, lattice.edges):
                if abs(d) > 1e-4:
                    g[e[3]] += d
            at = np.flatnonzero(g)
            g[at] -= penalty * w[at] / 10
            squares[at] += g[at] ** 2
            w[at] += 0.5 * g[at] / np.sqrt(squares[at])
    return Field({f: round(float(w[i]), 4) for f, i in names.items()})


# Sentences to learn from. Names, formats and words before entities are plain facts of how people write them.
_SYLLABLES = "an ba co de er fi go ha in ja ko la me no or pe ra sa ti un vo wi lu mo".split()
_TLDS = "com org net de fr es info io example edu".split()
_OPENERS = ["", "", "", "tel ", "Tel.: ", "phone: ", "call ", "fax ", "mail ", "email: ", "contact ", "write to ", "card ", "visa ", "ip ", "host ", "server ", "from "]
_IDLE = ["order ", "invoice no. ", "version ", "ref ", "isbn ", "page ", "on ", "total ", "id ", "", "", "build "]


def _word(rng) -> str:
    return "".join(rng.choice(_SYLLABLES, rng.integers(1, 4)))


def _digits(rng, n: int, first: str = "0123456789") -> str:
    return rng.choice(list(first)) + "".join(rng.choice(list("0123456789"), n - 1))


def _card(rng, valid: bool = True) -> str:
    n = int(rng.choice([16, 16, 16, 15, 13]))
    d = _digits(rng, n - 1, "3456")
    return next(d + str(k) for k in range(10) if luhn(d + str(k)) == valid)


def _grouped(d: str, sign: str) -> str:
    return sign.join(d[i : i + 4] for i in range(0, len(d), 4))


def _pick(rng, options):
    return options[int(rng.integers(len(options)))]


def _entity(rng) -> tuple[int, str]:
    kind = int(rng.integers(4))
    if kind == 0:
        at = _pick(rng, [" at ", " (at) ", "(at)", " [at] ", "[at]", "{at}", " @ ", "@", "<at>", " AT "])
        veil = at.strip() != "@"
        dot = _pick(rng, [" dot ", " (dot) ", "[dot]", "[.]", "(.)", " DOT ", "(dot)"] + [".", "."] * (at.strip() in ("@", "(at)", "[at]", "{at}", "<at>")))
        inner = _pick(rng, [".", "_", "", dot if veil else "."])
        local = _word(rng) + (inner + _word(rng) if inner and rng.random() < 0.5 else "") + (str(rng.integers(99)) if rng.random() < 0.3 else "")
        labels = [_word(rng) for _ in range(int(rng.integers(1, 3)))] + [_pick(rng, _TLDS)]
        return kind, local + at + dot.join(labels)
    if kind == 1:
        sign = _pick(rng, ["[.]", "(.)", " dot ", "[dot]", "(dot)", "."])
        return kind, sign.join(str(rng.integers(256)) for _ in range(4))
    if kind == 2:
        d = _card(rng, valid=rng.random() < 0.85)
        sign = _pick(rng, [".", "/", " ", "  ", "_", " - ", "–"])
        return kind, _grouped(d, sign) if len(d) == 16 else sign.join([d[:4], d[4:10], d[10:]])
    a, b, c = _digits(rng, 3), _digits(rng, 3, "23456789"), _digits(rng, 4)
    forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{_digits(rng, 2, '34')} {_digits(rng, 3)} {_digits(rng, 4)} {_digits(rng, 2)}", f"0{_digits(rng, 3)} / {_digits(rng, 7)}", f"({a}) {b} {c}", f"0{_digits(rng, 1)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)}", f"+{_digits(rng, 2, '34')}/{a}/{b}{c}"]
    return kind, _pick(rng, forms)


def _decoy(rng) -> str:
    n = lambda k: str(rng.integers(k))
    forms = [
        lambda: f"20{n(10)}{n(10)}-0{n(9)}-1{n(10)}", lambda: f"1{n(10)}.0{n(10)}.20{n(10)}{n(10)}", lambda: ".".join(n(30) for _ in range(int(rng.integers(2, 4)))), lambda: ".".join(n(20) for _ in range(5)), lambda: ".".join(str(rng.integers(256, 2000)) for _ in range(4)),
        lambda: _digits(rng, int(rng.integers(5, 12))), lambda: _digits(rng, int(rng.integers(12, 20))), lambda: _card(rng, False), lambda: "".join(rng.choice(list("0123456789abcdef"), 40)), lambda: f"978-{n(10)}-{_digits(rng, 3)}-{_digits(rng, 5)}-{n(10)}",
        lambda: f"{n(900)} {n(900)} {n(900)} {n(900)}", lambda: " ".join(n(99) for _ in range(8)), lambda: f"{_word(rng)} at {_word(rng)}. {_word(rng)} dot {_word(rng)}", lambda: f"{_word(rng)} at {n(60)}.{n(99)} percent", lambda: f"look at {_word(rng)} (dotted)",
        lambda: f"{n(99999)}.{n(99)} - {n(99999)}.{n(99)}", lambda: f"#{_digits(rng, 10)}", lambda: f"{n(24)}:{n(60)}:{n(60)}.{_digits(rng, 6)}", lambda: f"{_digits(rng, 4)}/{_digits(rng, 4)}", lambda: f"20{n(10)}{n(10)}.{_digits(rng, 3)}.{_digits(rng, 4)}", lambda: f"@{_word(rng)} and {_word(rng)}", lambda: f"{_digits(rng, 4)} {_digits(rng, 4)} {_digits(rng, 3)}", lambda: f"{_word(rng)} at the dot {_word(rng)}",
    ]
    return _pick(rng, forms)()


def sentence(rng) -> tuple[str, list[Span]]:
    """A sentence of made-up words with entities and decoys, and the entities' spans."""
    text, gold = "", []
    for _ in range(int(rng.integers(1, 4))):
        text += " ".join(_word(rng) for _ in range(int(rng.integers(2, 7)))) + _pick(rng, [" ", " ", ", ", ": ", "\n"])
        if rng.random() < 0.55:
            text += _pick(rng, _OPENERS)
            kind, s = _entity(rng)
            gold.append((len(text), kind, len(text) + len(s)))
        else:
            text += _pick(rng, _IDLE)
            s = _decoy(rng)
        text += s + _pick(rng, [" ", " ", ", ", ". ", "; ", "\n"])
    return text, gold


@lru_cache(maxsize=1)
def trained() -> Field:
    return train()


def written(spans: list[Span]) -> str:
    """kind:start:end of spans by start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_private(docs: DataFrame, field: Field | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) of each whole text.

    Counts and digest are of strict spans; ``spans`` has strict and added ones. Offsets are code points, ends exclusive."""
    field = field or trained()
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def judge(t: str | None) -> tuple:
        base = base_spans(t or "")
        added = field.added(t, base) if t else []
        counts = [0] * len(KINDS)
        for kind, own in groupby(sorted(k for _, k, _ in base)):
            counts[kind] = len(list(own))
        return (*counts, len(added), hashlib.sha256(written(base).encode()).hexdigest(), written(base + added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1)):
            columns = list(zip(*[judge(t) for t in batch.column(1).to_pylist()]))
            arrays = [batch.column(0)] + [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"n_{k}" for k in KINDS], "n_added", "base_sha256", "spans"])

    return rows.mapInArrow(tidy(run), SCHEMA)
