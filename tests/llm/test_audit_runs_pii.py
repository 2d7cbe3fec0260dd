"""Filter audit, periodic runs and personal data against plain versions, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import filter_audit, periodic, pii, queries

DOCS = "doc_id long, text string, source string, class string, bits int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated ids and rows; extra columns that clash with names used inside."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "DELTA", "éé", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = " ".join(f"w{k}" for k in range(20_000))
    texts = [text(n) for n in (5, 60, 60, 80, 200)] + ["# price $5", "", None, "   \n", long, long[:-1] + "~", long]
    rows = [(k, t, rng.choice(["a", "b", None])) for k, t in enumerate(texts)]
    rows += [(50 + k, texts[k % len(texts)], rng.choice(["a", "b", ""])) for k in range(30)]
    rows += [(3, texts[3], "a"), (3, "other text", "a"), (3, texts[3], "a"), (None, texts[1], "b"), (None, None, None), (None, "only without an id", "b"), (None, "only without an id", "b")]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], DOCS)


def plain_audit(docs, labels):
    """All counts by loops over rows and orders."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        rows.append((part or "", {f for f, x in fails.items() if x}, good, toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_loops(spark, odd):
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)] + [(0, 1, 1), (None, 1, 1), (4, None, None)]
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit([(r.doc_id, r.text, r.source) for r in odd.collect()], labels)
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(odd, ls).collect()}
    assert got == want
    assert filter_audit.audit(odd.limit(0), ls).collect() == []


def test_audit_of_a_crowded_bitmap(spark, odd, monkeypatch):
    """Classes that pass the bitmap by chance change nothing."""
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    want = sorted(map(tuple, filter_audit.audit(odd, labels).filter("step = 5").collect()))
    monkeypatch.setattr(filter_audit, "FILTER_BITS", 64)
    assert sorted(map(tuple, filter_audit.audit(odd, labels).filter("step = 5").collect())) == want


def test_blocks_tell_texts_apart(spark):
    """Texts of one length that differ in one place only, in any block."""
    base = "a" * 9000
    texts = [base] + [base[:k] + "b" + base[k + 1 :] for k in (0, 255, 256, 4095, 4096, 8999)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(filter_audit.block_hashes(F.col("t")).alias("b"))
    assert len({tuple(r.b) for r in df.collect()}) == len(texts)


def plain_runs(words):
    """(start, length, period) of all runs, by trying all periods."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def test_runs_equal_all_periods():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.choice([0, 1, 11, 12, 13, 40, 120]), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n > 30 and rng.random() < 0.7:
                p, s = rng.randint(1, 14), rng.randrange(n)
                for i in range(s + p, min(n, s + rng.randint(0, 8) * p)):
                    w[i] = w[i - p]
            texts.append(w)
        ids, first = np.array([x for w in texts for x in w], np.int64), np.cumsum([0] + [len(w) for w in texts])
        want = sorted((s + f, s + f + n, p) for w, f in zip(texts, first.tolist()) for s, n, p in plain_runs(w))
        for seed in (0, 3):
            assert sorted(zip(*(x.tolist() for x in periodic.find_runs(ids, first, seed)))) == want


def test_runs_of_a_text_that_fools_the_fast_hash(monkeypatch):
    """The Thue-Morse word has equal hashes of unequal halves modulo a power of two."""
    t = [0]
    for _ in range(13):
        t += [1 - x for x in t]
    t = t[: 1 << 12] + t[:40]
    got = sorted(zip(*(x.tolist() for x in periodic.find_runs(np.array(t), np.array([0, len(t)])))))
    assert [(s, e - s, p) for s, e, p in got] == plain_runs(t)


def test_pairs_in_small_chunks(monkeypatch):
    rng = random.Random(1)
    w = [rng.randrange(3) for _ in range(300)] + [1, 2] * 30 + [0] * 20
    monkeypatch.setattr(periodic, "PAIRS", 7)
    got = sorted(zip(*(x.tolist() for x in periodic.find_runs(np.array(w), np.array([0, len(w)])))))
    assert [(s, e - s, p) for s, e, p in got] == plain_runs(w)


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_collapsed_texts(spark, odd):
    got = periodic.repeated_runs(odd).collect()
    assert len(got) == odd.count()
    want = sorted((r.doc_id if r.doc_id is not None else -1, len(w), tuple(plain_runs(w)) if len(w) < 1000 else (), collapsed(w, plain_runs(w) if len(w) < 1000 else [])) for r in odd.collect() for w in [re.findall(r"[^\x20\x09-\x0D]+", r.text or "")])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == want
    assert periodic.repeated_runs(odd.limit(0)).collect() == []


def test_query_of_runs_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    for r, text in zip(queries.op12_periodic_runs(spark, sf).orderBy("doc_id").collect(), [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]):
        w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 1500:
            continue
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(collapsed(w, runs)))
        assert tuple(r)[1:] == want


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_strict_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789....@@a-+ ()bé") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == plain_base(t)
    assert pii.base_spans("4111 1111 1111 1111 a.b@c.de, +1 (017) 555-7713 at 10.0.0.255") == [(0, 2, 19), (20, 0, 28), (30, 3, 47), (51, 1, 61)]
    for t in ("a" * 300_000, "1." * 150_000, "1" * 300_000, "@" * 100_000, "+1 " * 100_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def field():
    return pii.trained()


def every_segmentation(lattice):
    """All ways through a lattice, as lists of edges."""
    def walk(at):
        if at == lattice.size:
            yield []
        for e in lattice.edges:
            if e[0] == at:
                for rest in walk(e[1]):
                    yield [e, *rest]

    return list(walk(0))


def test_programme_against_all_segmentations(field):
    rng = np.random.default_rng(4)
    seen = 0
    while seen < 60:
        text, _ = pii.sentence(rng)
        for tokens, own in pii.stretches(text, pii.candidates(text)):
            if len(tokens) > 14:
                continue
            lattice = pii.Lattice(tokens, own, lambda f: f)
            ways = every_segmentation(lattice)
            score = lambda way: sum(field.score(e[3]) for e in way)
            best = lattice.best(field.score)
            chosen = sum(field.score(c.features) for c in best) + sum(field.score(f) for s, e, f in tokens if not any(c.start <= s < c.end for c in best))
            assert chosen == pytest.approx(max(map(score, ways)))
            seen += 1


def test_expectations_against_all_segmentations():
    rng = np.random.default_rng(6)
    names = {}
    number = lambda fs: np.array([names.setdefault(f, len(names)) for f in fs])
    lattices = []
    while len(lattices) < 20:
        text, _ = pii.sentence(rng)
        lattices += [pii.Lattice(t, c, number) for t, c in pii.stretches(text, pii.candidates(text)) if len(t) <= 12]
    w = rng.normal(size=len(names))
    for lattice in lattices:
        ways = every_segmentation(lattice)
        mass = np.array([np.exp(sum(w[e[3]].sum() for e in way)) for way in ways])
        total, p = lattice.expected(w)
        assert total == pytest.approx(np.log(mass.sum()))
        for e, x in zip(lattice.edges, p):
            assert x == pytest.approx(mass[[any(y is e for y in way) for way in ways]].sum() / mass.sum(), abs=1e-9)


def test_held_out_sentences(field):
    rng = np.random.default_rng(1234)
    right = wrong = missed = 0
    for _ in range(600):
        text, gold = pii.sentence(rng)
        base = pii.base_spans(text)
        added, gold = set(field.added(text, base)), set(gold) - set(base)
        gold = {g for g in gold if not any(g[0] < e and s < g[2] for s, _, e in base)}
        right, wrong, missed = right + len(added & gold), wrong + len(added - gold), missed + len(gold - added)
    print(right, wrong, missed)
    assert right > 250 and wrong < 0.03 * right and missed < 0.03 * right


def test_veiled_and_clean_texts(field):
    spans = lambda t: {(pii.KINDS[k], t[s:e]) for s, k, e in field.added(t, pii.base_spans(t))}
    assert spans("write to jane dot roe at mail dot example dot com today") == {("email", "jane dot roe at mail dot example dot com")}
    assert spans("host 10[.]0[.]0[.]7 is down") == {("ip", "10[.]0[.]0[.]7")}
    assert spans("call (017) 555-7713 now") == {("phone", "(017) 555-7713")}
    assert spans("+1 (826) 555-4081 190.137.223.204 du") == {("phone", "+1 (826) 555-4081")}
    for clean in ("look at the dot. then go", "version 1.2.3.4.5 of 2024-05-06", "it was 10.5 percent at noon", "order 12345678", "", "plain words only", "total 12,345.67"):
        assert spans(clean) == set()


def test_rows_of_personal_data(spark, odd):
    got = pii.find_private(odd.unionByName(spark.createDataFrame([(900, "mail a.b@c.de or call (017) 555-7713", "s", "c", 1)], DOCS)))
    r = got.filter("doc_id = 900").first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (1, 0, 0, 0, 1) and r.spans == "email:5:13,phone:22:36"
    assert r.base_sha256 == hashlib.sha256(b"email:5:13").hexdigest()
    none = got.filter("doc_id = 7").first()
    assert none.spans == "" and none.base_sha256 == hashlib.sha256(b"").hexdigest() and got.count() == odd.count() + 1
    assert pii.find_private(odd.limit(0)).collect() == []


def test_strict_spans_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op13_pii(spark, sf).collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
