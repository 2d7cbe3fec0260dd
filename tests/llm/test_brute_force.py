"""Operators against plain versions of what they compute, on a small slice of generated rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from millrace.llm import ann, bpe, decontaminate, html_extract, simhash, suffix_dedup, toxicity, window_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


def test_bpe_equals_the_library(docs, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    b = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    odd = ["".join(rng.choice("abc'sre Σσİßé\u0301日本 12#\x1c\x85\u2028") for _ in range(rng.randint(0, 50))) for _ in range(300)] + ["<|endoftext|>x<|startoftext|>", "ab" * 400, "₿𞤀x"]
    for x in [*odd, *(x for _, x in texts[:60])]:
        want = t.encode(x, add_special_tokens=False).ids
        assert b.encode(x) == " ".join(map(str, want))
        assert b.decode(b.encode(x)) == t.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("block_bytes", [6 << 20, 40_000])
def test_suffix_dedup(docs, texts, block_bytes):
    first, want = {}, {}
    data = [(i, x.encode()) for i, x in texts]
    for i, x in data:
        for p in range(len(x) - 49):
            first.setdefault(x[p : p + 50], i)
    for i, x in data:
        cover = bytearray(len(x))
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < i:
                cover[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(x, cover) if not m)
        want[i] = (len(x), len(x) - len(kept), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, block_bytes=block_bytes).collect()}
    assert got == want


@pytest.mark.parametrize("block_bytes", [6 << 20, 40_000])
def test_window_dedup(docs, texts, block_bytes):
    seen, want = set(), {}
    for i, x in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        gone = set()
        for p in range(len(words) - 19):
            w = tuple(words[p : p + 20])
            if w in seen:
                gone |= set(range(p, p + 20))
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        want[i] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in window_dedup.remove_repeated_windows(docs, block_bytes=block_bytes).collect()}
    assert got == want


def test_run_index_is_incremental():
    index = window_dedup.RunIndex()
    rng = np.random.default_rng(0)
    seen = set()
    for _ in range(30):
        k = np.unique(rng.integers(0, 3000, 200).astype(np.uint64))
        hit = index.ingest(k, (k % np.uint64(7)).astype(np.uint16))
        assert hit.tolist() == [x in seen for x in k.tolist()]
        seen |= set(k.tolist())
    assert len(index.runs) <= 12
    assert not index.probe(np.array([5], np.uint64), np.array([9], np.uint16)).any()  # the check value differs


def test_simhash_fingerprints_and_components(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {}
    for i, x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sh = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            low = min(root[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4)
            if low < root[i]:
                root[i], changed = low, True
    assert root == {i: r.component_id for i, r in got.items()}


def test_dense_buckets_keep_every_link():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    x = np.unique(np.concatenate([np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(400)], np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    keys, members = simhash._filed(x)
    order = np.argsort(keys, kind="stable")
    u, v = simhash.bucket_links(keys[order], members[order])

    def groups(pairs):
        root = {int(a): int(a) for a in x}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in pairs:
            p, q = find(int(a)), find(int(b))
            root[max(p, q)] = min(p, q)
        return {a: find(a) for a in root}

    want = groups((a, b) for i, a in enumerate(x) for b in x[i + 1 :] if int(a ^ b).bit_count() <= 4)
    assert groups(zip(u, v)) == want
    assert all(int(a ^ b).bit_count() <= 4 for a, b in zip(u, v))


def test_decontamination_recall():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60)))) for k in range(40)]
    b = decontaminate.Benchmark.build(items)
    for rate, least in ((0.0, 1.0), (0.03, 0.97), (0.08, 0.9)):
        planted, docs = [], []
        for _ in range(120):
            k, t = rng.choice(items)
            copy = "".join(c if rng.random() > rate else rng.choice("abcdefgh ") for c in t)
            fill = [rng.choice(words) for _ in range(100)]
            at = rng.randrange(100)
            planted.append(k)
            docs.append(decontaminate.normal(" ".join(fill[:at]) + " " + copy + " " + " ".join(fill[at:])))
        found = b.search(docs)
        assert sum(k in [b.ids[h[0]] for h in f] for k, f in zip(planted, found)) >= least * len(docs)
    clean = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(100)]
    assert not any(b.search(clean))


def test_edit_distance_is_exact():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 80))) for _ in range(2))
        assert decontaminate.best_distance(p, t, 99)[0] == plain(p, t)


def test_nearest_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in e.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in ann.nearest(e).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q, v in zip(ids, x):
        if q % 20 == 0:
            s = x @ v
            want = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
            hits, total = hits + len(got[q] & set(want)), total + 20
    assert hits / total >= 0.9


def test_toxicity_held_out(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))  # noqa: E741
    rows = toxicity.classify(d, l).filter("held_out").join(l, "doc_id").select("score", "predicted", "toxic").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * np.mean(s[y == 1][:, None] == s[y == 0][None, :]) > 0.85
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95


def test_extraction_of_unseen_layouts():
    model = html_extract.train([])
    rng = random.Random(77)
    exact = 0
    for _ in range(60):
        page, mark = html_extract.generate(rng)
        nodes = html_extract.parse(page)
        y = [False] * len(nodes)
        for n in nodes:
            inside = mark in n.tokens or (n.parent is not None and y[n.parent.order])
            y[n.order] = inside and n.tag not in ("aside", "form") and not (n.tag != "p" and n.tokens - {mark} and mark not in n.tokens)
        exact += html_extract.extract(model, [re.sub(f"{mark} ?", "", page)])[0] == html_extract.text_of(nodes, y)
    assert exact >= 50


def test_decoding_has_no_content_below_dropped(spark):
    nodes = html_extract.parse("<body><article><p>a<div class=ad><p>b</div><p>c</article></body>")
    rng = np.random.default_rng(0)
    for _ in range(200):
        c = html_extract.decode(nodes, rng.standard_normal(len(nodes)) * 3)
        for n in nodes:
            above = []
            p = n.parent
            while p is not None:
                above.append(bool(c[p.order]))
                p = p.parent
            if c[n.order] and any(above):
                assert above[: above.index(False)].count(True) == sum(above)  # content is one stretch from its top down
