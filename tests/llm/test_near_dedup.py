"""The pipeline's near-duplicate stage against brute force, and rows that share an id."""

import random

import corpus_pipeline
from millrace.llm import shingle_dedup


def five_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    a, b = five_words(a), five_words(b)
    return len(a & b) / len(a | b)


def edited(words, rng, n):
    out = list(words)
    for p in rng.sample(range(len(out)), n):
        out[p] = f"new{rng.randrange(10**9)}"
    return out


def test_recall_at_080_to_095(spark):
    rng = random.Random(5)
    rows, near, far, bands = [], set(), set(), set()
    for k in range(160):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        first, second = " ".join(words), " ".join(edited(words, rng, 1 + k % 6))
        rows += [(2 * k, first), (2 * k + 1, second)]
        s = similarity(first, second)
        (near if s >= 0.8 else far).add(2 * k + 1)
        bands.add(round(s, 1))
    assert {0.8, 0.9} <= bands and far
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {i for i, _ in rows} - near


def test_chain_and_shared_ids(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    chain = [words]
    for _ in range(40):
        chain.append(edited(chain[-1], rng, 2))
    rows = [(10 + k, " ".join(w)) for k, w in enumerate(chain)]
    rows += [(5, "one text of its own that nobody else has"), (7, "one text of its own that nobody else has"), (7, "another text that only this row has at all"), (8, None), (9, ""), (None, rows[0][1]), (3, "twice the same row here now"), (3, "twice the same row here now")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got)
    assert have == sorted([(10, rows[0][1]), (-1, rows[0][1]), (5, "one text of its own that nobody else has"), (7, "another text that only this row has at all"), (8, ""), (3, "twice the same row here now")])


def test_links_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets = {i: shingle_dedup.shingles(x) for i, x in texts}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j:
                both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                either = len(sets[i]) + len(sets[j]) - both
                if not either or both >= 0.8 * either:
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {i for i in sets if top(i) == i}
