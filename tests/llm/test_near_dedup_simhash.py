"""The near-duplicate stage finds its candidates by SimHash; bands are beside it."""

import random

import corpus_pipeline
from millrace.llm import shingle_dedup as S


def test_a_copy_that_no_band_holds(spark):
    words = [f"w300002220x{i}" for i in range(14)]  # 9 shingles each, 8 of them in both: similarity 0.8
    first, second = S.shingles(" ".join(words[:-1])), S.shingles(" ".join(words[1:]))
    assert not set(S.band_keys(first).tolist()) & set(S.band_keys(second).tolist())
    assert (S.fingerprint(first) ^ S.fingerprint(second)).bit_count() <= 4
    rows = [(1, " ".join(words[:-1])), (2, " ".join(words[1:])), (3, "something else altogether, of more than five words")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_fingerprint_and_components_equal_plain_ones(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for p in base for _ in range(5)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    root = list(range(len(prints)))
    for _ in prints:
        for i, p in enumerate(prints):
            root[i] = min(root[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4)
    keys = {r.digest: r.key for r in S._components(spark.createDataFrame(signed, "digest long, fp long")).collect()}
    assert all((root[i] == root[j]) == (keys[i] == keys[j]) for i in keys for j in keys) and len(keys) == len(prints)
    found = S.shingles(" ".join(f"a{i}" for i in range(60)))
    assert S.fingerprint(found) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in found) > len(found))
