"""Crawls deduplicated in turn against a stored index equal one run over all of them."""

import random

from millrace.llm import window_dedup


def test_crawls_in_turn(spark, tmp_path):
    rng = random.Random(8)
    shared = [" ".join(f"s{rng.randrange(10**6)}" for _ in range(45)) for _ in range(12)]
    docs = []
    for i in range(240):
        body = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60)))
        docs.append((i, body + " " + rng.choice(shared) + " " + body if i % 3 else body))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.n_removed, r.kept_sha256) for r in window_dedup.remove_repeated_windows(frame(docs), block_bytes=4000).collect()}
    index, turns, at = window_dedup.WindowIndex(spark, str(tmp_path / "index")), set(), 0
    for n in (100, 20, 60, 40, 20):
        part = window_dedup.remove_repeated_windows(frame(docs[at : at + n]), block_bytes=4000, index=index)
        turns |= {(r.doc_id, r.n_removed, r.kept_sha256) for r in part.collect()}
        at += n
    assert turns == whole
    runs = index.runs()
    assert 1 <= len(runs) < 5 and all(2 * b[1] < a[1] for a, b in zip(runs, runs[1:]))
    again = window_dedup.remove_repeated_windows(frame([(i + 1000, t) for i, t in docs]), block_bytes=4000, index=index).collect()
    assert all(r.n_removed == r.n_words or r.n_words < 20 for r in again)
