"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, bpe, decontaminate, html_extract, lm_score, simhash, suffix_dedup, toxicity, url_filter, window_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows; the extra columns clash with names the operators use inside."""
    same = "one two three four five six seven eight nine ten " * 5
    rows = [(1, same), (2, same), (2, same), (3, None), (4, ""), (5, "   \n\t "), (6, LONG), (7, "é" * 200), (8, "short"), (None, same), (None, None)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return d.withColumn("block", F.lit(9)).withColumn("fp", F.lit("x")).withColumn("score", F.lit("y")).withColumn("bucket", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df):
    return df.collect()


def test_bpe(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = rows(bpe.encode_decode(docs, path))
    assert len(got) == 11 and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert rows(bpe.encode_decode(empty, path)) == []


def test_window_dedup(docs, empty):
    got = {}
    for r in rows(window_dedup.remove_repeated_windows(docs)):
        got.setdefault(r.doc_id, []).append(r)
    # the words of row 1 repeat within it, so only its first period is new; later copies lose everything
    assert got[1][0].n_removed == 40
    assert got[2][0].n_words == 50 and got[2][0].n_removed == 50
    assert [r.n_removed for r in got[None]] == [0, 0] and got[3][0].n_words == got[4][0].n_words == got[5][0].n_words == 0
    assert got[6][0].n_words == 30_000 and got[6][0].n_removed == 0
    assert rows(window_dedup.remove_repeated_windows(empty)) == []


def test_suffix_dedup(docs, empty):
    got = {}
    for r in rows(suffix_dedup.remove_repeats(docs)):
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].n_removed == 0  # repeats inside one document stay
    assert all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in got[2])
    assert all(r.n_removed == 0 for k in (3, 4, 5, 6, 7, 8, None) for r in got[k])
    assert rows(suffix_dedup.remove_repeats(empty)) == []
    kept = suffix_dedup.remove_repeats(docs, in_place=True)
    assert kept.columns == docs.columns and kept.count() == 11
    assert rows(suffix_dedup.remove_repeats(empty, in_place=True)) == []


def test_simhash(docs, empty):
    got = rows(simhash.near_duplicates(docs))
    assert len(got) == 11
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (3, 4, 5)} == {("0" * 16, 3)}
    assert rows(simhash.near_duplicates(empty)) == []


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert len(rows(toxicity.classify(docs, labels))) == 11
    assert {r.score for r in rows(toxicity.classify(docs, labels.limit(0)))} == {0.0}
    assert rows(toxicity.classify(empty, labels)) == []
    lexicon = toxicity.Lexicon({"idiot": 5.0, "trash": 5.0})
    assert lexicon.score("you ID10T") == lexicon.score("you idiot") > lexicon.score("you trash can") == lexicon.score(None)
    assert lexicon.score("you іdiоt") == lexicon.score("you idiot")  # Cyrillic letters
    assert lexicon.score("idiot") > lexicon.score("idiot " + "word " * 500)


def test_decontaminate(spark, docs, empty):
    passage = "the quick brown fox jumps over the lazy dog and then walks home through the quiet field"
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "tiny"), (1, passage)], "item_id long, text string")
    leak = spark.createDataFrame([(100, "before " * 50 + passage.upper() + " after" * 50, "en", "s", 1), (101, "b " + passage.replace("lazy", "lasy").replace("home", "hme"), "en", "s", 1)], DOCS)
    d = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(leak)
    got = rows(decontaminate.find_leaks(d, items))
    assert {(r.doc_id, r.item_id) for r in got} == {(100, 1), (101, 1)}
    assert {r.edits for r in got if r.doc_id == 100} == {0} and {r.edits for r in got if r.doc_id == 101} == {2}
    assert decontaminate.keep_clean(d, items).count() == 11
    assert rows(decontaminate.find_leaks(empty, items)) == [] and rows(decontaminate.find_leaks(d, items.limit(0))) == []


def test_lm_score(docs, empty):
    got = {r.doc_id: r for r in rows(lm_score.score(docs, lm_score.train(docs)))}
    assert got[4].n_tokens == 0 and got[4].log_likelihood == 0 and got[4].mean_log_likelihood is None
    assert got[1].mean_log_likelihood < 0
    assert rows(lm_score.score(empty, lm_score.train(empty))) == []


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<body><nav>menu</nav><article><h1>T</h1><p>a &amp; b<p>c</article></body>"), (1, None, None), (2, "u", ""), (3, "u", "plain"), (None, "u", "<div>" * 2000 + "deep")], "page_id long, url string, html string")
    model = html_extract.train_on(pages)
    got = rows(html_extract.extract_pages(pages, model))
    assert [r.text for r in got][:4] == ["T a & b c", "", "", "plain"] and all(r.n_chars == len(r.text) for r in got)
    assert rows(html_extract.extract_pages(pages.limit(0), html_extract.train_on(pages.limit(0)))) == []


def test_urls(spark):
    pages = spark.createDataFrame([(1, "HTTP://A.Example.ORG/x?q"), (2, None), (3, "no scheme"), (4, "http://b.net#f"), (4, "http://b.net#f"), (5, "http://c.net/a://b"), (None, "http://d.com/fr/1")], "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(4, False), (5, True), (1, None)], "page_id long, good boolean")
    rules = [url_filter.Rule("allow", "org/"), url_filter.Rule("block", "example.org/x")]
    got = {r.page_id: r for r in rows(url_filter.filter_urls(pages, outcomes, rules))}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/x", "example.org/x", "block")
    assert (got[2].host, got[2].path, got[2].rule) == ("", "", None) and (got[3].host, got[3].path) == ("", "")
    assert (got[4].host, got[4].path) == ("b.net", "") and got[5].path == "/a://b"
    assert len(rows(url_filter.filter_urls(pages, outcomes.limit(0)))) == 7 and rows(url_filter.filter_urls(pages.limit(0), outcomes)) == []


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = [[float(x) for x in rng.standard_normal(8)] for _ in range(60)]
    data = [(i, x) for i, x in enumerate(v)] + [(100, v[3]), (101, v[3]), (102, None), (103, [0.0] * 8), (104, [float("nan")] * 8), (105, [1.0, None] * 4), (None, v[0]), (120, v[3])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(d).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    real = {i: np.array(np.array(x, np.float32), float) for i, x in data if i is not None and x is not None and i not in (103, 104, 105)}
    assert set(got) == {i for i in real if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-float(real[q] @ x), i) for i, x in real.items() if i != q))[:20]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in want]
    few = spark.createDataFrame([(0, v[0]), (1, v[1])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r["rank"]) for r in ann.nearest(few).collect()] == [(0, 1, 1)]
    assert ann.nearest(few.limit(0)).collect() == []


def test_pipeline_stages(spark, docs, tmp_path):
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item that is long enough to be searched for in documents")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        counts.append(d.count())
    assert counts[0] == 11 and counts[1] < counts[0] and counts[2] == counts[3] == counts[4] == counts[1]
    e = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        e = stage(spark, e, str(tmp_path))
        assert e.count() == 0


def test_suffix_dedup_blanks_rows_not_ids(spark):
    a, b = "a text that two rows have, long enough to count as a repeat of fifty bytes", "only one row has this text, and it shares its id with a copy of the other"
    data = [(1, a), (2, a), (2, b), (3, ""), (4, None), (4, b[::-1]), (5, b)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for block_bytes in (4 << 20, 80):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs, block_bytes=block_bytes).collect())
        assert got == sorted([(1, len(a), 0), (2, len(a), len(a)), (2, len(b), 0), (3, 0, 0), (4, 0, 0), (4, len(b), 0), (5, len(b), len(b))])
