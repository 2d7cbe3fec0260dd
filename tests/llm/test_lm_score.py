"""The language model against plain versions: probabilities add up to one, gradients lower the loss, evidence equals brute force."""

import math
import random
from collections import Counter

import numpy as np

from millrace.llm import blocks, lm_score, slices
from millrace.llm.lm_score import EDGE, KINDS, PRIOR, VOCABULARY

SF = "/root/testdata/sf0.001"


def test_probabilities_add_up_to_one():
    net = lm_score.WindowNetwork()
    context = [np.full(VOCABULARY + KINDS, c) for c in (3, EDGE, 5, 77)]
    assert abs(np.exp(net.log_probability(context, np.arange(VOCABULARY + KINDS))).sum() - 1) < 1e-4


def test_both_sides_are_used_and_learned():
    rng = np.random.default_rng(1)
    net = lm_score.WindowNetwork()
    a, b = rng.integers(0, 8, 20_000), rng.integers(0, 8, 20_000)
    word = a * 8 + b  # known from both neighbours only
    context = [np.full(len(a), EDGE), a, b + 100, np.full(len(a), EDGE)]
    losses = [net.step([c[k : k + 2048] for c in context], word[k : k + 2048]) for _ in range(12) for k in range(0, len(a) - 2048, 2048)]
    assert losses[-1] < 0.5 * losses[0]
    left_only = [context[0], a, np.full(len(a), EDGE), context[3]]
    assert net.log_probability(context, word).mean() > net.log_probability(left_only, word).mean() + 0.5


def test_corpus_order_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm_score.train(docs)
    text = [r.text for r in docs.filter("lang = 'en' AND n_chars > 500").limit(20).collect()]
    rng = random.Random(4)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in text]
    real, other = model.score(text), model.score(mixed)
    assert real[0].tolist() == other[0].tolist() and real[1].sum() > other[1].sum()
    junk = [" ".join("".join(rng.choice("qxzjkv") for _ in range(9)) for _ in range(120)) for _ in range(40)]
    rows = [(10_000 + i, t) for i, t in enumerate(junk)] + [(20_000 + i, t) for i, t in enumerate(junk[:20])]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.mean_log_likelihood for r in lm_score.score(more, lm_score.train(more)).filter("doc_id >= 10000").collect()}
    assert min(got[10_000 + i] for i in range(20)) > max(got[10_020 + i] for i in range(20)) + 2  # those that occur twice are known


def test_evidence_equals_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(["a b c a b", "A b c", "", None, "x", "c a b d", "a b c a b"])] + [(None, "b c a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = lm_score.train(df)

    def windows(t):
        w = ["<>", *(t or "").lower().split(), "<>"]
        return [(w[i - 1], w[i], w[i + 1]) for i in range(1, len(w) - 1)]

    every = Counter(x for _, t in docs for x in windows(t))
    want = []
    for i, t in docs:
        own = Counter(windows(t))
        hashed, kind, n = lm_score.words([(t or "").encode()])
        s = 0.0
        for (a, w, b), p in zip(windows(t), np.exp(model.prior(hashed, kind, n))):
            left = Counter({k: v - own[k] for k, v in every.items()})
            s += math.log((left[a, w, b] + PRIOR * p) / (sum(v for k, v in left.items() if (k[0], k[2]) == (a, b)) + PRIOR))
        want.append((-1 if i is None else i, len(windows(t)), round(s, 4)))
    for block_bytes in (3 << 20, 8):
        got = lm_score.score(df, model, block_bytes=block_bytes).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.log_likelihood, 4)) for r in got) == sorted(want)
        assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) for r in got)


def test_counts_pack_exactly():
    n = np.array([1, 254, 255, 256, 10**12, 3])
    assert lm_score.unpack_counts(lm_score.pack_counts(n)).tolist() == n.tolist()
    assert len(lm_score.unpack_counts(lm_score.pack_counts(n[:0]))) == 0


def batch(n=500):
    rng = np.random.default_rng(7)
    return [rng.integers(0, EDGE + 1, n) for _ in range(4)], np.append(rng.integers(0, 64, n // 2), rng.integers(0, EDGE, n - n // 2))


def plain_forward(net, context, word):
    """Input, hidden values and both softmaxes of one word."""
    x = np.concatenate([*(net.embed[c] for c in context), [1]]).astype(float)
    h = np.append(np.tanh(x @ net.hidden), 1)
    a, b = np.exp(h @ net.classes), np.exp(h @ net.inside[word // lm_score.SLOTS])
    return x, h, a / a.sum(), b / b.sum()


def test_step_equals_plain_gradients():
    context, word = batch()
    net, plain = lm_score.WindowNetwork(), lm_score.WindowNetwork()
    grads = {name: np.zeros(shape) for name, shape in net.SHAPES.items()}
    loss = []
    for *near, w in zip(*context, word):
        (c, slot), (x, h, a, b) = divmod(w, lm_score.SLOTS), plain_forward(plain, near, w)
        loss.append(-math.log(a[c] * b[slot]))
        a[c] -= 1
        b[slot] -= 1
        grads["classes"] += np.outer(h, a) / len(word)
        grads["inside"][c] += np.outer(h, b) / len(word)
        dh = (plain.classes @ a + plain.inside[c] @ b)[:-1] * (1 - h[:-1] ** 2)
        grads["hidden"] += np.outer(x, dh) / len(word)
        dx = plain.hidden @ dh / len(word)
        for k, at in enumerate(near):
            grads["embed"][at] += dx[k * lm_score.EMBED : (k + 1) * lm_score.EMBED]
    assert abs(net.step(context, word) - np.mean(loss)) < 1e-4
    for name, g in grads.items():
        assert np.allclose(getattr(net, name), getattr(plain, name) - lm_score.RATE * g / np.sqrt(0.01 + g * g), atol=1e-5), name


def test_log_probability_equals_plain(monkeypatch):
    monkeypatch.setattr(lm_score, "ROWS", 64, raising=False)
    context, word = batch()
    net = lm_score.WindowNetwork()
    for scale in (1, 400):  # the larger weights could overflow
        net.classes *= np.float32(scale)
        net.inside *= np.float32(scale)
        want = []
        for *near, w in zip(*context, word):
            h = plain_forward(net, near, w)[1] if scale == 1 else np.append(np.tanh(np.concatenate([*(net.embed[c] for c in near), [1]]) @ net.hidden), 1)
            a, b = h @ net.classes, h @ net.inside[w // lm_score.SLOTS]
            want.append(sum(z[k] - z.max() - math.log(np.exp(z - z.max()).sum()) for z, k in ((a, w // lm_score.SLOTS), (b, w % lm_score.SLOTS))))
        assert np.allclose(net.log_probability(context, word), np.maximum(want, math.log(1e-37)), atol=1e-3 * scale)


def test_a_step_takes_softmaxes_of_all_classes_at_once(monkeypatch):
    """a step once took a softmax for each class of words apart, most of its CPU time."""
    calls, plain = [], lm_score.WindowNetwork._softmax
    monkeypatch.setattr(lm_score.WindowNetwork, "_softmax", staticmethod(lambda *a: calls.append(1) or plain(*a)))
    context, word = batch()
    net = lm_score.WindowNetwork()
    net.step(context, word)
    net.log_probability(context, word)
    assert len(calls) == 4


def test_groups_need_no_collection(monkeypatch):
    """a full collection after each group took some 50 ms of CPU time."""
    calls = []
    monkeypatch.setattr(slices.gc, "collect", lambda: calls.append(1))
    slices.tidy_group(lambda t: t, cycles=False)(None)
    slices.tidy_pair(lambda a, b: a, cycles=False)(None, None)
    assert not calls
    slices.tidy_group(lambda t: t)(None)
    assert calls


def test_stable_order():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3000):
        for free in (0, 4, 5, 20, 56):
            few = rng.integers(0, 2**64, max(1, n // 3), dtype=np.uint64)
            values = (rng.choice(few, n) >> np.uint64(free)) << np.uint64(free)
            ordered, order = blocks.stable_order(values, free)
            assert order.tolist() == np.argsort(values, kind="stable").tolist() and ordered.tolist() == np.sort(values).tolist()
    same = np.full(1000, 7 << 40, np.uint64)
    assert blocks.stable_order(same, 40)[1].tolist() == list(range(1000))


def test_runs_pack_as_each_alone():
    rng = np.random.default_rng(6)
    for n, bits in ((0, 64), (1, 64), (5000, 64), (5000, 34), (300, 12)):
        values = np.unique(rng.integers(0, 2**bits - 1, n, dtype=np.uint64))
        cuts = sorted({0, len(values), *rng.integers(0, len(values) + 1, 9).tolist()})
        cuts = [*cuts[:2], *cuts[1:]]  # an empty run
        got = list(blocks.pack_runs(values, cuts))
        assert [x[0] for x in got] == [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        for (_, a, b), data in got:
            assert data == blocks.pack_sorted(values[a:b]) and blocks.unpack_sorted(data, b - a)[0].tolist() == values[a:b].tolist()


def test_words_of_pieces():
    texts = [b"Ab c", b"", b"word " * 40_000, b"x", b" ", b"c ab " * 30_000, b"C"]
    every, apart = lm_score.words(texts), [lm_score.words([t]) for t in texts]
    for k in range(3):
        assert every[k].tolist() == np.concatenate([x[k] for x in apart]).tolist()
