"""Nearest neighbours over many cells against brute force, and how much the stop saves where vectors form clusters."""

import numpy as np
import pytest

from millrace.llm import ann


def clustered(n, d=32, clusters=150, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, d))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def truth(x, ids, k=20):
    return {int(q): [int(i) for i in sorted(ids, key=lambda i: (-s[i], i)) if i != q][:k] for q in ids if q % 20 == 0 for s in [x @ x[q]]}


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_recall_over_cells(spark, kind):
    x = clustered(3000) if kind == "clustered" else np.random.default_rng(2).standard_normal((3000, 32))
    x[100:1100] = x[0]  # a third of all rows are one vector
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, [float(y) for y in x[i]]) for i in ids], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(df, cell_rows=256).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = truth(x, ids)
    assert set(got) == set(want) and all(sorted(g)[k][0] == k + 1 for g in got.values() for k in range(20))
    hits = sum(len({v for _, v, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert [v for _, v, _ in sorted(got[0])] == list(range(100, 120))  # ties go to smaller ids
    assert all(abs(s - float(x[q] @ x[v])) < 1e-9 for q in got for _, v, s in got[q])


def test_the_stop_saves_work_on_clusters():
    x = clustered(16_384)
    space = ann.Space(x.shape[1], float((x * x).sum(1).max()))
    q = x[::164]
    place, found, _, verified = ann.search_part(space, q, np.arange(len(x)), x, 20)
    exact = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :20]
    recall = np.mean([len(set(found[place == i].tolist()) & set(exact[i].tolist())) / 20 for i in range(len(q))])
    leaves = len(ann.KdTree(space.lifted(x) @ space.directions).low)
    assert recall >= 0.9 and verified <= 0.3 * len(q) * leaves, (recall, verified / len(q) / leaves)
