"""Anchors of shared lines, their credit, and the sequential steps by themselves."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import anchors as A
from millrace.operators import near
from millrace.operators.joins import pair_budget

COMMON = ["for line in sys.stdin:", "    total += int(line)", "total //= 3"]
TAILS = [["print(total)"], ["sys.exit(total)"], ["print(total)", "log.close()"], []]
ANSWERS = [COMMON + tail for tail in TAILS]


def test_common_lines_are_one_anchor_of_all_answers():
    found = A.anchors_of_prompt([(row, 0, "none", lines) for row, lines in enumerate(ANSWERS)], similar=1.0)
    widest = max(found, key=len)
    assert {o.row for o in widest} == {0, 1, 2, 3} and {o.text for o in widest} == {"\n".join(COMMON)}
    places = [(o.row, k) for g in found for o in g for k in range(o.first, o.end)]
    assert len(places) == len(set(places))  # no line lies in two anchors


def test_nothing_in_common():
    alone = [(0, 0, "none", COMMON)]
    different = [(k, 0, "none", [f"value_{k} = {k}"]) for k in range(4)]
    for roots in ([], alone, different, [(0, 0, "none", []), (1, 0, "none", [])]):
        assert A.anchors_of_prompt(roots, similar=1.0) == []


def test_blocks():
    assert A.shared_blocks(["a", "b", "c"], ["a", "b", "d"], similar=1.0) == [((0, 2), (0, 2), "a\nb")]
    assert A.shared_blocks(["x = 1"], ["x = 12"], similar=0.8) == [((0, 1), (0, 1), "x = 12")]
    assert A.shared_blocks(["a", "b"], ["a", "c"], least_lines=2, similar=1.0) == []


def test_choice_covers_and_stops():
    groups = [[(1,), (2,)], [(1,), (2,)], [(3,), (4,), (5,)]]
    assert A.choose_by_gain(groups, [0.5, 0.4, 0.5], 0) == [2, 0]
    assert A.choose_by_gain(groups, [0.5, 0.4, 0.5], 1) == [2] and A.choose_by_gain([], [], 3) == []


def test_merge_attaches_once():
    o = lambda row, text: A.Occurrence(row, 0, 0, 1, text)
    merged = A.merge_by_support([[o(0, "abcdefgh")], [o(1, "abcdefgx"), o(2, "abcdefgx")], [o(3, "zzzz")]], 0.8)
    assert [sorted(x.row for x in g) for g in merged] == [[0, 1, 2], [3]]


def test_credit_of_grouped_tokens(spark):
    rows = [(0, i, 0, "none", COMMON) for i in range(4)]
    roots = spark.createDataFrame(rows, "uid int, row_id long, root int, edit_type string, lines array<string>")
    rewards = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 0.0), (3, 0.0)], "row_id long, reward double")
    credit = A.anchor_credit(A.find_anchors(roots, similar=1.0), rewards)
    assert {(r.row_id, r.credit) for r in credit.collect()} == {(0, 0.5), (1, 0.5), (2, -0.5), (3, -0.5)}
    tokens = rewards.select("row_id", (F.col("reward") - 0.5).alias("advantage"), F.array(*(F.lit(x) for x in (1, 1, 1, 0))).alias("mask"))
    spans = credit.select("row_id", F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit(1.0).alias("gs"), "credit")
    got = {r.row_id: r.token_advantage for r in A.spread_credit(tokens, spans).collect()}
    assert got[0] == [0.5, 1.0, 1.0, 0.0] and got[2] == [-0.5, -1.0, -1.0, 0.0]
    assert A.diagnostics(credit).first().asDict() == {"n_anchors": 1, "mean_group_size": 4.0, "median_group_size": 4.0, "n_occurrences": 4}


FALLBACK = "row_id long, uid int, level int, changed boolean, origin string, signature string, source string"


def group_sizes(spark, sources, uids, changed=None, **options):
    rows = [(i, u, 1, True if changed is None else changed[i], "fallback", "stmt::Return", x) for i, (u, x) in enumerate(zip(uids, sources))]
    found = A.fallback_groups(spark.createDataFrame(rows, FALLBACK), 1, "uid", "signature", **options)
    return sorted(r["count"] for r in found.groupBy("uid", "group_id").count().collect())


def test_fallback_groups(spark):
    sources = ["yield top(heap)"] * 4 + ["yield None"]
    assert group_sizes(spark, sources, [7] * 5) == [1, 4]
    assert group_sizes(spark, sources, [7, 7, 8, 8, 8]) == [1, 2, 2]
    assert group_sizes(spark, sources, [7] * 5, [False, True, True, True, True]) == [1, 3]


def test_fallback_groups_by_similarity(spark):
    sources = ["yield top(heap)", "yield top(heap2)", "yield None", "yield top(heaps)", "yield None"]
    assert group_sizes(spark, sources, [7] * 5) == [1, 1, 1, 2]
    assert group_sizes(spark, sources, [7] * 5, threshold=0.8) == [2, 3]
    assert group_sizes(spark, sources, [7, 7, 7, 8, 8], threshold=0.8) == [1, 1, 1, 2]


@pytest.mark.parametrize("n, budget, size", [(1, 5, 0), (5, 0, 0), (5, -1, 10), (5, 10, 10), (30, 64, 64)])
def test_pair_budget(n, budget, size):
    pairs = pair_budget(n, budget)
    assert len(pairs) == size and all(0 <= i < j < n for i, j in pairs)


def plain_merge(groups, similar):
    kept = []
    for g in sorted(groups, key=len, reverse=True):
        home = next((own for text, own in kept if A.SequenceMatcher(None, g[0].text, text).ratio() >= similar), None) if similar < 1 else None
        if home is None:
            kept.append((g[0].text, list(g)))
        else:
            home.extend(g)
    return [A.largest_by_row(own) for _, own in kept]


@pytest.mark.parametrize("similar", [0.6, 0.8, 0.9, 0.97, 1.0])
def test_merge_equals_all_ratios(similar):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    texts = ["", " ", "a", "ab", "ba", "a" * 300, "a" * 300, "a" * 700 + "b", "a" * 700 + "c", "\ud800x"]
    for n in (2, 5, 20, 60, 120):
        base = [rng.choice(words) for _ in range(n)]
        for changed in (0, 1, 2, n // 10, n // 4):
            own = list(base)
            for _ in range(changed):
                own[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    groups = [[A.Occurrence(10 * k + j, 0, 0, 1, t) for j in range(rng.randint(1, 3))] for k, t in enumerate(texts)]
    assert A.merge_by_support(groups, similar) == plain_merge(groups, similar)


def test_merge_aligns_few_unrelated_texts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)) for _ in range(120)]
    aligned = []
    ratio = A.SequenceMatcher.ratio
    monkeypatch.setattr(A.SequenceMatcher, "ratio", lambda self: aligned.append(1) or ratio(self))
    groups = [[A.Occurrence(k, 0, 0, 1, t)] for k, t in enumerate([*texts, texts[5] + " more"])]
    assert len(A.merge_by_support(groups, 0.9)) == 120 and len(aligned) < 100  # of 7,260 pairs


@pytest.mark.parametrize("least", [0.5, 0.9, 1.0])
def test_near_texts_equal_all_ratios(spark, monkeypatch, least):
    monkeypatch.setattr(near, "PIECE_ROWS", 8)
    rng = random.Random(5)
    texts = ["", "a", "ab", "ba", "a" * 300, "a" * 303]
    for n in (1, 3, 30, 200):
        for _ in range(6):
            base = [rng.choice("abc de\U0001f600") for _ in range(n)]
            for changed in (0, 1, n // 20, n // 8):
                own = list(base)
                for _ in range(changed):
                    own.insert(rng.randrange(len(own)), own.pop(rng.randrange(len(own)))) if rng.random() < 0.5 else own.append("x")
                texts.append("".join(own))
    texts = list(dict.fromkeys(texts))
    rng.shuffle(texts)
    rows = [(k % 2, k, t, k % 3 > 0) for k, t in enumerate(texts)]
    reached = lambda a, b: A.SequenceMatcher(None, texts[a], texts[b]).ratio() >= least
    pairs = [(p, a, b) for p, a, _, x in rows for q, b, _, y in rows if a < b and p == q and (x or y) and texts[a] and texts[b]]
    expected = {(p, a, b, reached(a, b), reached(b, a)) for p, a, b in pairs}
    got = near.near_texts(spark.createDataFrame(rows, "part long, id long, text string, new boolean"), least).collect()
    found = [(r.part, r.a, r.b, r.ab, r.ba) if r.a < r.b else (r.part, r.b, r.a, r.ba, r.ab) for r in got]
    assert len(found) == len(set(found)) and set(found) == {x for x in expected if x[3] or x[4]}


def odd_roots(seed, prompts=3, rows=70):
    """Roots of few lines with copies, near copies, shared and repeated lines, blank ones, rows of several roots, null keys and kinds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    lines = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(25)] + [" ", "", "a" * 260, "x\ny"]
    made, out = [], []
    for k in range(prompts * rows):
        own = [rng.choice(lines) if rng.random() < 0.4 else " ".join(word() for _ in range(9)) for _ in range(rng.randint(0, 7))]
        if made and rng.random() < 0.5:
            own = list(rng.choice(made))
            for _ in range(rng.choice([0, 0, 1, 2])):
                if own:
                    n = rng.randrange(len(own))
                    own[n] = own[n] + rng.choice(["", "z", " end"]) if rng.random() < 0.8 else word()
        made.append(own)
        out.append((rng.choice([None, 5, 7]), k // 2, k % 2, rng.choice(["add", "del", None]), own))
    return out


@pytest.mark.parametrize("seed, options", [(1, {"similar": 0.9}), (2, {"similar": 0.6, "least_lines": 2}), (3, {"similar": 0.97, "budget": -1}), (4, {"similar": 1.0}), (5, {"similar": 0.8, "budget": -1})])
def test_find_anchors_equals_all_pairs(spark, monkeypatch, seed, options):
    monkeypatch.setattr(near, "PIECE_ROWS", 16)  # several pieces a band
    roots = odd_roots(seed)
    expected = set()
    for uid in (None, 5, 7):
        own = sorted((r for r in roots if r[0] == uid), key=lambda r: r[1:3])
        expected |= {(uid, k, *o[:4]) for k, g in enumerate(A.anchors_of_prompt([r[1:] for r in own], **options)) for o in g}
    got = A.find_anchors(spark.createDataFrame(roots, "uid int, row_id long, root int, edit_type string, lines array<string>"), **options).collect()
    assert len(got) == len(expected) > 0 and {tuple(r) for r in got} == expected


def test_roots_beyond_any_budget_share_an_anchor(spark):
    """Of 40 roots only the last two share lines; 64 pairs from the first roots would miss them."""
    rows = [(0, k, 0, "none", [f"{k} is {'abcdefghij'[k % 10] * (k + 3)}"]) for k in range(38)] + [(0, k, 0, "none", [*COMMON, end * 60]) for k, end in ((38, "x"), (39, "y"))]
    found = A.find_anchors(spark.createDataFrame(rows, "uid int, row_id long, root int, edit_type string, lines array<string>"), similar=0.9).collect()
    assert {(r.row_id, r.first, r.end) for r in found} == {(38, 0, 3), (39, 0, 3)}
