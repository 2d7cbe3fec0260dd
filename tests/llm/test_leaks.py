"""Leaks that sparse windows miss: short items, odd word places, text without spaces, edits up to the accepted fifth."""

import random

from millrace.llm import decontaminate

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def edited(text, n):
    out = list(text)
    for _ in range(n):
        p, r = RNG.randrange(len(out)), RNG.random()
        if r < 0.4:
            out[p] = RNG.choice("qrstuvwxyz")
        elif r < 0.7:
            out.insert(p, RNG.choice("qrstuvwxyz"))
        else:
            del out[p]
    return "".join(out)


def share_found(items, rate, tries=150, unspaced=False):
    b = decontaminate.Benchmark.build(list(enumerate(items)))
    planted, docs = [], []
    for k in range(tries):
        item = RNG.randrange(len(items))
        copy = edited(items[item], int(rate * len(items[item])))
        fill = [RNG.choice(WORDS) for _ in range(60 + k % 2)]
        at = RNG.randrange(60)
        gap = "" if unspaced else " "
        docs.append(decontaminate.normal(gap.join([*fill[:at], copy, *fill[at:]])))
        planted.append(item)
    return sum(p in [f[0] for f in found] for p, found in zip(planted, b.search(docs))) / tries


def test_short_items_and_odd_places():
    short = ["".join(RNG.choice("abcdefghijklm") for _ in range(16)) + " " + " ".join(RNG.sample(WORDS, 4)) for _ in range(20)]
    assert share_found([x[:41] for x in short], 0) == 1
    assert share_found([x[:41] for x in short], 0.19) == 1
    assert share_found([x[:25] for x in short], 0.15) == 1


def test_text_without_spaces():
    items = ["".join(RNG.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(60)) for _ in range(20)]
    assert share_found(items, 0, unspaced=True) == 1


def test_edits_up_to_a_fifth():
    items = [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(15, 60))) for _ in range(40)]
    for rate, least in ((0.1, 0.99), (0.15, 0.97), (0.19, 0.95)):
        share = share_found(items, rate, 300)
        print(rate, share)
        assert share >= least


def least_edits(item, text):
    """Plain table: least edits between an item and any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (a != b))
    return min(row)


def test_exactly_a_fifth_is_found():
    items = [" ".join(RNG.choice(WORDS) for _ in range(30))[: 5 * n] for n in (*range(1, 12), 20, 24, 30)]
    items = [decontaminate.normal(x + "x" * (-len(x.strip()) % 5)) for x in items]
    b = decontaminate.Benchmark.build(list(enumerate(items)))
    found = tries = 0
    for k, item in enumerate(items):
        for _ in range(8):
            out = list(item)
            for p in RNG.sample([p for p, c in enumerate(out) if c != " "], len(item) // 5):
                out[p] = "z" if out[p] != "z" else "y"
            doc = decontaminate.normal("vorher " + "".join(out) + " nachher")
            hits = b.search([doc])[0]
            assert least_edits(item, doc) <= len(item) // 5
            tries, found = tries + 1, found + (k in [h[0] for h in hits])
    assert found >= 0.97 * tries


def test_all_pairs_by_plain_edit_distance():
    items = [" ".join(RNG.choice(WORDS) for _ in range(n))[: 5 * (len(WORDS) // 40 + n)] for n in (2, 3, 5, 8, 11, 14, 18, 25)]
    items = [decontaminate.normal(x) for x in items]
    docs = []
    for _ in range(40):
        item = RNG.choice(items)
        rate = RNG.choice([0, 0.05, 0.1, 0.15, 0.2, 0.22, 0.3])
        fill = [RNG.choice(WORDS) for _ in range(12)]
        docs.append(decontaminate.normal(" ".join([*fill[:6], edited(item, int(rate * len(item))), *fill[6:]])))
    b = decontaminate.Benchmark.build(list(enumerate(items)))
    want, got = {}, {}
    for d, doc in enumerate(docs):
        for k, item in enumerate(items):
            if (n := least_edits(item, doc)) <= len(item) // 5:
                want[d, k] = n
        for k, n, _, _ in b.search([doc])[0]:
            got[d, k] = n
    assert got.items() <= want.items()
    assert len(got) >= 0.95 * len(want) and len(want) >= 20
    assert all(x in got for x, n in want.items() if n <= len(items[x[1]]) // 10)


def test_repeated_items_and_parts(spark, monkeypatch):
    items = [" ".join(RNG.choice(WORDS) for _ in range(30)) for _ in range(4)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate([*items, items[0], None, ""])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"aa {t} bb") for k, t in enumerate([*items, "nothing here"])], "doc_id long, text string")
    want = sorted([(0, 0), (0, 4), (1, 1), (2, 2), (3, 3)])
    for size in (1 << 20, 200):  # in one part, and in several
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()) == want
        assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [4]
