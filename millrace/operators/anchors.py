"""Line-alignment anchors of edits, and the credit they carry.

Rollouts of one prompt often write the same lines. Line blocks that several rollouts share become anchors: each anchor is
a group of occurrences (row, root, first line, end), scored by how large and how frequent it is. A bounded set of
non-overlapping anchors is chosen per prompt, and the reward differences inside each are credit for its lines.

Pairs that can share a block come from joins and are aligned one by one, wherever they lie; merging along links and the choice
are sequential per prompt and get numbers only. Scores, re-scoring and credit are columns and windows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from hashlib import md5
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.groupstats import groupability
from millrace.operators.joins import similar_groups
from millrace.operators.near import CHARS, GRAMS, common_grams, counted, least_shared, may_reach, near_texts, numbered, reaches
from millrace.operators.state import cut


class Occurrence(NamedTuple):
    """Lines [first, end) of a row's root edit, and their text."""

    row: int
    root: int
    first: int
    end: int
    text: str

    @property
    def size(self) -> int:
        return self.end - self.first


def alike(a: str, b: str, least: float) -> bool:
    return a == b or (least < 1 and may_reach(a, b, least) and reaches(a, b, least))


def shared_blocks(a: Sequence[str], b: Sequence[str], least_lines: int = 1, similar: float = 0.8) -> list[tuple[tuple[int, int], tuple[int, int], str]]:
    """(lines of a, lines of b, text) of equal blocks, and of replaced ones that are similar (the longer text stands for both)."""
    found = []
    for kind, *at in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        spans = (at[0], at[1]), (at[2], at[3])
        if kind not in ("equal", "replace") or max(e - s for s, e in spans) < least_lines:
            continue
        one, two = ("\n".join(lines[s:e]) for lines, (s, e) in zip((a, b), spans))
        if kind == "equal" or (one.strip() and two.strip() and alike(one, two, similar)):
            found.append((*spans, one if len(one) >= len(two) else two))
    return found


def largest_by_row(occurrences: Iterable[Occurrence]) -> list[Occurrence]:
    """One occurrence a row, the largest; the first of equals."""
    best: dict[int, Occurrence] = {}
    for o in occurrences:
        if o.row not in best or o.size > best[o.row].size:
            best[o.row] = o
    return list(best.values())


class FirstAlike:
    """Texts in the order they are added; ``find`` gives the place of the first one whose ratio to a text is at least ``least``.

    The ratio is taken only where upper bounds allow it: lengths, then characters and q-grams that both texts have, counted by
    hash buckets, then the q-grams themselves (hashes that meet can only raise a bound). So nothing is lost, and unrelated texts
    cost a thousand bytes of comparison, not an alignment."""

    CHUNK = 512

    def __init__(self, least: float):
        self.least, self.texts, self.grams = least, [], []
        self.size = np.zeros(0, np.int64)
        self.counts = np.zeros((0, CHARS + GRAMS), np.uint8)

    def add(self, text: str) -> None:
        n = len(self.texts)
        if n == len(self.size):
            room = max(16, n)
            self.size = np.append(self.size, np.zeros(room, np.int64))
            self.counts = np.append(self.counts, np.zeros((room, self.counts.shape[1]), np.uint8), 0)
        counts, grams = counted(text)
        self.size[n], self.counts[n] = len(text), np.minimum(counts, 255)
        self.texts.append(text)
        self.grams.append(numbered(grams))

    def find(self, text: str) -> int | None:
        """The ratio isn't symmetric; the text comes first."""
        own, grams = counted(text)
        grams = numbered(grams)
        over = np.maximum(own - 255, 0)
        lost = int(over[:CHARS].sum()), int(over[CHARS:].sum())  # what cut counts may hide
        own = np.minimum(own, 255).astype(np.uint8)
        matcher = SequenceMatcher(None, text)
        for at in range(0, len(self.texts), self.CHUNK):
            size = self.size[at : min(at + self.CHUNK, len(self.texts))]
            total = size + len(text)
            near = np.flatnonzero(2 * np.minimum(size, len(text)) >= self.least * total - 1e-9)
            both = np.minimum(self.counts[at + near], own)
            matched, least_grams = least_shared(total[near], self.least)
            ok = (both[:, :CHARS].sum(1, dtype=np.int64) + lost[0] >= matched - 1e-9) & (both[:, CHARS:].sum(1, dtype=np.int64) + lost[1] >= least_grams - 1e-9)
            for k, least in zip((at + near[ok]).tolist(), least_grams[ok].tolist()):
                if least > 0 and len(grams) and common_grams(grams, self.grams[k]) < least - 1e-9:
                    continue
                matcher.set_seq2(self.texts[k])
                if matcher.quick_ratio() >= self.least and matcher.ratio() >= self.least:
                    return k
        return None


def merge_by_support(groups: Sequence[Sequence[Occurrence]], similar: float) -> list[list[Occurrence]]:
    """Groups in order of support; each joins the first survivor whose first text is similar, once and for all."""
    kept: list[list[Occurrence]] = []
    heads = FirstAlike(similar)
    for g in sorted(groups, key=len, reverse=True):
        home = heads.find(g[0].text) if similar < 1 else None
        if home is None:
            kept.append(list(g))
            if similar < 1:
                heads.add(g[0].text)
        else:
            kept[home].extend(g)
    return [largest_by_row(own) for own in kept]


def choose_by_gain(groups: Sequence[Sequence[tuple]], scores: Sequence[float], budget: int, tolerance: float = 1e-12) -> list[int]:
    """Greedy facility location: each step takes the group that raises the sum of best scores over places the most."""
    best: dict[tuple, float] = defaultdict(float)
    chosen: list[int] = []
    left = list(range(len(groups)))
    while left and len(chosen) < (budget if budget > 0 else len(groups)):
        top, pick = tolerance, None
        for k in left:
            gain = sum(max(0.0, scores[k] - best[p]) for p in groups[k])
            if gain > top + (tolerance if pick is not None else 0):
                top, pick = gain, k
        if pick is None:
            break
        chosen.append(pick)
        left.remove(pick)
        for p in groups[pick]:
            best[p] = max(best[p], scores[pick])
    return chosen


def cut_overlaps(groups: Sequence[Sequence[Occurrence]], scores: Sequence[float]) -> list[list[Occurrence]]:
    """Per root, occurrences that don't overlap, by score and then length; each group keeps what is left of it, one a row."""
    everything = sorted(((-s, -o.size, k, n, o) for k, (g, s) in enumerate(zip(groups, scores)) for n, o in enumerate(g)), key=lambda x: x[:4])
    taken: dict[tuple[int, int], list[Occurrence]] = defaultdict(list)
    left: list[list[Occurrence]] = [[] for _ in groups]
    for _, _, k, _, o in everything:
        own = taken[o.row, o.root]
        if all(o.end <= t.first or t.end <= o.first for t in own):
            own.append(o)
            left[k].append(o)
    return [largest_by_row(g) for g in left]


def _score(g: Sequence[Occurrence], s0: float, ref: float) -> float:
    """Plain form of :func:`groupstats.groupability` at saturating form."""
    if len(g) < 2:
        return 0.0
    size = sum(o.size for o in g) / len(g)
    return (1 - math.exp(-size / s0)) * (1 - math.exp(-(len(g) - 1) / ref))


def anchors_of_prompt(roots: Sequence[tuple[int, int, str, Sequence[str]]], similar: float = 0.8, budget: int = 16, least_lines: int = 1, s0: float = 8.0, ref: float = 8.0) -> list[list[Occurrence]]:
    """Chosen anchors of (row, root, kind of edit, lines) of one prompt: whole roots and blocks shared in pairs of roots.

    All pairs of a kind of edit are aligned, one after the other: the plain form of ``find_anchors``, for a handful of roots."""
    roots = [r for r in roots if len(r[3])]
    if len(roots) < 2:
        return []
    buckets: dict[tuple, list[Occurrence]] = defaultdict(list)

    def file(kind: str, what: str, text: str, row: int, root: int, lines: Sequence[str], first: int, end: int) -> None:
        own = "\n".join(lines[first:end])
        if own.strip():
            buckets[kind, what, md5(text.encode()).digest()].append(Occurrence(row, root, first, end, own))

    for row, root, kind, lines in roots:
        file(kind, "whole", "\n".join(lines), row, root, lines, 0, len(lines))
    for kind in dict.fromkeys(r[2] for r in roots):
        same = [r for r in roots if r[2] == kind]
        for i, j in combinations(range(len(same)), 2):
            for *spans, text in shared_blocks(same[i][3], same[j][3], least_lines, similar):
                for (row, root, _, lines), (first, end) in zip((same[i], same[j]), spans):
                    file(kind, "block", text, row, root, lines, first, end)
    return chosen_anchors(merge_by_support([largest_by_row(b) for b in buckets.values()], similar), budget, s0, ref)


def chosen_anchors(groups: Sequence[Sequence[Occurrence]], budget: int, s0: float, ref: float) -> list[list[Occurrence]]:
    """Of merged groups in order: those chosen, without overlaps."""
    groups = [g for g in groups if _score(g, s0, ref) > 0]
    picked = [groups[k] for k in choose_by_gain([[o[:4] for o in g] for g in groups], [_score(g, s0, ref) for g in groups], budget)]
    return [g for g in cut_overlaps(picked, [_score(g, s0, ref) for g in picked]) if _score(g, s0, ref) > 0]


ALIGNED = "p long, kind int, h binary, at int, first int, end int, i int, j int, op int, side int"


def _aligned(least_lines: int, similar: float):
    """Occurrences of blocks that the members of two classes of equal lines share. Of a member's pairs with the other class, the first
    one in order stands for all; which of two roots comes first matters, so classes that interleave are aligned both ways."""

    def ways(r) -> Iterator[tuple]:
        one, two = np.sort(r.a_at), np.sort(r.b_at)
        for x, xs, y, ys in ((r.a_lines, one, r.b_lines, two), (r.b_lines, two, r.a_lines, one)):
            if xs[0] < ys[-1]:
                for op, (at, to, text) in enumerate(shared_blocks(list(x), list(y), least_lines, similar)):
                    h = md5(text.encode("utf-8", "surrogatepass")).digest()
                    if "\n".join(x[at[0] : at[1]]).strip():
                        for i in xs[xs < ys[-1]].tolist():
                            yield r.p, r.kind, h, i, *at, i, int(ys[np.searchsorted(ys, i, "right")]), op, 0
                    if "\n".join(y[to[0] : to[1]]).strip():
                        for j in ys[ys > xs[0]].tolist():
                            yield r.p, r.kind, h, j, *to, int(xs[0]), j, op, 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ALIGNED.split(", ")]
        for part in parts:
            rows: list[tuple] = []
            for r in part.itertuples(index=False):
                for row in ways(r):
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return run


def _homes(pdf: pd.DataFrame) -> pd.DataFrame:
    """(p, node, home): in order, each node joins the first earlier one that is alike and hasn't joined another."""
    home: dict[int, int] = {}
    for node, before in sorted(zip(pdf["node"].tolist(), pdf["before"].tolist())):
        if node not in home and before not in home:
            home[node] = before
    return pd.DataFrame({"p": pdf["p"].iloc[0], "node": list(home), "home": list(home.values())}).astype("int64")


ANCHORS = "p long, anchor int, row_id long, root int, first int, end int"


def find_anchors(roots: DataFrame, uid: str = "uid", similar: float = 0.8, budget: int = 16, least_lines: int = 1, s0: float = 8.0, ref: float = 8.0) -> DataFrame:
    """(uid, anchor, row_id, root, first, end) of frames with (uid, row_id, root, edit_type, lines): ``anchors_of_prompt`` of every prompt.

    All pairs of roots of a kind count. Two roots can give a block only if they share a line or their whole texts are alike, so a join by
    line and ``near_texts`` name the pairs that are aligned, and nothing is lost. Equal roots are one class, aligned once. Groups are
    merged along links of near texts. The merge and the choice are sequential: they get a prompt's links and places, as numbers."""
    kind = dict(roots.dtypes)[uid]
    own = roots.select(F.col(uid).cast(kind).alias("uid"), F.col("row_id").cast("long").alias("row_id"), F.col("root").cast("int").alias("root"), "edit_type", "lines").filter(F.size("lines") > 0)
    own = own.withColumn("_id", F.monotonically_increasing_id())
    own = own.withColumn("at", F.row_number().over(Window.partitionBy("uid").orderBy("row_id", "root", "edit_type", "lines", "_id"))).withColumn("p", F.min("_id").over(Window.partitionBy("uid")))
    own = own.withColumn("kind", F.min("at").over(Window.partitionBy("uid", "edit_type"))).withColumn("text", F.array_join("lines", "\n")).drop("_id", "edit_type")
    own = cut(own)  # numbers stay as they are
    filled = F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")
    classes = cut(own.groupBy("p", "kind", "lines").agg(F.min("at").alias("c"), F.sort_array(F.collect_list("at")).alias("ats"), F.first("text").alias("text")))

    # pairs of classes that may share a block
    by_line = classes.select("p", "kind", "c", F.explode(F.array_distinct("lines")).alias("line")).select("p", "kind", "c", F.xxhash64("line").alias("h"))
    ordered = lambda x: x.select("p", "kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    meet = lambda x, *on: x.withColumnRenamed("c", "a").join(x.withColumnRenamed("c", "b"), ["p", "kind", *on]).filter("a < b").select("p", "kind", "a", "b")
    texts = classes.filter(filled).groupBy("p", "text").agg(F.min("c").cast("long").alias("id"))
    of_text = classes.filter(filled).join(texts, ["p", "text"]).select("p", "kind", "c", "id")
    pairs = meet(by_line, "h").unionByName(meet(of_text, "id"))
    near = None
    if similar < 1:
        near = cut(near_texts(texts.select(F.col("p").alias("part"), "id", "text", F.lit(True).alias("new")), similar)).withColumnRenamed("part", "p")
        side = lambda c, i: of_text.select("p", "kind", F.col("c").alias(c), F.col("id").alias(i))
        linked = near.select("p", F.col("a").alias("ia"), F.col("b").alias("ib")).join(side("a", "ia"), ["p", "ia"]).join(side("b", "ib"), ["p", "kind", "ib"])
        pairs = pairs.unionByName(ordered(linked.select("p", "kind", "a", "b")))
    lines = lambda c: classes.select("p", F.col("c").alias(c), F.col("lines").alias(f"{c}_lines"), F.col("ats").alias(f"{c}_at"))
    both = pairs.distinct().join(lines("a"), ["p", "a"]).join(lines("b"), ["p", "b"])
    aligned = both.mapInPandas(_aligned(least_lines, similar), ALIGNED)
    # members of one class share all their lines
    copies = classes.filter((F.size("ats") > 1) & (F.size("lines") >= least_lines) & filled).select("p", "kind", F.unhex(F.md5("text")).alias("h"), F.size("lines").alias("end"), "ats", F.posexplode("ats").alias("n", "at"))
    copies = copies.select("p", "kind", "h", "at", F.lit(0).alias("first"), "end", F.col("ats")[0].alias("i"), F.when(F.col("n") == 0, F.col("ats")[1]).otherwise(F.col("at")).alias("j"), F.lit(0).alias("op"), F.when(F.col("n") == 0, 0).otherwise(1).alias("side"))

    # buckets: one occurrence a row, the largest, the first of equals
    zero = F.lit(0)
    seen = lambda *c: F.struct(*(F.col(x).alias(f"s{n}") if isinstance(x, str) else x.alias(f"s{n}") for n, x in enumerate(c)))
    whole = own.filter(filled).select("p", "kind", zero.alias("what"), F.unhex(F.md5("text")).alias("h"), "at", "row_id", "root", zero.alias("first"), F.size("lines").alias("end"), seen(zero, "at", zero, zero, zero, zero).alias("seen"))
    blocks = aligned.unionByName(copies).join(own.select("p", "at", "row_id", "root"), ["p", "at"])
    blocks = blocks.select("p", "kind", F.lit(1).alias("what"), "h", "at", "row_id", "root", "first", "end", seen(F.lit(1), "kind", "i", "j", "op", "side").alias("seen"))
    bucket = ["p", "kind", "what", "h"]
    rows = whole.unionByName(blocks).groupBy(*bucket, "row_id").agg(F.min("seen").alias("seen"), F.min(F.struct((F.col("first") - F.col("end")).alias("less"), F.col("seen").alias("seen"), "at", "root", "first", "end")).alias("best"))
    rows = cut(rows.select(*bucket, "row_id", "seen", "best.at", "best.root", "best.first", "best.end"))
    groups = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.min(F.struct("seen", "at", "first", "end")).alias("head"))
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), "head.seen")).cast("long"))
    merged = groups.withColumn("home", F.col("g"))
    if similar < 1:
        merged = _merged(cut(groups.select(*bucket, "g", "head.at", "head.first", "head.end")), own, texts, near, similar)

    # merged groups: one occurrence a row again, then the choice
    least = F.min(F.struct((F.col("first") - F.col("end")).alias("less"), "g", "root", "first", "end")).alias("best")
    members = rows.join(merged.select(*bucket, "g", "home"), bucket).groupBy("p", "home", "row_id").agg(least, F.min(F.struct("g", "seen")).alias("seen"))
    shared = members.groupBy("p", "home").agg(F.count("*").alias("n")).filter("n > 1").select("p", "home")
    members = members.join(shared, ["p", "home"]).select("p", "home", "row_id", "best.root", "best.first", "best.end", F.col("seen.g").alias("g"), *(F.col(f"seen.seen.s{n}").alias(f"s{n}") for n in range(6)))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "g", *(f"s{n}" for n in range(6))])
        merged: dict[int, list[Occurrence]] = defaultdict(list)
        for h, *o in zip(*(pdf[c].tolist() for c in ("home", "row_id", "root", "first", "end"))):
            merged[h].append(Occurrence(*o, ""))
        found = [(pdf["p"].iloc[0], k, *o[:4]) for k, g in enumerate(chosen_anchors(list(merged.values()), budget, s0, ref)) for o in g]
        return pd.DataFrame(found, columns=["p", "anchor", "row_id", "root", "first", "end"])

    found = members.groupBy("p").applyInPandas(choose, ANCHORS)
    return found.join(own.select("p", "uid").distinct(), "p").select("uid", "anchor", "row_id", "root", "first", "end")


def _merged(groups: DataFrame, own: DataFrame, texts: DataFrame, near: DataFrame, similar: float) -> DataFrame:
    """Groups with ``home``: each, in order, joins the first survivor whose first text is alike, once and for all.

    Texts that are roots have their links (``near``); links of the others are found here. Groups of one text are one node, as the first's
    home is that of all, but for the rare text whose ratio to itself falls short (long ones of frequent characters only)."""
    heads = groups.join(own.select("p", "at", "lines"), ["p", "at"])
    heads = heads.withColumn("text", F.array_join(F.slice("lines", F.col("first") + 1, F.col("end") - F.col("first")), "\n")).drop("lines")
    known = heads.groupBy("p", "text").agg(F.min("g").alias("least"), F.count("*").alias("many")).join(texts, ["p", "text"], "left")

    @F.pandas_udf("boolean")
    def itself(text: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([n == 1 or len(t) < 200 or reaches(t, t, similar) for t, n in zip(text, many)], dtype=bool)

    known = cut(known.select("p", "text", F.coalesce("id", -F.col("least")).alias("id"), F.col("id").isNull().alias("new"), "least", itself("text", "many").alias("one")))
    nodes = heads.join(known.select("p", "text", "id", "least", "one"), ["p", "text"]).select("p", "g", "id", F.when(F.col("one"), F.col("least")).otherwise(F.col("g")).alias("node"))
    nodes = cut(nodes)
    links = near.unionByName(near_texts(known.select(F.col("p").alias("part"), "id", "text", "new"), similar).withColumnRenamed("part", "p"))
    side = lambda c: nodes.select("p", F.col("id").alias(c), F.col("node").alias(f"{c}_node")).distinct()
    links = links.join(side("a"), ["p", "a"]).join(side("b"), ["p", "b"])
    later = F.col("a_node") > F.col("b_node")
    links = links.filter(F.when(later, F.col("ab")).otherwise(F.col("ba"))).select("p", F.greatest("a_node", "b_node").alias("node"), F.least("a_node", "b_node").alias("before"))
    homes = links.groupBy("p").applyInPandas(_homes, "p long, node long, home long")
    placed = nodes.join(homes, ["p", "node"], "left").select("p", "g", F.coalesce("home", "node").alias("home"))
    return groups.join(placed, ["p", "g"])


def rescore(members: DataFrame, *keys: str, size: str = "size", s0: float = 8.0, ref: float = 8.0, form: str = "saturating") -> DataFrame:
    """(keys, n, mean_size, gs) of groups; those of one member or without a score are dropped."""
    g = members.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(size).alias("mean_size"))
    return g.withColumn("gs", groupability(F.col("mean_size"), F.col("n"), s0, ref, form)).filter("n > 1 AND gs > 0")


def fallback_groups(snippets: DataFrame, level: int, *keys: str, threshold: float | None = None) -> DataFrame:
    """Eligible snippets (of the level, changed, not roots) with group_id: the least row of those with the same keys and source.

    With a ``threshold`` sources needn't be equal: in order of their least rows, each joins the first group of its keys whose first
    source is similar enough. Copies are compared once."""
    ok = snippets.filter((F.col("level") == level) & F.coalesce("changed", F.lit(True)) & (F.coalesce("origin", F.lit("")) != "root"))
    exact = ok.withColumn("group_id", F.min("row_id").over(Window.partitionBy(*keys, F.md5("source"))))
    if threshold is None or threshold >= 1:
        return exact
    heads = exact.filter("row_id = group_id").select(*keys, F.col("row_id").alias("_head"), "source").distinct()
    first = similar_groups(heads, "source", "_head", threshold, *keys)
    merged = first.select(*keys, F.col("_head").alias("group_id"), F.min("_head").over(Window.partitionBy(*keys, "cluster")).alias("_group"))
    return exact.join(merged, [*keys, "group_id"]).drop("group_id").withColumnRenamed("_group", "group_id")


def spread_credit(tokens: DataFrame, spans: DataFrame, weight: float = 1.0, base: str = "advantage", mask: str = "mask") -> DataFrame:
    """Token advantages: the row's episode advantage, plus the weighted credit of the best-scored span over a token.

    ``tokens`` has (row_id, base, mask array), ``spans`` (row_id, start, end, gs, credit); a row's spans don't outnumber its tokens."""
    s = spans.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("gs")).alias("a"), "start", "end", "credit"))).alias("_s"))

    def at(i: Column, on: Column) -> Column:
        hit = F.filter("_s", lambda x: (x["start"] <= i) & (i < x["end"]))
        return on * (F.col(base) + weight * F.coalesce(F.try_element_at(hit, F.lit(1))["credit"], F.lit(0.0)))

    return tokens.join(s, "row_id", "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<a:double,start:int,end:int,credit:double>>"))).withColumn("token_advantage", F.transform(mask, lambda m, i: at(i, m))).drop("_s")


def anchor_credit(anchors: DataFrame, rewards: DataFrame) -> DataFrame:
    """Anchors with ``credit``: a row's reward minus the mean of its anchor's rows. ``rewards`` has (row_id, reward)."""
    w = Window.partitionBy("uid", "anchor")
    return anchors.join(rewards, "row_id").withColumn("credit", F.col("reward") - F.avg("reward").over(w))


def diagnostics(anchors: DataFrame) -> DataFrame:
    """One row: anchors chosen, their mean and median size, and occurrences."""
    g = anchors.groupBy("uid", "anchor").count()
    return g.agg(F.count("*").alias("n_anchors"), F.avg("count").alias("mean_group_size"), F.median("count").alias("median_group_size"), F.sum("count").alias("n_occurrences"))
