"""Approximate nearest neighbours: stable projections, kd-tree, chi-square stopping.

Vectors are projected to a few dimensions by Gaussian (2-stable) directions: the squared projected distance over the
squared distance follows a chi-square law. Inner products become distances by one more coordinate, the root of what a
vector's square lacks to the largest.

One kd-tree, built on the driver from the projections of a bounded sample (``SAMPLE_ROWS``), cuts the whole table into
cells; every row is indexed. A query visits cells in order of the least projected distance it can have to their boxes,
in rounds of growing size, until the next cell is so far that a true neighbour would lie there only with probability
1 - CONFIDENCE, given the k-th best so far. Inside a cell a smaller tree yields leaves in the same order with the same
test. So a query's cost follows the cells that it can't rule out, not the rows.

A cell of more rows than ``PART_ROWS`` is dealt to parts, its visitors to groups, by hashes: a task holds a part and a
group. Equal query vectors are searched once; copies of a vector in a part are verified once and answer with their
smallest ids. So a very common vector costs no more than a rare one.

Cases: null vectors, zero vectors, null or non-finite components, and vectors whose length is not the most common
one take no part; fewer candidates than k are all returned; repeated ids are each candidates, but no row of a
query's own id is; rows without an id are left out. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.durable import checkpoint, hot_keys, join_split
from millrace.llm.slices import tidy, tidy_pair

PROJECTIONS, CONFIDENCE, LEAF, STEP, SEED = 8, 0.9, 48, 8, 3
CELL_ROWS, PART_ROWS, GROUP_ROWS, SAMPLE_ROWS = 4096, 16_384, 4096, 65_536
#: Cells that a query has visited after each round but the last, which visits all that are left.
ROUNDS = (1, 5)
#: Normal quantiles, for chi-square quantiles by the Wilson-Hilferty rule.
NORMAL_QUANTILE = {0.8: 0.8416, 0.9: 1.2816, 0.95: 1.6449, 0.97: 1.8808, 0.99: 2.3263}


def chi_square_quantile(confidence: float, degrees: int) -> float:
    a = 2 / (9 * degrees)
    return degrees * (1 - a + NORMAL_QUANTILE[confidence] * math.sqrt(a)) ** 3


BOUND = chi_square_quantile(CONFIDENCE, PROJECTIONS)


def least_to_boxes(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least squared distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(0, np.maximum(low[None, :, d] - q[:, None, d], q[:, None, d] - high[None, :, d]))
        out += gap * gap
    return out


class KdTree:
    """Leaves of a balanced kd-tree: rows in leaf order, and each leaf's box."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        parts = [np.arange(len(x))]
        for _ in range(max(0, math.ceil(math.log2(max(1, len(x) / leaf))))):
            halves = []
            for p in parts:
                axis = int(np.argmax(np.ptp(x[p], axis=0))) if len(p) else 0
                s = p[np.argsort(x[p, axis], kind="stable")]
                halves += [s[: len(s) // 2], s[len(s) // 2 :]]
            parts = halves
        parts = [p for p in parts if len(p)]
        self.rows, self.first = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])
        self.low, self.high = np.array([x[p].min(0) for p in parts]), np.array([x[p].max(0) for p in parts])


class Cells:
    """The splits of a kd-tree of ``levels`` levels over sampled projections, as arrays in heap order."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.at = np.zeros(max(1, 2**levels - 1), np.int64), np.zeros(max(1, 2**levels - 1))
        parts = [sample]
        for level in range(levels):
            halves = []
            for k, p in enumerate(parts):
                axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
                at = float(np.median(p[:, axis])) if len(p) else 0.0
                self.axis[2**level - 1 + k], self.at[2**level - 1 + k] = axis, at
                right = p[:, axis] >= at if len(p) else np.zeros(0, bool)
                halves += [p[~right], p[right]]
            parts = halves

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cell of each projected row."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return (node - (2**self.levels - 1)).astype(np.int32)


class Space:
    """Projections of vectors and of queries whose largest square is given."""

    def __init__(self, dimension: int, largest: float):
        self.largest = largest
        self.directions = np.random.default_rng(SEED).standard_normal((dimension + 1, PROJECTIONS))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.largest - (x * x).sum(1)))[:, None]])

    def scale(self, q: np.ndarray) -> np.ndarray:
        """Only the order of distances matters, so queries are scaled to the common length."""
        return math.sqrt(self.largest) / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)

    def lifted_query(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q * self.scale(q)[:, None], np.zeros((len(q), 1))])


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, term after term, so equal vectors give equal values."""
    return (q * x).cumsum(axis=-1)[..., -1]


def search_part(space: Space, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best k rows of a part for each query: (place of the query, id, score), and how many leaves were verified.

    ``reach`` is the squared distance of each query's k-th best found elsewhere, infinite if there is none."""
    view = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, lead, group = np.unique(view, return_index=True, return_inverse=True)
    by_group = np.lexsort((ids, group))
    edges = np.searchsorted(group[by_group], np.arange(len(lead) + 1))
    copies = [ids[by_group[a : min(b, a + k)]] for a, b in zip(edges, edges[1:])]
    v = x[lead]
    lifted, lifted_q = space.lifted(v), space.lifted_query(q)
    tree = KdTree(lifted @ space.directions)
    least = least_to_boxes(lifted_q @ space.directions, tree.low, tree.high)
    order = np.argsort(least, axis=1, kind="stable")
    ordered_x, sizes = lifted[tree.rows], np.diff(tree.first)
    known = np.full(len(q), np.inf) if reach is None else reach
    take = min(k, len(lead))
    best, best_row = np.full((len(q), take), np.inf), np.full((len(q), take), -1)
    n_leaves, width, r, verified = len(sizes), int(sizes.max()), 0, 0
    active = np.arange(len(q))
    while r < n_leaves:
        # k distinct vectors found here bound the k-th best, too
        here = best[active].max(1) if take == k else np.full(len(active), np.inf)
        active = active[~(least[active, order[active, r]] > BOUND * np.maximum(0, np.minimum(known[active], here)))]
        if not len(active):
            break
        leaves = order[active, r : r + STEP]
        verified += leaves.size
        dist, rows = np.full((len(active), leaves.shape[1] * width), np.inf), np.full((len(active), leaves.shape[1] * width), -1)
        flat = leaves.ravel()
        by_leaf = np.argsort(flat, kind="stable")
        edge = np.flatnonzero(np.append(True, flat[by_leaf][1:] != flat[by_leaf][:-1]))
        for a, b in zip(edge, [*edge[1:], len(flat)]):  # queries that want the same leaf are verified in one product
            leaf = flat[by_leaf[a]]
            i, slot = np.divmod(by_leaf[a:b], leaves.shape[1])
            members = slice(tree.first[leaf], tree.first[leaf + 1])
            at = (slot * width)[:, None] + np.arange(sizes[leaf])
            dist[i[:, None], at] = 2 * space.largest - 2 * (lifted_q[active[i]] @ ordered_x[members].T)
            rows[i[:, None], at] = tree.rows[members]
        all_d, all_r = np.hstack([best[active], dist]), np.hstack([best_row[active], rows])
        top = np.argpartition(all_d, take - 1, axis=1)[:, :take]
        best[active] = np.take_along_axis(all_d, top, 1)
        best_row[active] = np.take_along_axis(all_r, top, 1)
        r += STEP
    out_q, out_id, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in range(len(q)):
        groups = np.unique(best_row[i][np.isfinite(best[i])])
        if not len(groups):
            continue
        score = exact(q[i][None, :], v[groups])
        found = np.concatenate([copies[g] for g in groups])
        value = np.repeat(score, [len(copies[g]) for g in groups])
        top = np.lexsort((found, -value))[:k]
        out_q.append(np.full(len(top), i))
        out_id.append(found[top])
        out_s.append(value[top])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s), verified


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def nearest(rows: DataFrame, query_every: int = 20, k: int = 20, vector: str = "embedding", key: str = "vec_id", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to each row whose id ``query_every`` divides."""
    v = F.col("v")
    clean = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    clean = clean.filter(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0))
    stats = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c)).alias("sq")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if stats is None:
        return rows.sparkSession.createDataFrame([], result)
    dimension, n = stats.d, stats.n
    clean = clean.filter(F.size("v") == dimension)
    space = Space(dimension, float(stats.sq))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_listed(space.lifted(_matrix(b.column(0), dimension)) @ space.directions)], names=["p"])

    levels = max(0, min(math.ceil(math.log2(max(1, n / cell_rows))), int(math.log2(SAMPLE_ROWS / 32))))
    share = min(1 << 20, math.ceil((1 << 20) * SAMPLE_ROWS / n))
    sample = clean.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < share).select("v").limit(2 * SAMPLE_ROWS).mapInArrow(project, "p array<double>").toArrow() if levels else None
    cells = Cells(_matrix(sample.column("p"), PROJECTIONS) if sample is not None and sample.num_rows else np.zeros((0, PROJECTIONS)), levels)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = space.lifted(_matrix(b.column(1), dimension)) @ space.directions
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.of(p), pa.int32()), _listed(p)], names=["id", "v", "cell", "p"])

    placed = checkpoint(clean.mapInArrow(tidy(place), "id long, v array<double>, cell int, p array<double>"))
    # one row a cell, of which there are at most SAMPLE_ROWS / 32
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *(f(F.col("p")[i]).alias(f"{name}{i}") for i in range(PROJECTIONS) for name, f in (("low", F.min), ("high", F.max)))).orderBy("cell").collect()
    low, high = (np.array([[r[f"{name}{i}"] for i in range(PROJECTIONS)] for r in boxes]) for name in ("low", "high"))
    numbers = [r.cell for r in boxes]
    parts = {r.cell: math.ceil(r.n / PART_ROWS) for r in boxes}

    def looked_up(values: dict[int, int]) -> F.Column:
        """A cell's value; one for most cells."""
        other = {c: x for c, x in values.items() if x > 1}
        return F.coalesce(F.create_map(*(F.lit(x) for pair in other.items() for x in pair))[F.col("cell")], F.lit(1)) if other else F.lit(1)

    data = placed.select("cell", F.pmod(F.xxhash64("id", "v"), looked_up(parts)).cast("int").alias("part"), "id", "v")
    asked = placed.filter(F.col("id") % query_every == 0).select("id", "v")
    # equal vectors ask once; as many more answers as the most frequent id has rows, since none of them may be its own
    queries = checkpoint(asked.groupBy("v").agg(F.min("id").alias("qid")))
    repeats = asked.groupBy("id").count().agg(F.max("count").alias("m")).first().m
    want = k + (repeats or 0)

    def choose(done: int, upto: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    q = _matrix(part.column(1), dimension)
                    worst = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                    reach = np.where(np.isnan(worst), np.inf, np.maximum(0, 2 * space.largest - 2 * worst * space.scale(q)))
                    least = least_to_boxes(space.lifted_query(q) @ space.directions, low, high)
                    order = np.argsort(least, axis=1, kind="stable")[:, done:upto]
                    visited = ~(np.take_along_axis(least, order, 1) > BOUND * reach[:, None])
                    i, j = np.nonzero(visited)
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int32)[order[i, j]]), part.column(0).take(take), part.column(1).take(take), pa.array(reach[i])], names=["cell", "qid", "v", "reach"])

        return tidy(run)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            ids, x = left.column("id").to_numpy(), _matrix(left.column("v"), dimension)
            qid, q, reach = right.column("qid").to_numpy(), _matrix(right.column("v"), dimension), right.column("reach").to_numpy()
            for at in range(0, len(q), 512):
                i, found, score, _ = search_part(space, q[at : at + 512], ids, x, want, reach[at : at + 512])
                for c, new in zip(columns, (qid[at + i], found, score)):
                    c.append(new)
        return pa.table({"qid": pa.array(np.concatenate(columns[0]), pa.int64()), "vec_id": pa.array(np.concatenate(columns[1]), pa.int64()), "score": pa.array(np.concatenate(columns[2]), pa.float64())})

    found = None
    best_first = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    edges = [0, *(r for r in ROUNDS if r < len(boxes)), None]
    for done, upto in zip(edges, edges[1:]):
        if found is None:
            state = queries.select("qid", "v", F.lit(None).cast("double").alias("worst"))
        else:
            full = found.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= want)
            state = queries.join(full, "qid", "left").select("qid", "v", F.col("s").alias("worst"))
        visits = checkpoint(state.mapInArrow(choose(done, upto), "cell int, qid long, v array<double>, reach double"))
        groups = {r.cell: math.ceil(r["count"] / GROUP_ROWS) for r in visits.groupBy("cell").count().collect()}
        if not groups:
            break
        upto_of = lambda values: F.explode(F.sequence(F.lit(0), looked_up(values).cast("int") - 1))
        sent = data.filter(F.col("cell").isin(list(groups))).withColumn("g", upto_of(groups))
        come = visits.withColumn("g", F.pmod(F.xxhash64("qid"), looked_up(groups)).cast("int")).withColumn("part", upto_of(parts))
        new = sent.groupBy("cell", "part", "g").cogroup(come.groupBy("cell", "part", "g")).applyInArrow(tidy_pair(meet), "qid long, vec_id long, score double")
        every = new if found is None else found.unionByName(new)
        found = checkpoint(every.withColumn("r", F.row_number().over(best_first)).filter(F.col("r") <= want).drop("r"))
    best = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("a"), F.col("vec_id"), "score"))).alias("best"))
    each = asked.join(queries, "v").select("id", "qid").distinct()
    own = join_split(each, best, "qid", "id", hot_keys(queries.join(asked, "v").select("qid"), "qid"))
    top = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)
    out = own.select(F.col("id").alias("query_id"), F.posexplode(top).alias("r", "b"))
    return out.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
