"""Reports: metrics over groups, percentiles, bootstraps, votes, run summaries, best-of-n and balanced partitions."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, value: str, *keys: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample deviation, least, interpolated percentiles, largest, per key."""
    p = [F.percentile(value, q).alias(f"p{round(q * 100)}") for q in percentiles]
    aggs = [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *p, F.max(value).alias("max")]
    return (df.groupBy(*keys) if keys else df).agg(*aggs)


def majority(df: DataFrame, vote: str, value: str, order: str, *keys: str) -> DataFrame:
    """Value of the first member of the most frequent vote; the vote seen first wins ties."""
    v = df.groupBy(*keys, vote).agg(F.count("*").alias("n"), F.min(order).alias("at"), F.min_by(value, order).alias("v"))
    return v.groupBy(*keys).agg(F.max_by("v", F.struct("n", (-F.col("at")).alias("at"))).alias("maj"))


def expected_best_of(df: DataFrame, value: str, k: int, *keys: str, best: bool = True) -> DataFrame:
    """Closed form of the expected best (or worst) of k draws with replacement per key."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(F.col(value) if best else F.desc(value)))
    n = F.count("*").over(w)
    return df.withColumn("_w", F.pow(i / n, F.lit(float(k))) - F.pow((i - 1) / n, F.lit(float(k)))).groupBy(*keys).agg(F.sum(F.col(value) * F.col("_w")).alias("expected"))


def bootstrap(df: DataFrame, value: str, subset: int, *keys: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and population deviation, over draws of ``subset`` values with replacement, of the largest, least and mean.

    A key's values are gathered in one task: meant for the responses to one prompt."""
    names = ["best_mean", "best_std", "worst_mean", "worst_std", "mean_mean", "mean_std"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[value].to_numpy()
        state = np.random.RandomState(seed)
        d = v[np.array([state.choice(len(v), size=subset, replace=True) for _ in range(rounds)])]
        stats = [x for f in (d.max(1), d.min(1), d.mean(1)) for x in (f.mean(), f.std())]
        return pd.DataFrame([[*key, *stats]], columns=[*keys, *names])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} double" for n in names)])
    return df.groupBy(*keys).applyInPandas(run, schema)


def reduce_by_name(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """max if the name holds "max", else min if it holds "min", else the mean."""
    m = F.col(metric)
    return df.groupBy(metric).agg(F.when(F.first(m).contains("max"), F.max(value)).when(F.first(m).contains("min"), F.min(value)).otherwise(F.avg(value)).alias("value"))


def two_level_mean(df: DataFrame, value: str, inner: Sequence[str], outer: Sequence[str]) -> DataFrame:
    """Mean per inner key, then the mean of those per outer key."""
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("mean"), F.count("*").alias("n"))


def explained_variance(returns: str, values: str) -> Column:
    return 1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)


def outcome_summary(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Counts of graded, failed to run, won and lost, and win rates over all and over graded ones."""
    n = lambda *v: F.sum(F.col(outcome).isin(*v).cast("long"))
    won, lost, total = n("won"), n("lost"), F.count("*")
    return df.agg(total.alias("n"), (won + lost).alias("graded"), n("error").alias("errors"), won.alias("won"), lost.alias("lost"), F.try_divide(won, total).alias("win_rate"), F.try_divide(won, won + lost).alias("win_rate_graded"))


def frequency(df: DataFrame, *keys: str, top: int | None = None) -> DataFrame:
    """Counts, most frequent first, equal counts by key."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return out.limit(top) if top else out


def rate_by(df: DataFrame, hit: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(hit.cast("long")).alias("hits"), F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"))


def best_by(df: DataFrame, order: Sequence[Column], *keys: str) -> DataFrame:
    """First row per key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def best_hybrid(df: DataFrame, prob: str, regression: str, reproduction: str, pos: str, *keys: str) -> DataFrame:
    """The better half by probability, then most regression passes, most reproductions, highest probability. One of one is kept."""
    w = Window.partitionBy(*keys)
    half = F.greatest(F.floor(F.count("*").over(w) / 2), F.lit(1))
    top = df.withColumn("_n", F.row_number().over(w.orderBy(F.desc(prob), pos))).withColumn("_h", half).filter("_n <= _h").drop("_n", "_h")
    return best_by(top, [F.desc(regression), F.desc(reproduction), F.desc(prob), F.col(pos)], *keys)


def mass_share(df: DataFrame, step: str, kind: str, size: str, kinds: Sequence[str]) -> DataFrame:
    """Share of each kind in a step's mass, 0 where it is missing."""
    p = df.groupBy(step).pivot(kind, list(kinds)).agg(F.sum(size))
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in kinds[1:]), F.coalesce(F.col(kinds[0]), F.lit(0.0)))
    return p.select(step, *((F.coalesce(F.col(k), F.lit(0.0)) / total).alias(k) for k in kinds))


def length_imbalance(df: DataFrame, length: str, part: str) -> DataFrame:
    s = df.groupBy(part).agg(F.sum(length).alias("s"))
    return s.agg(F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean"))


def ldm_partition(lengths: Sequence[int], k: int, equal: bool = False) -> list[int]:
    """Part of each item by the largest differencing method; with ``equal`` parts have the same number of items."""
    n = len(lengths)
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    heap: list = []
    if equal:
        if n % k:
            raise ValueError("equal parts need a number of items that k divides")
        groups = [[(lengths[i], [i]) for i in order[a : a + k]] for a in range(0, n, k)]
    else:
        groups = [[(0, [])] * (k - 1) + [(lengths[i], [i])] for i in order]
    for c, g in enumerate(groups):
        g = sorted(g, key=lambda x: -x[0])
        heapq.heappush(heap, (-(g[0][0] - g[-1][0]), c, g))
    c = len(groups)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        g = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda x: -x[0])
        heapq.heappush(heap, (-(g[0][0] - g[-1][0]), c, g))
        c += 1
    out = [0] * n
    for p, (_, items) in enumerate(heap[0][2] if heap else []):
        for i in items:
            out[i] = p
    return out


def greedy_partition(lengths: Sequence[int], k: int) -> list[int]:
    """Each item in the given order goes to the part with the least sum, the first of equals."""
    heap = [(0, p) for p in range(k)]
    out = []
    for x in lengths:
        s, p = heapq.heappop(heap)
        out.append(p)
        heapq.heappush(heap, (s + x, p))
    return out


def greedy_parts(df: DataFrame, length: str, k: int, order: str, *keys: str) -> DataFrame:
    """(keys, order, part): each row of a batch, in order, goes to the part with the least sum, the first of equals.

    A fold over the batch's rows in one row, as ``greedy_partition`` does it for a list; batches are bounded."""
    item = F.struct(F.col(order).alias("o"), F.col(length).cast("double").alias("n"))
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_r"))
    zero = F.struct(F.array_repeat(F.lit(0.0), k).alias("sums"), F.array().cast("array<int>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        least = F.array_position(s["sums"], F.array_min(s["sums"])).cast("int") - 1
        return F.struct(F.transform(s["sums"], lambda v, i: F.when(i == least, v + x["n"]).otherwise(v)).alias("sums"), F.concat(s["parts"], F.array(least)).alias("parts"))

    parts = F.aggregate("_r", zero, step, lambda s: s["parts"])
    return g.select(*keys, F.explode(F.zip_with("_r", parts, lambda r, p: F.struct(r["o"].alias(order), p.alias("part")))).alias("_x")).select(*keys, "_x.*")


def balanced_parts(df: DataFrame, length: str, k: int, *keys: str, row: str = "row_id", equal: bool = False) -> DataFrame:
    """part of each row of a batch (``keys``), balanced by length; a batch is bounded and handled in one task."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        return pdf.assign(part=ldm_partition(pdf[length].tolist(), k, equal))[[*keys, row, "part"]]

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, row)), "part int"]))


def micro_batch_count(df: DataFrame, length: str, budget: int, *keys: str) -> DataFrame:
    """min(rows, ceil(sum / budget)) per batch."""
    return df.groupBy(*keys).agg(F.least(F.count("*"), F.ceil(F.sum(length) / budget)).alias("n_micro"))
