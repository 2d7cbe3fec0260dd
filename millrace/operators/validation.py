"""Validation metrics over several responses a prompt: mean@N, best@k, worst@k, maj@k by bootstrap, for any reducer.

Draws depend only on the numbers of responses and of draws, so each pair of them has one seeded table of indices. The reducers
that are defined here (best, worst, maj) take it from a worker's memory and reduce all draws of many prompts at once, in numpy. For reducers
given as columns the tables are data: prompts are joined to them by their number of responses and reduce the drawn values
in columns. No draw becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, SEED = 1000, 42
#: Drawn values that are held at once, in one worker.
HELD = 1 << 20
#: The tables of indices are broadcast up to this many indices in all; beyond it they are joined by a shuffle.
BROADCAST_INDICES = 4_000_000

#: Reducers of one draw: from (values, votes) of the draw, in its order, to a number.
Reducer = Callable[[Column, Column], Column]


def majority_of(values: Column, votes: Column) -> Column:
    """First value of the most frequent vote; of equally frequent votes that which is drawn first."""
    ranked = F.transform(votes, lambda v, j: F.struct(F.size(F.filter(votes, lambda x: x.eqNullSafe(v))).alias("n"), (-j).alias("j")))
    return F.get(values, -F.array_max(ranked)["j"])


REDUCERS: dict[str, Reducer] = {"best": lambda v, p: F.array_max(v), "worst": lambda v, p: F.array_min(v)}
MAJORITY: dict[str, Reducer] = {"maj": majority_of}


def subset_sizes(n: int) -> list[int]:
    """2, 4, 8, ... below the number of responses, and that number."""
    return [1 << k for k in range(1, n.bit_length()) if 1 << k < n] + [n] if n > 1 else []


def draw_indices(n: int, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Indices of each round's draws with replacement: the seeded sequence that the metrics are defined by."""
    state = np.random.RandomState(seed)
    return np.array([state.choice(n, size=k, replace=True) for _ in range(rounds)], np.int32)


@lru_cache(maxsize=32)
def _draws(n: int, k: int, rounds: int, seed: int) -> np.ndarray:
    return draw_indices(n, k, rounds, seed)


def _drawn(kind: str, values: np.ndarray, codes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(prompt, draw) of a reducer: NaN is the largest value; ``codes`` number the different votes of each prompt."""
    if kind == "best":
        return values[:, draws].max(2)
    if kind == "worst":
        return np.fmin.reduce(values[:, draws], axis=2)
    own = codes[:, draws]
    often = np.zeros(own.shape, np.int32)
    for c in range(int(codes.max()) + 1):
        same = own == c
        often += same * same.sum(2, keepdims=True, dtype=np.int32)
    first = often.argmax(2)  # of equally frequent votes that which is drawn first
    return np.take_along_axis(values, draws[np.arange(len(draws)), first], 1)


def _codes(votes: Sequence) -> list[int]:
    seen: dict = {}
    return [seen.setdefault(x, len(seen)) for x in votes]


def _at_k(kinds: Sequence[str], rounds: int, seed: int) -> Callable[[Column, Column], Column]:
    """Array of {metric, value} at each subset size, of the values and votes of a prompt."""

    @F.pandas_udf("array<struct<metric:string,value:double>>")
    def run(values: pd.Series, votes: pd.Series) -> pd.Series:
        sizes = values.map(len).to_numpy()
        out: list[list] = [[] for _ in sizes]
        for n in np.unique(sizes[sizes > 1]).tolist():
            rows = np.flatnonzero(sizes == n)
            for k in subset_sizes(n):
                draws = _draws(n, k, rounds, seed)
                for part in np.array_split(rows, min(len(rows), -(-len(rows) * rounds * k // HELD))):
                    v = np.stack([np.asarray(values.iloc[i], float) for i in part])
                    codes = np.array([_codes(votes.iloc[i]) for i in part]) if "maj" in kinds else None
                    for kind in kinds:
                        found = _drawn(kind, v, codes, draws)
                        for i, mean, std in zip(part.tolist(), found.mean(1).tolist(), found.std(1).tolist()):
                            out[i] += [(f"{kind}@{k}/mean", mean), (f"{kind}@{k}/std", std)]
        return pd.Series([[{"metric": m, "value": x} for m, x in own] for own in out], dtype=object)

    return run


def index_tables(sizes: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(n, k, draws) of each number of responses in ``sizes`` (n)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for n in part["n"]:
                for k in subset_sizes(int(n)):
                    yield pd.DataFrame({"n": [n], "k": [k], "draws": [list(draw_indices(int(n), k, rounds, seed))]})

    return sizes.select(F.col("n").cast("int").alias("n")).mapInPandas(run, "n int, k int, draws array<array<int>>")


def _moments(values: Column) -> Column:
    """{mean, std} of an array in one fold: a running mean and sum of squares about it."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, x: Column) -> Column:
        n, gap = s["n"] + 1, x - s["mean"]
        mean = s["mean"] + gap / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + gap * (x - mean)).alias("m2"))

    return F.aggregate(values, zero, step, lambda s: F.struct(s["mean"].alias("mean"), F.sqrt(s["m2"] / s["n"]).alias("std")))


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r["v"][name])


def _reduced(reduce: Reducer) -> Column:
    return F.transform("draws", lambda d: reduce(F.transform(d, lambda i: F.get("_v", i)), F.transform(d, lambda i: F.get("_p", i))))


def prompt_metrics(df: DataFrame, source: str, prompt: str, order: str, variables: Sequence[str], vote: str | None = None, reducers: Mapping[str, Reducer] | None = None, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(source, prompt, variable, metric, value): mean@N of all prompts; of those with several responses also std@N, and for each
    reducer and subset size k its mean and population deviation over the draws (``best@k/mean``, ``best@k/std``).

    ``order`` tells the responses of a prompt apart. ``reducers`` adds to best and worst (and maj, with a ``vote``). Responses of
    a prompt are bounded and gathered in one row; null values count as NaN, as the mean of such a prompt is undefined."""
    chosen = REDUCERS | (MAJORITY if vote else {}) | dict(reducers or {})
    item = F.struct(F.col(order).alias("o"), F.struct(*(F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in variables)).alias("v"), (F.col(vote).cast("string") if vote else F.lit(None).cast("string")).alias("p"))
    rows = df.groupBy(source, prompt).agg(F.sort_array(F.collect_list(item)).alias("_r")).withColumn("n", F.size("_r"))
    variable = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), _field("_r", v).alias("v")) for v in variables)))
    long = rows.select(source, prompt, "n", F.transform("_r", lambda r: r["p"]).alias("_p"), variable.alias("_x")).select(source, prompt, "n", "_p", "_x.variable", F.col("_x.v").alias("_v"))
    name = lambda head, k, tail="": F.concat(F.lit(head + "@"), F.col(k).cast("string"), F.lit(tail))
    plain = F.array(F.struct(name("mean", "n").alias("metric"), F.col("_s.mean").alias("value")), F.struct(name("std", "n").alias("metric"), F.when(F.col("n") > 1, F.col("_s.std")).alias("value")))
    whole = long.withColumn("_s", _moments(F.col("_v"))).select(source, prompt, "variable", F.explode(plain).alias("_m")).select(source, prompt, "variable", "_m.*").filter("value IS NOT NULL")

    own = [kind for kind, reduce in chosen.items() if (REDUCERS | MAJORITY).get(kind) is reduce]
    given = {kind: reduce for kind, reduce in chosen.items() if kind not in own}
    if own:
        at = long.filter("n > 1").select(source, prompt, "variable", F.explode(_at_k(own, rounds, seed)("_v", "_p")).alias("_m"))
        value = F.coalesce("_m.value", F.lit(float("nan"))).alias("value")  # NaN comes back from pandas as null
        whole = whole.unionByName(at.select(source, prompt, "variable", "_m.metric", value))
    if not given:
        return whole
    sizes = rows.select("n").distinct()
    drawn = sizes.agg(F.sum(F.col("n") * F.ceil(F.log2(F.col("n") + 1)) * rounds).alias("s")).first().s or 0
    tables = index_tables(sizes, rounds, seed)
    sampled = long.join(F.broadcast(tables) if drawn <= BROADCAST_INDICES else tables, "n")
    sampled = sampled.select(source, prompt, "variable", "k", *(_moments(_reduced(reduce)).alias(f"_{kind}") for kind, reduce in given.items()))
    both = [F.struct(name(kind, "k", f"/{part}").alias("metric"), F.col(f"_{kind}.{part}").alias("value")) for kind in given for part in ("mean", "std")]
    at_k = sampled.select(source, prompt, "variable", F.explode(F.array(*both)).alias("_m")).select(source, prompt, "variable", "_m.*")
    return whole.unionByName(at_k)


def validation_metrics(df: DataFrame, source: str, prompt: str, order: str, variables: Sequence[str], **options) -> DataFrame:
    """(source, variable, metric, value): each metric of the prompts (``prompt_metrics``), averaged over those that have it."""
    return prompt_metrics(df, source, prompt, order, variables, **options).groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))
