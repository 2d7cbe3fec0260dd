"""Extension points: advantage estimators, reward functions by data source, scorers with fallbacks, and partitioned application."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import groupstats as G
from millrace.operators import returns as R

Estimator = Callable[..., DataFrame]

ESTIMATORS: dict[str, Estimator] = {
    "grpo": G.grpo,
    "grpo_passk": G.pass_at_k,
    "rloo": G.rloo,
    "rfpp_baseline": G.rfpp_baseline,
    "episode_step": G.episode_step_joint,
    "history": G.history_groups,
    "return_to_go": R.return_to_go,
}


def register_estimator(name: str, fn: Estimator) -> None:
    if name in ESTIMATORS:
        raise ValueError(f"{name} is registered")
    ESTIMATORS[name] = fn


def advantage(df: DataFrame, estimator: str, **options) -> DataFrame:
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](df, **options)


def dispatch_score(source: Column, scorers: dict[str, Column]) -> Column:
    """Score by data source; an unknown source fails the query."""
    out = F.raise_error(F.concat(F.lit("no score for "), source)).cast("double")
    for name, score in scorers.items():
        out = F.when(source == name, score.cast("double")).otherwise(out)
    return out


def vector_scorer(fn: Callable[[list[str], list[str]], list[float]], fallback: float = 0.0):
    """A column function over batches of (response, truth); a batch that raises is scored row by row, a bad row gets the fallback."""

    @F.pandas_udf("double")
    def score(responses: pd.Series, truths: pd.Series) -> pd.Series:
        r, t = responses.fillna("").tolist(), truths.fillna("").tolist()
        try:
            return pd.Series([float(x) for x in fn(r, t)])
        except Exception:  # noqa: BLE001 - a scorer is foreign code
            out = []
            for a, b in zip(r, t):
                try:
                    out.append(float(fn([a], [b])[0]))
                except Exception:  # noqa: BLE001
                    out.append(fallback)
            return pd.Series(out)

    return score


def on_partitions(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int | None = None) -> DataFrame:
    """Applies fn to Arrow batches of evenly dealt rows; no padding is needed and order is by row_id, not by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(fn, batches)

    return (df.repartition(parts) if parts else df).mapInPandas(run, schema)


def balanced_order(df: DataFrame, part: str, parts: int) -> DataFrame:
    """Rows dealt to partitions by their balanced part."""
    return df.repartition(parts, part)


def replicated(df: DataFrame, ranks: int) -> DataFrame:
    """Each row once a rank, for work that every rank does on all rows."""
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
