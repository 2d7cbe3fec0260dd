"""Writers: by suffix, by step, append-only dumps with a latest view, fan-out, and run manifests."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Format by suffix: .jsonl/.json (nulls kept), .csv (with a header), else Parquet."""
    w = df.write.mode(mode)
    if path.endswith((".jsonl", ".json")):
        w.option("ignoreNullFields", False).json(path)
    elif path.endswith(".csv"):
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_by_step(df: DataFrame, path: str, step: str = "step") -> None:
    """A folder per step; written again, a step is replaced and the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).json(path)


def latest(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """The newest row of each key of an append-only dump."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), order).alias("_r")).select(*keys, "_r.*")


def fan_out(sinks: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each micro-batch to every sink; the batch is computed once."""

    def run(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for s in sinks:
                s(batch, n)
        finally:
            batch.unpersist()

    return run


def manifest(stats: DataFrame, extra: Mapping | None = None) -> str:
    """JSON of a one-row aggregate."""
    return json.dumps({**stats.first().asDict(recursive=True), **(extra or {})}, default=str, sort_keys=True)


def console_lines(df: DataFrame, step: str = "step", metric: str = "metric", value: str = "value") -> DataFrame:
    """(step, line): "step:N - name:0.000 - ..." with names in order."""
    g = df.groupBy(step).agg(F.sort_array(F.collect_list(F.struct(F.col(metric).alias("m"), F.col(value).alias("v")))).alias("_s"))
    return g.select(step, F.concat_ws(" - ", F.concat(F.lit("step:"), F.col(step).cast("string")), F.array_join(F.transform("_s", lambda x: F.format_string("%s:%.3f", x["m"], x["v"])), " - ")).alias("line"))


def wide_samples(df: DataFrame, step: str, order: str, columns: Sequence[str], n: int) -> DataFrame:
    """One row a step with columns input_1.. for the first n samples."""
    w = Window.partitionBy(step).orderBy(order)
    x = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return x.groupBy(step).agg(*(F.max(F.when(F.col("_n") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, n + 1) for c in columns))


def flatten_config(config, prefix: str = "") -> dict:
    """Nested settings as a/b/c keys; lists become their length and numbered entries."""
    if isinstance(config, Mapping):
        items = config.items()
    elif isinstance(config, (list, tuple)):
        items = [("list_len", len(config)), *((str(i), v) for i, v in enumerate(config))]
    else:
        return {prefix: config}
    out: dict = {}
    for k, v in items:
        out |= flatten_config(v, f"{prefix}/{k}" if prefix else str(k))
    return out


def best_of_n_submission(df: DataFrame, key: str, patch: str, path: str) -> None:
    """One JSON object a line: key and chosen patch."""
    df.select(F.col(key).alias("instance_id"), F.col(patch).alias("model_patch")).coalesce(1).write.mode("overwrite").json(path)
