"""Cutting lineage in the folder that the cluster names, and joins and components that split hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has at least one in HOT_SHARE of all rows (so there are at most HOT_SHARE of them); its rows are dealt to SALTS parts.
HOT_SHARE, SALTS = 1000, 64


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder, from where a lost executor's part can be read again.

    The folder is the one that spark.checkpoint.dir names. Only a local master, as in tests, gets one of its own."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def hot_keys(rows: DataFrame, key: str) -> list[int]:
    """Keys (long) with at least one in HOT_SHARE of all rows: at most HOT_SHARE of them, whatever the input."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    return [r[0] for r in counts.filter(F.col("n") > max(SALTS, total / HOT_SHARE)).select(key).collect()]


def join_split(rows: DataFrame, one_per_key: DataFrame, key: str, spread: str, hot: list[int], how: str = "inner") -> DataFrame:
    """Join of many rows a key with one; the rows of hot keys are dealt by a hash of ``spread``, and their single row goes to every part.

    In a left join rows without a key are kept, and dealt as well."""
    if not hot and how == "inner":
        return rows.join(one_per_key, key)
    is_hot = F.col(key).isin(hot)
    dealt = is_hot | F.col(key).isNull() if how == "left" else is_hot
    left = rows.withColumn("_part", F.when(dealt, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("long"))
    right = one_per_key.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right, [key, "_part"], how).drop("_part")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) of every node of (u, v) edges but the roots; the root is a component's smallest node.

    Alternates large-star and small-star until nothing changes: rounds are few (the logarithm of the longest path), and
    if ``max_rounds`` don't do, it raises. A hub's edges are aggregated by partial minima and joined in parts, never
    gathered. Each round is checkpointed. No edges give no rows; self-loops and repeats are ignored."""
    e = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if state[0] == 0 or state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = hot_keys(both, "u")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpoint(join_split(both.filter("v > u"), low, "u", "v", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_split(large, down, "u", "v", hot_keys(large, "u")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v"))
        e = checkpoint(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
