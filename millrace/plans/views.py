"""Views of the test tables as rollout steps, outcome groups and token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import table


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (trajectory, step) of ``events``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 8).alias("uid"), F.col("user_id").alias("traj_uid"), (F.row_number().over(w) - 1).alias("step"),
        F.col("event_id").alias("row_id"), F.col("event_type").alias("anchor_obs"), F.col("value").alias("reward"), F.lead("event_type").over(w).alias("next_obs"),
    )


#: The same view for the oracle.
STEPS = """steps AS (SELECT user_id % 8 AS uid, user_id AS traj_uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
 event_id AS row_id, event_type AS anchor_obs, value AS reward, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_obs FROM events)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per outcome of a group: order lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("uid"), F.concat_ws("-", "l_orderkey", "l_suppkey").alias("traj_uid"), F.col("l_linenumber").alias("step"), F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"))


OUTCOMES = """outcomes AS (SELECT l_orderkey AS uid, l_orderkey || '-' || l_suppkey AS traj_uid, l_linenumber AS step, l_quantity AS score, l_extendedprice AS price, l_partkey AS part FROM lineitem)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows: two 32-long streams of log-probabilities of each vector, a mask, and an advantage."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") / 4).cast("long").alias("uid"), F.slice(v, 1, 32).alias("old"), F.slice(v, 33, 32).alias("new"),
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i < 8 + F.col("vec_id") % 24).cast("int")).alias("mask"), (F.col("label") % 5 - 2).cast("double").alias("advantage"), F.slice(v, 17, 32).alias("ref"),
    )


TOKENS = """tokens AS (SELECT vec_id AS row_id, vec_id // 4 AS uid, CAST(embedding[1:32] AS DOUBLE[]) AS old, CAST(embedding[33:64] AS DOUBLE[]) AS new, CAST(embedding[17:48] AS DOUBLE[]) AS ref,
 list_transform(range(0, 32), lambda i: CASE WHEN i < 8 + vec_id % 24 THEN 1 ELSE 0 END) AS mask, CAST(label % 5 - 2 AS DOUBLE) AS advantage FROM embeddings),
tok AS (SELECT row_id, uid, advantage, i, old[i] AS old, new[i] AS new, ref[i] AS ref, mask[i] AS m FROM (SELECT *, unnest(range(1, 33)) AS i FROM tokens))"""
