"""Streams: event-time windows with watermarks, and per-trajectory state in processing order.

The reports by event time go beyond the batch operators: tumbling, sliding and session windows with late data dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """A stream of a folder's Parquet files; the files of a trigger bound its size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def timed(df: DataFrame, ts: str = "ts", delay: str | None = "10 minutes") -> DataFrame:
    """Event time as a timestamp with a zone, watermarked for streams."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if delay and df.isStreaming else out


def windowed(df: DataFrame, window: Column, aggs: list[Column], *keys: str) -> DataFrame:
    g = df.groupBy(window.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in g.columns if c != "w"))


def tumbling(df: DataFrame, width: str, aggs: list[Column], *keys: str, ts: str = "ts") -> DataFrame:
    return windowed(timed(df, ts), F.window(ts, width), aggs, *keys)


def sliding(df: DataFrame, width: str, slide: str, aggs: list[Column], *keys: str, ts: str = "ts") -> DataFrame:
    return windowed(timed(df, ts), F.window(ts, width, slide), aggs, *keys)


def sessions(df: DataFrame, gap: str, aggs: list[Column], *keys: str, ts: str = "ts") -> DataFrame:
    return windowed(timed(df, ts), F.session_window(ts, gap), aggs, *keys)


ROLLOUT = "traj_uid long, n_steps long, total double, done boolean, history string"


def rollout_state(max_steps: int, is_done: Callable[[str], bool], history: int = 3):
    """State function of a trajectory: steps, reward and last observations, until it is done or out of steps; later rows are ignored."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, done, past = state.get if state.exists else (0, 0.0, False, "")
        seen = [x for x in past.split("\u0001") if x]
        rows = pd.concat(list(parts)).sort_values("step")
        for obs, reward in zip(rows["anchor_obs"], rows["reward"]):
            if done:
                break
            n, total = n + 1, total + float(reward)
            seen = (seen + [obs])[-history:]
            done = bool(is_done(obs)) or n >= max_steps
        state.update((n, total, done, "\u0001".join(seen)))
        yield pd.DataFrame([[key[0], n, total, done, " ".join(seen)]], columns=["traj_uid", "n_steps", "total", "done", "history"])

    return run


def rollouts(steps: DataFrame, max_steps: int, is_done: Callable[[str], bool]) -> DataFrame:
    """Running summary of each trajectory of a stream of steps, updated by micro-batch."""
    return steps.groupBy("traj_uid").applyInPandasWithState(rollout_state(max_steps, is_done), ROLLOUT, "n long, total double, done boolean, past string", "update", GroupStateTimeout.NoTimeout)


def rollouts_batch(steps: DataFrame, max_steps: int, done_obs: str) -> DataFrame:
    """The same over a complete table: rows up to the first that is done."""
    first_done = F.min(F.when(F.col("anchor_obs") == done_obs, F.col("step")))
    g = steps.groupBy("traj_uid").agg(F.coalesce(first_done, F.lit(1 << 40)).alias("end"))
    kept = steps.join(g, "traj_uid").filter((F.col("step") <= F.col("end")) & (F.col("step") < max_steps))
    return kept.groupBy("traj_uid").agg(F.count("*").alias("n_steps"), F.sum("reward").alias("total"), ((F.max("step") == F.max("end")) | (F.count("*") >= max_steps)).alias("done"))


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs all that is available and returns the memory sink's table."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, at: str, checkpoint: str) -> DataFrame:
    """Runs all that is available and returns what was appended: Parquet files under ``at``, written by the tasks, so no row goes to the driver."""
    stream.writeStream.format("parquet").outputMode("append").option("path", at).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(at)


def resume(rows: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Rows without a finished result of an earlier run."""
    return rows.join(prior.filter("error IS NULL").select(key), key, "left_anti")


def first_ids(df: DataFrame, order: str, key: str, n: int, prior: DataFrame | None = None) -> DataFrame:
    """The first n distinct stable ids (not blank, no UUID); once a table of n is given it stays as it is."""
    if prior is not None and prior.count() >= n:
        return prior
    ids = df.filter((F.col(key) != "") & ~F.col(key).rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"))
    return ids.groupBy(key).agg(F.min(order).alias("at")).orderBy("at", key).limit(n)


#: States of a request, and the events that move it on.
TRANSITIONS = {("pending", "start"): "running", ("running", "tool"): "tool_calling", ("tool_calling", "reply"): "running", ("running", "finish"): "completed", ("running", "error"): "failed", ("tool_calling", "error"): "failed"}


def request_states(events: DataFrame, order: str, event: str, *keys: str) -> DataFrame:
    """Final state of each request by folding its events in order; unknown moves keep the state."""
    table = F.create_map(*(F.lit(x) for (a, b), c in TRANSITIONS.items() for x in (f"{a}/{b}", c)))
    seq = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, event))).alias("_s"))
    return seq.select(*keys, F.aggregate("_s", F.lit("pending"), lambda a, x: F.coalesce(F.try_element_at(table, F.concat_ws("/", a, x[event])), a)).alias("state"))
