"""Operators with typed state in a stream: the change gate of snippets, the lock of tracked ids, rewards that come later.

State is kept by key with transformWithState: a map of last sources, a value of locked ids. Both can have a time to live, and a
key that says it is finished gives its state up at once, so what a long run holds follows the keys that are open. With a time
to live a stream goes on by the clock until it is stopped; without, it can also run over what is there and end. The state
store must be able to hold several columns a key (``state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _clock(ttl_ms: int | None) -> str:
    return "processingTime" if ttl_ms else "none"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[SparkSession]:
    """Streams that start inside keep their state in the store that typed state needs; the session is as before after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield spark
    finally:
        spark.conf.set(name, before)


class _Gate(StatefulProcessor):
    """Marks a source that differs from the last one of the same name; keeps a digest of each name's last source."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "name string", "digest binary", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("place", kind="stable")
        seen: dict[str, bytes | None] = {}
        changed = []
        for name, digest in zip(own["name"], own["digest"]):
            if name not in seen:
                seen[name] = bytes(self.last.getValue((name,))[0]) if self.last.containsKey((name,)) else None
            changed.append(seen[name] != bytes(digest))
            seen[name] = bytes(digest)
        if own["done"].any():
            self.last.clear()
        else:
            for name, digest in seen.items():
                self.last.updateValue((name,), (digest,))
        yield pd.DataFrame({"traj": key[0], "place": own["place"], "name": own["name"], "changed": changed})

    def close(self) -> None:
        pass


def gate_changes(snippets: DataFrame, traj: str, place: str, name: Column, source: Column, done: Column, ttl_ms: int | None = None) -> DataFrame:
    """(traj, place, name, changed) of a stream of snippets: a snippet is unchanged if the last one of its name in its trajectory had the same source.

    Rows of a trajectory must come in the order of ``place`` over the batches; within a batch they are sorted. A row with ``done``
    ends its trajectory, whose state is dropped; others lose theirs ``ttl_ms`` after its last change, if that is given. Sources are kept as
    SHA-256, so the state of a name is of fixed size."""
    rows = snippets.select(F.col(traj).cast("string").alias("traj"), F.col(place).cast("long").alias("place"), name.cast("string").alias("name"), F.sha2(F.coalesce(source, F.lit("")), 256).cast("binary").alias("digest"), F.coalesce(done, F.lit(False)).alias("done"))
    return rows.groupBy("traj").transformWithStateInPandas(_Gate(ttl_ms), "traj string, place long, name string, changed boolean", "append", _clock(ttl_ms))


class _Lock(StatefulProcessor):
    """The first ids of a run, locked once there are enough."""

    def __init__(self, n: int, ttl: int | None):
        self.n, self.ttl = n, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getValueState("ids", "ids array<string>", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ids = list(self.ids.get()[0]) if self.ids.exists() else []
        known, finished = len(ids), False
        if known < self.n:
            first: dict[str, int] = {}
            for part in rows:
                finished |= bool(part["done"].any())
                for i, place in zip(part["id"], part["place"]):
                    if i is not None:
                        first[i] = min(place, first.get(i, place))
            ids += [i for i in sorted(first, key=lambda i: (first[i], i)) if i not in ids][: self.n - known]
        else:
            finished = any(part["done"].any() for part in rows)
        if finished:
            self.ids.clear()
        elif len(ids) > known:
            self.ids.update((ids,))
        if len(ids) > known:
            yield pd.DataFrame({"run": key[0], "rank": range(known, len(ids)), "id": ids[known:]}).astype({"rank": "int32"})

    def close(self) -> None:
        pass


#: Ids made anew for each batch can't be followed; a fixed pattern.
UNSTABLE = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def lock_ids(rows: DataFrame, run: str, place: str, key: str, n: int, done: Column | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(run, rank, id): the first ``n`` distinct stable ids of each run of a stream, in order; each comes out once, when it is locked.

    Blank ids and UUIDs don't count. Ids stay locked over restarts from the checkpoint; ``done`` ends a run and drops its state.
    A batch sends each id once, however many rows have it."""
    stable = F.when((F.col(key) != "") & ~F.col(key).cast("string").rlike(UNSTABLE), F.col(key).cast("string"))
    flag = F.lit(False) if done is None else F.coalesce(done, F.lit(False))
    few = rows.select(F.col(run).cast("string").alias("run"), F.col(place).cast("long").alias("place"), stable.alias("id"), flag.alias("done")).filter("id IS NOT NULL OR done")
    return few.groupBy("run").transformWithStateInPandas(_Lock(n, ttl_ms), "run string, rank int, id string", "append", _clock(ttl_ms))


def with_late_rewards(steps: DataFrame, rewards: DataFrame, key: str, at: str, rewarded_at: str, within: str, delay: str = "0 seconds") -> DataFrame:
    """Each row of a stream of steps once: with the reward that came within ``within`` of it, or null when none can come any more.

    Both streams are watermarked with ``delay``; a step waits in state until the watermark has passed its bound, a reward until
    no step of its time can come. A key has at most one reward; one that comes too late is dropped with its step's row already
    out. ``rewards`` has ``key``, ``rewarded_at`` and its values. Tables instead of streams give the same rows at once."""
    left, right = steps.withColumn(at, F.col(at).cast("timestamp")), rewards.withColumnRenamed(key, "_key").withColumn(rewarded_at, F.col(rewarded_at).cast("timestamp"))
    if steps.isStreaming:
        left, right = left.withWatermark(at, delay), right.withWatermark(rewarded_at, delay)
    near = (F.col(key) == F.col("_key")) & (F.col(rewarded_at) >= F.col(at)) & (F.col(rewarded_at) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "leftOuter").drop("_key")
