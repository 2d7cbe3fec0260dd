"""State of streams: equal to the batch forms, kept over restarts, given up when a key is done."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import returns
from millrace.streaming import keyed


def drain(out, folder, mode="append"):
    """Runs what is there into a table of its own and returns all rows so far."""
    name = "t" + uuid.uuid4().hex
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).queryName(name).start()
    q.awaitTermination()
    return out.sparkSession.read.parquet(f"{folder}/out")


@pytest.fixture
def store(spark):
    with keyed.state_store(spark):
        yield spark


def write(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


GATE = "traj string, place long, sig string, source string, done boolean"


def gate(spark, folder):
    s = spark.readStream.schema(GATE).parquet(f"{folder}/in")
    return keyed.gate_changes(s, "traj", "place", F.col("sig"), F.col("source"), F.col("done"))


def test_gate_equals_batch_over_restarts(store, tmp_path):
    first = [("a", 1, "f", "x", False), ("a", 2, "f", "x", False), ("b", 1, "f", "x", False), ("a", 3, "g", "y", False)]
    second = [("a", 4, "f", "x", False), ("a", 5, "g", "z", False), ("b", 2, "f", "w", True), ("a", 6, "g", None, False), ("a", 7, "g", "", False)]
    write(store, first, GATE, f"{tmp_path}/in", 1)
    drain(gate(store, tmp_path), tmp_path)
    write(store, second, GATE, f"{tmp_path}/in", 2)  # a new query from the checkpoint
    got = {(r.traj, r.place): r.changed for r in drain(gate(store, tmp_path), tmp_path).collect()}
    table = store.createDataFrame(first + second, GATE).withColumn("source", F.coalesce("source", F.lit("")))
    want = {(r.traj, r.place): r.changed for r in returns.changed_since_last(table, "source", "place", "traj", "sig").collect()}
    assert got == want and got["a", 2] is False and got["a", 4] is False and got["a", 5] is True
    write(store, [("b", 3, "f", "w", False)], GATE, f"{tmp_path}/in", 3)  # b was done: nothing is known of it
    got = {(r.traj, r.place): r.changed for r in drain(gate(store, tmp_path), tmp_path).collect()}
    assert got["b", 3] is True


def test_state_has_a_time_to_live(store, tmp_path):
    write(store, [("a", 1, "f", "x", False)], GATE, f"{tmp_path}/in", 1)
    s = store.readStream.schema(GATE).parquet(f"{tmp_path}/in")
    out = keyed.gate_changes(s, "traj", "place", F.col("sig"), F.col("source"), F.col("done"), ttl_ms=1)
    q = out.writeStream.format("memory").queryName("gate_ttl").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for k in (1, 2):
            for _ in range(60):
                if store.table("gate_ttl").count() == k:
                    break
                time.sleep(0.5)
            if k == 1:
                write(store, [("a", 2, "f", "x", False)], GATE, f"{tmp_path}/in", 2)
    finally:
        q.stop()
    assert [r.changed for r in store.table("gate_ttl").orderBy("place").collect()] == [True, True]


LOCK = "run string, place long, id string, done boolean"


def test_lock_stays_over_restarts(store, tmp_path):
    out = lambda: keyed.lock_ids(store.readStream.schema(LOCK).parquet(f"{tmp_path}/in"), "run", "place", "id", 3, F.col("done"))
    write(store, [("r", 2, "b", False), ("r", 1, "a", False), ("r", 3, "a", False), ("r", 0, "", False), ("r", 0, None, False), ("r", 0, str(uuid.uuid4()), False), ("q", 1, "z", False)], LOCK, f"{tmp_path}/in", 1)
    rows = lambda: sorted((r.run, r["rank"], r.id) for r in drain(out(), tmp_path).collect())
    assert rows() == [("q", 0, "z"), ("r", 0, "a"), ("r", 1, "b")]
    write(store, [("r", 4, "c", False), ("r", 5, "d", False), ("q", 2, "z", True)], LOCK, f"{tmp_path}/in", 2)
    assert rows() == [("q", 0, "z"), ("r", 0, "a"), ("r", 1, "b"), ("r", 2, "c")]
    write(store, [("r", 0, "earlier", False), ("q", 3, "y", False)], LOCK, f"{tmp_path}/in", 3)
    assert rows() == [("q", 0, "y"), ("q", 0, "z"), ("r", 0, "a"), ("r", 1, "b"), ("r", 2, "c")]


def test_rewards_that_come_later(spark, tmp_path):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    steps = [(k, at(k)) for k in range(10)] + [(99, "2030-01-01 00:00:00")]
    rewards = [(0, at(20), 1.0), (3, at(3), 3.0), (4, at(70), 4.0), (50, at(60), 5.0), (98, "2030-01-01 00:00:00", 0.0)]
    for name, rows, schema in (("s", steps, "k long, ts string"), ("r", rewards, "k long, rts string, reward double")):
        spark.createDataFrame(rows, schema).withColumn(schema.split()[2], F.col(schema.split()[2]).cast("timestamp")).write.parquet(f"{tmp_path}/{name}")
    s = spark.readStream.schema("k long, ts timestamp").parquet(f"{tmp_path}/s")
    r = spark.readStream.schema("k long, rts timestamp, reward double").parquet(f"{tmp_path}/r")
    joined = lambda a, b: keyed.with_late_rewards(a, b, "k", "ts", "rts", "1 HOUR")
    got = sorted((x.k, x.reward) for x in drain(joined(s, r), tmp_path).filter("k < 99").collect())
    want = [(k, {0: 1.0, 3: 3.0}.get(k)) for k in range(10)]
    assert got == want
    assert sorted((x.k, x.reward) for x in joined(spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/r")).filter("k < 99").collect()) == want
    assert os.path.exists(f"{tmp_path}/checkpoint")
