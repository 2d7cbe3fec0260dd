"""Trajectory logs: bad lines, byte ranges, pushed filters and a stream of the same."""

import json
import random
import uuid

import pytest

from millrace.sources import trajectories as T

SCHEMA = "traj_id bigint, step bigint, action string, reward double"


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    for k in range(3):
        lines = [json.dumps({"traj_id": k, "step": i, "action": rng.choice(["look", "edit é"]), "reward": i / 4 if i % 3 else None}) for i in range(40)]
        lines[5:5] = ["", "{broken", "[1, 2]", '{"traj_id": "text", "step": 1}'] if k else ["  "]
        (tmp_path / f"log-{k}.jsonl").write_text("\n".join(lines) + ("\n" if k else ""), encoding="utf-8")
    return tmp_path


@pytest.fixture
def source(spark):
    T.register(spark)
    return spark


def key(rows):
    return sorted((r.traj_id, r.step, r.action, r.reward is None, r.reward or 0.0) for r in rows)


def test_bad_lines_are_counted_by_file(spark, folder):
    records, report = T.read_records(spark, str(folder), SCHEMA)
    assert records.count() == 120 and records.columns == ["traj_id", "step", "action", "reward"]
    assert sorted((r.file, r.lines, r.bad, r.example) for r in report.collect()) == [("log-0.jsonl", 40, 0, None), ("log-1.jsonl", 43, 3, "[1, 2]"), ("log-2.jsonl", 43, 3, "[1, 2]")]


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_source_equals_plain_reading(source, folder, size):
    df = source.read.format("trajectory_log").option("rangeBytes", size).load(str(folder))
    good = df.filter("_bad IS NULL").collect()
    assert key(good) == key(T.read_records(source, str(folder), SCHEMA)[0].collect())
    assert sorted(r._bad for r in df.filter("_bad IS NOT NULL").collect()) == sorted(["{broken", "[1, 2]", '{"traj_id": "text", "step": 1}'] * 2)


def test_filters_are_pushed(source, folder):
    df = source.read.format("trajectory_log").load(str(folder))
    assert df.filter("traj_id = 1 AND action = 'look' AND step > 3").count() == sum(r.traj_id == 1 and r.action == "look" and r.step > 3 for r in df.collect())
    reader = T._Reader({"path": str(folder)}, df.schema)
    left = list(reader.pushFilters([T.EqualTo(("traj_id",), 1), T.EqualTo(("_bad",), "x")]))
    assert reader.wanted == {"traj_id": 1} and len(left) == 1
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {1}


def test_a_stream_takes_each_file_once(source, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")

    def drain():
        q = source.readStream.format("trajectory_log").load(str(folder)).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).queryName("x" + uuid.uuid4().hex).start()
        assert q.awaitTermination(60)
        return source.read.parquet(f"{at}/out")

    assert drain().filter("_bad IS NULL").count() == 120
    (folder / "log-9.jsonl").write_text('{"traj_id": 9, "step": 0, "action": "x", "reward": 1}\n')
    again = drain()
    assert again.filter("_bad IS NULL").count() == 121 and again.filter("traj_id = 9").count() == 1
