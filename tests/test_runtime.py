"""Runtime surfaces, and row numbers of wide frames."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import runtime as U
from millrace.operators.batch import with_row_id
from millrace.operators.selection import common_divisor, parse_slice


def test_loading_and_timeouts(tmp_path):
    (tmp_path / "score.py").write_text("def score(x, k=1):\n    return x * k\n")
    assert U.load_function(str(tmp_path / "score.py"), "score", k=3)(2) == 6
    with pytest.raises(AttributeError):
        U.load_function(str(tmp_path / "score.py"), "other")
    assert U.with_timeout(lambda: time.sleep(3), 0.05, fallback=0.0)() == 0.0
    with pytest.raises(TimeoutError):
        U.with_timeout(lambda: time.sleep(3), 0.05)()


def test_pool_keeps_order_and_errors():
    def work(x):
        if x == 1:
            raise ValueError("bad")
        if x == 2:
            time.sleep(3)
        return x

    got = U.run_pool(work, range(4), 4, 0.5)
    assert [r["item"] for r in got] == [0, 1, 2, 3] and [r["value"] for r in got] == [0, None, None, 3]
    assert got[1]["error"].startswith("ValueError") and got[2]["error"].startswith("TimeoutError")


def test_rate_limit_and_tools():
    limit, most = U.RateLimit(2), []

    def hold(_):
        with limit:
            most.append(limit.held)
            time.sleep(0.01)

    U.run_pool(hold, range(8), 8, 5)
    assert max(most) <= 2 and limit.held == 0
    tool = U.Tool(lambda state, args: (str(args["x"] + state["base"]), 0.5, {}), lambda state: float(state["base"]))
    key = tool.create(base=2)
    assert tool.execute(key, {"x": 1})[0] == "3" and tool.reward(key) == 2.0
    tool.release(key)
    with pytest.raises(KeyError):
        tool.reward(key)


def test_resampling(spark):
    draw = lambda k: spark.range(k * 3, k * 3 + 3).withColumnRenamed("id", "g")
    assert sorted(r.g for r in U.resample_until(draw, lambda x: x, "g", 5, 4).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        U.resample_until(draw, lambda x: x.limit(0), "g", 1, 2)


def test_slices_and_divisors():
    assert parse_slice("3:9:2") == (3, 9, 2) and parse_slice(":4") == (None, 4, 1) and parse_slice("-2:") == (-2, None, 1)
    with pytest.raises(ValueError):
        parse_slice("1:2:3:4")
    assert common_divisor(4, 6, 10) == 60


def test_row_ids_of_wide_frames(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        x = with_row_id(li.withColumn("pad", F.repeat(F.lit("x"), 200)), "l_orderkey", "l_linenumber")
        n = x.count()
        r = x.agg(F.count_distinct("row_id").alias("d"), F.min("row_id").alias("a"), F.max("row_id").alias("b"), F.count("row_id").alias("c")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (r.d, r.a, r.b, r.c) == (n, 0, n - 1, n)
