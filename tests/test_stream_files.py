"""Streams whose output grows with their input leave it in files, not on the driver."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import registry, texts  # noqa: F401
from millrace.streaming import events, keyed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["t08_late_rewards", "t03_gate_stream"])
def test_output_is_in_files(spark, name):
    out = registry.queries()[name](spark, SF)
    assert out.inputFiles()  # a table in the driver's memory has none
    assert out.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_nothing_to_read(spark, tmp_path):
    schema = "traj string, place long, sig string, source string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    with keyed.state_store(spark):
        stream = keyed.gate_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "traj", "place", F.col("sig"), F.col("source"), F.lit(False))
        out = events.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert out.columns == ["traj", "place", "name", "changed"] and out.collect() == []
