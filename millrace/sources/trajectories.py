"""Trajectory logs: JSON lines with bad lines counted by file, and a data source of one's own with pushed filters and a stream.

``read_records`` is the plain way, on any file system that Spark reads. ``TrajectoryLogs`` shows how a format of one's own joins
in (``register(spark)``, then ``format("trajectory_log")``): partitions are byte ranges of files, filters
on equality are applied while lines are parsed, and a stream takes each new file once. It opens files itself, so their folder
must be mounted on all executors.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

RANGE_BYTES = 64 << 20
BAD = "_bad"


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, report): the lines that hold a record of the schema, and (file, lines, bad, example) of each file.

    A line is bad if it isn't a JSON object or a value doesn't fit its column; blank lines don't count. ``example`` is the first
    80 characters of the least bad line, null if there is none. The report is counted, not gathered."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").filter(F.trim("value") != "")
    fields = ", ".join([schema, f"`{BAD}` string"])
    parsed = lines.select("file", "value", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    bad = F.col(f"r.{BAD}").isNotNull() | F.col("r").isNull()
    records = parsed.filter(~bad).select("r.*").drop(BAD)
    report = parsed.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad"), F.left(F.min(F.when(bad, F.col("value"))), F.lit(80)).alias("example"))
    return records, report


class Range(InputPartition):
    """A file's lines that start in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def lines_of(part: Range) -> Iterator[bytes]:
    with open(part.path, "rb") as f:
        if part.start:
            f.seek(part.start - 1)
            f.readline()  # the line that the range before has
        while f.tell() < part.end and (line := f.readline()):
            yield line


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    return sorted(f for f in (glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))


def _ranges(files: list[str], size: int) -> list[Range]:
    return [Range(f, a, min(a + size, n)) for f in files for n in [os.path.getsize(f)] for a in range(0, n, size)]


def _fits(value, kind: str) -> bool:
    return value is None or {"bigint": lambda v: type(v) is int, "double": lambda v: type(v) in (int, float), "string": lambda v: type(v) is str, "boolean": lambda v: type(v) is bool}[kind](value)


def _rows(part: Range, schema: StructType, wanted: dict) -> Iterator[tuple]:
    """Records of a range; a bad line comes as nulls and the line itself in the last column."""
    names, kinds = schema.names[:-1], [f.dataType.simpleString() for f in schema.fields[:-1]]
    for line in lines_of(part):
        if not line.strip():
            continue
        try:
            record = json.loads(line)
            ok = isinstance(record, dict) and all(_fits(record.get(n), k) for n, k in zip(names, kinds))
        except ValueError:
            ok = False
        if not ok:
            if not wanted:
                yield (*[None] * len(names), line.decode(errors="replace").rstrip("\r\n"))
        elif all(record.get(n) == v for n, v in wanted.items()):
            yield (*[float(v) if k == "double" and v is not None else v for v, k in ((record.get(n), k) for n, k in zip(names, kinds))], None)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.size, self.schema = options["path"], int(options.get("rangeBytes", RANGE_BYTES)), schema
        self.wanted: dict = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities of records' columns are taken; the others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.schema.names[:-1]:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.path), self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(partition, self.schema, self.wanted)


class _StreamReader(DataSourceStreamReader):
    """Files in the order of their names; the offset is the last name seen, so files must be added in order and whole."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.size, self.schema = options["path"], int(options.get("rangeBytes", RANGE_BYTES)), schema

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = [os.path.basename(f) for f in _files(self.path)]
        return {"after": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges([f for f in _files(self.path) if start["after"] < os.path.basename(f) <= end["after"]], self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(partition, self.schema, {})

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class TrajectoryLogs(DataSource):
    """Format ``trajectory_log``: the schema's columns (bigint, double, string, boolean) and, last, ``_bad`` for lines that hold no record."""

    @classmethod
    def name(cls) -> str:
        return "trajectory_log"

    def schema(self) -> str:
        return f"traj_id bigint, step bigint, action string, reward double, {BAD} string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets sources of one's own take filters in it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrajectoryLogs)
