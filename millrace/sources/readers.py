"""Readers: prompt tables, line-delimited records, metric logs, paired test files, archives and synthetic rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    def add(fn):
        READERS[name] = fn
        return fn

    return add


@reader("parquet")
def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, lenient: bool = False) -> DataFrame:
    """One or many paths or globs; nested columns by dotted names; ``lenient`` skips missing and corrupt files."""
    r = spark.read.option("ignoreMissingFiles", lenient).option("ignoreCorruptFiles", lenient)
    df = r.parquet(*paths)
    return df.select(*columns) if columns else df


@reader("jsonl")
def read_jsonl(spark: SparkSession, *paths: str, schema: str | None = None, drop_bad: bool = True) -> DataFrame:
    r = spark.read.option("mode", "DROPMALFORMED" if drop_bad else "FAILFAST")
    return (r.schema(schema) if schema else r).json(list(paths))


@reader("json")
def read_json(spark: SparkSession, path: str, key: str = "per_instance") -> DataFrame:
    """A JSON document: its list under ``key``, or itself a list."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode(key).alias("_x")).select("_x.*") if key in df.columns else df


@reader("local")
def read_local(spark: SparkSession, root: str, split: str) -> DataFrame:
    """First of the usual layouts that exists: split.jsonl, split.parquet, split-*.parquet, data/split-*.parquet."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for pattern in (f"{split}.jsonl", f"{split}.parquet", f"{split}-*.parquet", f"data/{split}-*.parquet", f"{split}/*.parquet"):
        p = fs_path(f"{root}/{pattern}")
        found = p.getFileSystem(conf).globStatus(p)
        if found is not None and len(found):
            return READERS["jsonl" if pattern.endswith("jsonl") else "parquet"](spark, f"{root}/{pattern}")
    raise FileNotFoundError(f"{root}: no file of split {split}")


@reader("metric_log")
def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """(step, metric, value) of lines "step:N - name:value - ..."; of repeated steps the last line counts."""
    lines = spark.read.text(path).select("value", F.regexp_extract("value", r"step:(\d+)", 1).try_cast("long").alias("step"), F.monotonically_increasing_id().alias("_n")).filter("step IS NOT NULL")
    last = lines.groupBy("step").agg(F.max_by("value", "_n").alias("value"))
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(r" - ([^:\s]+):(-?[0-9.eE+-]+)"), F.lit(1)).alias("m"), F.regexp_extract_all("value", F.lit(r" - ([^:\s]+):(-?[0-9.eE+-]+)"), F.lit(2)).alias("v"))
    return last.select("step", F.explode(pairs).alias("p")).select("step", F.col("p.m").alias("metric"), F.col("p.v").try_cast("double").alias("value"))


@reader("column_logs")
def read_column_logs(spark: SparkSession, root: str, files: str = "*.log") -> DataFrame:
    """One folder a metric with JSON lines {index, data}, pivoted to a row per index; of repeated indices the last line counts."""
    rows = spark.read.schema("index long, data double").json(f"{root}/*/{files}").withColumn("metric", F.element_at(F.split(F.input_file_name(), "/"), -2)).withColumn("_n", F.monotonically_increasing_id())
    return rows.groupBy("index").pivot("metric").agg(F.max_by("data", "_n"))


@reader("paired_tests")
def read_paired_tests(spark: SparkSession, root: str) -> DataFrame:
    """(stem, input, output): name.in with name.out or name.ans."""
    f = spark.read.format("binaryFile").load(f"{root}/*").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("text"))
    stem, kind = F.regexp_extract("name", r"^(.*)\.(in|out|ans)$", 1), F.regexp_extract("name", r"\.(in|out|ans)$", 1)
    f = f.select(stem.alias("stem"), kind.alias("kind"), "text").filter("kind <> ''")
    outs = f.filter("kind <> 'in'").groupBy("stem").agg(F.max_by("text", "kind").alias("output"))
    return f.filter("kind = 'in'").select("stem", F.col("text").alias("input")).join(outs, "stem")


@reader("zip_tests")
def read_zip_tests(spark: SparkSession, path: str) -> DataFrame:
    """(archive, stem, input, output) of the paired files in zip archives, an archive at a time."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for archive, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = {n: z.read(n).decode() for n in z.namelist() if re.search(r"\.(in|out|ans)$", n)}
                for n in sorted(names):
                    stem = n.removesuffix(".in")
                    answer = names.get(f"{stem}.out", names.get(f"{stem}.ans"))
                    if n.endswith(".in") and answer is not None:
                        out.append((archive, stem, names[n], answer))
            yield pd.DataFrame(out, columns=["archive", "stem", "input", "output"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, stem string, input string, output string")


@reader("synthetic")
def synthetic(spark: SparkSession, n: int, mode: str = "text") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("index"), F.lit(mode).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("placeholder "), F.col("id").cast("string")).alias("content"))).alias("prompt"))


@reader("columns")
def from_columns(spark: SparkSession, **columns: Sequence) -> DataFrame:
    """Rows of equally long sequences, numbered by row_id."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) != 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(pd.DataFrame({"row_id": range(sizes.pop()), **{k: list(v) for k, v in columns.items()}}))


def read(spark: SparkSession, kind: str, *args, **options) -> DataFrame:
    return READERS[kind](spark, *args, **options)
