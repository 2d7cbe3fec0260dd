"""Selecting and merging instances: allow-lists, seeded orders, slices, draws, overlays and named benchmarks.

Random choices are by a hash of seed and key, so they don't depend on partitions and repeat.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.batch import slice_rows, with_row_id


def seeded(key: str, seed: int | str) -> Column:
    """A pseudo-random order: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def parse_slice(spec: str) -> tuple[int | None, int | None, int]:
    """Bounds of "a:b:c"; a missing step is 1."""
    parts = [int(x) if x.strip() else None for x in spec.split(":")]
    if len(parts) > 3:
        raise ValueError(f"invalid slice {spec!r}")
    start, stop, step = (parts + [None, None])[:3] if len(parts) > 1 else (None, parts[0], None)
    return start, stop, step or 1


def select_instances(df: DataFrame, key: str = "instance_id", allowed: Sequence[str] | None = None, level: str = "difficulty", easy_first: Sequence[str] = (), seed: int | None = None, pattern: str = "", spec: str = "", first: int | None = None) -> DataFrame:
    """Allow-list, order by rank of level or by seed (else by key), names that a pattern fits from their start, slice, first rows. Adds row_id."""
    if allowed:
        df = df.filter(F.lower(level).isin([a.lower() for a in allowed]))
    rank = F.lit(0)
    if easy_first:
        rank = F.coalesce(F.create_map(*(F.lit(x) for k, name in enumerate(easy_first) for x in (name, k)))[F.lower(level)], F.lit(len(easy_first)))
    if pattern:
        df = df.filter(F.col(key).rlike(f"^(?:{pattern})"))
    order = F.lit("") if seed is None else seeded(key, seed)
    out = with_row_id(df.withColumn("_rank", rank).withColumn("_order", order), "_order" if seed is not None else "_rank", key).drop("_rank", "_order")
    if spec:
        out = slice_rows(out, *parse_slice(spec))
    return out.filter(F.col("row_id") < first) if first is not None else out


def labelled(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.length(label) > 0)


def since(df: DataFrame, date: str, least: str, strict: bool = False) -> DataFrame:
    """Rows of a date, or after it if ``strict``; dates as text compare as dates do."""
    at = F.lit(least).cast(dict(df.dtypes)[date])
    return df.filter(F.col(date) > at if strict else F.col(date) >= at)


def exclude_done(df: DataFrame, done: DataFrame, key: str, mode: str = "won") -> DataFrame:
    """Rows whose id no earlier run has: any outcome ("all"), or a win ("won")."""
    if mode not in ("won", "all"):
        raise ValueError(mode)
    gone = done if mode == "all" else done.filter(F.col("outcome") == "won")
    return df.join(gone.select(key).distinct(), key, "left_anti")


def eligible_snippets(df: DataFrame, level: int, snippets: str = "snippets") -> DataFrame:
    """Exploded snippets of a level that changed and are not the root."""
    x = df.withColumn("_s", F.explode(snippets)).drop(snippets)
    s = F.col("_s")
    return x.filter((s["level"] == level) & F.coalesce(s["changed"], F.lit(True)) & (F.coalesce(s["origin"], F.lit("")) != "root")).select(*(c for c in x.columns if c != "_s"), "_s.*")


def with_tool_arguments(df: DataFrame, info: str, truth: Column, tool: str) -> DataFrame:
    """The nested record gets the tool's arguments from a sibling field."""
    extra = F.struct(F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")).alias(tool))
    return df.withColumn(info, F.col(info).withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", extra))


def position_range(df: DataFrame, key: str, seed: int, start: int, k: int, done: DataFrame | None = None, only_rewarded: bool = False) -> DataFrame:
    """Positions [start, start + k) of the seeded order, without ids that are done (or done with a reward of 1)."""
    out = with_row_id(df.withColumn("_order", seeded(key, seed)), "_order", key).drop("_order").filter(F.col("row_id").between(start, start + k - 1))
    if done is None:
        return out
    return out.join((done.filter("reward = 1") if only_rewarded else done).select(key).distinct(), key, "left_anti")


def matched_cases(inputs: Column, outputs: Column) -> Column:
    """{inputs, outputs} of the keys that both maps have, numbers first in order of value, then other keys."""
    both = F.array_intersect(F.map_keys(inputs), F.map_keys(outputs))
    number = lambda k: F.when(k.rlike(r"^\d+$"), k.try_cast("long"))
    keys = F.transform(F.array_sort(F.transform(both, lambda k: F.struct(number(k).isNull().alias("a"), number(k).alias("b"), k.alias("k")))), lambda s: s["k"])
    return F.struct(F.transform(keys, lambda k: inputs[k]).alias("inputs"), F.transform(keys, lambda k: outputs[k]).alias("outputs"))


def draw_weighted(df: DataFrame, weight: str, n: int, seed: int, group: str, *order: str) -> DataFrame:
    """n draws with replacement in each group, by weight: a draw falls into a row's part of the running sum.

    ``order`` must tell all rows of a group apart, else their parts are not defined; the last row's part goes up to 1.
    The draws of a group are its rows' counts in intervals of the unit, so rows and draws meet without a range join."""
    w = Window.partitionBy(group)
    running = w.orderBy(*order)
    upto = F.sum(weight).over(running.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w)
    unit = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = df.withColumn("_to", F.when(F.lead(F.lit(1)).over(running).isNull(), 1.0).otherwise(upto)).withColumn("_from", F.lag("_to", 1, 0.0).over(running))
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("draw"), unit(i).alias("u")))
    hit = F.filter(draws, lambda x: (x["u"] >= F.col("_from")) & (x["u"] < F.col("_to")))
    return rows.withColumn("_d", F.explode(hit)).select(*df.columns, F.col("_d.draw").alias("draw"))


def draw_instances(pool: DataFrame, key: str, pinned: Sequence, n: int, repeat: int, seed: int) -> DataFrame:
    """Pinned ids first, then others in seeded order (again from the start if the pool is too small), each ``repeat`` times. Adds place and copy."""
    order = F.coalesce(F.create_map(*(F.lit(x) for k, p in enumerate(pinned) for x in (p, k)))[F.col(key)], F.lit(len(pinned))) if pinned else F.lit(0)
    ranked = with_row_id(pool.withColumn("_pin", order).withColumn("_order", seeded(key, seed)), "_pin", "_order", key).drop("_pin", "_order")
    size = ranked.count()
    if not size:
        return ranked.withColumn("place", F.lit(0).cast("long")).withColumn("copy", F.lit(0)).drop("row_id")
    rounds = math.ceil(n / size)
    out = ranked.withColumn("place", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: r * size + F.col("row_id")))).filter(F.col("place") < n).drop("row_id")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))


def shard(df: DataFrame, rank: int, world: int, drop_last: bool = True, row: str = "row_id", n: int | None = None) -> DataFrame:
    """Every ``world``-th row from ``rank`` on; with ``drop_last`` all shards are as long as the shortest."""
    n = df.count() if n is None else n
    upto = n // world * world if drop_last else n
    return df.filter((F.col(row) < upto) & (F.col(row) % world == rank))


def sample_order(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    """Rows numbered in sequence, or in seeded order."""
    return with_row_id(df, key) if seed is None else with_row_id(df.withColumn("_order", seeded(key, seed)), "_order", key).drop("_order")


def until_target(groups: DataFrame, size: str, order: str, target: int) -> DataFrame:
    """Groups in order, up to and with the one that reaches the target: two running sums, one over blocks of groups."""
    g = groups.withColumn("_b", (F.col(order) / 1024).cast("long"))
    blocks = g.groupBy("_b").agg(F.sum(size).alias("_s"))
    before = blocks.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("_inside", inside).join(before, "_b").filter(F.col("_before") + F.col("_inside") < target).select(*groups.columns)


def merge_sliced(sources: Mapping[str, DataFrame], specs: Mapping[str, str], key: str) -> DataFrame:
    """Union of sources, each cut by its slice in order of key, with its name as _source."""
    out = None
    for name, df in sources.items():
        part = slice_rows(with_row_id(df, key), *parse_slice(specs[name])) if specs.get(name) else with_row_id(df, key)
        part = part.withColumn("_source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_accepted(base: DataFrame, extras: DataFrame, base_name: str, extra_name: str) -> DataFrame:
    return base.withColumn("_source", F.lit(base_name)).unionByName(extras.withColumn("_source", F.lit(extra_name)), allowMissingColumns=True)


def overlay(early: DataFrame, live: DataFrame, *keys: str) -> DataFrame:
    """Live rows, and early ones whose keys live doesn't have."""
    return live.unionByName(early.join(live.select(*keys).distinct(), list(keys), "left_anti").select(live.columns))


def cached_name(url: str) -> str:
    """File name of a url in a cache."""
    return sha256(url.encode()).hexdigest() + ".parquet"


def read_cached(spark: SparkSession, url: str, cache: str) -> DataFrame:
    """The cached copy of a url; nothing is fetched."""
    return spark.read.parquet(f"{cache}/{cached_name(url)}")


BENCHMARKS: dict[str, Callable[..., DataFrame]] = {}


def benchmark(name: str):
    """Decorator: a named loader (spark, root) of instances."""

    def add(fn):
        BENCHMARKS[name] = fn
        return fn

    return add


def load_benchmark(spark: SparkSession, name: str, root: str, spec: str = "", key: str = "instance_id", min_date: str = "", date: str = "date") -> DataFrame:
    """Instances of one benchmark, or of several joined by "+", not before ``min_date``, cut by a slice."""
    found = {n: BENCHMARKS[n](spark, root) for n in name.split("+")}
    found = {n: since(df, date, min_date) if min_date and date in df.columns else df for n, df in found.items()}
    return merge_sliced(found, dict.fromkeys(found, spec), key)


def first_files(spark: SparkSession, folder: str, n: int | None = None) -> DataFrame:
    """JSON documents of a folder, one a file, in order of file name, the first n."""
    df = spark.read.option("multiLine", True).json(folder).withColumn("_file", F.input_file_name())
    return (df.orderBy("_file").limit(n) if n is not None else df).withColumn("file", F.element_at(F.split("_file", "/"), -1)).drop("_file")


def common_divisor(*divisors: int) -> int:
    """Least common multiple that a batch must be divisible by."""
    return math.lcm(*divisors)
