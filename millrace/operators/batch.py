"""Batch algebra: projections, filters, slices, reshapes, padding and positional joins of row-numbered frames.

Every frame carries an explicit ``row_id`` (0-based, dense), so position never depends on file order, and most
operators are arithmetic on it: narrow, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.state import cut

RID = "row_id"


def with_row_id(df: DataFrame, *order: str, name: str = RID) -> DataFrame:
    """Dense 0-based numbers in the given order: one range exchange, then offsets by partition (one count each on the driver).

    The placement is written first: planned again for fewer columns, adaptive execution could merge partitions otherwise."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = {r._p: r["count"] for r in placed.groupBy("_p").count().collect()}
    offset, at = F.lit(0), 0
    pairs = []
    for p in sorted(counts):
        pairs += [F.lit(p), F.lit(at)]
        at += counts[p]
    offset = F.create_map(*pairs)[F.col("_p")] if pairs else F.lit(0)
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.withColumn(name, (local - 1 + offset).cast("long")).drop("_p")


def select_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys)


def pop(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(popped columns with row_id, the rest); an unknown key is an error."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(missing)
    return df.select(RID, *keys), df.drop(*keys)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.filter(mask)


def gather(df: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows by (pos, row_id) in order of pos, repeats kept; pos becomes the new row_id."""
    return indices.join(df, RID).drop(RID).withColumnRenamed("pos", RID)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Python's slice of a positive step; only negative bounds need a count."""
    n = df.count() if any(x is not None and x < 0 for x in (start, stop)) else None
    lo = 0 if start is None else max(0, start + n) if start < 0 else start
    hi = None if stop is None else max(0, stop + n) if stop < 0 else stop
    keep = (F.col(RID) >= lo) & ((F.col(RID) - lo) % step == 0)
    return df.filter(keep if hi is None else keep & (F.col(RID) < hi)).withColumn(RID, ((F.col(RID) - lo) / step).cast("long"))


def reorder(df: DataFrame, permutation: DataFrame) -> DataFrame:
    return gather(df, permutation)


def inverse_permutation(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col(RID).alias("pos"), F.col("pos").alias(RID))


def repeat(df: DataFrame, n: int, interleave: bool = True, total: int | None = None) -> DataFrame:
    """Each row n times: aabbcc if interleaved, else abcabc (which needs the number of rows)."""
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return out.withColumn(RID, F.col(RID) * n + F.col("_k")).drop("_k")
    total = df.count() if total is None else total
    return out.withColumn(RID, F.col("_k") * F.lit(total) + F.col(RID)).drop("_k")


def repeat_by(df: DataFrame, counts: Column) -> DataFrame:
    """Row-wise repeat counts; ``copy`` numbers the copies."""
    return df.withColumn("copy", F.explode(F.when(counts > 0, F.sequence(F.lit(0), counts.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def unfold_chunks(df: DataFrame, n_split: int, keys: Sequence[str]) -> DataFrame:
    """Arrays in ``keys`` are cut into n equal chunks, one row each; other columns repeat."""
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_split - 1))))
    for k in keys:
        w = (F.size(k) / n_split).cast("int")
        out = out.withColumn(k, F.slice(F.col(k), F.col("_k") * w + 1, w))
    return out.withColumn(RID, F.col(RID) * n_split + F.col("_k")).drop("_k")


def fold(df: DataFrame, size: int, value: str) -> DataFrame:
    """``size`` consecutive rows become one with an array."""
    rows = df.groupBy((F.col(RID) / size).cast("long").alias("fold_id")).agg(F.sort_array(F.collect_list(F.struct(RID, value))).alias("_v"))
    return rows.select(F.col("fold_id").alias(RID), F.transform("_v", lambda s: s[value]).alias(value))


def unfold(df: DataFrame, size: int, value: str) -> DataFrame:
    return df.select(RID, F.posexplode(value).alias("_p", value)).select((F.col(RID) * size + F.col("_p")).alias(RID), value)


def pad_to_divisor(df: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """Appends rows cycling from the front until ``divisor`` divides their number; (frame, pad size)."""
    n = df.count()
    pad = -n % divisor if n else 0
    if not pad:
        return df, 0
    extra = df.sparkSession.range(pad).select((F.col("id") + n).alias("_new"), (F.col("id") % n).alias(RID)).join(df, RID).withColumn(RID, F.col("_new")).drop("_new")
    return df.unionByName(extra), pad


def unpad(df: DataFrame, pad: int) -> DataFrame:
    return df.filter(F.col(RID) < df.count() - pad) if pad else df


def pad_repeat(df: DataFrame, size: int, candidate: str = "first") -> DataFrame:
    """Appends ``size`` copies of the first or else the last row."""
    n = df.count()
    row = df.filter(F.col(RID) == (0 if candidate == "first" else n - 1))
    return df.unionByName(row.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(RID, F.lit(n) + F.col("_k")).drop("_k"))


def chunk(df: DataFrame, k: int, n: int | None = None, name: str = "chunk") -> DataFrame:
    """Consecutive parts as even as possible, the first ones larger."""
    n = df.count() if n is None else n
    base, rest = divmod(n, k)
    cut = (base + 1) * rest
    r = F.col(RID)
    part = F.when(r < cut, (r / (base + 1)).cast("int")).otherwise(rest + ((r - cut) / max(base, 1)).cast("int"))
    return df.withColumn(name, part)


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """(epoch, batch) of each row per epoch; with a seed the order is a hash of seed, epoch and row."""
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return out.withColumn("batch", (F.col(RID) / size).cast("long"))
    numbered = [with_row_id(out.filter(F.col("epoch") == e).withColumn("_h", F.xxhash64(F.lit(seed), F.lit(e), F.col(RID))), "_h", RID, name="_n") for e in range(epochs)]
    out = numbered[0]
    for x in numbered[1:]:
        out = out.unionByName(x)
    return out.withColumn("batch", (F.col("_n") / size).cast("long")).drop("_n", "_h")


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional join; shared columns must be equal row by row, else the query fails."""
    shared = [c for c in left.columns if c in right.columns and c != RID]
    r = right.select(RID, *(F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns if c != RID))
    out = left.join(r, RID)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        out = out.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(dict(left.dtypes)[c]))).drop(f"_r_{c}")
    return out


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; each needs the same columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rows_to_columns(df: DataFrame, *columns: str) -> DataFrame:
    """One row of arrays in order of row_id: for bounded frames."""
    s = df.agg(F.sort_array(F.collect_list(F.struct(RID, *columns))).alias("_s"))
    return s.select(*(F.col("_s")[c].alias(c) for c in columns))


def balance_to(df: DataFrame, divisor: int, mode: str = "copy", seed: int = 0) -> DataFrame:
    """Drops or copies pseudo-random rows until the divisor divides their number; by a hash of the row, so it repeats."""
    n = df.count()
    rest = n % divisor
    if not rest:
        return df
    order = F.xxhash64(F.lit(seed), F.col(RID))
    if mode == "delete":
        gone = df.select(RID).orderBy(order, RID).limit(rest)
        return df.join(gone, RID, "left_anti")
    return df.unionByName(df.orderBy(order, RID).limit(divisor - rest))


# ---- arrays of a row ----


def position_ids(mask: Column) -> Column:
    """max(running sum - 1, 0) of a 0/1 array."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ids"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + x.cast("int")
        return F.struct(n.alias("n"), F.concat(s["ids"], F.array(F.greatest(n - 1, F.lit(0)))).alias("ids"))

    return F.aggregate(mask, zero, step, lambda s: s["ids"])


def response_mask(mask: Column, length: int) -> Column:
    return F.slice(mask, -length, length)


def eos_mask(ids: Column, eos: Sequence[int]) -> Column:
    """Ones up to the first end token, zeros after it."""
    first = F.array_min(F.filter(F.array(*(F.array_position(ids, F.lit(e)) for e in eos)), lambda p: p > 0))
    return F.transform(ids, lambda _, i: (i < F.coalesce(first, F.size(ids))).cast("int"))


def pad_or_cut(values: Column, length: int, pad: Column, truncation: str = "right", left_pad: bool = False) -> Column:
    """Exactly ``length`` elements; truncation keeps the left part ("right"), the right ("left"), both ends ("middle"), or fails ("error")."""
    n = F.size(values)
    half = length // 2
    cut = {
        "right": F.slice(values, 1, length),
        "left": F.slice(values, -length, length),
        "middle": F.concat(F.slice(values, 1, half), F.slice(values, -(length - half), length - half)),
        "error": F.when(n > length, F.raise_error(F.lit("sequence too long")).cast("array<int>")).otherwise(F.slice(values, 1, length)) if truncation == "error" else None,
    }[truncation]
    filler = F.array_repeat(pad, F.greatest(F.lit(length) - n, F.lit(0)))
    return F.when(n > length, cut).when(F.lit(left_pad), F.concat(filler, values)).otherwise(F.concat(values, filler))


def strip_left_padding(ids: Column, mask: Column) -> Column:
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(n > 0, F.slice(ids, -n, n)).otherwise(F.slice(ids, 1, 0))


def sft_loss_mask(mask: Column, prompt_length: Column, response_length: Column) -> Column:
    """Prompt tokens but the last are zero, and so is the last token of the response."""
    last = prompt_length + response_length - 1
    return F.transform(mask, lambda m, i: F.when(((prompt_length > 1) & (i < prompt_length - 1)) | (i == last), 0).otherwise(m.cast("int")))


def micro_batches(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("micro_batch", (F.col(RID) / size).cast("long"))
