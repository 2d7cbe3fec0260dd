"""Returns and sequence operators. Folds run inside one row's array, so a long trajectory costs its length, not its square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _reverse_fold(items: Column, start: Column, step) -> Column:
    """Array of a recursion from the last element back; ``step(run, item)`` gives the new run, which is also the output."""
    zero = F.struct(start.alias("run"), F.array().cast("array<double>").alias("out"))
    done = F.aggregate(F.reverse(items), zero, lambda a, x: F.struct(step(a["run"], x).alias("run"), F.concat(a["out"], F.array(step(a["run"], x))).alias("out")))
    return F.reverse(done["out"])


def discounted(values: Column, gamma: float) -> Column:
    """G_t = r_t + gamma * G_{t+1} of an array."""
    return _reverse_fold(values, F.lit(0.0), lambda run, x: x + gamma * run)


def reverse_cumsum(values: Column) -> Column:
    return discounted(values, 1.0)


def return_to_go(df: DataFrame, gamma: float, reward: str = "reward", traj: str = "traj_uid", step: str = "step", name: str = "ret") -> DataFrame:
    """Discounted return of every step: one grouping per trajectory, a fold, and back to rows."""
    rest = [c for c in df.columns if c != traj]
    g = df.groupBy(traj).agg(F.sort_array(F.collect_list(F.struct(F.col(step).alias("_o"), *(F.col(c).alias(c) for c in rest)))).alias("_s"))
    g = g.withColumn("_g", discounted(F.transform("_s", lambda s: s[reward].cast("double")), gamma))
    out = g.select(traj, F.explode(F.arrays_zip("_s", "_g")).alias("_z"))
    return out.select(traj, *(F.col(f"_z._s.{c}").alias(c) for c in rest), F.col("_z._g").alias(name))


def masked_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse fold that is reset behind masked tokens."""
    return _reverse_fold(F.arrays_zip(rewards.alias("r"), mask.alias("m")), F.lit(0.0), lambda run, x: (x["r"] + gamma * run) * x["m"])


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages; the value after the end is 0 and the mask plays no part in the recursion."""
    nxt = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, values, lambda r, v: r - v), nxt, lambda d, v: d + gamma * v)
    return discounted(delta, gamma * lam)


def rolling(df: DataFrame, value: str, window: int, order: str, *keys: str) -> DataFrame:
    """Rolling mean, least, largest and deviation (0 for one row) over up to ``window`` rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.select("*", F.avg(value).over(w).alias("roll_mean"), F.min(value).over(w).alias("roll_min"), F.max(value).over(w).alias("roll_max"), F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)).alias("roll_std"))


def ema(values: Column, alpha: float) -> Column:
    """Exponential mean (unadjusted) of an array."""
    zero = F.struct(F.lit(None).cast("double").alias("run"), F.array().cast("array<double>").alias("out"))

    def step(a, x):
        nxt = F.when(a["run"].isNull(), x).otherwise(alpha * x + (1 - alpha) * a["run"])
        return F.struct(nxt.alias("run"), F.concat(a["out"], F.array(nxt)).alias("out"))

    return F.aggregate(values, zero, step)["out"]


def first_per_key(df: DataFrame, order: str, *keys: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def last_per_key(df: DataFrame, order: str, *keys: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def rank_percentile(df: DataFrame, value: str, *keys: str, name: str = "pct") -> DataFrame:
    """Rank with averaged ties over n-1; 0.5 for a lone row."""
    w, t = Window.partitionBy(*keys), Window.partitionBy(*keys, value)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(t) - 1) / 2 - 1
    n = F.count("*").over(w)
    return df.withColumn(name, F.when(n > 1, rank / (n - 1)).otherwise(0.5))


def prefix_rate(df: DataFrame, hit: str, order: str, *keys: str) -> DataFrame:
    """Mean of the rows before each row, 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("prefix_rate", F.coalesce(F.avg(F.col(hit).cast("double")).over(w), F.lit(0.0)))


def longest_run(df: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Longest run of equal consecutive values per key."""
    w, v = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, value).orderBy(order)
    runs = df.withColumn("_i", F.row_number().over(w) - F.row_number().over(v)).groupBy(*keys, value, "_i").count()
    return runs.groupBy(*keys).agg(F.max("count").alias("longest_run"))


def history_text(df: DataFrame, text: str, h: int, order: str, *keys: str, sep: str = "\n") -> DataFrame:
    """The last h texts, each with its absolute step number; h = 0 means all."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding if h == 0 else -(h - 1), 0)
    return df.withColumn("history", F.array_join(F.collect_list(F.concat(F.lit("[step "), F.col(order).cast("string"), F.lit("] "), F.col(text))).over(w), sep))


def changed_since_last(df: DataFrame, source: str, order: str, *keys: str) -> DataFrame:
    """Whether a source differs from the last one of the same key; the first is changed."""
    before = F.lag(source).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("changed", before.isNull() | (before != F.col(source)))


def running_offsets(df: DataFrame, size: str, order: str, *keys: str) -> DataFrame:
    """Start and end of each piece in the concatenation."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(size).over(w)
    return df.withColumn("start_at", end - F.col(size)).withColumn("end_at", end)


def error_spread(df: DataFrame, status: str, order: str, *keys: str, error: int = -4) -> DataFrame:
    """Every case after the first compile error has that status."""
    seen = F.max((F.col(status) == error).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(status, F.when(F.coalesce(seen, F.lit(0)) == 1, F.lit(error)).otherwise(F.col(status)))


def stitch(early: DataFrame, live: DataFrame, step: str = "step") -> DataFrame:
    """Early rows only before the first live step, then live rows."""
    first = live.agg(F.min(step).alias("m")).first().m
    return (early if first is None else early.filter(F.col(step) < first)).unionByName(live)


def modal_first_state(df: DataFrame, state: str, order: str, traj: str, uid: str) -> DataFrame:
    """Most frequent first state of each group's trajectories; the smallest of equals."""
    n = first_per_key(df, order, uid, traj).groupBy(uid, state).count()
    w = Window.partitionBy(uid).orderBy(F.desc("count"), state)
    return n.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(uid, F.col(state).alias("first_state"))
