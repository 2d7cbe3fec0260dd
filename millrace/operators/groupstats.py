"""Group-relative statistics and advantages. All are windows over one partitioning, so a plan shuffles once for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def centred(score: Column, *keys: str, ddof: int | None = 1, singleton: str = "raw", eps: float = EPS) -> Column:
    """(score - mean) / (std + eps) over a group. ddof None: no division. singleton "raw": a lone row keeps its
    score (mean 0, deviation 1); "zero": it becomes 0."""
    w = Window.partitionBy(*keys)
    n, mean = F.count(score).over(w), F.avg(score).over(w)
    std = F.lit(1.0) if ddof is None else (F.stddev_samp(score) if ddof == 1 else F.stddev_pop(score)).over(w) + eps
    return F.when(n > 1, (score - mean) / std).otherwise(score.cast("double") if singleton == "raw" else F.lit(0.0))


def grpo(df: DataFrame, score: str = "score", uid: str = "uid", norm: bool = True, name: str = "advantage") -> DataFrame:
    return df.withColumn(name, centred(F.col(score), uid, ddof=1 if norm else None))


def first_rows_stats(df: DataFrame, score: str, uid: str, traj: str, order: str) -> DataFrame:
    """Advantage whose statistics use only each trajectory's first row, applied to all rows."""
    first = F.row_number().over(Window.partitionBy(uid, traj).orderBy(order)) == 1
    d = df.withColumn("_s", F.when(first, F.col(score)))
    w = Window.partitionBy(uid)
    n, mean, std = F.count("_s").over(w), F.avg("_s").over(w), F.stddev_samp("_s").over(w)
    return d.withColumn("advantage", F.when(n > 1, (F.col(score) - mean) / (std + EPS)).otherwise(F.col(score))).drop("_s")


def pass_at_k(df: DataFrame, score: str = "score", uid: str = "uid", order: str = "row_id", norm: bool = True) -> DataFrame:
    """Only a group's best row gets something: its lead over the second, by the deviation."""
    w = Window.partitionBy(uid)
    rank = F.row_number().over(w.orderBy(F.desc(score), order))
    second = F.max(F.when(F.col("_r") == 2, F.col(score))).over(w)
    gain = F.col(score) - second
    if norm:
        gain = gain / (F.stddev_samp(score).over(w) + EPS)
    return df.withColumn("_r", rank).withColumn("advantage", F.when(F.col("_r") == 1, F.coalesce(gain, F.lit(0.0))).otherwise(0.0)).drop("_r")


def rloo(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    w = Window.partitionBy(uid)
    n = F.count(score).over(w)
    return df.withColumn("advantage", F.when(n > 1, (F.col(score) - F.avg(score).over(w)) * n / (n - 1)).otherwise(F.col(score)))


def episode_step_joint(df: DataFrame, episode: str, ret: str, uid: str = "uid", anchor: str = "anchor_obs", weight: float = 1.0, norm: bool = False) -> DataFrame:
    """Episode advantage over the prompt group plus weighted step advantage over the anchor group."""
    ddof = 1 if norm else None
    w = Window.partitionBy(uid)
    n, mean = F.count(episode).over(w), F.avg(episode).over(w)
    std = (F.stddev_samp(episode).over(w) + EPS) if norm else F.lit(1.0)
    d = df.withColumn("adv_episode", F.when(n > 1, (F.col(episode) - mean) / std).otherwise(F.col(episode)))
    d = d.withColumn("adv_step", centred(F.col(ret), uid, anchor, ddof=ddof, singleton="zero"))
    return d.withColumn("advantage", F.col("adv_episode") + weight * F.col("adv_step"))


def whiten(df: DataFrame, value: str, mask: Column | None = None, shift_mean: bool = True, name: str = "whitened") -> DataFrame:
    """(v - mean) / sqrt(var + 1e-8) over the whole masked frame; its three sums come to the driver as scalars."""
    m = F.lit(1.0) if mask is None else mask.cast("double")
    s = df.agg(F.sum(m).alias("n"), F.sum(m * F.col(value)).alias("s")).first()
    if not s.n or s.n <= 1:
        raise ValueError("whitening needs at least two values")
    mean = s.s / s.n
    var = df.agg(F.sum(m * (F.col(value) - mean) ** 2).alias("v")).first().v / (s.n - 1)
    out = (F.col(value) - mean) / (var + 1e-8) ** 0.5
    return df.withColumn(name, out if shift_mean else out + mean)


def rfpp_baseline(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    """Minus the group's mean, then whitened over all."""
    w = Window.partitionBy(uid)
    d = df.withColumn("_c", F.when(F.count(score).over(w) > 1, F.col(score) - F.avg(score).over(w)).otherwise(F.col(score)))
    return whiten(d, "_c", name="advantage").drop("_c")


def consecutive_rloo(df: DataFrame, score: str, n: int, row: str = "row_id") -> DataFrame:
    """Leave-one-out over n consecutive rows."""
    w = Window.partitionBy((F.col(row) / n).cast("long"))
    others = (F.sum(score).over(w) - F.col(score)) / F.greatest(F.count(score).over(w) - 1, F.lit(1))
    return df.withColumn("advantage", F.col(score) - others)


def history_groups(df: DataFrame, ret: str = "reward", k: int = 3, alpha: float = 1.0, uid: str = "uid", traj: str = "traj_uid", step: str = "step", obs: str = "anchor_obs", base: str | None = None) -> DataFrame:
    """Weighted mean of advantages in groups that share the last 1..k observations; groups of one and zeros don't count. ``base`` is an advantage of weight 1 for no history."""
    w = Window.partitionBy(uid, traj).orderBy(step)
    d = df.withColumn("_h", F.collect_list(obs).over(w.rowsBetween(-(k - 1), 0)))
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_h")))).withColumn("_key", F.array_join(F.slice("_h", -F.col("_k"), F.col("_k")), "\u0001"))
    g = Window.partitionBy(uid, "_k", "_key")
    adv = F.when(F.count("*").over(g) > 1, (F.col(ret) - F.avg(ret).over(g)) / (F.stddev_pop(ret).over(g) + EPS)).otherwise(0.0)
    d = d.withColumn("_a", adv).withColumn("_w", F.pow((F.col("_k") + 1).cast("double"), F.lit(alpha)))
    d = d.select(uid, traj, step, "_a", "_w")
    if base:
        d = d.unionByName(df.select(uid, traj, step, F.col(base).alias("_a"), F.lit(1.0).alias("_w")))
    on = F.col("_a") != 0
    return d.groupBy(uid, traj, step).agg((F.coalesce(F.sum(F.when(on, F.col("_w") * F.col("_a"))), F.lit(0.0)) / (F.coalesce(F.sum(F.when(on, F.col("_w"))), F.lit(0.0)) + EPS)).alias("advantage"))


def soft_mean_baseline(df: DataFrame, score: str, beta: float) -> DataFrame:
    """score minus (logsumexp(beta x) - ln n) / beta over the whole frame; beta 0 is the mean."""
    if beta == 0:
        base = df.agg(F.avg(score).alias("b")).first().b
    else:
        top = df.agg(F.max(F.lit(beta) * F.col(score)).alias("m")).first().m
        base = df.agg((F.log(F.avg(F.exp(F.lit(beta) * F.col(score) - top))) + top).alias("b")).first().b / beta
    return df.withColumn("advantage", F.col(score) - base)


def preference_pairs(df: DataFrame, score: str, row: str = "row_id") -> DataFrame:
    """chosen: the better of each two consecutive rows, the first if equal."""
    w = Window.partitionBy((F.col(row) / 2).cast("long")).orderBy(F.desc(score), row)
    return df.withColumn("chosen", F.row_number().over(w) == 1)


def pairwise_accuracy(df: DataFrame, score: str, acc: str, n: int, row: str = "row_id") -> DataFrame:
    """Per group of n rows: share of pairs ranked as their accuracies are, weighted by their difference; 0.5 if all are equal."""
    g = df.select((F.col(row) / n).cast("long").alias("g"), F.col(row).alias("k"), F.col(score).alias("s"), F.col(acc).cast("double").alias("a"))
    a, b = g.alias("x"), g.alias("y")
    p = a.join(b, (F.col("x.g") == F.col("y.g")) & (F.col("x.k") < F.col("y.k")), "left")
    gap = F.abs(F.col("x.a") - F.col("y.a"))
    right = ((F.col("x.s") - F.col("y.s")) * (F.col("x.a") - F.col("y.a")) > 0).cast("double")
    s = p.groupBy(F.col("x.g").alias("group_id")).agg(F.sum(gap * right).alias("hit"), F.sum(gap).alias("all"))
    return s.select("group_id", F.when(F.coalesce("all", F.lit(0.0)) == 0, 0.5).otherwise(F.col("hit") / F.col("all")).alias("accuracy"))


def keep_mixed_groups(df: DataFrame, reward: str, uid: str = "uid", keep_single: bool = False) -> DataFrame:
    """Groups whose rewards differ (and those of one row, if asked for)."""
    w = Window.partitionBy(uid)
    keep = F.min(reward).over(w) < F.max(reward).over(w)
    if keep_single:
        keep = keep | (F.count("*").over(w) == 1)
    return df.withColumn("_keep", keep).filter("_keep").drop("_keep")


def filter_by_band(df: DataFrame, acc: str, uid: str, low: float, high: float, take: int) -> DataFrame:
    """Groups inside the accuracy band first, then others, by group; the first ``take`` groups."""
    g = df.groupBy(uid).agg(F.avg(acc).alias("acc"))
    ranked = g.withColumn("kept", ((F.col("acc") >= low) & (F.col("acc") <= high)).cast("int")).orderBy(F.desc("kept"), uid).limit(take)
    return df.join(ranked.select(uid), uid, "left_semi")


def weights_pf(df: DataFrame, score: str, method: str = "pow", power: float = 2.0) -> DataFrame:
    """Normalised resampling weights: abs score to a power, or 1 for the extremes and 0 else."""
    if method == "pow":
        raw = F.pow(F.abs(F.col(score)), F.lit(power))
    else:
        s = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
        raw = F.col(score).isin(s.lo, s.hi).cast("double") if method == "max_min" else F.when(F.col(score) == s.hi, 1.0).otherwise(0.4)
    total = df.agg(F.sum(raw).alias("t")).first().t
    return df.withColumn("weight", raw / total)


def group_size_summary(df: DataFrame, *keys: str) -> DataFrame:
    g = df.groupBy(*keys).count()
    return g.agg(F.count("*").alias("n_groups"), F.avg("count").alias("mean_size"), F.median("count").alias("median_size"), F.avg((F.col("count") <= 1).cast("double")).alias("singleton_rate"))


def group_size_histogram(df: DataFrame, *keys: str) -> DataFrame:
    """Groups by size: 1 to 8, 9-16, 17+."""
    n = F.col("count")
    return df.groupBy(*keys).count().groupBy(F.when(n <= 8, n.cast("string")).when(n <= 16, "9-16").otherwise("17+").alias("bucket")).agg(F.count("*").alias("n_groups"))


def groupability(size: Column, n: Column, s0: float = 8.0, ref: float = 8.0, form: str = "saturating") -> Column:
    """phi(size) * psi(n): saturating 1-exp(-x/s0), logarithmic or linear; a group of one has none."""
    def shape(x: Column, scale: float) -> Column:
        return {"saturating": 1 - F.exp(-x / scale), "log": F.log1p(x) / F.log1p(F.lit(scale)), "linear": F.least(x / scale, F.lit(1.0))}[form]

    return shape(size.cast("double"), s0) * F.when(n > 1, shape((n - 1).cast("double"), ref)).otherwise(0.0)


def prime_norm(df: DataFrame, rewards: str) -> DataFrame:
    """Token scores over the largest absolute reverse running sum of the whole frame."""
    from millrace.operators.returns import reverse_cumsum

    top = df.agg(F.max(F.array_max(F.transform(reverse_cumsum(F.col(rewards)), lambda x: F.abs(x)))).alias("m")).first().m
    return df.withColumn(rewards, F.transform(rewards, lambda x: x / (top + 1e-6)))


def weighted_joint(df: DataFrame, episode: str, ret: str, step_weight: float = 1.0, episode_weight: float = 1.0, uid: str = "uid", anchor: str = "anchor_obs", norm: bool = False) -> DataFrame:
    """Step advantage over the anchor group and episode advantage over the prompt group, each by its weight; an episode weight of 0 is not computed."""
    if episode_weight == 0:
        return df.withColumn("advantage", step_weight * centred(F.col(ret), uid, anchor, ddof=1 if norm else None, singleton="zero"))
    joint = episode_step_joint(df, episode, ret, uid, anchor, norm=norm)
    return joint.withColumn("advantage", step_weight * F.col("adv_step") + episode_weight * F.col("adv_episode"))


def detached_loss(df: DataFrame, score: str, acc: str, beta: float, uid: str = "uid") -> DataFrame:
    """Per row the loss of its score against the mean score of the rows of its group that did otherwise, and its best-of-n weight by accuracy.

    Accuracies have few distinct values, so the sums of those below and above are windows in order of accuracy, not pairs."""
    w = Window.partitionBy(uid).orderBy(acc)
    whole = Window.partitionBy(uid)
    upto, n_upto = F.sum(score).over(w), F.count("*").over(w)  # ties included
    own, n_own = F.sum(score).over(Window.partitionBy(uid, acc)), F.count("*").over(Window.partitionBy(uid, acc))
    total, n = F.sum(score).over(whole), F.count("*").over(whole)
    good = F.col(acc) > 0
    other, n_other = F.when(good, upto - own).otherwise(total - upto), F.when(good, n_upto - n_own).otherwise(n - n_upto)
    margin = beta * (F.col(score) - F.when(n_other > 0, other / n_other).otherwise(0.0)) * F.when(good, 1).otherwise(-1)
    return df.withColumn("loss", F.log1p(F.exp(-margin))).withColumn("weight", n * F.pow(n_upto / n, n - 1))


def size_shares(groups: DataFrame, low: int, high: int, by_mass: bool, macro: bool, instance: str = "instance", step: str = "step", size: str = "size") -> DataFrame:
    """(bucket, pct): shares of group sizes 2..20 and 21+ in steps low..high, by count or by mass; pooled, or as the mean of instances."""
    g = groups.filter(F.col(step).between(low, high))
    have = g.select(instance).distinct().count() if macro else 1
    g = g.filter(F.col(size) >= 2).withColumn("bucket", F.when(F.col(size) >= 21, "21+").otherwise(F.col(size).cast("string")))
    keys = [instance] if macro else []
    sums = g.groupBy(*keys, "bucket").agg((F.sum(size) if by_mass else F.count("*")).cast("double").alias("_m"))
    pct = sums.withColumn("_p", 100.0 * F.col("_m") / F.sum("_m").over(Window.partitionBy(*keys)))
    out = pct.groupBy("bucket").agg((F.sum("_p") / F.lit(max(1, have))).alias("pct"))
    return out.withColumn("pct", 100.0 * F.col("pct") / F.sum("pct").over(Window.partitionBy()))


def edge_rank(df: DataFrame, value: str, *keys: str, name: str = "pct") -> DataFrame:
    """Rank share with mean ranks of ties inside a group; where all are equal, 1, 0 or a half by sign."""
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0 - 1
    low, high = F.min(value).over(w), F.max(value).over(w)
    alone = F.when(low > 0, 1.0).when(low < 0, 0.0).otherwise(0.5)
    return df.withColumn(name, F.when(low == high, alone).otherwise(rank / (F.count("*").over(w) - 1)))
