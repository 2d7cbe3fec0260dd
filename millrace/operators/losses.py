"""Policy, value and preference losses over token arrays: column expressions inside a row, one aggregate over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def zipped(f, *arrays: Column) -> Column:
    """Elementwise f over arrays of one length."""
    names = [f"a{i}" for i in range(len(arrays))]
    return F.transform(F.arrays_zip(*(a.alias(n) for a, n in zip(arrays, names))), lambda s: f(*(s[n] for n in names)))


def masked_sum(x: Column, m: Column) -> Column:
    return asum(zipped(lambda v, k: v * k, x, m.cast("array<double>")))


def token_loss(df: DataFrame, loss: Column, mask: Column, mode: str = "token-mean") -> Column:
    """An aggregate of token losses: over tokens, or over sequences of sums, means, or sums over the length."""
    s, n = masked_sum(loss, mask), asum(mask.cast("array<double>"))
    return {
        "token-mean": F.sum(s) / (F.sum(n) + 1e-8),
        "seq-mean-token-sum": F.avg(s),
        "seq-mean-token-mean": F.avg(s / (n + 1e-8)),
        "seq-mean-token-sum-norm": F.sum(s) / F.max(F.size(mask)),
    }[mode]


def ppo_terms(old: Column, new: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Per token: struct of dual-clipped loss, upper clip, lower clip and approximate KL."""
    def term(o, n):
        kl = o - n
        r = F.exp(F.greatest(F.least(-kl, F.lit(20.0)), F.lit(-20.0)))
        plain, clipped = -adv * r, -adv * F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low))
        worse, floor = F.greatest(plain, clipped), -adv * dual
        loss = F.when(adv < 0, F.least(worse, floor)).otherwise(worse)
        return F.struct(loss.alias("loss"), (clipped > plain).cast("double").alias("clip"), ((worse > floor) & (adv < 0)).cast("double").alias("clip_low"), kl.alias("kl"))

    return zipped(term, old, new)


def ppo_loss(df: DataFrame, old: str = "old", new: str = "new", adv: str = "advantage", mask: str = "mask", mode: str = "token-mean") -> DataFrame:
    d = df.withColumn("_t", ppo_terms(F.col(old), F.col(new), F.col(adv)))
    get = lambda n: F.transform("_t", lambda s: s[n])
    m = F.col(mask)
    return d.agg(token_loss(d, get("loss"), m, mode).alias("pg_loss"), token_loss(d, get("clip"), m).alias("clip_frac"), token_loss(d, get("clip_low"), m).alias("clip_frac_low"), token_loss(d, get("kl"), m).alias("approx_kl"))


def gspo_loss(df: DataFrame, old: str = "old", new: str = "new", adv: str = "advantage", mask: str = "mask", low: float = 3e-4, high: float = 4e-4) -> DataFrame:
    """Sequence ratio: the exponent of the mean log ratio, clipped; mean over sequences."""
    n = asum(F.col(mask).cast("array<double>"))
    ratio = F.exp(F.least(masked_sum(zipped(lambda a, b: b - a, F.col(old), F.col(new)), F.col(mask)) / F.greatest(n, F.lit(1.0)), F.lit(10.0)))
    a = F.col(adv)
    loss = F.greatest(-a * ratio, -a * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)))
    return df.agg(F.avg(loss * n / (n + 1e-8)).alias("pg_loss"))


def value_loss(df: DataFrame, preds: str, values: str, returns: str, mask: str, clip: float) -> DataFrame:
    """Larger of plain and clipped squared errors, without a factor of one half."""
    def term(p, v, r):
        c = F.greatest(F.least(p, v + clip), v - clip)
        return F.struct(F.greatest((p - r) ** 2, (c - r) ** 2).alias("loss"), ((c - r) ** 2 > (p - r) ** 2).cast("double").alias("clip"))

    d = df.withColumn("_t", zipped(term, F.col(preds), F.col(values), F.col(returns)))
    m = F.col(mask)
    return d.agg(token_loss(d, F.transform("_t", lambda s: s["loss"]), m).alias("vf_loss"), token_loss(d, F.transform("_t", lambda s: s["clip"]), m).alias("clip_frac"))


def kl(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """Elementwise KL estimate: k1 (difference), abs, k2 (half its square), k3 (low variance, clamped)."""
    d = ref - logp
    return {"k1": logp - ref, "abs": F.abs(logp - ref), "k2": 0.5 * (logp - ref) ** 2, "k3": F.greatest(F.least(F.exp(d) - d - 1, F.lit(10.0)), F.lit(-10.0))}[kind]


def kl_in_reward(df: DataFrame, beta: float, scores: str, old: str, ref: str, mask: str, kind: str = "k1") -> DataFrame:
    """Scores minus beta times the masked KL, and the row's mean KL."""
    k = zipped(lambda a, b, m: kl(a, b, kind) * m, F.col(old), F.col(ref), F.col(mask).cast("array<double>"))
    return df.withColumn("_k", k).withColumn("token_rewards", zipped(lambda s, x: s - beta * x, F.col(scores), F.col("_k"))).withColumn("mean_kl", asum(F.col("_k")) / (asum(F.col(mask).cast("array<double>")) + 1e-8)).drop("_k")


def beta_sequence(kls: Column, start: float, target: float, horizon: float, n_steps: float) -> Column:
    """Adaptive controller: beta moves by the error's ratio, clipped to a fifth."""
    zero = F.struct(F.lit(start).alias("b"), F.array().cast("array<double>").alias("out"))

    def step(a, x):
        b = a["b"] * (1 + F.greatest(F.least(x / target - 1, F.lit(0.2)), F.lit(-0.2)) * n_steps / horizon)
        return F.struct(b.alias("b"), F.concat(a["out"], F.array(b)).alias("out"))

    return F.aggregate(kls, zero, step)["out"]


def entropy(logits: Column) -> Column:
    """logsumexp minus the mean logit of a row's logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = asum(e)
    return F.log(z) + top - asum(zipped(lambda p, x: p * x, e, logits)) / z


def log_softmax_at(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    return F.element_at(logits, label + 1) - top - F.log(asum(F.transform(logits, lambda x: F.exp(x - top))))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid", reference_free: bool = False) -> Column:
    ref = F.lit(0.0) if reference_free else ref_chosen - ref_rejected
    x = (chosen - rejected) - ref
    if kind == "ipo":
        return (x - 1 / (2 * beta)) ** 2
    return -log_sigmoid(beta * x) * (1 - smoothing) - log_sigmoid(-beta * x) * smoothing


def ce_loss(logit: Column, target: Column, beta: float = 1.0) -> Column:
    """Binary cross entropy of a scaled sum."""
    x = beta * logit
    return -(target * log_sigmoid(x) + (1 - target) * log_sigmoid(-x))


def penalise_invalid(scores: Column, length: Column, valid: Column, coefficient: float) -> Column:
    """Takes the penalty from the last valid token of invalid rows; rows without tokens stay."""
    return F.transform(scores, lambda x, i: F.when((i == length - 1) & ~valid, x - coefficient).otherwise(x))


def score_at_end(score: Column, length: Column, total: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.when(i == length - 1, score).otherwise(F.lit(0.0)))


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))
