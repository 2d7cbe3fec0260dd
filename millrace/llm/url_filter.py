"""URL filter with empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host. A host's good rate is shrunk towards its registered
domain's, that towards its suffix's, that towards the overall rate; each level is a beta-binomial whose
intraclass correlation is estimated by the method of moments. A page is blocked where the lower posterior bound
of its host's good rate (a quantile of the beta posterior) lies under a threshold; explicit rules come before the estimate.
The registered domain is the label before the suffix; the suffix is the last label, or the last two where a general
label (``co``, ``com``, ...) stands before a country's; numeric addresses are a domain of their own.

Cases: a null url or one without ``://`` has an empty host and path and is judged by the prior; hosts without
labels get their domain's posterior; without any label at all the prior mean is 0.5. Null outcomes are ignored.
The only wide operation on pages is the join to the per-host table, which adaptive execution broadcasts if it is
small and else splits at hot hosts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.durable import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an url; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL_PATTERN, 1), UPPER, LOWER), F.regexp_extract(url, URL_PATTERN, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, else nulls. A rule fits its host and all subdomains."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern, verdict = F.when(fits, F.lit(r.pattern)).otherwise(pattern), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


#: General labels that countries register under.
GENERAL = "ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|nom|or|org"
NUMERIC = r"^[0-9.]+(:[0-9]+)?$"


def suffix_of(host: Column) -> Column:
    """The part of a host under which domains are registered."""
    return F.when(host.rlike(NUMERIC), host).when(host.rlike(rf"(^|\.)({GENERAL})\.[a-z]{{2}}$"), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Suffix and the label before it."""
    return F.when(host.rlike(NUMERIC), host).when(host.rlike(rf"(^|\.)({GENERAL})\.[a-z]{{2}}$"), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (Lentz), for whole arrays."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a, b)]) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 201):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-12):
            break
    return np.where(swap, 1 - front * h, front * h)


def beta_quantile(level: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where beta distributions reach ``level``, by bisection."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(50):
        middle = (low + high) / 2
        under = beta_below(middle, a, b) < level
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def _correlation(rows: DataFrame, floor: float = 0.001) -> float:
    """Intraclass correlation of rates k/n around the parents' means mu, by moments; one row comes to the driver."""
    chi = F.col("n") * (F.col("k") / F.col("n") - F.col("mu")) ** 2 / (F.col("mu") * (1 - F.col("mu")))
    x = rows.filter("n > 0 AND mu > 0 AND mu < 1").agg(F.sum(chi).alias("chi"), F.count("*").alias("c"), F.sum(F.col("n") - 1).alias("d")).first()
    return min(0.999, max(floor, (x.chi - x.c) / x.d)) if x.c and x.d else 0.5


def host_reputation(hosts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """``hosts`` has (host, n, k): labelled pages and good ones, 0 if none. Returns host, mean and lower bound.

    Works on pre-aggregated rows, one per host, so a hot host costs no more than a rare one."""
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total.k + 0.5) / (total.n + 1.0) if total.n is not None else 0.5

    def shrunk(rows: DataFrame) -> DataFrame:
        strength = 1 / _correlation(rows) - 1
        a, b = F.col("mu") * strength + F.col("k"), (1 - F.col("mu")) * strength + F.col("n") - F.col("k")
        return rows.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:  # one row for each host
        return pd.Series(beta_quantile(1 - confidence, a.to_numpy(), b.to_numpy()))

    suffixes = shrunk(suffixes.withColumn("mu", F.lit(mean))).select("suffix", F.col("mean").alias("mu"))
    domains = shrunk(domains.join(suffixes, "suffix")).select("domain", F.col("mean").alias("mu"))
    return shrunk(hosts.join(domains, "domain")).select("host", "mean", bound("a", "b").alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), threshold: float = 0.5, url: str = "url", key: str = "page_id") -> DataFrame:
    """Adds host, path, rule, verdict and the host's posterior mean and lower bound to ``pages``.

    ``outcomes`` has (key, good boolean); several outcomes of one page all count. Of ``pages`` only ``key`` and
    ``url`` are read; other columns, whatever their names, stay out of the result."""
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    good = outcomes.select(F.col(key).alias("page_id"), F.col("good").cast("int").alias("good")).filter("good IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    hosts = checkpoint(parts.select("page_id", "host").join(good, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = parts.join(host_reputation(hosts), "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") >= threshold, "allow").otherwise("block")).alias("verdict"), F.col("mean").alias("reputation"), F.col("bound").alias("reputation_bound"))
