"""Smoothing of shares over steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smooth_shares(df: DataFrame, low: int, high: int, kind: str = "kind", step: str = "step", value: str = "value", dx: float = 0.25, sigma_steps: float = 2.0) -> DataFrame:
    """(kind, place, x, share): each kind's values on a grid, interpolated, smoothed by a Gaussian, and scaled to a sum of one at each place.

    Before the first and after the last step the nearest value holds, for the interpolation and for the Gaussian, which is cut at
    four sigma. The grid's size is fixed by its ends, not by the rows. One value a step; nulls are left out."""
    n = int((high - low) / dx + 1e-9) + 1
    sigma = max(0.5, sigma_steps / dx)
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    bell = F.array(*(F.lit(w / sum(weights)) for w in weights))

    points = df.filter(F.col(value).isNotNull()).select(kind, F.col(step).cast("double").alias("x"), F.col(value).cast("double").alias("v"), F.lit(None).cast("int").alias("place"))
    places = points.select(kind).distinct().select(kind, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
    grid = places.select(kind, (low + F.col("place") * dx).alias("x"), F.lit(None).cast("double").alias("v"), "place")
    here = F.when(F.col("v").isNotNull(), F.struct("x", "v"))
    w = Window.partitionBy(kind).orderBy("x")
    a = F.last(here, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    b = F.first(here, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = grid.unionByName(points).select(kind, "x", "place", a.alias("a"), b.alias("b")).filter("place IS NOT NULL")
    part = F.try_divide(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    dense = F.coalesce(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * F.coalesce(part, F.lit(0.0)), F.col("a.v"), F.col("b.v"))
    rows = near.select(kind, "place", dense.alias("v")).groupBy(kind).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda p: p["v"]).alias("_v"))
    at = lambda i, k: F.get("_v", F.least(F.greatest(i + k - reach, F.lit(0)), F.lit(n - 1)))
    blurred = F.transform("_v", lambda _, i: F.greatest(F.aggregate(F.transform(bell, lambda w, k: w * at(i, k)), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))
    long = rows.select(kind, F.posexplode(blurred).alias("place", "v"))
    total = F.sum("v").over(Window.partitionBy("place"))
    return long.select(kind, "place", (low + F.col("place") * dx).alias("x"), F.when(total > 0, F.col("v") / total).otherwise(F.col("v")).alias("share"))
