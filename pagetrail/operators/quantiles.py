"""Exact quantiles of large groups.

Values are counted first, the counts are summed by buckets of the value, and only the buckets that hold a wanted
position are ordered.  No group has to fit into one task, unlike with the built-in exact percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.operators.ranking import ROWS_PER_BUCKET, bounds_of, bucket_sums, with_bucket

METHODS = ("linear", "averaged_inverted_cdf")


def _positions(share: float, total: Column, method: str) -> tuple[Column, Column, Column]:
    """The two places (from 0) whose values a quantile mixes, and the part of the second."""
    if method == "linear":
        at = (total - 1) * F.lit(float(share))
        return F.floor(at), F.ceil(at), at - F.floor(at)
    if method == "averaged_inverted_cdf":  # both neighbours where the share falls between two values
        at = F.round(total * F.lit(float(share)), 9)
        inside = lambda x: F.least(F.greatest(x, F.lit(0)), total - 1)
        return inside(F.ceil(at) - 1), inside(F.floor(at)), F.lit(0.5)
    raise ValueError(f"unknown quantile method {method}")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], *, method: str = "linear", count: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per group with a double for each named share. Nulls don't count; a group of nulls alone has no row. count: a
    column that tells how many rows a row stands for."""
    groups = by or ["_all"]
    known = rows.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    if not by:
        known = known.withColumn("_all", F.lit(0))
    bounds = bounds_of(known, groups, "_v", rows_per_bucket=rows_per_bucket)
    counts = with_bucket(known.groupBy(*groups, "_v").agg((F.count("*") if count is None else F.sum(count)).alias("_n")), bounds, groups, "_v")
    places = [_positions(share, F.col("total"), method) for share in shares.values()]
    ends = F.array(*(p.cast("long") for low, high, _ in places for p in (low, high)))
    sums = bucket_sums(counts, groups, F.col("_n")).withColumn("_ends", F.array_distinct(ends))
    holds = lambda ahead, own: F.exists("_ends", lambda p: (F.col(ahead) <= p) & (p < F.col(ahead) + F.col(own)))
    own = Window.partitionBy(*groups, "bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(sums.where(holds("offset", "amount")).drop("amount"), [*groups, "bucket"])
    placed = placed.withColumn("before", F.col("offset") + F.coalesce(F.sum("_n").over(own), F.lit(0))).where(holds("before", "_n"))
    covers = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("_n"))
    found, mixed = [], []
    for name, (low, high, part) in zip(shares, places, strict=True):
        found += [F.max(F.when(covers(low), F.col("_v"))).alias(f"{name}_low"), F.max(F.when(covers(high), F.col("_v"))).alias(f"{name}_high")]
        mixed.append((F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * part).alias(name))
    return placed.groupBy(*groups).agg(F.max("total").alias("total"), *found).select(*by, *mixed)
