"""What follows and precedes the insertion of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.operators.asof import KEYS
from pagetrail.operators.pages import ordinals
from pagetrail.operators.quantiles import quantiles

PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def delta_summary(deltas: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, least, median and largest of the values that are known."""
    known = deltas.where(F.col(value).isNotNull())
    spread = known.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return spread.join(quantiles(known, by, value, {"median": 0.5}), by).select(*by, "n", "least", "median", "largest")


def delta_percentiles(deltas: DataFrame, value: str, by: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """One row per percent, by linear interpolation."""
    found = quantiles(deltas, by, value, {f"p{p}": p / 100 for p in percents})
    listed = F.explode(F.array(*(F.struct(F.lit(p).alias("percent"), F.col(f"p{p}").alias("value")) for p in percents)))
    return found.select(*by, listed.alias("x")).select(*by, "x.percent", "x.value")


def by_time_bin(insertions: DataFrame, delta: str, bins: int, spans: DataFrame) -> DataFrame:
    """spans: trial_id, start, stop. Per trial and time bin: insertions, those with a delta, their share, and the
    median and mean delta (null in a bin without any). Bins are half open, so that a row at the very end has none."""
    placed = insertions.join(spans, "trial_id").withColumn("bin", F.expr(f"((ts - start) * {bins}) div nullif(stop - start, 0)"))
    placed = placed.where(F.col("bin").between(0, bins - 1))
    found = placed.groupBy("trial_id", "bin").agg(F.count("*").alias("n"), F.count(delta).alias("n_with"), F.avg(delta).alias("mean"))
    found = found.join(quantiles(placed, ["trial_id", "bin"], delta, {"median": 0.5}), ["trial_id", "bin"], "left")
    every = spans.select("trial_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    share = F.coalesce(F.round(F.col("n_with") / F.col("n"), 9), F.lit(0.0))
    return every.join(found, ["trial_id", "bin"], "left").select("trial_id", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_with", F.lit(0)).alias("n_with"), share.alias("share"), F.round("median", 3).alias("median"), F.round("mean", 0).alias("mean"))


def before_insertion(found: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """found: insertions with before_ts. Count, spread and threshold shares of the time since the latest access."""
    gap = found.where("before_ts IS NOT NULL").withColumn("gap", F.col("ts") - F.col("before_ts"))
    shares = [F.round(F.avg((F.col("gap") < limit).cast("int")), 9).alias(f"share_under_{name}") for name, limit in thresholds.items()]
    spread = gap.groupBy("trial_id").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("largest"), *shares)
    at = quantiles(gap, ["trial_id"], "gap", {"p1": 0.01, "p10": 0.1, "median": 0.5, "p90": 0.9})
    return spread.join(at.select("trial_id", *(F.round(c, 3).alias(c) for c in ("p1", "p10", "median", "p90"))), "trial_id")


def ordering_anomalies(found: DataFrame, ordinals: DataFrame, key: str) -> DataFrame:
    """Insertions whose page was accessed before, in all and by ordinal of the insertion (1, 2, 3 and later)."""
    joined = found.join(ordinals.select(key, "ordinal"), key)
    early = F.col("before_ts").isNotNull()
    return joined.groupBy("trial_id").agg(F.count("*").alias("n_insertions"), F.count_if(early).alias("n_early"), *(F.count_if(early & (F.least("ordinal", F.lit(3)) == k)).alias(f"n_early_{k}") for k in (1, 2, 3)))


def insertion_ordinals(insertion: DataFrame, ties: list[str]) -> DataFrame:
    """Adds ordinal, from 1 per page, and gap, the time since the page's insertion before."""
    return ordinals(insertion, list(KEYS), ["ts", *ties]).withColumn("gap", F.col("ts") - F.col("before")).drop("before")


def reinsertion_stats(insertion: DataFrame) -> DataFrame:
    """Pages inserted again, all insertions of these, and their share of the inserted pages."""
    counts = insertion.groupBy(*KEYS).agg(F.count("*").alias("n"))
    again = F.count_if(F.col("n") >= 2)
    return counts.groupBy("trial_id").agg(F.count("*").alias("n_pages"), again.alias("n_reinserted"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("n_insertions"), F.round(again / F.count("*"), 9).alias("share"))


def ordinal_classes(ordinals: DataFrame) -> DataFrame:
    """Insertions that are a page's first, second, or a later one."""
    name = F.when(F.col("ordinal") == 1, "1st").when(F.col("ordinal") == 2, "2nd").otherwise("3rd+")
    return ordinals.groupBy("trial_id", name.alias("ordinal_class")).agg(F.count("*").alias("n"))
