"""Cache turnover: how long the cache takes to be filled anew, and the label horizon that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.operators.pages import ordinals
from pagetrail.operators.ranking import ROWS_PER_BUCKET


def insertion_gaps(insertion: DataFrame, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The gap of each insertion to the one before it in its trial."""
    return ordinals(insertion.select("trial_id", "ts"), ["trial_id"], ["ts"], rows_per_bucket=rows_per_bucket).select("trial_id", "ts", (F.col("ts") - F.col("before")).alias("gap"))


def turnover_estimate(access: DataFrame, eviction: DataFrame, insertion: DataFrame, *, second: int, active_gap: float = 1.0, capacity: int | None = None, trials: DataFrame | None = None) -> DataFrame:
    """Per trial, those of ``trials`` (trial_id) or else all that occur in any log: capacity_pages, capacity_estimated, n_insertions, active_seconds, insertion_rate, turnover_seconds,
    label_window (null without accesses or evictions) and problem (null, or why there is no estimate).

    Without a given capacity, it is the number of insertions before the first eviction.  Only gaps of up to
    active_gap seconds are active time, but the rate counts all n - 1 insertions after the first.
    """
    first = eviction.groupBy("trial_id").agg(F.min("ts").alias("first_eviction"))
    last = access.groupBy("trial_id").agg(F.max("ts").alias("last_access"))
    every = trials.select("trial_id") if trials is not None else access.select("trial_id").unionByName(eviction.select("trial_id")).unionByName(insertion.select("trial_id"))
    before = insertion.join(first, "trial_id", "left").groupBy("trial_id").agg(F.count("*").alias("n_insertions"), F.count_if(F.col("ts") < F.col("first_eviction")).alias("filled"))
    filled = every.distinct().join(before, "trial_id", "left").join(first, "trial_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_insertions", "filled")})
    active = insertion_gaps(insertion).groupBy("trial_id").agg((F.coalesce(F.sum(F.when(F.col("gap") <= F.lit(int(active_gap * second)), F.col("gap"))), F.lit(0)) / second).alias("active_seconds"))
    size = F.lit(capacity).cast("long") if capacity is not None else F.when(F.col("first_eviction").isNotNull(), F.col("filled"))
    rows = filled.join(active, "trial_id", "left").withColumn("active_seconds", F.coalesce("active_seconds", F.lit(0.0))).join(last, "trial_id", "left").withColumn("capacity_pages", size)
    problem = (
        F.when(F.col("n_insertions") < 2, F.lit("fewer than two insertions"))
        .when(F.col("capacity_pages").isNull(), F.lit("no eviction: the cache was never filled"))
        .when(F.col("capacity_pages") <= 0, F.lit("no insertion before the first eviction"))
        .when(F.col("active_seconds") <= 0, F.lit("no active time"))
    )
    rate = (F.col("n_insertions") - 1) / F.nullif(F.col("active_seconds"), F.lit(0.0))
    rows = rows.withColumn("problem", problem).withColumn("insertion_rate", F.when(F.col("problem").isNull(), rate))
    return rows.select(
        "trial_id", "capacity_pages", F.lit(capacity is None).alias("capacity_estimated"), "n_insertions", "active_seconds", "insertion_rate",
        (F.col("capacity_pages") / F.nullif(F.col("insertion_rate"), F.lit(0.0))).alias("turnover_seconds"),
        (F.col("last_access") - F.col("first_eviction")).alias("label_window"), "problem",
    )


class TurnoverError(ValueError):
    """A trial from which no turnover can be estimated."""


def checked(estimate: DataFrame) -> list:
    """The rows of an estimate (one per trial), or an error that names the first problem."""
    rows = estimate.orderBy("trial_id").collect()
    for r in rows:
        if r["problem"]:
            raise TurnoverError(f"trial {r['trial_id']}: {r['problem']}")
    return rows


def auto_horizon(estimate: DataFrame, second: int) -> DataFrame:
    """One row: the mean turnover, the least positive label window, and the horizon: the turnover, at most half of
    that window."""
    usable: Column = F.when(F.col("label_window") > 0, F.col("label_window") / second)
    out = estimate.agg(F.avg("turnover_seconds").alias("mean_turnover"), F.min(usable).alias("least_window"), F.count("*").alias("n_trials"))
    return out.withColumn("horizon_seconds", F.least("mean_turnover", F.col("least_window") / 2))
