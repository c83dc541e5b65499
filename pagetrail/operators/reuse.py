"""How often and how soon pages come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.operators.pages import next_value
from pagetrail.operators.quantiles import quantiles
from pagetrail.operators.ranking import position_bin, row_numbers

PAGE = ["trial_id", "page"]


def page_access_counts(access: DataFrame) -> DataFrame:
    return access.groupBy(*PAGE).agg(F.count("*").alias("n_accesses"))


def reaccess_probability(access: DataFrame) -> DataFrame:
    """Per trial: pages, those seen once, those seen again, and the share of the latter."""
    counts = page_access_counts(access)
    again = F.count_if(F.col("n_accesses") >= 2)
    return counts.groupBy("trial_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("n_accesses") == 1).alias("n_single"), again.alias("n_reaccessed"), F.round(again / F.count("*"), 9).alias("reaccess_probability"))


def access_count_histogram(access: DataFrame, most: int = 100) -> DataFrame:
    """Pages by number of accesses, in unit bins; the last bin holds all from ``most`` on."""
    return page_access_counts(access).groupBy("trial_id", F.least("n_accesses", F.lit(most)).alias("n_accesses")).agg(F.count("*").alias("n_pages"))


def first_access(access: DataFrame) -> DataFrame:
    return access.groupBy(*PAGE).agg(F.min("ts").alias("ts"), F.max("ts").alias("last_ts"))


def next_reuse_delta(access: DataFrame, order: list[str], delta: str) -> DataFrame:
    """Adds y: the delta of the page's next row."""
    return next_value(access, PAGE, order, delta, "y")


def reuse_label_coverage(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("trial_id").agg(F.count("*").alias("n_rows"), F.count("y").alias("n_with_next"), F.count_if(F.col("y").isNull()).alias("n_without_next"))


def median_split(labelled: DataFrame, fill: float = 1e15) -> DataFrame:
    """Adds label: whether y, unknown ones filled, reaches the median of its trial."""
    filled = labelled.withColumn("y", F.coalesce(F.col("y").cast("double"), F.lit(fill)))
    middle = quantiles(filled, ["trial_id"], "y", {"middle": 0.5})
    # one row per trial, which would else gather all rows of a trial in one task
    return filled.join(F.broadcast(middle), "trial_id").withColumn("label", (F.col("y") >= F.col("middle")).cast("int"))


def reaccess_by_position(rows: DataFrame, bins: int, ties: list[str]) -> DataFrame:
    """rows: ts and is_reaccessed. Per trial and bin of the position in time: n and the share reaccessed."""
    placed = row_numbers(rows, ["trial_id"], "ts", ties).withColumn("bin", position_bin(bins))
    return placed.groupBy("trial_id", "bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_reaccessed").cast("int")), 9).alias("probability"))


def mean_over_bins(by_position: DataFrame) -> DataFrame:
    """The overall figure that goes with them: bins count alike, whatever they hold."""
    return by_position.groupBy("trial_id").agg(F.round(F.avg("probability"), 6).alias("overall"), F.count("*").alias("n_bins"))


def event_rates(streams: dict[str, DataFrame], second: int) -> DataFrame:
    """Per stream: rows, and rows per second of the time since the first event of any stream."""
    out = None
    for name, rows in streams.items():
        part = rows.groupBy("trial_id").agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")).withColumn("stream", F.lit(name))
        out = part if out is None else out.unionByName(part)
    start = out.groupBy("trial_id").agg(F.min("low").alias("start"))
    seconds = (F.col("high") - F.col("start")) / second
    return out.join(start, "trial_id").select("trial_id", "stream", "n", F.round(F.col("n") / F.nullif(seconds, F.lit(0.0)), 9).alias("per_second"))


def normalised_time(rows: DataFrame, starts: DataFrame, second: int) -> DataFrame:
    """Adds seconds since the trial's start (starts: trial_id, start)."""
    return rows.join(starts, "trial_id").withColumn("seconds", (F.col("ts") - F.col("start")) / second).drop("start")


def shared_pages(access: DataFrame, insertion: DataFrame) -> DataFrame:
    """Pages that occur in both streams."""
    return insertion.select(*PAGE).distinct().join(access.select(*PAGE).distinct(), PAGE, "left_semi")
