"""Trace views: tables with the columns of a trace, made from other tables.

An access row has ``trial_id``, ``page``, ``ts`` and features; an eviction row ``trial_id`` and ``ts``; an insertion
row ``trial_id``, ``page`` and ``ts``.  Times are long; their unit is the adapter's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000  # of the adapters below, which count microseconds
HOUR, DAY = 3600 * SECOND, 86_400 * SECOND


@dataclass(frozen=True)
class Trace:
    access: DataFrame
    eviction: DataFrame
    insertion: DataFrame | None = None


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_trace(spark: SparkSession, sf_dir: str, trials: int = 1) -> Trace:
    """Views, clicks and purchases access the page of their user; errors are evictions, signups insertions."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % trials).cast("int").alias("trial_id"), "event_id", F.col("user_id").alias("page"), micros("ts").alias("ts"), "value", "event_type")
    return Trace(
        rows.where(F.col("event_type").isin("view", "click", "purchase")).select("trial_id", "page", "ts", "event_id", "value", "event_type"),
        rows.where("event_type = 'error'").select("trial_id", "ts", "event_id"),
        rows.where("event_type = 'signup'").select("trial_id", "page", "ts", "event_id"),
    )


def orders_trace(spark: SparkSession, sf_dir: str) -> Trace:
    """Line items access the page of their part on the ship date; orders are evictions. Many ties."""
    access = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("trial_id"), F.col("l_partkey").alias("page"), micros("l_shipdate").alias("ts"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    eviction = table(spark, sf_dir, "orders").select(F.lit(0).alias("trial_id"), micros("o_orderdate").alias("ts"))
    return Trace(access, eviction)


#: The same views for the oracle, to be put before a query.
EVENTS_SQL = """
ev AS (SELECT event_id, user_id AS page, epoch_us(ts) AS ts, value, event_type FROM events),
access AS (SELECT 0 AS trial_id, * FROM ev WHERE event_type IN ('view', 'click', 'purchase')),
eviction AS (SELECT 0 AS trial_id, ts, event_id FROM ev WHERE event_type = 'error'),
insertion AS (SELECT 0 AS trial_id, page, ts, event_id FROM ev WHERE event_type = 'signup')
"""
ORDERS_SQL = """
access AS (SELECT 0 AS trial_id, l_partkey AS page, epoch_us(l_shipdate) AS ts, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
eviction AS (SELECT 0 AS trial_id, epoch_us(o_orderdate) AS ts FROM orders)
"""
