"""As-of lookups between insertions and accesses of the same page, safe against equal times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.operators.pages import Paged, next_value
from pagetrail.operators.ranking import ROWS_PER_BUCKET

KEYS = ("trial_id", "page")
_FAR = (1 << 63) - 1


def _merged(access: DataFrame, insertion: DataFrame, key: str, kind_of_access: int) -> DataFrame:
    """Accesses, with the next access of their page, and insertions in one table; kind orders them at equal times."""
    a = access.select(*KEYS, "ts", F.lit(kind_of_access).alias("kind"), F.struct("ts", F.coalesce("then", F.lit(_FAR)).alias("then")).alias("hit"), F.lit(None).cast("long").alias(key))
    i = insertion.select(*KEYS, "ts", F.lit(1 - kind_of_access).alias("kind"), F.lit(None).cast("struct<ts:long,then:long>").alias("hit"), F.col(key).cast("long").alias(key))
    return a.unionByName(i)


def accesses_after(access: DataFrame, insertion: DataFrame, key: str, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each insertion with the first and second access strictly after it; null where there is none."""
    a = next_value(access.select(*KEYS, "ts"), list(KEYS), ["ts"], "ts", "then", rows_per_bucket=rows_per_bucket)
    paged = Paged.of(_merged(a, insertion, key, 0), list(KEYS), ["ts", "kind"], rows_per_bucket)
    # of accesses at one time, the one whose next access comes first is the first
    behind = paged.window(F.desc("ts"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.min("hit").over(behind), "_later") if paged.is_cut else F.min("hit").over(behind)
    out = (paged.carrying(_later=(F.col("hit"), "after")) if paged.is_cut else paged.rows).withColumn("found", found).where(F.col("kind") == 1)
    return out.select(*KEYS, "ts", key, F.col("found.ts").alias("first_ts"), F.nullif("found.then", F.lit(_FAR)).alias("second_ts"))


def access_before(access: DataFrame, insertion: DataFrame, key: str, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each insertion with the latest access strictly before it, of the same page."""
    paged = Paged.of(_merged(access.select(*KEYS, "ts", F.lit(None).cast("long").alias("then")), insertion, key, 1), list(KEYS), ["ts", "kind"], rows_per_bucket)
    ahead = F.max("hit.ts").over(paged.window().rowsBetween(Window.unboundedPreceding, -1))
    found = F.coalesce(ahead, "_earlier") if paged.is_cut else ahead
    out = (paged.carrying(_earlier=(F.col("hit.ts"), "before")) if paged.is_cut else paged.rows).withColumn("before_ts", found).where(F.col("kind") == 0)
    return out.select(*KEYS, "ts", key, "before_ts")


def reaccessed(access: DataFrame, insertion: DataFrame) -> DataFrame:
    """Insertions with is_reaccessed: an access of the page comes strictly later."""
    last = access.groupBy(*KEYS).agg(F.max("ts").alias("last_access"))
    return insertion.join(last, list(KEYS), "left").withColumn("is_reaccessed", F.coalesce(F.col("last_access") > F.col("ts"), F.lit(False))).drop("last_access")
