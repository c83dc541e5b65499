"""Active time of an insertion stream, as a Structured Streaming aggregation.

Insertions no further apart than the gap make a session; the sum of session lengths is the active time that the
turnover estimate uses.  Sessions end, and are given out, once the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_sessions(insertions: DataFrame, *, gap: str = "1 second", late: str = "10 seconds", time: str = "event_time") -> DataFrame:
    """insertions: trial_id and a timestamp. Per session: n_insertions and active_seconds. Works on streams and tables.

    A session window ends one gap behind its last event, so that events exactly one gap apart are in different
    sessions; the batch form counts such a gap as active.
    """
    rows = insertions.withWatermark(time, late) if insertions.isStreaming else insertions
    sessions = rows.groupBy("trial_id", F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n_insertions"), F.min(time).alias("first"), F.max(time).alias("last"))
    seconds = (F.unix_micros("last") - F.unix_micros("first")) / F.lit(1e6)
    return sessions.select("trial_id", F.col("first").alias("started"), "n_insertions", seconds.alias("active_seconds"))
