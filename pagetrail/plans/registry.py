"""Every registered query of the trace analytics, with its oracle SQL where SQL can express it.

Adapter E reads ``events`` (pages are users), adapter L reads ``lineitem`` and ``orders`` (pages are parts, with many
equal times); see :mod:`pagetrail.plans.adapters`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.operators import asof, candidates, insertions, reuse, turnover
from pagetrail.plans.adapters import DAY, EVENTS_SQL, HOUR, ORDERS_SQL, SECOND, events_trace, orders_trace


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, views: str | None = None, *, recursive: bool = False):
    """Register a function under its name; views: table definitions that go before the SQL, recursive ones among them."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        text = None if sql is None else sql if views is None else f"WITH {'RECURSIVE ' * recursive}{views}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        QUERIES[f.__name__] = Query(f, text)
        return f

    return put


#: Adapter E has an eviction before its first insertion, so that a capacity is given.
CAPACITY = 500

# A1-A3, A11, W1, W2, W10, P3, P9, P10, P13


@query("SELECT trial_id, page, count(*) AS n_accesses FROM access GROUP BY ALL", EVENTS_SQL)
def page_access_counts(spark, d):
    return reuse.page_access_counts(events_trace(spark, d).access)


@query(
    """+ c AS (SELECT trial_id, page, count(*) AS n FROM access GROUP BY ALL)
SELECT trial_id, count(*) AS n_pages, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n >= 2) AS n_reaccessed,
       round(count(*) FILTER (n >= 2) / count(*), 9) AS reaccess_probability FROM c GROUP BY trial_id""",
    EVENTS_SQL,
)
def reaccess_probability(spark, d):
    return reuse.reaccess_probability(events_trace(spark, d).access)


@query(
    """+ c AS (SELECT trial_id, page, count(*) AS n FROM access GROUP BY ALL)
SELECT trial_id, least(n, 100) AS n_accesses, count(*) AS n_pages FROM c GROUP BY ALL""",
    EVENTS_SQL,
)
def access_count_histogram(spark, d):
    return reuse.access_count_histogram(events_trace(spark, d).access)


@query("SELECT trial_id, page, ts, lead(ts) OVER (PARTITION BY trial_id, page ORDER BY ts) - ts AS delta FROM access", EVENTS_SQL)
def next_access_delta(spark, d):
    return candidates.next_access(events_trace(spark, d).access).select("trial_id", "page", "ts", (F.col("next_ts") - F.col("ts")).alias("delta"))


@query(
    """+ y AS (SELECT trial_id, lead(value) OVER (PARTITION BY trial_id, page ORDER BY ts, event_id) AS y FROM access)
SELECT trial_id, count(*) AS n_rows, count(y) AS n_with_next, count(*) FILTER (y IS NULL) AS n_without_next FROM y GROUP BY trial_id""",
    EVENTS_SQL,
)
def reuse_label_coverage(spark, d):
    return reuse.reuse_label_coverage(reuse.next_reuse_delta(events_trace(spark, d).access, ["ts", "event_id"], "value"))


@query(
    """+ y AS (SELECT trial_id, coalesce(lead(value) OVER (PARTITION BY trial_id, page ORDER BY ts, event_id), 1e15) AS y FROM access),
m AS (SELECT trial_id, quantile_cont(y, 0.5) AS middle FROM y GROUP BY trial_id)
SELECT trial_id, CAST(y >= middle AS INTEGER) AS label, count(*) AS n FROM y JOIN m USING (trial_id) GROUP BY ALL""",
    EVENTS_SQL,
)
def median_split_label(spark, d):
    labelled = reuse.next_reuse_delta(events_trace(spark, d).access, ["ts", "event_id"], "value")
    return reuse.median_split(labelled).groupBy("trial_id", "label").agg(F.count("*").alias("n"))


@query("SELECT trial_id, page, min(ts) AS ts, max(ts) AS last_ts FROM access GROUP BY ALL", EVENTS_SQL)
def first_access(spark, d):
    return reuse.first_access(events_trace(spark, d).access)


@query(
    """+ s AS (SELECT trial_id, 'access' AS stream, ts FROM access UNION ALL SELECT trial_id, 'eviction', ts FROM eviction UNION ALL SELECT trial_id, 'insertion', ts FROM insertion),
t AS (SELECT trial_id, min(ts) AS start FROM s GROUP BY trial_id)
SELECT trial_id, stream, count(*) AS n, round(count(*) / nullif((max(ts) - any_value(start)) / 1e6, 0), 9) AS per_second FROM s JOIN t USING (trial_id) GROUP BY trial_id, stream""",
    EVENTS_SQL,
)
def event_rates(spark, d):
    t = events_trace(spark, d)
    return reuse.event_rates({"access": t.access, "eviction": t.eviction, "insertion": t.insertion}, SECOND)


@query("+ t AS (SELECT trial_id, min(ts) AS start FROM access GROUP BY trial_id) SELECT event_id, round((ts - start) / 1e6, 6) AS seconds FROM access JOIN t USING (trial_id)", EVENTS_SQL)
def normalised_time(spark, d):
    access = events_trace(spark, d).access
    starts = access.groupBy("trial_id").agg(F.min("ts").alias("start"))
    return reuse.normalised_time(access, starts, SECOND).select("event_id", F.round("seconds", 6).alias("seconds"))


@query("SELECT DISTINCT trial_id, page FROM insertion WHERE (trial_id, page) IN (SELECT (trial_id, page) FROM access)", EVENTS_SQL)
def shared_pages(spark, d):
    t = events_trace(spark, d)
    return reuse.shared_pages(t.access, t.insertion)


# W4, W12, J5, T11

_BY_POSITION = """
n AS (SELECT trial_id, is_reaccessed, row_number() OVER (PARTITION BY trial_id ORDER BY ts, page) AS rn, count(*) OVER (PARTITION BY trial_id) AS n FROM base),
b AS (SELECT trial_id, CAST(floor((rn * 10 - 1) / n) AS INTEGER) AS bin, count(*) AS n, round(avg(CAST(is_reaccessed AS INTEGER)), 9) AS probability FROM n GROUP BY ALL)
"""
_INS_BASE = "+ m AS (SELECT trial_id, page, max(ts) AS last_ts FROM access GROUP BY ALL), base AS (SELECT i.trial_id, i.page, i.ts, coalesce(m.last_ts > i.ts, false) AS is_reaccessed FROM insertion i LEFT JOIN m USING (trial_id, page)),"
_FIRST_BASE = "+ base AS (SELECT trial_id, page, min(ts) AS ts, max(ts) > min(ts) AS is_reaccessed FROM access GROUP BY ALL),"


def _by_insertion(spark, d):
    t = events_trace(spark, d)
    return reuse.reaccess_by_position(asof.reaccessed(t.access, t.insertion), 10, ["page"])


def _by_first_access(spark, d):
    rows = reuse.first_access(events_trace(spark, d).access).withColumn("is_reaccessed", F.col("last_ts") > F.col("ts"))
    return reuse.reaccess_by_position(rows, 10, ["page"])


@query(f"{_INS_BASE} {_BY_POSITION} SELECT * FROM b", EVENTS_SQL)
def reaccess_by_insertion_pct(spark, d):
    return _by_insertion(spark, d)


@query(f"{_FIRST_BASE} {_BY_POSITION} SELECT * FROM b", EVENTS_SQL)
def reaccess_by_first_access_pct(spark, d):
    return _by_first_access(spark, d)


@query(f"{_INS_BASE} {_BY_POSITION} SELECT trial_id, round(avg(probability), 6) AS overall, count(*) AS n_bins FROM b GROUP BY trial_id", EVENTS_SQL)
def reaccess_overall(spark, d):
    return reuse.mean_over_bins(_by_insertion(spark, d))


# J2, P4-P6, A9, A43

_BANDS = """
nx AS (SELECT *, lead(ts) OVER (PARTITION BY trial_id, page ORDER BY ts) AS next_ts FROM access),
pairs AS (
  SELECT a.trial_id, coalesce(a.next_ts - e.ts < {h}, false) AS positive FROM nx a JOIN eviction e
  ON a.trial_id = e.trial_id AND e.ts > a.ts AND e.ts < coalesce(least(a.next_ts, {cap}), 9223372036854775807))
"""


def _totals(trace, horizon, cap):
    return candidates.candidate_totals(trace.access, trace.eviction, horizon=horizon, cap=cap)


def _totals_sql(horizon: int, cap: int | None) -> str:
    end = "a.next_ts" if cap is None else f"a.ts + CAST({cap} AS BIGINT)"
    return "+" + _BANDS.format(h=f"CAST({horizon} AS BIGINT)", cap=end) + " SELECT trial_id, count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg FROM pairs GROUP BY trial_id"


@query(_totals_sql(6 * HOUR, None), EVENTS_SQL)
def candidate_counts(spark, d):
    return _totals(events_trace(spark, d), 6 * HOUR, None)


@query(_totals_sql(6 * HOUR, 6 * HOUR), EVENTS_SQL)
def candidate_counts_capped(spark, d):
    return _totals(events_trace(spark, d), 6 * HOUR, 6 * HOUR)


@query(_totals_sql(3 * DAY, 3 * DAY), ORDERS_SQL)
def candidate_counts_ties(spark, d):
    return _totals(orders_trace(spark, d), 3 * DAY, 3 * DAY)


@query(
    """+ nx AS (SELECT *, lead(ts) OVER (PARTITION BY trial_id, page ORDER BY ts) AS next_ts FROM access)
SELECT a.trial_id, a.event_id, count(*) FILTER (e.ts <= a.ts) AS lo,
       count(*) FILTER (e.ts < least(a.next_ts, a.ts + 21600000000) AND (a.next_ts IS NULL OR e.ts <= greatest(a.ts, a.next_ts - 21600000000))) AS pos_lo,
       count(*) FILTER (e.ts < least(a.next_ts, a.ts + 21600000000)) AS hi
FROM nx a JOIN eviction e USING (trial_id) GROUP BY ALL""",
    EVENTS_SQL,
)
def candidate_bands(spark, d):
    t = events_trace(spark, d)
    return candidates.candidate_bands(t.access, t.eviction, horizon=6 * HOUR, cap=6 * HOUR, key="event_id")


@query(
    """+ nx AS (SELECT *, lead(ts) OVER (PARTITION BY trial_id, page ORDER BY ts) AS next_ts FROM access)
SELECT a.event_id, a.next_ts, e.ts AS e_ts, CAST(coalesce(a.next_ts - e.ts < 21600000000, false) AS INTEGER) AS label
FROM nx a JOIN eviction e ON a.trial_id = e.trial_id AND e.ts > a.ts AND e.ts < coalesce(least(a.next_ts, a.ts + 21600000000), 9223372036854775807)""",
    EVENTS_SQL,
)
def candidate_pairs(spark, d):
    t = events_trace(spark, d)
    return candidates.candidate_pairs(t.access, t.eviction, horizon=6 * HOUR, cap=6 * HOUR, slot=HOUR).select("event_id", "next_ts", "e_ts", "label")


@query(
    "+" + _BANDS.format(h="21600000000", cap="a.ts + 21600000000") + " SELECT trial_id, round(count(*) FILTER (positive) / count(*), 9) AS true_positive_rate, round(count(*) / (2.0 * count(*) FILTER (positive)), 9) AS weight_pos, round(count(*) / (2.0 * count(*) FILTER (NOT positive)), 9) AS weight_neg FROM pairs GROUP BY trial_id",
    EVENTS_SQL,
)
def candidate_class_weights(spark, d):
    n, p, q = F.col("n_pos") + F.col("n_neg"), F.col("n_pos"), F.col("n_neg")
    rate = F.when(n > 0, p / n).otherwise(0.0)
    return _totals(events_trace(spark, d), 6 * HOUR, 6 * HOUR).select("trial_id", F.round(rate, 9).alias("true_positive_rate"), F.round(n / (2.0 * F.nullif(p, F.lit(0))), 9).alias("weight_pos"), F.round(n / (2.0 * F.nullif(q, F.lit(0))), 9).alias("weight_neg"))


_TRIALS_SQL = EVENTS_SQL.replace("0 AS trial_id", "CAST(event_id % 3 AS INTEGER) AS trial_id")


@query(_totals_sql(6 * HOUR, 6 * HOUR), _TRIALS_SQL)
def candidate_counts_by_trial(spark, d):
    return _totals(events_trace(spark, d, trials=3), 6 * HOUR, 6 * HOUR)


@query(
    _totals_sql(6 * HOUR, 6 * HOUR).replace(" SELECT trial_id, count(*) FILTER", ", n AS (SELECT trial_id, count(*) FILTER", 1)
    + ") SELECT 'w' || trial_id AS workload, n_pos + n_neg AS n_train_rows, 21600.0::DOUBLE AS horizon_seconds, n_pos, n_neg, round(n_pos / (n_pos + n_neg), 9) AS true_positive_rate, NULL::DOUBLE AS auc, NULL::DOUBLE AS f1 FROM n",
    _TRIALS_SQL,
)
def training_summary(spark, d):
    """The summary of a run, one row per workload; workloads are trials here, which train on all their candidates."""
    from pagetrail.plans.training import WorkloadSample, summary

    results = {}
    for r in _totals(events_trace(spark, d, trials=3), 6 * HOUR, 6 * HOUR).collect():  # one row per trial
        share = WorkloadSample(None, None, None, r["n_pos"], r["n_neg"]).true_positive_rate
        results[f"w{r['trial_id']}"] = {"n_train_rows": r["n_pos"] + r["n_neg"], "n_pos": r["n_pos"], "n_neg": r["n_neg"], "true_positive_rate": share, "metrics": {"horizon_ns": 6 * 3600 * 1_000_000_000}}
    return summary(spark, results).withColumn("true_positive_rate", F.round("true_positive_rate", 9))


@query(
    """+ v AS (SELECT e.* FROM eviction e JOIN (SELECT trial_id, max(ts) - 21600000000 AS last FROM access GROUP BY trial_id) USING (trial_id) WHERE ts <= last),
c AS (SELECT trial_id, quantile_cont(ts, 0.8) AS cut, count(*) AS n FROM v GROUP BY trial_id)
SELECT trial_id, n >= 2 AND ts >= cut AS is_eval, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM v JOIN c USING (trial_id) GROUP BY ALL""",
    _TRIALS_SQL,
)
def temporal_split(spark, d):
    t = events_trace(spark, d, trials=3)
    rows = candidates.temporal_split(candidates.valid_evictions(t.access, t.eviction, 6 * HOUR), 0.2)
    return rows.groupBy("trial_id", "is_eval").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# A4-A8


def _estimate(spark, d):
    t = events_trace(spark, d)
    return turnover.turnover_estimate(t.access, t.eviction, t.insertion, second=SECOND, active_gap=1800, capacity=CAPACITY)


_TURNOVER = f"""+ f AS (SELECT trial_id, min(ts) AS first_eviction FROM eviction GROUP BY trial_id),
g AS (SELECT trial_id, ts, ts - lag(ts) OVER (PARTITION BY trial_id ORDER BY ts) AS gap FROM insertion),
s AS (SELECT g.trial_id, count(*) AS n_insertions, CAST({CAPACITY} AS BIGINT) AS capacity_pages, any_value(first_eviction) AS first_eviction,
             CAST(coalesce(sum(gap) FILTER (gap <= 1800000000), 0) AS DOUBLE) / 1e6 AS active_seconds FROM g JOIN f USING (trial_id) GROUP BY g.trial_id),
t AS (SELECT s.*, (n_insertions - 1) / active_seconds AS insertion_rate, l.last_access - first_eviction AS label_window
      FROM s JOIN (SELECT trial_id, max(ts) AS last_access FROM access GROUP BY trial_id) l USING (trial_id))"""


@query(_TURNOVER + " SELECT trial_id, capacity_pages, false AS capacity_estimated, n_insertions, round(active_seconds, 6) AS active_seconds, round(insertion_rate, 12) AS insertion_rate, round(capacity_pages / insertion_rate, 3) AS turnover_seconds, label_window, CAST(NULL AS VARCHAR) AS problem FROM t", EVENTS_SQL)
def turnover_estimate(spark, d):
    out = _estimate(spark, d)
    return out.withColumns({"active_seconds": F.round("active_seconds", 6), "insertion_rate": F.round("insertion_rate", 12), "turnover_seconds": F.round("turnover_seconds", 3)})


@query(_TURNOVER + " SELECT round(avg(capacity_pages / insertion_rate), 3) AS mean_turnover, min(label_window) / 1e6 AS least_window, count(*) AS n_trials, round(least(avg(capacity_pages / insertion_rate), min(label_window) / 2e6), 3) AS horizon_seconds FROM t", EVENTS_SQL)
def auto_horizon(spark, d):
    out = turnover.auto_horizon(_estimate(spark, d), SECOND)
    return out.withColumns({"mean_turnover": F.round("mean_turnover", 3), "horizon_seconds": F.round("horizon_seconds", 3)})


_FIVE_SQL = EVENTS_SQL.replace("0 AS trial_id", "CAST(event_id % 5 AS INTEGER) AS trial_id")


@query(
    """+ evs AS (SELECT * FROM eviction WHERE trial_id <> 1), ins AS (SELECT * FROM insertion WHERE trial_id <> 2),
f AS (SELECT trial_id, min(ts) AS first_eviction FROM evs GROUP BY trial_id),
g AS (SELECT trial_id, ts, ts - lag(ts) OVER (PARTITION BY trial_id ORDER BY ts) AS gap FROM ins),
n AS (SELECT trial_id, count(*) AS n, coalesce(sum(gap) FILTER (gap <= 86400000000), 0) AS active FROM g GROUP BY trial_id),
b AS (SELECT trial_id, count(*) AS filled FROM ins JOIN f USING (trial_id) WHERE ts < first_eviction GROUP BY trial_id)
SELECT t.trial_id, coalesce(n, 0) AS n_insertions, CASE WHEN coalesce(n, 0) < 2 THEN 'fewer than two insertions' WHEN first_eviction IS NULL THEN 'no eviction: the cache was never filled'
  WHEN coalesce(filled, 0) <= 0 THEN 'no insertion before the first eviction' WHEN coalesce(active, 0) <= 0 THEN 'no active time' END AS problem
FROM (SELECT DISTINCT trial_id FROM access) t LEFT JOIN n USING (trial_id) LEFT JOIN f USING (trial_id) LEFT JOIN b USING (trial_id)""",
    _FIVE_SQL,
)
def turnover_problems(spark, d):
    """Why trials have no estimate: one has no evictions, one no insertions, others were full before they began."""
    t = events_trace(spark, d, trials=5)
    out = turnover.turnover_estimate(t.access, t.eviction.where("trial_id <> 1"), t.insertion.where("trial_id <> 2"), second=SECOND, active_gap=86400)
    return out.select("trial_id", "n_insertions", "problem")


@query(
    _TURNOVER
    + """, a AS (SELECT *, capacity_pages / insertion_rate AS turnover_seconds FROM t), h AS (SELECT *, least(turnover_seconds, label_window / 2e6) AS horizon FROM a)
SELECT 'auto' AS horizon_source, round(turnover_seconds * 1e9, 0) AS turnover_ns, horizon < turnover_seconds AS horizon_clamped, capacity_pages, false AS capacity_estimated, round(insertion_rate, 9) AS insertion_rate_per_s, round(active_seconds, 6) AS active_seconds,
  n_insertions, label_window * 1000.0::DOUBLE AS label_window_ns, round(floor(horizon * 1e6) * 1e3, 0) AS horizon_ns, round(floor(horizon * 1e6) * 1e3, 0) AS residency_cap_ns FROM h""",
    EVENTS_SQL,
)
def horizon_provenance(spark, d):
    """Where an automatic horizon comes from, as the metrics file says it; without a cap of its own, residency ends there too."""
    from pagetrail.plans.training import effective_cap, horizon_facts
    from pagetrail.sources.artifacts import write_json
    from pagetrail.sources.files import new_folder

    estimate = _estimate(spark, d)
    auto = turnover.auto_horizon(estimate, SECOND).first()
    horizon = int(auto["horizon_seconds"] * SECOND) * (1_000_000_000 // SECOND)
    path = f"{new_folder(spark)}/metrics.json"
    write_json(spark, path, {"horizon_ns": float(horizon), "residency_cap_ns": float(effective_cap(None, horizon))} | horizon_facts(turnover.checked(estimate)[0], auto, SECOND))
    digits = {"turnover_ns": 0, "insertion_rate_per_s": 9, "active_seconds": 6, "horizon_ns": 0, "residency_cap_ns": 0}
    return spark.read.json(path, multiLine=True).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("SELECT trial_id, ts, ts - lag(ts) OVER (PARTITION BY trial_id ORDER BY ts) AS gap FROM insertion", EVENTS_SQL)
def insertion_gaps(spark, d):
    return turnover.insertion_gaps(events_trace(spark, d).insertion)


# J4-J7, A12-A19, W5, W6

_AFTER = """+ af AS (SELECT i.trial_id, i.page, i.ts, i.event_id, a.ts AS a_ts, row_number() OVER (PARTITION BY i.event_id ORDER BY a.ts) AS rn
  FROM insertion i LEFT JOIN access a ON a.trial_id = i.trial_id AND a.page = i.page AND a.ts > i.ts),
f AS (SELECT trial_id, page, ts, event_id, min(a_ts) FILTER (rn = 1) AS first_ts, min(a_ts) FILTER (rn = 2) AS second_ts FROM af GROUP BY ALL)"""


def _after(spark, d):
    t = events_trace(spark, d)
    return asof.accesses_after(t.access, t.insertion, "event_id")


@query(f"{_AFTER} SELECT * FROM f", EVENTS_SQL)
def insertion_access_deltas(spark, d):
    return _after(spark, d)


def _deltas(spark, d):
    return _after(spark, d).withColumn("delta", F.col("first_ts") - F.col("ts")).withColumn("second", F.col("second_ts") - F.col("ts"))


@query(f"{_AFTER} SELECT trial_id, count(*) AS n, min(first_ts - ts) AS least, quantile_cont(first_ts - ts, 0.5) AS median, max(first_ts - ts) AS largest FROM f WHERE first_ts IS NOT NULL GROUP BY trial_id", EVENTS_SQL)
def delta_summary(spark, d):
    return insertions.delta_summary(_deltas(spark, d), "delta", ["trial_id"])


@query(f"{_AFTER} SELECT trial_id, count(*) AS n, min(second_ts - ts) AS least, quantile_cont(second_ts - ts, 0.5) AS median, max(second_ts - ts) AS largest FROM f WHERE second_ts IS NOT NULL GROUP BY trial_id", EVENTS_SQL)
def second_delta_summary(spark, d):
    return insertions.delta_summary(_deltas(spark, d), "second", ["trial_id"])


@query(
    f"""{_AFTER}, q AS (SELECT trial_id, quantile_cont(first_ts - ts, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM f WHERE first_ts IS NOT NULL GROUP BY trial_id)
SELECT trial_id, CAST(unnest([1, 5, 10, 25, 50, 75, 90, 95, 99]) AS INTEGER) AS percent, round(unnest(q), 3) AS value FROM q""",
    EVENTS_SQL,
)
def delta_percentiles(spark, d):
    return insertions.delta_percentiles(_deltas(spark, d), "delta", ["trial_id"]).withColumn("value", F.round("value", 3))


def _spans(t):
    both = t.access.select("trial_id", "ts").unionByName(t.insertion.select("trial_id", "ts"))
    return both.groupBy("trial_id").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))


def _time_bins_sql(source: str, delta: str, bins: int) -> str:
    return f"""{source}, sp AS (SELECT trial_id, min(ts) AS start, max(ts) AS stop FROM (SELECT trial_id, ts FROM access UNION ALL SELECT trial_id, ts FROM insertion) GROUP BY trial_id),
pl AS (SELECT f.trial_id, CAST(floor((f.ts - start) * {bins} / (stop - start)) AS BIGINT) AS bin, {delta} AS delta FROM f JOIN sp USING (trial_id)),
fo AS (SELECT trial_id, bin, count(*) AS n, count(delta) AS n_with, quantile_cont(delta, 0.5) AS median, avg(delta) AS mean FROM pl GROUP BY ALL),
ev2 AS (SELECT trial_id, unnest(range({bins})) AS bin FROM sp)
SELECT trial_id, bin, coalesce(n, 0) AS n, coalesce(n_with, 0) AS n_with, coalesce(round(n_with / n, 9), 0) AS share, round(median, 3) AS median, round(mean, 0) AS mean FROM ev2 LEFT JOIN fo USING (trial_id, bin)"""


@query(_time_bins_sql(_AFTER, "first_ts - ts", 100), EVENTS_SQL)
def delta_by_time_bin(spark, d):
    return insertions.by_time_bin(_deltas(spark, d), "delta", 100, _spans(events_trace(spark, d)))


@query(_time_bins_sql(_AFTER, "second_ts - ts", 60), EVENTS_SQL)
def second_delta_by_time_bin(spark, d):
    return insertions.by_time_bin(_deltas(spark, d), "second", 60, _spans(events_trace(spark, d)))


_BEFORE = "+ f AS (SELECT i.trial_id, i.page, i.ts, i.event_id, (SELECT max(a.ts) FROM access a WHERE a.trial_id = i.trial_id AND a.page = i.page AND a.ts < i.ts) AS before_ts FROM insertion i)"


def _before(spark, d):
    t = events_trace(spark, d)
    return asof.access_before(t.access, t.insertion, "event_id")


@query(f"{_BEFORE} SELECT * FROM f", EVENTS_SQL)
def insertion_access_before(spark, d):
    return _before(spark, d)


_LIMITS = {"1h": HOUR, "1d": DAY, "7d": 7 * DAY}


@query(
    f"{_BEFORE}, g AS (SELECT trial_id, ts - before_ts AS gap FROM f WHERE before_ts IS NOT NULL) SELECT trial_id, count(*) AS n, min(gap) AS least, "
    + ", ".join(f"round(quantile_cont(gap, {p}), 3) AS {a}" for a, p in (("p1", 0.01), ("p10", 0.1), ("median", 0.5), ("p90", 0.9)))
    + ", max(gap) AS largest, "
    + ", ".join(f"round(avg(CAST(gap < CAST({v} AS BIGINT) AS INTEGER)), 9) AS share_under_{k}" for k, v in _LIMITS.items())
    + " FROM g GROUP BY trial_id",
    EVENTS_SQL,
)
def access_before_insertion(spark, d):
    return insertions.before_insertion(_before(spark, d), _LIMITS)


_ORDINALS = "o AS (SELECT *, row_number() OVER (PARTITION BY trial_id, page ORDER BY ts, event_id) AS ordinal, ts - lag(ts) OVER (PARTITION BY trial_id, page ORDER BY ts, event_id) AS gap FROM insertion)"


@query(
    f"{_BEFORE}, {_ORDINALS} SELECT f.trial_id, count(*) AS n_insertions, count(before_ts) AS n_early, "
    + ", ".join(f"count(before_ts) FILTER (least(ordinal, 3) = {k}) AS n_early_{k}" for k in (1, 2, 3))
    + " FROM f JOIN o USING (event_id) GROUP BY f.trial_id",
    EVENTS_SQL,
)
def insertion_order_anomalies(spark, d):
    return insertions.ordering_anomalies(_before(spark, d), _ordinals(spark, d), "event_id")


def _ordinals(spark, d):
    return insertions.insertion_ordinals(events_trace(spark, d).insertion, ["event_id"])


@query(f"+ {_ORDINALS} SELECT * FROM o", EVENTS_SQL)
def reinsertion_gaps(spark, d):
    return _ordinals(spark, d)


@query(f"+ {_ORDINALS} SELECT trial_id, CASE WHEN ordinal = 1 THEN '1st' WHEN ordinal = 2 THEN '2nd' ELSE '3rd+' END AS ordinal_class, count(*) AS n FROM o GROUP BY ALL", EVENTS_SQL)
def insertion_ordinal_classes(spark, d):
    return insertions.ordinal_classes(_ordinals(spark, d))


@query(_time_bins_sql(f"+ {_ORDINALS}, f AS (SELECT * FROM o)", "gap", 40), EVENTS_SQL)
def reinsertion_by_time_bin(spark, d):
    return insertions.by_time_bin(_ordinals(spark, d), "gap", 40, _spans(events_trace(spark, d)))


@query("+ c AS (SELECT trial_id, page, count(*) AS n FROM insertion GROUP BY ALL) SELECT trial_id, count(*) AS n_pages, count(*) FILTER (n >= 2) AS n_reinserted, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS n_insertions, round(count(*) FILTER (n >= 2) / count(*), 9) AS share FROM c GROUP BY trial_id", EVENTS_SQL)
def reinsertion_stats(spark, d):
    return insertions.reinsertion_stats(events_trace(spark, d).insertion)
