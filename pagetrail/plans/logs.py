"""Registered queries on sources: logs and reports are written from ``events``, found, read and compared with ``events``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions.scalars import clamp_u64, run_stamp
from pagetrail.plans.adapters import EVENTS_SQL, events_trace, table
from pagetrail.plans.registry import query
from pagetrail.sources import artifacts, binary_logs, text_logs
from pagetrail.sources.files import new_folder

#: Numbers of the iter folders; the order of numbers and that of names differ.
ITERS = (2, 10, 11)
_TRIAL_SQL = EVENTS_SQL.replace("0 AS trial_id", "CAST(event_id % 3 AS INTEGER) AS trial_id")


def _trial_folder(spark: SparkSession, rows: DataFrame, kind: str, rest: bytes = b"", base: str | None = None) -> str:
    """A data folder with the logs of one kind of a workload of three trials."""
    base = base or new_folder(spark)
    numbers = F.get(F.array(*(F.lit(i) for i in ITERS)), F.col("trial_id"))
    path = F.concat(F.lit(f"{base}/w/iter_"), numbers.cast("string"), F.lit(f"/t_{kind}_1.bin"))
    binary_logs.write_logs(rows.withColumn("path", path), kind, rest=rest)
    return base


def _read_back(spark: SparkSession, base: str, kind: str) -> DataFrame:
    return binary_logs.trial_logs(spark, binary_logs.discover(spark, base)["w"], kind)


# S1, S5-S7, U1


@query('SELECT trial_id, ts, page AS inode, CAST(-event_id - 1 + 18446744073709551616::HUGEINT AS VARCHAR) AS "offset", 7::BIGINT AS device FROM access', _TRIAL_SQL)
def access_log_scan(spark, d):
    """All fields come back, 64-bit ones without a sign."""
    rows = events_trace(spark, d, trials=3).access.select("trial_id", "ts", F.col("page").alias("in"), (-F.col("event_id") - 1).alias("of"), F.lit(7).alias("dm"))
    found = _read_back(spark, _trial_folder(spark, rows, "access"), "access")
    return found.select("trial_id", "ts", F.col("`in`").cast("long").alias("inode"), F.col("of").cast("string").alias("offset"), F.col("dm").alias("device"))


# S2, S4


@query("SELECT trial_id, ts FROM eviction", _TRIAL_SQL)
def eviction_log_scan(spark, d):
    """Bytes behind the last record are left out."""
    base = _trial_folder(spark, events_trace(spark, d, trials=3).eviction, "eviction", rest=b"abc")
    return _read_back(spark, base, "eviction").select("trial_id", "ts")


# The first trial by name is that of iter_10


@query("SELECT 0 AS trial_id, ts, page AS inode, event_id FROM insertion WHERE trial_id = 1", _TRIAL_SQL)
def insertion_log_scan(spark, d):
    rows = events_trace(spark, d, trials=3).insertion.select("trial_id", "ts", F.col("page").alias("in"), F.col("event_id").alias("ix"))
    folders = binary_logs.discover(spark, _trial_folder(spark, rows, "insertion"), ["w"])["w"]
    found = binary_logs.trial_logs(spark, [min(folders, key=lambda p: p.rsplit("/", 1)[-1])], "insertion")
    return found.select("trial_id", "ts", F.col("page.inode").cast("long").alias("inode"), F.col("page.index").cast("long").alias("event_id"))


# S8


@query("""SELECT 'access' AS kind, 0 AS trial_id, ts FROM access WHERE trial_id = 1 UNION ALL SELECT 'eviction', 0, ts FROM eviction WHERE trial_id = 1 UNION ALL SELECT 'insertion', 0, ts FROM insertion WHERE trial_id = 1""", _TRIAL_SQL)
def first_trial_logs(spark, d):
    """All three logs of the first trial by name."""
    t, base = events_trace(spark, d, trials=3), None
    for kind, rows in {"access": t.access, "eviction": t.eviction, "insertion": t.insertion}.items():
        base = _trial_folder(spark, rows.select("trial_id", "ts"), kind, base=base)
    found = binary_logs.first_trial(spark, base, "w")
    return reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind"), "trial_id", "ts") for kind, rows in found.items()))


# S9-S13, K7, X8

_LINE = "concat('log ', 'event_id=', event_id, '  type=', event_type, ' value=', value, ' end')"


def _text_log(spark: SparkSession, d: str) -> str:
    folder = new_folder(spark)
    lines = table(spark, d, "events").select(F.expr(_LINE).alias("value"))
    lines.unionByName(spark.createDataFrame([(" ",)], "value string")).repartition(3).write.text(folder)
    return folder


@query("SELECT CAST(event_id AS BIGINT) AS event_id, event_type AS type, value FROM events")
def key_value_log(spark, d):
    rows = text_logs.read_key_value_log(spark, _text_log(spark, d))
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "type", F.col("value").cast("double").alias("value"))


def _csv_folder(spark: SparkSession, d: str) -> str:
    folder = new_folder(spark)
    text_logs.logs_to_csv(spark, f"{_text_log(spark, d)}/*.txt", folder, ["event_id", "type", "value"])
    return folder


@query("SELECT CAST(event_id AS BIGINT) AS event_id, event_type AS type, value FROM events")
def logs_as_csv(spark, d):
    rows = text_logs.read_csv_trials(spark, f"{_csv_folder(spark, d)}/*/*.csv", "event_id long, type string, value double")
    return rows.where("trial_id IS NOT NULL").select("event_id", "type", "value")


@query("SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (event_type = 'view')::BIGINT AS n_views FROM events")
def csv_row_totals(spark, d):
    """Row counts of written CSV files, summed."""
    folder = new_folder(spark)
    artifacts.write_csv(table(spark, d, "events").where("event_type <> 'view'"), f"{folder}/others")
    artifacts.write_csv(table(spark, d, "events").where("event_type = 'view'"), f"{folder}/views")
    counts = text_logs.csv_row_counts(spark, f"{folder}/*/*.csv")
    return counts.agg(F.sum("rows").alias("n_rows"), F.sum(F.when(F.contains("path", F.lit("/views/")), F.col("rows")).otherwise(0)).alias("n_views"))


# S14, X2


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events UNION ALL SELECT -1 - event_id, NULL FROM events")
def run_stamps(spark, d):
    """The stamp in the names of files; names without one have none."""
    e = table(spark, d, "events")
    named = e.select("event_id", F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_access.csv")).alias("name"))
    plain = e.select((-1 - F.col("event_id")).alias("event_id"), F.concat(F.lit("run_2024_"), F.col("event_id").cast("string")).alias("name"))
    return named.unionByName(plain).select("event_id", run_stamp(F.col("name")).alias("stamp"))


@query("SELECT event_id, CAST(least(greatest((event_id - 300)::HUGEINT * 100000000000000000, 0::HUGEINT), 18446744073709551615::HUGEINT) AS VARCHAR) AS clamped FROM events")
def clamped_edges(spark, d):
    """Numbers as the unsigned 64-bit ones that a model file may hold."""
    wide = (F.col("event_id") - 300).cast("decimal(30,0)") * F.lit("100000000000000000").cast("decimal(20,0)")
    return table(spark, d, "events").select("event_id", clamp_u64(wide.cast("decimal(30,0)")).cast("string").alias("clamped"))


# S15, O6, X7


@query("SELECT event_id % 1000 * 17 + 5 AS ns FROM events WHERE event_type <> 'view' ORDER BY event_id LIMIT 1000")
def first_latencies(spark, d):
    """The first thousand latencies of a log in the order of its lines; other lines lie between."""
    folder = new_folder(spark)
    took = F.format_string("[%d] eviction took %d ns", F.col("event_id"), F.col("event_id") % 1000 * 17 + 5)
    lines = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", F.lit("page viewed")).otherwise(took).alias("value"))
    lines.orderBy("event_id").select("value").write.text(folder)
    return text_logs.eviction_latencies(spark, folder, 1000)


# S16, S17, K2


@query(
    """SELECT event_type AS model, (count(*) % 89 + 10) / 100.0::DOUBLE AS precision, (count(*) % 79 + 10) / 100.0::DOUBLE AS recall, (count(*) % 71 + 10) / 100.0::DOUBLE AS f1,
       count(*)::BIGINT AS support, CASE WHEN event_type <> 'view' THEN (count(*) % 89 + 10) / 100.0::DOUBLE END AS auc FROM events GROUP BY 1"""
)
def model_reports(spark, d):
    """One report per event type, in both forms that are read; that of views names no area."""
    folder = new_folder(spark)
    for r in table(spark, d, "events").groupBy("event_type").count().collect():
        n = r["count"]
        p, q, f = ((n % k + 10) / 100 for k in (89, 79, 71))
        area = "" if r["event_type"] == "view" else f"Pairwise Test AUC: {p:.4f}\n"
        report = f"{area}   weighted avg   {p:.2f}   {q:.2f}   {f:.2f}   {n}\n"
        if r["event_type"] == "click":
            report = artifacts.eval_report("click", {"confusion": dict(tn=1, fp=1, fn=1, tp=1), "horizon_source": "manual", "horizon_ns": 1, "n_eval": n, "positive_rate": 0.5, "auc": p, "precision": p, "recall": q, "f1": f, "prob_threshold": 0.5})
        artifacts.write_text(spark, f"{folder}/{r['event_type']}/eval_report.txt", report)
    return text_logs.read_reports(spark, folder)
