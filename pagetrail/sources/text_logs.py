"""Text traces, CSV traces, latency logs and model reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions.scalars import run_stamp
from pagetrail.sources.files import matching

_LOCAL = "^file:/*"


def in_file_order(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Lines of all matching files with columns that order them as in the files, and the names of these columns."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("line", F.monotonically_increasing_id()), ["file", "block", "line"]


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    return [re.sub(_LOCAL, "/", e.path) for e in matching(spark, pattern)]


def key_values(line: Column) -> Column:
    """A map from the ``key=value`` tokens of a line; tokens without '=' are dropped, of equal keys the last counts."""
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: F.contains(t, F.lit("=")))
    entries = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substr(t, F.instr(t, "=") + 1).alias("v")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))


def read_key_value_log(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of a ``key=value`` log. Without columns, they are the keys of the first line that has any, as in its order.

    Missing keys are null; blank lines are left out.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(key_values(F.col("value")).alias("kv"))
    columns = first_keys(spark, path) if columns is None else columns
    return lines.select(*(F.try_element_at("kv", F.lit(c)).alias(c) for c in columns)) if columns else lines.select()


def first_keys(spark: SparkSession, path: str) -> list[str]:
    """The keys of the first line that has any, in file order."""
    lines, order = in_file_order(spark, path)
    first = lines.withColumn("k", F.map_keys(key_values(F.col("value")))).where(F.size("k") > 0).orderBy(*order).limit(1).collect()
    return list(first[0]["k"]) if first else []


def logs_to_csv(spark: SparkSession, pattern: str, folder: str, columns: list[str] | None = None) -> None:
    """Every matching log as CSV, under a folder named after its file. Without columns, they are the keys of the first
    line of the first log that has any."""
    columns = first_keys(spark, pattern) if columns is None else columns
    lines = spark.read.text(pattern).where(F.trim("value") != "").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("log"), key_values(F.col("value")).alias("kv"))
    lines.select("log", *(F.try_element_at("kv", F.lit(c)).alias(c) for c in columns)).write.partitionBy("log").option("header", True).csv(folder, mode="overwrite")


def read_csv_trials(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All matching CSV files with trial_id, the place of the file among the sorted paths."""
    if not (found := _paths(spark, pattern)):
        raise FileNotFoundError(f"no CSV file fits {pattern}")
    rows = spark.read.schema(schema).option("header", True).csv(found).withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), _LOCAL, "/"))
    places = spark.createDataFrame(list(enumerate(found)), "trial_id int, path string")  # one row per file
    return rows.join(F.broadcast(places), "path").select(*(c for c in rows.columns if c != "path"), "trial_id")


def csv_row_counts(spark: SparkSession, pattern: str) -> DataFrame:
    """path, rows (lines less the header; -1 for an empty file) and the time stamp in the name."""
    if not (found := _paths(spark, pattern)):
        raise FileNotFoundError(f"no file fits {pattern}")
    lines = spark.read.text(found).groupBy(F.regexp_replace(F.col("_metadata.file_path"), _LOCAL, "/").alias("path")).agg(F.count("*").alias("lines"))
    every = spark.createDataFrame([(p,) for p in found], "path string")
    out = every.join(lines, "path", "left").select("path", (F.coalesce("lines", F.lit(0)) - 1).alias("rows"))
    return out.withColumn("stamp", run_stamp(F.regexp_extract("path", r"([^/]+)$", 1)))


def eviction_latencies(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """The first ``most`` numbers of nanoseconds of a log, in file order; the cut is part of the feature."""
    lines, order = in_file_order(spark, path)
    rows = lines.withColumn("ns", F.regexp_extract("value", r"eviction took (\d+) ns", 1)).where("ns <> ''")
    return rows.orderBy(*order).limit(most).select(F.col("ns").cast("long"))


_NUMBER = r"(\d+\.?\d*)"


def _number(found: Column) -> Column:
    """A double, or null for what a pattern didn't find."""
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def parse_reports(texts: DataFrame, text: str = "value") -> DataFrame:
    """Adds precision, recall, f1, support and auc. Both report forms are read: the averaged table, and lines of
    ``name: value``. Without averages a row is left out; without an AUC it is null."""
    averages = rf"weighted avg\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+(\d+)"
    number = lambda pattern, k: _number(F.regexp_extract(text, pattern, k))
    names = {
        "precision": (1, rf"(?im)^\s*precision(?: / recall)?\s*:\s*{_NUMBER}"),
        "recall": (2, rf"(?im)^\s*(?:precision / )?recall\s*:\s*(?:[\d.]+ / )?{_NUMBER}"),
        "f1": (3, rf"(?im)^\s*f1\s*:\s*{_NUMBER}"),
        "support": (4, r"(?im)^\s*(?:support|(?:holdout )?rows)\s*:\s*([\d,]+)"),
    }
    out = texts.withColumns({n: F.coalesce(number(averages, k), number(line, 1)) for n, (k, line) in names.items()})
    auc = F.coalesce(number(rf"Pairwise Test AUC:\s*{_NUMBER}", 1), number(rf"(?im)^\s*(?:roc )?auc\s*:\s*{_NUMBER}", 1))
    return out.withColumn("auc", auc).where("precision IS NOT NULL").withColumn("support", F.col("support").cast("long"))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of all models of a folder, best AUC first; the model is the name of its folder."""
    texts = spark.read.text(f"{folder}/*/eval_report.txt", wholetext=True).withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/eval_report\.txt$", 1))
    return parse_reports(texts).select("model", "precision", "recall", "f1", "support", "auc").orderBy(F.desc_nulls_last("auc"), "model")
