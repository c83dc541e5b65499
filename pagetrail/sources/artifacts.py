"""What a training run leaves behind."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession

from pagetrail.sources.files import write_small


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, on any file system that Spark reaches."""
    write_small(spark, str(path), text.encode())


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A small document as one file; NaN becomes null."""

    def plain(x):
        if isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    write_text(spark, path, json.dumps(plain(document), indent=2, allow_nan=False) + "\n")


def eval_report(name: str, metrics: dict) -> str:
    """The report of a holdout, or one line that there was none."""
    if "confusion" not in metrics:
        return f"{name}: nothing was held out to judge the model by.\n"
    cells = metrics["confusion"]
    # The labels of the report's lines
    lines = [
        ("horizon (" + metrics["horizon_source"] + ") ", f"{metrics['horizon_ns'] / 1e9:.1f}s"),
        ("holdout rows", f"{metrics['n_eval']:,}"),
        ("positive rate", f"{metrics['positive_rate']:.4f}"),
        ("AUC", "undefined" if metrics["auc"] is None else f"{metrics['auc']:.4f}"),
        ("precision / recall", f"{metrics['precision']:.4f} / {metrics['recall']:.4f}"),
        ("F1", f"{metrics['f1']:.4f}"),
        ("decision prob thresh", f"{metrics['prob_threshold']:.4f}"),
        ("confusion (tn fp fn tp)", " ".join(str(cells[c]) for c in ("tn", "fp", "fn", "tp"))),
    ]
    title = f"Eviction-time binary reuse classifier -- {name}"
    return "\n".join([title, "=" * len(title), *(f"{label:<21}: {value}" for label, value in lines)]) + "\n"


def edges_table(spark: SparkSession, edges: dict[str, list[float]]) -> DataFrame:
    return spark.createDataFrame([(f, i, float(e)) for f, own in edges.items() for i, e in enumerate(own)], "feature string, i int, edge double")


def edges_from(table: DataFrame) -> dict[str, list[float]]:
    out: dict[str, list[float]] = {}
    for r in table.orderBy("feature", "i").collect():
        out.setdefault(r["feature"], []).append(r["edge"])
    return out


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)
