"""Sources and sinks on small files."""

from __future__ import annotations

import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.sources import artifacts, binary_logs, text_logs


def write(path, kind, rows):
    out = np.zeros(len(rows), binary_logs.record_dtype(kind))
    for i, r in enumerate(rows):
        for k, v in r.items():
            out[i][k] = v
    out.tofile(path)
    return path


def test_access_log(spark, tmp_path):
    path = write(tmp_path / "a.bin", "access", [{"ts": 5, "pd": 2**64 - 1, "in": 7, "of": 2**63, "fq": 2**32 - 1}, {"ts": 9, "ie": 3}])
    rows = binary_logs.read_log(spark, path, "access").orderBy("ts").collect()
    assert len(rows[0]) == 13 and rows[0]["pd"] == Decimal(2**64 - 1) and rows[0]["of"] == Decimal(2**63) and rows[0]["fq"] == 2**32 - 1
    assert rows[1]["ts"] == 9 and rows[1]["ie"] == 3 and rows[1]["pd"] == 0


def test_trailing_bytes_and_empty_and_missing(spark, tmp_path):
    path = write(tmp_path / "e.bin", "eviction", [{"ts": t} for t in range(10)])
    path.write_bytes(path.read_bytes() + b"abc")
    assert [r["ts"] for r in binary_logs.read_log(spark, path, "eviction").orderBy("ts").collect()] == list(range(10))
    with pytest.warns(UserWarning, match="3 bytes"):
        binary_logs.LogReader([str(path)], "eviction").partitions()
    (tmp_path / "none.bin").write_bytes(b"")
    assert binary_logs.read_log(spark, tmp_path / "none.bin", "insertion").count() == 0
    with pytest.raises(FileNotFoundError):
        binary_logs.read_log(spark, tmp_path / "missing.bin", "access")


@pytest.mark.parametrize("rest", [b"", b"abc"])
def test_log_through_hadoop(spark, tmp_path, rest):
    """A path that only Hadoop's file systems open."""
    path = write(tmp_path / "e.bin", "insertion", [{"ts": t, "in": 2**64 - 1 - t} for t in range(500)])
    path.write_bytes(path.read_bytes() + rest)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{tmp_path.name}.link./in", f"file://{tmp_path}")
    rows = binary_logs.read_log(spark, f"viewfs://{tmp_path.name}/in/e.bin", "insertion").orderBy("ts").collect()
    assert [(r["ts"], int(r["in"])) for r in rows] == [(t, 2**64 - 1 - t) for t in range(500)]
    assert binary_logs.single_log(spark, f"viewfs://{tmp_path.name}/in", "*.bin").endswith("/in/e.bin")


def test_written_logs_come_back(spark, tmp_path):
    """A file per path, in the order of time; nulls are 0, -1 is the largest number; rows that come again change nothing."""
    rows = spark.createDataFrame([(f"{tmp_path}/{k % 2}/e.bin", 90 - k, -1 if k < 4 else None) for k in range(9)], "path string, ts long, in long")
    for _ in range(2):
        assert binary_logs.write_logs(rows, "insertion", rest=b"xy") == 9
    for k in range(2):
        assert [p.name for p in (tmp_path / str(k)).iterdir() if not p.name.startswith(".")] == ["e.bin"]
        back = binary_logs.read_log(spark, tmp_path / str(k) / "e.bin", "insertion", numbered=True).orderBy("record").collect()
        assert [(r["ts"], int(r["in"])) for r in back] == sorted((90 - i, 2**64 - 1 if i < 4 else 0) for i in range(k, 9, 2))
    assert binary_logs.write_logs(rows.limit(0), "insertion") == 0


def test_many_ranges(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "e.bin", "eviction", [{"ts": t} for t in range(1000)])
    monkeypatch.setattr(binary_logs, "_RANGE", 800)
    parts = binary_logs.LogReader([str(path)], "eviction").partitions()
    assert len(parts) == 10 and sum(p.count for p in parts) == 1000


def test_discovery(spark, tmp_path):
    for name in ("w2/iter_10", "w2/iter_9", "w2/iter_x", "w1/iter_0", ".hidden/iter_0"):
        (tmp_path / name).mkdir(parents=True)
    found = binary_logs.discover(spark, tmp_path)
    assert list(found) == ["w1", "w2"] and [p.rsplit("/", 1)[1] for p in found["w2"]] == ["iter_9", "iter_10"]
    assert list(binary_logs.discover(spark, tmp_path, ["w2"])) == ["w2"]
    with pytest.raises(ValueError, match="nope"):
        binary_logs.discover(spark, tmp_path, ["nope"])
    with pytest.raises(FileNotFoundError):
        binary_logs.discover(spark, tmp_path / "away")
    (tmp_path / "w3").mkdir()
    with pytest.raises(FileNotFoundError, match="w3"):
        binary_logs.discover(spark, tmp_path)
    with pytest.raises(FileNotFoundError, match="exactly one"):
        binary_logs.single_log(spark, tmp_path, "*.bin")


def test_key_value_log(spark, tmp_path):
    (tmp_path / "t.log").write_text("start t=1 z=2 f=a=b\n\n  t=3   noise z=4\nt=5 t=6 q=9\n")
    rows = [r.asDict() for r in text_logs.read_key_value_log(spark, str(tmp_path / "t.log"), ["t", "z", "f"]).collect()]
    assert rows == [{"t": "1", "z": "2", "f": "a=b"}, {"t": "3", "z": "4", "f": None}, {"t": "6", "z": None, "f": None}]
    assert set(text_logs.read_key_value_log(spark, str(tmp_path / "t.log")).columns) == {"t", "z", "f"}
    text_logs.logs_to_csv(spark, str(tmp_path / "*.log"), str(tmp_path / "csv"))
    assert set(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == {"t", "z", "f", "log"}
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_csv_trials(spark, tmp_path):
    (tmp_path / "b_20240102_030405.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "a.csv").write_text("x,y\n5,6\n")
    (tmp_path / "c.csv").write_text("")
    rows = text_logs.read_csv_trials(spark, str(tmp_path / "[ab]*.csv"), "x int, y int").orderBy("x").collect()
    assert [(r["x"], r["trial_id"]) for r in rows] == [(1, 1), (3, 1), (5, 0)]
    counts = {r["path"].split("/")[-1]: (r["rows"], r["stamp"]) for r in text_logs.csv_row_counts(spark, str(tmp_path / "*.csv")).collect()}
    assert counts == {"a.csv": (1, None), "b_20240102_030405.csv": (2, "20240102_030405"), "c.csv": (-1, None)}
    with pytest.raises(FileNotFoundError):
        text_logs.read_csv_trials(spark, str(tmp_path / "z*.csv"), "x int")


def test_latencies_and_reports(spark, tmp_path):
    (tmp_path / "l.log").write_text("".join(f"x eviction took {n} ns y\nother\n" for n in (5, 7, 9)))
    assert [r["ns"] for r in text_logs.eviction_latencies(spark, str(tmp_path / "l.log"), 2).collect()] == [5, 7]
    for name, text in {"m1": "head\nweighted avg  0.5 0.6 0.7 447\nPairwise Test AUC: 0.7174\n", "m2": "rows: 10\nprecision: 0.9\nrecall: 0.8\nf1: 0.85\nauc: 0.91\n", "m3": "nothing", "m4": "weighted avg 1.0 1.0 1.0 3\n"}.items():
        (tmp_path / "models" / name).mkdir(parents=True)
        (tmp_path / "models" / name / "eval_report.txt").write_text(text)
    rows = [tuple(r) for r in text_logs.read_reports(spark, str(tmp_path / "models")).collect()]
    assert rows == [("m2", 0.9, 0.8, 0.85, 10, 0.91), ("m1", 0.5, 0.6, 0.7, 447, 0.7174), ("m4", 1.0, 1.0, 1.0, 3, None)]


def test_artifacts(spark, tmp_path):
    artifacts.write_json(spark, tmp_path / "m.json", {"auc": float("nan"), "w": [1.5, float("nan")], "n": 2})
    assert json.loads((tmp_path / "m.json").read_text()) == {"auc": None, "w": [1.5, None], "n": 2}
    assert artifacts.eval_report("w", {"horizon_source": "manual"}).count("\n") == 1
    edges = {"b": [1.0, 2.0], "a": [0.0, 5.0, 9.0]}
    assert artifacts.edges_from(artifacts.edges_table(spark, edges)) == edges
    artifacts.write_csv(spark.range(3).withColumn("x", F.lit("a")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_trials_are_one_scan(spark, tmp_path):
    """The plan of many trials is no larger than that of one; each row knows its trial and its place in the log."""
    for k in range(60):
        folder = tmp_path / f"iter_{k}"
        folder.mkdir()
        write(folder / "t_access_x.bin", "access", [{"ts": 10 * k + j, "in": k} for j in range(k % 4)])
    folders = [str(tmp_path / f"iter_{k}") for k in range(60)]
    rows = binary_logs.trial_logs(spark, folders, "access")
    assert sorted((r["trial_id"], r["access_key"], r["ts"]) for r in rows.collect()) == sorted((k, j, 10 * k + j) for k in range(60) for j in range(k % 4))
    size = lambda df: len(df._jdf.queryExecution().executedPlan().toString().splitlines())
    assert size(rows) == size(binary_logs.trial_logs(spark, folders[:2], "access"))


def test_csv_trials_are_one_scan(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"f{k:02}.csv").write_text("a,b\n" + "".join(f"{k},{j}\n" for j in range(k % 3)))
    rows = text_logs.read_csv_trials(spark, f"{tmp_path}/*.csv", "a int, b int")
    assert rows.columns == ["a", "b", "trial_id"]
    assert sorted(map(tuple, rows.collect())) == sorted((k, j, k) for k in range(40) for j in range(k % 3))
    with pytest.raises(FileNotFoundError):
        text_logs.read_csv_trials(spark, f"{tmp_path}/*.none", "a int")
