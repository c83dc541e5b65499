"""Fixed-width binary event logs as a Spark data source.

``spark.read.format("trace_log").option("kind", "access").load(path)`` reads files of packed little-endian records.
Files are cut into byte ranges of whole records, each read by one task into Arrow batches.  Bytes behind the last
whole record are left out with a warning.  The data source needs paths that tasks can open; :func:`read_log` takes any
path that Spark reaches, and reads other file systems through Hadoop's fixed-length records.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pagetrail.shipping import ensure_shipped
from pagetrail.sources.files import Entry, entries, is_folder, matching

# The record layouts of the logs.
LAYOUTS = {
    "access": [("ts", "u8"), ("pd", "u8"), ("p2", "u8"), ("id", "u8"), ("i2", "u8"), ("dm", "u4"), ("dn", "u4"), ("in", "u8"), ("of", "u8"), ("sd", "u4"), ("_pad", "u4"), ("sz", "u8"), ("fq", "u4"), ("ie", "u4")],
    "eviction": [("ts", "u8")],
    "insertion": [("ts", "u8"), ("dm", "u4"), ("dn", "u4"), ("in", "u8"), ("ix", "u8")],
}
_RANGE = 64 << 20  # bytes that one task reads


def record_dtype(kind: str) -> np.dtype:
    if kind not in LAYOUTS:
        raise ValueError(f"kind must be one of {', '.join(LAYOUTS)}")
    return np.dtype([(name, f"<{code}") for name, code in LAYOUTS[kind]])


def fields(kind: str) -> list[str]:
    return [name for name, _ in LAYOUTS[kind] if not name.startswith("_")]


def ddl(kind: str) -> str:
    """Times are long (nanoseconds since boot); other 64-bit fields are decimals, so that 2**64 - 1 stays whole."""
    types = {"u4": "bigint", "u8": "decimal(20,0)"}
    return ", ".join(f"`{name}` {'bigint' if name == 'ts' else types[code]}" for name, code in LAYOUTS[kind] if not name.startswith("_"))


@dataclass
class FileRange(InputPartition):
    path: str
    first: int
    count: int
    place: int = 0


def _unsigned_decimals(values: np.ndarray) -> pa.Array:
    """decimal(20, 0) from unsigned 64-bit values: as 128-bit integers whose upper half is zero."""
    wide = np.zeros((len(values), 2), "<u8")
    wide[:, 0] = values
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(values), [None, pa.py_buffer(wide.tobytes())])


def _batch(records: np.ndarray, kind: str, first: int | None = None, place: int | None = None) -> pa.RecordBatch:
    """first: the number of the first record, where numbers are wanted; place: that of the file among the files."""
    columns, names = [], fields(kind)
    for name, code in LAYOUTS[kind]:
        if name.startswith("_"):
            continue
        values = np.ascontiguousarray(records[name])
        if name == "ts":
            if len(values) and values.max() > np.uint64((1 << 63) - 1):
                raise ValueError("a time beyond 2**63 - 1")
            columns.append(pa.array(values.astype(np.int64)))
        else:
            columns.append(pa.array(values.astype(np.int64)) if code == "u4" else _unsigned_decimals(values))
    if first is not None:
        columns, names = [*columns, pa.array(np.arange(first, first + len(records), dtype=np.int64))], [*names, "record"]
    if place is not None:
        columns, names = [*columns, pa.array(np.full(len(records), place, np.int32))], [*names, "trial_id"]
    return pa.RecordBatch.from_arrays(columns, names)


def _warn_of_rest(path: str, size: int, kind: str) -> None:
    if rest := size % record_dtype(kind).itemsize:
        warnings.warn(f"{path}: {rest} bytes behind the last whole {kind} record are left out", stacklevel=3)


class LogReader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str, numbered: bool = False, placed: bool = False):
        self.paths, self.kind, self.numbered, self.placed = paths, kind, numbered, placed

    def partitions(self) -> list[FileRange]:
        size, out = record_dtype(self.kind).itemsize, []
        for place, path in enumerate(self.paths):
            held = os.path.getsize(path)
            _warn_of_rest(path, held, self.kind)
            step = max(1, _RANGE // size)
            out += [FileRange(path, k, min(step, held // size - k), place) for k in range(0, held // size, step)]
        return out or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        dtype = record_dtype(self.kind)
        for at in range(0, partition.count, 1 << 16):
            n = min(1 << 16, partition.count - at)
            records = np.fromfile(partition.path, dtype, n, offset=(partition.first + at) * dtype.itemsize)
            yield _batch(records, self.kind, partition.first + at if self.numbered else None, partition.place if self.placed else None)


class TraceLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace_log"

    def schema(self) -> str:
        return ddl(self.options.get("kind", "access")) + ", record bigint" * ("numbered" in self.options) + ", trial_id int" * ("placed" in self.options)

    def reader(self, schema: StructType) -> LogReader:
        found = [p for part in self.options["path"].split(",") for p in (sorted(glob.glob(part)) if glob.has_magic(part) else [part])]
        if missing := [p for p in found if not os.path.exists(p)] or ([] if found else [self.options["path"]]):
            raise FileNotFoundError(f"no such log: {missing[0]}")
        return LogReader(found, self.options.get("kind", "access"), "numbered" in self.options, "placed" in self.options)


def _by_hadoop(spark: SparkSession, files: list[Entry], kind: str) -> DataFrame:
    """Records of files that only Spark's own readers open. Files with a rest behind the last record are read whole."""
    dtype = record_dtype(kind)
    whole = [f.path for f in files if f.size and f.size % dtype.itemsize == 0]
    odd = [f.path for f in files if f.size % dtype.itemsize]
    content = spark.createDataFrame([], "value binary")
    if whole:
        records = spark.sparkContext._jsc.binaryRecords(",".join(whole), dtype.itemsize).rdd()
        found = spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
        content = content.unionByName(DataFrame(found, spark))
    if odd:
        content = content.unionByName(spark.read.format("binaryFile").load(odd).select(F.col("content").alias("value")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = b"".join(v[: len(v) // dtype.itemsize * dtype.itemsize] for v in batch.column(0).to_pylist())
            yield _batch(np.frombuffer(held, dtype), kind)

    return content.mapInArrow(work, ddl(kind))


def read_log(spark: SparkSession, path: str, kind: str, *, numbered: bool = False) -> DataFrame:
    """One log, or several separated by commas, each a path or a pattern of names. An empty file gives an empty table, a
    missing one FileNotFoundError. numbered: add ``record``, the place in its file, where the tasks open files themselves."""
    files = []
    for p in str(path).split(","):
        found = matching(spark, p)
        if not found:
            raise FileNotFoundError(f"no such log: {p}")
        files += found
    ensure_shipped(spark)
    if not all(f.path.startswith("file:") for f in files):
        for f in files:
            _warn_of_rest(f.path, f.size, kind)
        return _by_hadoop(spark, files, kind)
    return _local(spark, [f.path for f in files], kind, numbered=numbered)


def _local(spark: SparkSession, paths: list[str], kind: str, *, numbered: bool = False, placed: bool = False) -> DataFrame:
    """One scan over files that tasks open. placed: add ``trial_id``, the place of the file in the list."""
    ensure_shipped(spark)
    spark.dataSource.register(TraceLog)
    reader = spark.read.format("trace_log").option("kind", kind)
    for name in ["numbered"] * numbered + ["placed"] * placed:
        reader = reader.option(name, "true")
    return reader.load(",".join(re.sub("^file:/*", "/", p) for p in paths))


def write_logs(rows: DataFrame, kind: str, path: str = "path", rest: bytes = b"") -> int:
    """Writes logs and returns how many records they hold. rows: a column with the path of each record's log, which tasks
    can open, and fields of the kind as numbers (missing fields and nulls are 0, -1 stands for 2**64 - 1).

    A log is one file, written by one task in the order of ``ts`` and put in place when it is whole, so that a task that
    runs again does no harm. rest: bytes behind the last record.
    """
    dtype, names = record_dtype(kind), [f for f in fields(kind) if f in rows.columns]
    known = rows.select(F.regexp_replace(F.col(path), "^file:/*", "/").alias("path"), *(F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f) for f in names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, draft, file, n = None, "", None, 0

        def close() -> None:
            if file is not None:
                file.write(rest)
                file.close()
                os.replace(draft, current)

        for batch in batches:
            if not batch.num_rows:
                continue
            paths = np.array(batch.column("path").to_pylist(), object)
            starts = np.flatnonzero(np.r_[True, paths[1:] != paths[:-1]]).tolist()
            for a, b in zip(starts, [*starts[1:], len(paths)], strict=True):
                if paths[a] != current:
                    close()
                    current = paths[a]
                    os.makedirs(os.path.dirname(current), exist_ok=True)
                    draft = f"{current}.{uuid.uuid4().hex}"
                    file = open(draft, "wb")  # noqa: SIM115
                records = np.zeros(b - a, dtype)
                for f in names:
                    records[f] = batch.column(f).to_numpy()[a:b].astype(np.uint64)
                file.write(records.tobytes())
                n += b - a
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ensure_shipped(rows.sparkSession)
    order = ["path", "ts"] if "ts" in names else ["path"]
    return known.repartition("path").sortWithinPartitions(*order).mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0


def single_log(spark: SparkSession, folder: str, pattern: str) -> str:
    """The one file of a folder that fits the pattern."""
    found = matching(spark, f"{folder}/{pattern}")
    if len(found) != 1:
        raise FileNotFoundError(f"{folder}: exactly one file {pattern} is needed, {len(found)} found")
    return found[0].path


def discover(spark: SparkSession, base: str, workloads: list[str] | None = None) -> dict[str, list[str]]:
    """Workload folders with their iter_<n> folders, in the order of n. Hidden folders are left out."""
    if not is_folder(spark, base):
        raise FileNotFoundError(f"no such folder: {base}")
    there = {e.name: e.path for e in entries(spark, base) if e.is_folder and not e.name.startswith(".")}
    if workloads is not None and (unknown := sorted(set(workloads) - set(there))):
        raise ValueError(f"unknown workloads {', '.join(unknown)}; there are {', '.join(sorted(there)) or 'none'}")
    out = {}
    for name in workloads if workloads is not None else there:
        iters = sorted((int(m[1]), e.path) for e in entries(spark, there[name]) if e.is_folder and (m := re.fullmatch(r"iter_(\d+)", e.name)))
        if not iters:
            raise FileNotFoundError(f"workload {name} has no iter_<n> folder")
        out[name] = [p for _, p in iters]
    if not out:
        raise FileNotFoundError(f"{base} holds no workload")
    return out


PAGE_FIELDS = {"access": ("dm", "dn", "in", "of"), "insertion": ("dm", "dn", "in", "ix")}


def trial_logs(spark: SparkSession, iters: list[str], kind: str, prefix: str = "*") -> DataFrame:
    """The logs of all trials in one table with trial_id, the position in the list; page keys become a struct ``page``,
    and accesses have ``access_key``, their place in the log, where records are numbered."""
    files = [single_log(spark, folder, f"{prefix}_{kind}_*.bin") for folder in iters]
    if all(f.startswith("file:") for f in files):
        out = _local(spark, files, kind, numbered=kind == "access", placed=True)
    else:
        parts = [read_log(spark, f, kind, numbered=kind == "access").withColumn("trial_id", F.lit(trial)) for trial, f in enumerate(files)]
        out = reduce(DataFrame.unionByName, parts)
    out = out.withColumnRenamed("record", "access_key")
    if kind in PAGE_FIELDS:
        out = out.withColumn("page", F.struct(*(F.col(f"`{c}`").alias(a) for c, a in zip(PAGE_FIELDS[kind], ("dm", "dn", "inode", "index"), strict=True))))
    return out


def first_trial(spark: SparkSession, base: str, workload: str, prefix: str = "*") -> dict[str, DataFrame]:
    """All three logs of a workload's first trial, as trial 0. First is meant by name, so that iter_10 stands before iter_2."""
    folder = min(discover(spark, base, [workload])[workload], key=lambda p: p.rsplit("/", 1)[-1])
    return {kind: trial_logs(spark, [folder], kind, prefix) for kind in LAYOUTS}
