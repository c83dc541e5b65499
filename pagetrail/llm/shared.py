"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagetrail.shipping import ensure_shipped

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local session without one (tests) gets a folder of its own; on
    a cluster its absence is an error, as executors don't share local folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame, *, small: bool = False) -> DataFrame:
    """Cut the lineage into the shared checkpoint folder, so that a lost executor costs no recomputation.

    small: of tables that hold a few numbers per row; they are written in two files per core, not in one for each
    shuffle partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if small:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return freed memory to the system. Spark keeps Python workers for later tasks and stages, and allocators keep what a
    task has freed, so that an executor would hold the largest need of each worker beside its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def mapped(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow with this package at hand in the workers, which give freed memory back at the end of a task."""
    ensure_shipped(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(work, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the checkpoint folder, for tables that stages hand on."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_position(docs: DataFrame, *columns: str) -> tuple:
    """The rows with columns named c0, c1, ... by position, so that added ones clash with none; and the new names of columns."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), *(f"c{docs.columns.index(c)}" for c in columns)


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from the values of columns; independent of partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) * F.lit(2.0**-53)).cast("double")


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Bytes of texts in a slice for steps that make several 64-bit numbers of each byte.
SMALL_SLICE = 1 << 18


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes, so that working memory is bounded."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    yield batch.slice(begin)
