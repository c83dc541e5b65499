"""Folders and small files on any file system that Spark reaches, by Hadoop's own interface.

Only names, sizes and small documents pass here; tables are read and written by Spark.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    is_folder: bool
    size: int


def _open(spark: SparkSession, path: str) -> tuple:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _entry(status) -> Entry:
    path = status.getPath()
    return Entry(path.toString(), path.getName(), status.isDirectory(), status.getLen())


def is_folder(spark: SparkSession, path: str) -> bool:
    system, hadoop = _open(spark, path)
    return system.exists(hadoop) and system.getFileStatus(hadoop).isDirectory()


def entries(spark: SparkSession, folder: str) -> list[Entry]:
    """What a folder holds, by name."""
    system, hadoop = _open(spark, folder)
    return sorted((_entry(s) for s in system.listStatus(hadoop)), key=lambda e: e.name)


def matching(spark: SparkSession, pattern: str) -> list[Entry]:
    """What fits a pattern of names, or the one path that it is, by path."""
    system, hadoop = _open(spark, pattern)
    return sorted((_entry(s) for s in system.globStatus(hadoop) or []), key=lambda e: e.path)


def write_small(spark: SparkSession, path: str, content: bytes) -> None:
    system, hadoop = _open(spark, path)
    out = system.create(hadoop, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_small(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(str(path)).first()["content"])


def new_folder(spark: SparkSession) -> str:
    """A path for a new folder that the driver and all executors share: below ``spark.checkpoint.dir``, or, in a local
    session without that setting, below the machine's own temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='pagetrail-')}/files-{uuid.uuid4().hex}"
