"""What Python workers hold between tasks, and that slices of texts, which bound it, change no result."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagetrail.llm.near_duplicates import labelled_shingles
from pagetrail.llm.quality_rules import with_statistics


def _most_held(spark) -> float:
    """MB of anonymous memory of the worker that holds most."""

    def held(batches):
        for _ in batches:
            pass
        kb = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))
        yield pa.RecordBatch.from_pydict({"mb": [kb / 1024]})

    return max(r["mb"] for r in spark.range(0, 32, 1, 32).mapInArrow(held, "mb double").collect())


def test_workers_give_memory_back(spark):
    def judged(words: int) -> int:
        texts = spark.range(0, 32, 1, 32).select(F.repeat(F.lit("words of a text "), words).alias("text"))
        return with_statistics(texts).where("n_words > 0").count()

    assert judged(10) == 32  # imports
    before = _most_held(spark)
    assert judged(80_000) == 32  # 1.3 MB a text
    after = _most_held(spark)
    assert after - before < 30, (before, after)


def test_shingles_do_not_depend_on_the_slice():
    plain = " ".join(f"word{i}" for i in range(40))
    for beside in ("again and again and " * 20, "a few words", ""):
        shingles, at = labelled_shingles(pa.array([beside, plain, beside]))
        alone, _ = labelled_shingles(pa.array([plain]))
        assert np.array_equal(shingles[at[1] : at[2]], alone)
