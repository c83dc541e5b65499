"""The pipeline, stage by stage, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagetrail.llm.near_duplicates import near_duplicate_classes
from pagetrail.llm.shared import documents

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TINY = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = documents(spark, TINY)
    counts, columns = [docs.count()], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, TINY)
        if i < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i == 1:
            assert near_duplicate_classes(docs).where("class_size > 1").count() == 0
        if i == 2:
            assert docs.where("text rlike '[0-9a-f]{24}'").count() == 0
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[5] > 0


def test_run(spark):
    out = corpus_pipeline.run(spark, TINY)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


LONG = " ".join(f"word{i * i % 997} of sentence {i}" for i in range(4000))
ROWS = [
    (1, None, "en", None, None), (2, "", None, "b", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (4, "one two", "en", "a", 7),
    (5, LONG, "en", "a", len(LONG)), (6, LONG + " tail", None, None, len(LONG) + 5), (None, "key = no id", "fr", "c", 11),
    (7, "password = hunter2secret", "fr", "c", 24),
]
#: Names that stages use inside.
CLASHING = ("q_n_words", "q_kept", "kept", "node", "shingle", "band", "leader", "label", "size", "taken", "bin", "draw", "c0", "start", "length", "sequence_id", "offset", "ids", "weight", "place")


@pytest.fixture(scope="module", params=["rows", "none"])
def odd(request, spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns whose names stages use; and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(ROWS if request.param == "rows" else [], schema)
    return docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, odd, tmp_path, name):
    dict(corpus_pipeline.STAGES)[name](spark, odd, TINY).write.parquet(str(tmp_path / name))
    out = spark.read.parquet(str(tmp_path / name))
    found, given = out.collect(), odd.collect()
    if name == "packing":  # all ids of every document, in pieces without gaps
        lengths = Counter()
        for r in found:
            lengths[r["sequence_id"]] += r["length"]
        assert all(n <= 1024 for n in lengths.values()) and {r["doc_id"] for r in found} == {r["doc_id"] for r in given}
        assert sum(r["start"] == 0 for r in found) == len(given)
        return
    assert out.columns == odd.columns
    for r in found:
        assert all(r[c] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING)
    texts = Counter(r["text"] for r in found)
    if name == "secret_scan":
        assert len(found) == len(given) and not any("hunter2secret" in (t or "") for t in texts)
    if name == "near_dedup" and given:
        assert texts["one two"] == 1 and texts[LONG] + texts[LONG + " tail"] == 1 and texts["key = no id"] == 1
    if name == "quality_rules":
        assert not {None, "", "one two", "key = no id"} & set(texts)
