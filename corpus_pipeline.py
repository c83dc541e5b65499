"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's
documents.  All of them read whole texts of any length, give no rows for an empty table, and keep columns that they don't
know, whatever their names (packing returns its pieces alone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetrail.llm import decoded_secrets, mixing, near_duplicates, packing, quality_rules
from pagetrail.llm.shared import documents, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learned decision list reject. A null or empty text fails the base rules; rows of one
    text are judged alike, so that repeated rows stay or go together; ties of learned tests go to the feature that stands
    first; null ids and sources don't matter."""
    rules = quality_rules.train_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_good(docs, rules)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: that with the least id, a null id only where there is no other; of
    repeated rows and ties one. Null texts count as empty ones, which are copies of each other."""
    return near_duplicates.drop_near_duplicates(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, also those inside encodings, and counts characters anew. A null text stays null, an empty one empty;
    repeated rows are masked alike; overlapping spans become one mask."""
    return decoded_secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or drops documents so that sources reach their target weights. Null or empty texts have no words and are
    never taken in part; a null source is a source of its own; repeated rows are taken in turn; ties of keys go by id and size."""
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, as pieces of documents. A null or empty text is one token; repeated rows are packed as
    often as they stand there; ties go to the document that stands first in its shard."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", keep_good), ("near_dedup", drop_copies), ("secret_scan", mask), ("mixing", mix), ("packing", pack)]

#: Learned rules, sketches and nested decoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}_{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
