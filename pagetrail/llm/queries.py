"""The registered queries of this subpackage; each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm import alignment, decoded_secrets, fingerprints, kd_shards, langid, license_match, mixing, near_duplicates, packing, pieces, quality_model, quality_rules, spelling
from pagetrail.llm.shared import crc_of_id, documents


def op1_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_of_id() % 3 == 1
    model = langid.train_language_model(docs.where(~held_out))
    out = langid.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted", F.round("cross_entropy", 6).alias("cross_entropy"))


def op2_decoded_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded_secrets.digest(decoded_secrets.find_secrets(documents(spark, sf_dir)))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(documents(spark, sf_dir))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.shard_documents(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_match.document_licenses(documents(spark, sf_dir)).withColumn("dice", F.round("dice", 6))


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(documents(spark, sf_dir))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_of_id() % 5 == 0
    known = labels.where(~held_out & F.col("quality").isNotNull()).select("doc_id", "quality")
    model = quality_model.train_labelled(docs, known)
    out = quality_model.score_quality(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality_rules.train_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_rules.judge(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir))


def op12_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encoded(documents(spark, sf_dir)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_kneser_ney_language, op2_decoded_secrets, op3_order_minhash, op4_kd_shards, op5_license_dice, op6_weighted_fingerprints, op7_subword_quality, op8_decision_list, op9_bm25_packing, op10_weighted_mix, op11_cross_tokenizer_alignment, op12_sentencepiece_chunks, op13_spelling_variants)}


def _licenses_sql() -> str:
    """Every unit of every document against every template, without the pruning of the operator."""
    # RE2 has no look-around: dots that don't stand before a digit, then those that don't stand after one
    norm = r"regexp_replace(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}.]+', ' ', 'g'), '\.([^0-9]|$)', ' \1', 'g'), '(^|[^0-9])\.', '\1 ', 'g')"
    # twice, since neighbouring matches share a character
    twice = norm.format(norm.format("u"))
    templates = " UNION ALL ".join(f"SELECT '{name}' AS license, [{', '.join(repr(b) for b in own)}] AS want" for name, own in sorted(license_match.template_bigrams().items()))
    return rf"""
WITH templates AS ({templates}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
units AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS u, unnest(range(len(string_split(text, chr(10))))) AS unit FROM docs WHERE text IS NOT NULL
  UNION ALL SELECT rid, text, -1 FROM docs WHERE contains(text, chr(10))),
words AS (SELECT rid, unit, list_filter(string_split({twice}, ' '), lambda x: x <> '') AS w FROM units),
own AS (SELECT rid, unit, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS b FROM words WHERE len(w) > 1),
matches AS (
  SELECT rid, unit, license, 2.0 * len(list_intersect(b, want)) / (len(b) + len(want)) AS dice
  FROM own, templates WHERE len(b) BETWEEN len(want) * 0.66 AND len(want) * 1.51),
hits AS (SELECT * FROM matches WHERE dice >= {license_match.THRESHOLD}),
best AS (
  SELECT rid, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS dice FROM hits GROUP BY rid),
named AS (SELECT b.rid, min(h.license) AS license FROM best b JOIN hits h ON b.rid = h.rid AND b.dice = h.dice GROUP BY b.rid)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, license, round(dice, 6) AS dice, coalesce(licenses, '') AS licenses
FROM docs d LEFT JOIN best USING (rid) LEFT JOIN named USING (rid)
"""


#: Shared weights 1, 2, 3 in code point order; the level at which unfilled sources settle is found from the sorted caps.
_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols
  FROM documents),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
            / (1.0 - 0.75 * least(coalesce(CAST(symbols AS DOUBLE) / nullif(size, 0), 0.0), 1.0)) AS es_key
  FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM keyed GROUP BY source),
caps AS (SELECT *, CAST(3.0 * source_size AS DOUBLE) AS cap, 3.0 * source_size / w AS level FROM sources),
steps AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM caps),
rate AS (SELECT max(CAST(total - full_before AS DOUBLE) / w_left) FILTER (WHERE CAST(total - full_before AS DOUBLE) / w_left <= level) AS r FROM steps),
targets AS (SELECT source, source_size, least(cap, coalesce(w * r, cap)) AS target FROM caps, rate),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
         CASE WHEN p.source_size > 0 THEN CAST(round_even(p.target, 0) AS BIGINT) - p.epochs * p.source_size ELSE 0 END AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY es_key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS ahead
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(epochs * size + greatest(least(budget - ahead, size), 0) AS BIGINT) AS taken FROM run
"""

ORACLE_SQL = {"op5_license_dice": _licenses_sql(), "op10_weighted_mix": _MIX_SQL}
