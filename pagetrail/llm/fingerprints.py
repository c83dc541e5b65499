"""Document fingerprints by consistent weighted sampling.

A document is the bag of its words, each weighted by its count.  For every
sample each term gets two gamma variates and a uniform one from hashes of the
term; with them the term's weight is quantised on a logarithmic grid, and the
term with the least sampling value is drawn together with its grid cell.  Two
documents draw the same (term, cell) with a probability equal to the
generalised Jaccard similarity sum(min) / sum(max) of their weights.  A
fingerprint holds 16 bits of each of ``SAMPLES`` draws.

Defined results: null texts count as empty; wordless texts share one constant
fingerprint, so they are alike (1.0) among themselves and unlike all others; of
terms with an equal sampling value the first in hash order is drawn; equal texts
and repeated rows have equal fingerprints; keys may be of any type that can be
ordered, null keys stand first; other columns don't matter; an empty table gives
no rows.  Whole texts are read, however long.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.shared import mapped, slices, uniform
from pagetrail.llm.words import Words, mix64
from pagetrail.shipping import ensure_shipped

SAMPLES = 128
_EMPTY = np.zeros(SAMPLES, np.uint16)
_SLICE = 2 << 20
_TERMS_AT_ONCE = 1024  # keeps the working arrays in cache
_SALTS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_24 = np.uint64(0xFFFFFF)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 24 bits."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def _sampling_values(terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of each term's sampling value, and the 16 bits that the draw would leave.

    Five uniform numbers of 24 bits come from two hashes of the term and the sample.
    """
    value = np.empty((len(terms), SAMPLES), np.float32)
    code = np.empty((len(terms), SAMPLES), np.uint16)
    log_weight = np.log(weight).astype(np.float32)
    for k in range(0, len(terms), _TERMS_AT_ONCE):
        part = slice(k, k + _TERMS_AT_ONCE)
        one = terms[part, None] ^ _SALTS
        one *= np.uint64(0xD6E8FEB86659FD93)
        one ^= one >> np.uint64(32)
        one *= np.uint64(0x9E3779B97F4A7C15)
        one ^= one >> np.uint64(29)
        two = one * np.uint64(0xC2B2AE3D27D4EB4F)
        two ^= two >> np.uint64(31)
        r = -np.log(_uniform(one >> np.uint64(40)) * _uniform((one >> np.uint64(16)) & _24))
        c = -np.log(_uniform(two >> np.uint64(40)) * _uniform((two >> np.uint64(16)) & _24))
        shift = _uniform((((one & np.uint64(0xFFFF)) << np.uint64(8)) | (two & np.uint64(0xFF))))
        cell = np.floor(log_weight[part, None] / r + shift)
        value[part] = np.log(c) - r * (cell - shift) - r
        two += cell.astype(np.int64).view(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        two *= np.uint64(0xD6E8FEB86659FD93)
        code[part] = two >> np.uint64(48)
    return value, code


def fingerprints(column: pa.Array) -> np.ndarray:
    """16-bit draws of each text, as rows."""
    words = Words.of(column)
    n, hashes, owner = len(column), words.hashes(), words.owner
    out = np.tile(_EMPTY, (n, 1))
    if not len(hashes):
        return out
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    weight = np.diff(np.append(first, len(h)))
    h, o = h[first], o[first]
    pairs, index = np.unique(h ^ mix64(weight.astype(np.uint64)), return_inverse=True)  # a term with its weight
    pick = np.zeros(len(pairs), np.int64)
    pick[index] = np.arange(len(index))
    value, code = _sampling_values(h[pick], weight[pick])
    at = np.searchsorted(o, np.arange(n + 1))
    column_of = np.arange(SAMPLES)
    for i in np.flatnonzero(np.diff(at)):
        own = index[at[i] : at[i + 1]]
        out[i] = code[own[value[own].argmin(0)], column_of]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal draws, by row."""
    return (a == b).mean(1)


def _written(prints: np.ndarray) -> list[str]:
    """Each fingerprint as base64 of its big-endian draws."""
    return [base64.b64encode(row.tobytes()).decode() for row in prints.astype(">u2")]


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the fingerprint of every row; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t", _SLICE)):
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(_written(fingerprints(batch.column("t"))), pa.string())], ["k", "fingerprint"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return mapped(rows, work, f"k {rows.schema['k'].dataType.simpleString()}, fingerprint string").withColumnRenamed("k", key)


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _bounds(rows: DataFrame, bytes_per_range: int, least_ranges: int) -> list:
    """Keys that occur, at which ranges of about so many bytes begin, but for the first range. About ten sampled keys per
    range reach the driver."""
    seen = rows.agg(F.sum(F.octet_length("t") + 64).alias("bytes"), F.count("*").alias("n")).first()
    ranges = max(least_ranges, -(-(seen["bytes"] or 0) // bytes_per_range))
    share = min(1.0, 10 * ranges / max(seen["n"], 1))
    held = sorted(r["k"] for r in rows.where(F.col("k").isNotNull() & (uniform("k", seed=17) < share)).select("k").collect())
    return sorted({held[i * len(held) // ranges] for i in range(1, ranges)}) if held else []


def fingerprint_with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bytes_per_range: int = 128 << 20, least_ranges: int = 256) -> DataFrame:
    """Fingerprints of each document and of its edit with the following document in key order, null keys first.

    Documents are put into ranges of the key, by binary search among bounds, which are keys that occur; the documents at
    a bound also go to the range before it, and those of the least key to the last range, so that every document meets its
    successor without a global sort.  Of rows with equal keys the order is that of their texts.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    bounds = _bounds(rows, bytes_per_range, least_ranges)
    least = rows.agg(F.min(F.struct(F.col("k").isNotNull().alias("known"), "k")).alias("least")).first()["least"]
    shipped = docs.sparkSession.sparkContext.broadcast(bounds)  # one key per range

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        """Twice the range of a key, and one more if the key is a bound."""
        listed = shipped.value
        right = [bisect_right(listed, x) for x in k.tolist()]
        return pd.Series([2 * r + (r > 0 and listed[r - 1] == x) for r, x in zip(right, k.tolist(), strict=True)], dtype="int32")

    ensure_shipped(docs.sparkSession)
    at, is_bound = F.shiftright("p", 1), F.col("p") % 2 == 1
    own, ahead = F.struct(at.alias("at"), F.lit(0).alias("role")), F.struct((at - 1).alias("at"), F.lit(1).alias("role"))
    # at a bound: also the range before; the least key: also the last range, as the successor of the last document
    spread = F.when(is_bound, F.array(own, ahead)).otherwise(F.array(own))
    first = F.lit(None).cast(rows.schema["k"].dataType) if least is None or least["k"] is None else F.lit(least["k"])
    spread = F.when(F.col("k").eqNullSafe(first), F.concat(spread, F.array(F.struct(F.lit(len(bounds)).alias("at"), F.lit(2).alias("role"))))).otherwise(spread)
    rows, ranges = rows.withColumn("p", F.when(F.col("k").isNull(), 0).otherwise(place(F.coalesce("k", F.lit(bounds[0])))) if bounds else F.lit(0)), len(bounds) + 1
    key_type = rows.schema["k"].dataType.simpleString()
    dealt = rows.select("k", "t", F.explode(spread).alias("x")).select(F.col("x.at").alias("at"), F.col("x.role").alias("role"), "k", "t")
    dealt = dealt.repartition(ranges, "at").sortWithinPartitions("at", "role", "k", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range that wait for their successors

        kind = None

        def done(ready: list[tuple], after: tuple | None) -> pa.RecordBatch:
            """ready: documents; after: the one behind the last of them."""
            texts = [r[3] for r in ready]
            following = [*texts[1:], after[3] if after else texts[0]]
            edits = [_edited(a, b) for a, b in zip(texts, following, strict=True)]
            every = fingerprints(pa.array([*texts, following[-1], *edits], pa.string()))  # they share most terms
            own, changed = every[: len(texts) + 1], every[len(texts) + 1 :]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r in ready], kind),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                    pa.array(_written(own[:-1]), pa.string()),
                    pa.array(_written(changed), pa.string()),
                    pa.array(likeness(own[:-1], changed), pa.float64()),
                    pa.array(likeness(own[:-1], own[1:]), pa.float64()),
                ],
                ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        def closed(last: list[tuple]) -> Iterator[pa.RecordBatch]:
            """A range is complete: its first row of role 1 or else 2 follows its last document."""
            own = [r for r in last if r[1] == 0]
            after = next((r for r in last if r[1] == 1), None) or next((r for r in last if r[1] == 2), None)
            if own:
                yield done(own, after)

        size = 0
        for batch in (s for b in batches for s in slices(b, "t", _SLICE)):
            kind = batch.column("k").type
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if held and row[0] != held[-1][0]:
                    yield from closed(held)
                    held, size = [], 0
                if row[1] == 0 and size > _SLICE:
                    yield done(held, row)
                    held, size = [], 0
                if row[1] == 0 or not held or held[-1][1] != row[1]:
                    held.append(row)  # of rows with another role only the first counts
                    size += len(row[3])
        if held:
            yield from closed(held)

    out = mapped(dealt, work, f"k {key_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("k", key)
