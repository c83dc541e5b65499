"""Quality classifier: supervised subword embeddings.

Every word has a hashed vector and so has each of its character n-grams; a word is
the mean of these.  Pairs of neighbouring words have hashed vectors, too.  A
document is the mean of its words and pairs, and a softmax layer gives the
class.  Vectors and layer are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows.  Once trained, vectors times layer
is one table of class scores per bucket, which is what tasks receive.

Defined results: a null or wordless text scores by the prior of the labels
alone; repeated rows score alike; with one class only, that class is certain;
with no labelled row the score is 0.5; of repeated labels of a key the least, of
repeated texts the one that sorts first is learned; an empty table gives no rows;
keys may be of any type, other columns don't matter.  Whole texts are read,
however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.shared import mapped, slices, uniform
from pagetrail.llm.words import Words, mix64, windows

NGRAMS = (3, 4, 5)


def pair_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each pair of neighbouring words, its text, and text boundaries in pairs."""
    pairs, owner, at = windows(words.hashes(), words.word_at, 2)
    return (pairs % np.uint64(buckets)).astype(np.int64), owner, at


def word_features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: the index of each word of the texts, and for the distinct words the flat
    (word, bucket) features with the number of features of each distinct word."""
    hashes = words.hashes()
    _, pick, index = np.unique(hashes, return_index=True, return_inverse=True)
    char = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))  # where characters begin
    head, tail = np.searchsorted(char, words.start[pick]), np.searchsorted(char, words.end[pick])
    owner, begin, end = [np.arange(len(pick))], [], []
    for n in NGRAMS:
        count = np.maximum(tail - head - n + 1, 0)
        who = np.repeat(np.arange(len(pick)), count)
        first = head[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        owner.append(who)
        begin.append(char[first])
        end.append(char[first + n])
    grams = mix64(words.span_hashes(np.concatenate(begin), np.concatenate(end)) + np.uint64(1))  # apart from the words' own
    bucket = (np.concatenate([hashes[pick], grams]) % np.uint64(buckets)).astype(np.int64)
    owner = np.concatenate(owner)
    return index, owner, bucket, np.bincount(owner, minlength=len(pick))


@dataclass
class QualityModel:
    table: np.ndarray  # class scores of each bucket
    bias: np.ndarray
    classes: list[int]

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Of every class, for each text."""
        words = Words.of(column)
        n, k = len(column), len(self.classes)
        total = np.zeros((n, k))
        if len(words.start):
            index, owner, bucket, size = word_features(words, len(self.table))
            pair, pair_owner, pair_at = pair_buckets(words, len(self.table))
            counts = words.counts + np.diff(pair_at)
            for c in range(k):
                word_score = np.bincount(owner, self.table[bucket, c], len(size)) / size
                total[:, c] = np.bincount(words.owner, word_score[index], n) + np.bincount(pair_owner, self.table[pair, c], n)
            total /= np.maximum(counts, 1)[:, None]
        total += self.bias
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)


def fit(texts: list[str | None], labels: np.ndarray, priors: dict[int, float], *, buckets: int = 1 << 19, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 5) -> QualityModel:
    """priors: the share of each class among all labelled rows; the sample may be balanced otherwise."""
    classes = sorted(priors)
    share = np.array([priors[c] for c in classes])
    if len(classes) < 2:
        return QualityModel(np.zeros((buckets, len(classes)), np.float32), np.zeros(len(classes)), classes)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    target = np.searchsorted(classes, labels)
    words = Words.of(pa.array(texts, pa.string()))
    index, owner, bucket, size = word_features(words, buckets)
    order = np.argsort(owner, kind="stable")
    bucket, first = bucket[order], np.concatenate([[0], np.cumsum(size)])
    pair, _, pair_at = pair_buckets(words, buckets)
    docs = []
    for i in range(len(texts)):
        own, n = np.unique(index[words.word_at[i] : words.word_at[i + 1]], return_counts=True)
        if not len(own):
            continue
        reps = size[own]
        at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[own], reps)
        two, times = np.unique(pair[pair_at[i] : pair_at[i + 1]], return_counts=True)
        total = n.sum() + times.sum()
        weight = np.concatenate([np.repeat(n / total / reps, reps), times / total]).astype(np.float32)
        docs.append((np.concatenate([bucket[at], two]).astype(np.int32), weight, target[i]))
    steps, done = epochs * max(len(docs), 1), 0
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            ids, weight, y = docs[d]
            step = rate * (1 - done / steps)
            done += 1
            hidden = weight @ vectors[ids]
            score = hidden @ layer + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= step * np.outer(hidden, p)
            bias -= step * p
            np.subtract.at(vectors, ids, (len(ids) ** 0.5 * step * weight)[:, None] * back)
    drawn = np.bincount(target, minlength=len(classes)) / len(target)
    correction = np.log(np.maximum(share, 1e-9)) - np.log(np.maximum(drawn, 1e-9))
    return QualityModel((vectors @ layer).astype(np.float32), bias + correction, classes)


def train_labelled(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1000, seed: int = 23, **options) -> QualityModel:
    """Train on a bounded sample of labelled rows: ``per_class`` documents of each class are expected, drawn by a hash
    of the key.  Only the sample's texts leave the scan."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], np.zeros(0, int), {})
    share = F.lit(1.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    drawn = known.where(uniform("k", seed=seed) < share)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    # per_class keys of each class, and one text of each
    sample = texts.join(F.broadcast(drawn), "k").groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).toPandas()
    sample = sample.sort_values(["k", "t"], kind="stable", na_position="first")
    total = sum(sizes.values())
    return fit(sample["t"].tolist(), sample["y"].to_numpy(int), {y: n / total for y, n in sizes.items()}, **options)


def score_quality(docs: DataFrame, model: QualityModel, *, key: str = "doc_id", text: str = "text", positive: int = 1) -> DataFrame:
    """The probability of the positive class for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in (s for b in batches for s in slices(b, "t")):
            if positive in m.classes:
                p = m.probabilities(batch.column("t"))[:, m.classes.index(positive)]
            else:
                p = np.full(batch.num_rows, 0.0 if m.classes else 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(p, pa.float64())], ["k", "score"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return mapped(rows, work, f"k {rows.schema['k'].dataType.simpleString()}, score double").withColumnRenamed("k", key)
