"""Lexical retrieval packing.

Documents are tokenised and end with token 0.  Whole windows of a document
become sequences of their own; its rest is packed with the rests of lexically
near documents: a BM25 inverted index over the token ids of whole documents is
cut into shards of near documents, a seed document asks its shard for its
nearest unused neighbours, and these fill the seed's window greedily.  The last
neighbour is cut so that the window is full; what is left of it waits as a
document of its own.

Shards are lexical.  A document has ``PROBES`` keys, minimum hashes of its runs of
``RUN`` tokens, and is put beside those that share one of them: of its keys it
takes the one that most documents hold, as long as these fit into a shard, else
the rarest.  A document that shares no key is put beside those with the same
heaviest BM25 terms.  All are range partitioned in that order and cut into shards
of ``rows_per_shard``; a hash divides larger groups, so that no key or group of
copies meets in one task.  Document frequencies are those of all whole documents.

Defined results: a null text counts as empty, which leaves token 0 alone;
repeated rows are packed as often as they stand there; ties go to the document
that stands first in its shard (by shard key, then by a hash); one partial
sequence per shard may need padding; very long texts are read whole; keys may be
of any type, other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.chunks import byte_tokens, default_byte_tokenizer
from pagetrail.llm.shared import cut, mapped, slices
from pagetrail.llm.words import mix64

WINDOW, END = 1024, 0
MOST_TASKS = 20_000
RUN, PROBES = 8, 16  # powers of two
K1, B = 1.2, 0.75
_PROBE_BITS, _MOST = 40, (1 << 20) - 1


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Token ids of each text, as the plain call of the tokenizer gives them: strings of special tokens are these tokens."""
    return byte_tokens(path, False).of_texts(texts)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def vocabulary_of(path: str) -> int:
    return byte_tokens(path, False).size


def probes(ids: np.ndarray) -> np.ndarray:
    """The least hash of the runs of ``RUN`` tokens (of a shorter document, of all its tokens) in each of ``PROBES`` equal
    ranges of hashes; ranges without a run give none."""
    code = ids.astype(np.uint64) + np.uint64(1)
    step, run = 1, 1
    while run < RUN and len(code) > step:
        code = mix64(code[:-step]) * np.uint64(31) + code[step:]
        step, run = step * 2, run * 2
    code = mix64(code)
    part = (code >> np.uint64(64 - PROBES.bit_length() + 1)).astype(np.intp)
    least, some = np.full(PROBES, np.iinfo(np.uint64).max, np.uint64), np.zeros(PROBES, bool)
    np.minimum.at(least, part, code)
    some[part] = True
    return least[some]


def bag_of(rest: bytes, whole: bytes, width: type) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token ids of a document and their counts: of its rest, unless whole windows stand before that."""
    if not whole:
        return np.unique(np.frombuffer(rest, width), return_counts=True)
    n = len(whole) // (np.dtype(width).itemsize + 4)
    return np.frombuffer(whole, width, n), np.frombuffer(whole, np.uint32, n, n * np.dtype(width).itemsize)


def tokenised(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Per row: key, hash of the text, number of tokens, checksums of whole windows, the ids of the rest, the ids and
    counts of the whole document where it is longer than its rest, and its probes."""
    path = tokenizer or default_byte_tokenizer()
    width = np.uint16 if vocabulary_of(path) <= 1 << 16 else np.uint32

    def row(ids: np.ndarray) -> tuple:
        ids = np.append(ids, np.uint32(END))
        whole = len(ids) // window * window
        crcs = [crc_of_ids(ids[k : k + window]) for k in range(0, whole, window)]
        bag = b""
        if whole:
            held, n = np.unique(ids, return_counts=True)
            bag = held.astype(width).tobytes() + n.astype(np.uint32).tobytes()
        return len(ids), crcs, ids[whole:].astype(width).tobytes(), bag, probes(ids).view(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t", 2 << 20)):
            total, crcs, rests, bags, keys = zip(*map(row, encode(batch.column("t").to_pylist(), path)), strict=True)
            columns = [batch.column("k"), batch.column("h"), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary()), pa.array(bags, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "h", "tokens", "crcs", "rest", "bag", "keys"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), body.alias("t"), F.xxhash64(body).alias("h"))
    return mapped(rows, work, f"k {rows.schema['k'].dataType.simpleString()}, h long, tokens long, crcs array<long>, rest binary, bag binary, keys array<long>")


def document_frequencies(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """Over all whole documents: how many hold each token id, how many there are, and their mean length."""
    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for rest, bag, length in zip(*(batch.column(c).to_pylist() for c in ("rest", "bag", "tokens")), strict=True):
                df[bag_of(rest, bag, width)[0]] += 1
                n, total = n + 1, total + length
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [-1, -2]]), pa.int64()), pa.array(np.concatenate([df[held], [n, total]]), pa.int64())], ["term", "n"])

    # at most one row per token id
    summed = mapped(tokens.select("rest", "bag", "tokens"), work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(vocabulary, np.int64)
    term, n = summed["term"].to_numpy(np.int64), summed["n"].to_numpy(np.int64)
    df[term[term >= 0]] = n[term >= 0]
    count = int(n[term == -1].sum())
    return df, count, float(n[term == -2].sum()) / max(count, 1)


def inverse_frequencies(df: np.ndarray, count: int) -> np.ndarray:
    return np.log1p((count - df + 0.5) / (df + 0.5))


Bag = tuple[np.ndarray, np.ndarray]


class Index:
    """BM25 inverted index over the whole documents of one shard."""

    def __init__(self, bags: list[Bag], idf: np.ndarray, mean: float):
        sizes = np.array([len(ids) for ids, _ in bags], np.int64)
        self.doc_at = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(bags)), sizes)
        self.term = np.concatenate([*(ids for ids, _ in bags), np.zeros(0, np.int64)]).astype(np.int64)
        count = np.concatenate([*(n for _, n in bags), np.zeros(0, np.int64)]).astype(np.int64)
        norm = K1 * (1 - B + B * np.bincount(doc, count, len(bags))[doc] / max(mean, 1e-9))
        weight = idf[self.term] * count * (K1 + 1) / (count + norm)
        order = np.argsort(self.term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.term_at = np.searchsorted(self.term[order], np.arange(len(idf) + 1))
        self.n = len(bags)

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents of the shard for the terms of the seed."""
        terms = self.term[self.doc_at[seed] : self.doc_at[seed + 1]]
        begin, size = self.term_at[terms], self.term_at[terms + 1] - self.term_at[terms]
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        return np.bincount(self.posting_doc[at], self.posting_weight[at], self.n)


def pack(rests: list[int], bags: list[Bag], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """rests: how many tokens of each document wait. Returns sequences of (document, start in its rest, length); the
    longest unused documents are seeds."""
    size, start = np.array(rests, np.int64), np.zeros(len(rests), np.int64)
    index = Index(bags, idf, mean)
    out = []
    for seed in np.argsort(-size, kind="stable").tolist():
        while size[seed]:
            took = int(min(size[seed], window))
            pieces, room = [(seed, int(start[seed]), took)], window - took
            start[seed] += took
            size[seed] -= took
            if room:
                score = index.scores(seed)
                near = np.flatnonzero(size)
                near = near[np.argsort(-score[near], kind="stable")]
                for i in near.tolist():
                    took = int(min(size[i], room))
                    pieces.append((i, int(start[i]), took))
                    start[i] += took
                    size[i] -= took
                    room -= took
                    if not room:
                        break
            out.append(pieces)
    return out


def _heaviest(tokens: DataFrame, idf, mean, width: type) -> DataFrame:
    """row and own: the two heaviest BM25 terms of the document as one number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rest, bag, length in zip(*(batch.column(c).to_pylist() for c in ("rest", "bag", "tokens")), strict=True):
                ids, n = bag_of(rest, bag, width)
                weight = idf.value[ids] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))
                first = int(weight.argmax())
                weight[first] = -1
                out.append(int(ids[first]) << 31 | int(ids[weight.argmax()]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.int64())], ["row", "own"])

    return mapped(tokens.select("row", "rest", "bag", "tokens"), work, "row long, own long")


def shard_keys(tokens: DataFrame, rows_per_shard: int) -> DataFrame:
    """row and shared: of the probes of a document that others hold too, the one of most documents that still fit into a
    shard, else of the fewest."""
    held = tokens.select("row", F.explode("keys").alias("probe"))
    often = held.groupBy("probe").agg(F.count("*").alias("c")).where("c > 1")
    rank = F.when(F.col("c") <= rows_per_shard, F.col("c") + _MOST + 1).otherwise(_MOST - F.least("c", F.lit(_MOST)))
    best = F.max(F.shiftleft(rank, _PROBE_BITS).bitwiseOR(F.col("probe").bitwiseAND(F.lit((1 << _PROBE_BITS) - 1))))
    return held.join(often, "probe").groupBy("row").agg(best.bitwiseAND(F.lit((1 << _PROBE_BITS) - 1)).alias("shared"))


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SEQUENCE_BITS, _SHARD_BITS = 24, 40  # of a sequence id: the sequence in its shard; with the shard in its partition


def pack_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, rows_per_shard: int = 500, shards_per_task: int = 8) -> DataFrame:
    """One row per piece of a document in a sequence. The upper bits of sequence_id name the shard."""
    vocabulary = vocabulary_of(tokenizer or default_byte_tokenizer())
    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    tokens = tokenised(docs, key=key, text=text, tokenizer=tokenizer, window=window)
    tokens = cut(tokens.withColumn("row", F.monotonically_increasing_id()))
    df, count, mean = document_frequencies(tokens, vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(df, count))  # one number per token id
    placed = _heaviest(tokens, shipped, mean, width).join(shard_keys(tokens, rows_per_shard), "row", "left")
    tasks = min(MOST_TASKS, max(1, -(-count // (rows_per_shard * shards_per_task))))  # beyond, a task works off more shards
    dealt = tokens.drop("keys").join(placed, "row").withColumn("salt", F.xxhash64("h", "row"))
    dealt = dealt.repartitionByRange(tasks, "shared", "own", "salt").sortWithinPartitions("shared", "own", "salt")
    key_type = docs.schema[key].dataType.simpleString()

    def finished(shard: int, rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        out, keys, local = [], [], 0
        for k, total, crcs, _, _ in rows:
            for i, crc in enumerate(crcs):
                keys.append(k)
                out.append((i * window, window, crc, total, (shard << _SEQUENCE_BITS) + local, 0))
                local += 1
        rests = [np.frombuffer(r[3], width) for r in rows]
        for pieces in pack([len(r) for r in rests], [bag_of(r[3], r[4], width) for r in rows], shipped.value, mean, window):
            offset = 0
            for i, start, length in pieces:
                k, total, crcs, _, _ = rows[i]
                keys.append(k)
                out.append((len(crcs) * window + start, length, crc_of_ids(rests[i][start : start + length]), total, (shard << _SEQUENCE_BITS) + local, offset))
                offset += length
            local += 1
        names = ["k", *(c.split()[0] for c in _PIECES.split(", "))]
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, kind = TaskContext.get().partitionId() << (_SHARD_BITS - _SEQUENCE_BITS), [], None
        for batch in batches:
            kind = batch.column("k").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "tokens", "crcs", "rest", "bag")), strict=True):
                held.append(row)
                if len(held) == rows_per_shard:
                    yield from finished(shard, held, kind)
                    shard, held = shard + 1, []
        if held:
            yield from finished(shard, held, kind)

    return mapped(dealt.select("k", "tokens", "crcs", "rest", "bag"), work, f"k {key_type}, {_PIECES}").withColumnRenamed("k", key)
