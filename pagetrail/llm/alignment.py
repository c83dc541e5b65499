"""Cross-tokenizer alignment.

A byte-level BPE (A) reads a space and the text, a sentencepiece model (B) the text, to which it adds that space itself.
Every byte gets a label: no token ends there, one of A, one of B, or one of both.  A regular expression cuts the labels
into spans that run up to a both-label, and the labels of a span tell how many tokens of A and of B belong to its group.
The two tokens that end with a group are linked.

Both tokenizers end a token before the spaces at which :mod:`pagetrail.llm.chunks` cuts, so that labels, groups and links
are found once per distinct chunk and task, and joined back by position.

How often two ids are linked is counted over all documents.  Of two linked tokens, one's bytes are the end of the other's.
So there are at most as many pairs of ids as the two vocabularies have bytes, times the ids that share one token (two: a
piece and a byte piece): some 500,000 for the default ones, whatever the corpus holds.  This table is gathered and
broadcast; the links themselves stay in the checkpoint folder, four bytes each.

Defined results: null and empty texts have no tokens, nor have texts that either tokenizer doesn't give back byte by byte
(a text with U+2581); such rows have zeros and an empty string; strings of special tokens are plain text; ties of
``n_best`` all count; repeated rows count as often as they stand there; texts are read whole, whatever their length; an
empty table gives no rows; keys may be of any type and may be null, other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.chunks import ChunkTable, Chunks, byte_tokens, default_byte_tokenizer, default_piece_model, pieces
from pagetrail.llm.shared import cut, mapped, slices

NONE, A_END, B_END, BOTH = b"0123"
_SPAN = re.compile(b"[012]*3")


class Tables:
    """What both vocabularies say about an id: its bytes, their number, and how it is written in a list of groups."""

    def __init__(self, a: str, b: str):
        self.a, self.b = byte_tokens(a, True), pieces(b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        # ids of A within a group, the last of it, ids of B within a group, the last of it
        self.written = [b"%d%s" % (i, end) for n, ends in ((n_a, b",|"), (n_b, b",;")) for end in (ends[:1], ends[1:]) for i in range(n)]


@lru_cache(2)
def tables(a: str, b: str) -> Tables:
    return Tables(a, b)


def labels_of(size: int, end_a: np.ndarray, end_b: np.ndarray) -> bytes:
    """One character per byte: 0 none, 1 a token of A ends, 2 one of B, 3 both. Ends are the places behind tokens."""
    out = np.full(size, NONE, np.uint8)
    out[end_a - 1] += A_END - NONE
    out[end_b - 1] += B_END - NONE
    return out.tobytes()


def span_ends(labels: bytes) -> np.ndarray:
    return np.array([m.end() for m in _SPAN.finditer(labels)], np.int64)


def chunk_groups(chunks: list[str], t: Tables) -> list[tuple]:
    """Per chunk (of a text to which a space was added): fits, tokens of A, of B, groups, groups written out, links."""
    ids_a, ids_b = t.a.ids([" " + c for c in chunks]), t.b.ids(chunks)
    want = [b" " + c.encode() for c in chunks]
    fits = [b"".join(map(t.bytes_a.__getitem__, x)) == w == b"".join(map(t.bytes_b.__getitem__, y)) and x != [] for x, y, w in zip(ids_a, ids_b, want, strict=True)]
    flat = lambda ids: np.fromiter((i for x, ok in zip(ids, fits, strict=True) if ok for i in x), np.int64)
    count = lambda ids: np.array([len(x) if ok else 0 for x, ok in zip(ids, fits, strict=True)], np.int64)
    a, b, n_a, n_b = flat(ids_a), flat(ids_b), count(ids_a), count(ids_b)
    end_a, end_b = np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b])
    # a chunk that fits ends with a token of both, so that no span reaches over two chunks
    labels = labels_of(int(end_a[-1]) if len(a) else 0, end_a, end_b)
    ends = span_ends(labels)
    held = np.frombuffer(labels, np.uint8)
    upto_a, upto_b = (np.concatenate([[0], np.cumsum((held == own) | (held == BOTH))])[ends] for own in (A_END, B_END))
    # tokens of A of a group, then those of B: each token's place in this order
    own_a, own_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    code = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[upto_a - 1], last_b[upto_b - 1] = True, True
    code[np.arange(len(a)) + np.repeat(upto_b - own_b, own_a)] = a + last_a * len(t.bytes_a)
    code[np.arange(len(b)) + np.repeat(upto_a, own_b)] = b + last_b * len(t.bytes_b) + 2 * len(t.bytes_a)
    linked = (a[upto_a - 1] * len(t.bytes_b) + b[upto_b - 1]).astype("<u4").tobytes()
    written = list(map(t.written.__getitem__, code.tolist()))
    tokens = pairwise(np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist())
    groups = pairwise(np.searchsorted(upto_a, np.concatenate([[0], np.cumsum(n_a)]), "right").tolist())
    return [(ok, x, y, h - g, b"".join(written[i:j]), linked[4 * g : 4 * h]) for ok, x, y, (i, j), (g, h) in zip(fits, n_a.tolist(), n_b.tolist(), tokens, groups, strict=True)]


def aligned(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, written: bool = False) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, groups_sha256 and links (binary: per link A's id times B's vocabulary plus B's id,
    as unsigned 32-bit numbers). written: also ``groups``, such as ``a1,a2|b1;a3|b2,b3``."""
    paths = a or default_byte_tokenizer(), b or default_piece_model()
    if byte_tokens(paths[0], True).size * pieces(paths[1]).size > 1 << 32:
        raise ValueError("pairs of these vocabularies don't fit into 32 bits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(*paths)
        table = ChunkTable(lambda new: chunk_groups(new, t), 200_000)
        for batch in (s for x in batches for s in slices(x, "t", 2 << 20)):
            texts = [x or "" for x in batch.column("t").to_pylist()]
            chunks = Chunks(texts, not t.b.chunked)
            fits, n_a, n_b, n_groups, groups, links = table.of(chunks.distinct) if texts else [()] * 6
            misfit = chunks.sums(~np.array(fits, bool)) > 0
            counts = [np.where(misfit, 0, chunks.sums(np.array(n, np.int64))) for n in (n_a, n_b, n_groups)]
            data, at = chunks.joined(groups)
            lists = [b"" if bad else data[i : j - 1].tobytes() for (i, j), bad in zip(pairwise(at.tolist()), misfit, strict=True)]
            hashes = [hashlib.sha256(x).hexdigest() if x else "" for x in lists]
            data, at = chunks.joined(links)
            pairs = [b"" if bad else data[i:j].tobytes() for (i, j), bad in zip(pairwise(at.tolist()), misfit, strict=True)]
            columns = [batch.column("k"), *(pa.array(n, pa.int64()) for n in counts), pa.array(hashes, pa.string()), pa.array(pairs, pa.binary())]
            names = ["k", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
            if written:
                columns, names = [*columns, pa.array([x.decode() for x in lists], pa.string())], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return mapped(rows, work, f"k {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + ", groups string" * written).withColumnRenamed("k", key)


def link_counts(rows: DataFrame, b: str | None = None) -> DataFrame:
    """a, b, n: how many links of all rows hold the pair. Summed in each task before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, waiting, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for x in batch.column("links").to_pylist():
                waiting.append(np.frombuffer(x, "<u4"))
                size += len(waiting[-1])
                if size > 4_000_000:
                    codes, n = _added(codes, n, waiting)
                    waiting, size = [], 0
        codes, n = _added(codes, n, waiting)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["code", "n"])

    n_b = pieces(b or default_piece_model()).size
    summed = mapped(rows.select("links"), work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return summed.select(F.expr(f"int(code div {n_b})").alias("a"), F.expr(f"int(code % {n_b})").alias("b"), "n")


def _added(codes: np.ndarray, n: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, count = np.unique(np.concatenate([np.zeros(0, np.uint32), *more]), return_counts=True)
    both, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
    total = np.zeros(len(both), np.int64)
    np.add.at(total, at, np.concatenate([n, count]))
    return both, total


def align_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = cut(aligned(docs, key=key, text=text, a=a, b=b))
    counts = link_counts(rows, b).toPandas()  # bounded by the vocabularies
    n_b = pieces(b or default_piece_model()).size
    code = counts["a"].to_numpy(np.int64) * n_b + counts["b"].to_numpy(np.int64)
    order, n = np.argsort(code), counts["n"].to_numpy(np.int64)
    most = np.zeros(n_b, np.int64)
    np.maximum.at(most, code % n_b, n)
    shipped = docs.sparkSession.sparkContext.broadcast((code[order].astype(np.uint32), n[order], (n == most[code % n_b])[order]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shipped.value
        for batch in (s for x in batches for s in slices(x, "links", 4 << 20)):
            links = [np.frombuffer(x, "<u4") for x in batch.column("links").to_pylist()]
            at = np.cumsum([0, *map(len, links)])
            found = np.searchsorted(codes, np.concatenate([np.zeros(0, np.uint32), *links]))
            sums = (np.concatenate([[0], np.cumsum(x[found])])[at] for x in (best.astype(np.int64), n))
            n_best, count_sum = (np.diff(x) for x in sums)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "n_a", "n_b", "n_groups")), pa.array(np.diff(at)), pa.array(n_best), pa.array(count_sum), batch.column("groups_sha256")], [c.split()[0] for c in names.split(", ")])

    kind = docs.schema[key].dataType.simpleString()
    names = f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return mapped(rows.withColumnRenamed(key, "k"), work, names).withColumnRenamed("k", key)
