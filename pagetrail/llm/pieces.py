"""SentencePiece encoding and decoding by a table of distinct chunks.

Where pieces can't cross white space markers, a text's ids are those of its marked words in turn.  Each slice of rows
becomes a table of distinct chunks (:mod:`pagetrail.llm.chunks`) and the row of that table at each position; a chunk is
segmented and decoded once per task, and ids and decoded bytes are joined back by position with one ``take``.  A model
whose pieces cross markers, or that changes texts before it segments them, gets whole texts as chunks, so that results
are the library's for any model.

One pass without a shuffle: a table over the whole corpus would send each block's distinct chunks out and their ids back,
which is more than the texts themselves.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows are encoded as often as they
stand there; texts are read whole, whatever their length; there are no ties; an empty table gives no rows; keys may be of
any type and may be null, other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.chunks import ChunkTable, Chunks, default_piece_model, pieces
from pagetrail.llm.shared import mapped, slices


def encoded(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per row: the key, ``ids`` (array of int) and ``decoded``, the text that these ids give again."""
    path = model or default_piece_model()

    def made(new: list[str]) -> list[tuple[bytes, bytes]]:
        of = pieces(path)
        ids = of.ids(new)
        back = of.model.decode(ids, num_threads=1) if new else []
        return [(np.array(i, "<i4").tobytes(), b" " * bool(i) + b.encode()) for i, b in zip(ids, back, strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, whole = ChunkTable(made), not pieces(path).chunked
        for batch in (s for b in batches for s in slices(b, "t", 4 << 20)):
            chunks = Chunks([t or "" for t in batch.column("t").to_pylist()], whole)
            ids, back = table.of(chunks.distinct)
            data, at = chunks.joined(ids)
            ids = pa.ListArray.from_arrays(pa.array(at // 4, pa.int32()), pa.array(data.view("<i4")))
            data, at = chunks.joined(back)
            keep = np.ones(len(data), bool)
            keep[at[:-1][at[:-1] < at[1:]]] = False  # the space that a text's first chunk has for its marker
            left = np.concatenate([[0], np.cumsum(keep)])[at]
            back = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[keep].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), ids, back], ["k", "ids", "decoded"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return mapped(rows, work, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("k", key)


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of ids and checksums of an encoded table."""
    return rows.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
