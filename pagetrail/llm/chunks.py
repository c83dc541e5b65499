"""Distinct chunks of many texts, so that a tokenizer sees each of them once per task.

A text is cut before single spaces that stand between two characters that are neither white space nor the marker U+2581.
No token of a byte-level BPE with its usual pattern, and none of a sentencepiece model whose pieces have no marker behind
other characters, reaches over such a place, so that a text's tokens are those of its chunks in turn.  Runs of spaces
stay inside a chunk, and a text without spaces is one chunk.

:class:`Chunks` is the table of a slice of rows: ``distinct`` chunks, and for each position of each text the row of its
chunk.  :class:`ChunkTable` keeps what was made of a chunk for later slices of the task; it forgets all at ``limit``
entries, which changes no result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

_SPACES = bytes(32 if chr(b).isspace() else b for b in range(256))
_LONG_SPACE = b" " * 64
_BLANK, _OTHER, _LETTER, _SIGN = range(4)
#: Kinds of bytes in texts that have no white space but ASCII's.
_KIND = bytes(_BLANK if b in b" \t\n\v\f\r" else _OTHER if b > 126 or b < 32 or chr(b).isdigit() else _LETTER if chr(b).isalpha() else _SIGN for b in range(256))
#: ASCII, Latin letters and signs, dashes and quotes: all of them have been letters, digits, spaces or none of these in every
#: version of Unicode, so that readers with different versions part them alike.
_EASY = re.compile("[\\x00-\\x7e\\u00a1-\\u017f\\u2010-\\u2027]*")
_CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")


class Chunks:
    """distinct: chunks; index: the chunk at each position; text_at: text boundaries in positions."""

    def __init__(self, texts: list[str], whole: bool = False):
        split = [[t] for t in texts] if whole else list(map(_CUT.split, texts))
        self.text_at = np.concatenate([[0], np.cumsum([len(s) for s in split], dtype=np.int64)])
        flat = pa.array([c for s in split for c in s], pa.large_string()).dictionary_encode()
        self.index = flat.indices.to_numpy(zero_copy_only=False)
        self.distinct: list[str] = flat.dictionary.to_pylist()

    def sums(self, of_chunk: np.ndarray) -> np.ndarray:
        """Per text, the sum of a number of its chunks."""
        total = np.concatenate([[0], np.cumsum(of_chunk[self.index], dtype=np.int64)])
        return total[self.text_at[1:]] - total[self.text_at[:-1]]

    def joined(self, of_chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts' chunks in a row, and where each text begins (one more entry for the end)."""
        sizes = np.fromiter(map(len, of_chunk), np.int64, len(of_chunk))
        at = np.concatenate([[0], np.cumsum(sizes)])
        offsets = np.concatenate([[0], np.cumsum(sizes[self.index])])
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of_chunk), [None, pa.py_buffer(at), pa.py_buffer(b"".join(of_chunk))])
        data = held.take(pa.array(self.index)).buffers()[2]
        return np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets[self.text_at]


class ChunkTable:
    """make: from new chunks to one tuple for each."""

    def __init__(self, make: Callable[[list[str]], list[tuple]], limit: int = 300_000):
        self.make, self.limit, self.known = make, limit, {}

    def of(self, chunks: list[str]) -> list[tuple]:
        """One list per field of the tuples."""
        if len(self.known) > self.limit:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        self.known.update(zip(new, self.make(new), strict=True))
        return list(zip(*map(self.known.__getitem__, chunks), strict=True))


def default_byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """Token ids by ``tokenizers``. Short chunks of ASCII, Latin letters and usual signs go through ``tiktoken`` where the file's
    ranks lie beside it: it reads the same vocabulary faster, and on these both know the same letters, digits and white space.

    plain: strings of special tokens in a text are ordinary text.
    """

    SHORT = 200

    def __init__(self, path: str, *, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = plain
        added = [] if plain else [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = _ranked(path)

    @property
    def size(self) -> int:
        return self.exact.get_vocab_size()

    def ids(self, chunks: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.exact.encode_batch_fast(chunks, add_special_tokens=False)]
        easy = [len(c) <= self.SHORT and (c.isascii() or _EASY.fullmatch(c) is not None) and not (self.added and self.added.search(c)) for c in chunks]
        hard = iter(self.exact.encode_batch_fast([c for c, e in zip(chunks, easy, strict=True) if not e], add_special_tokens=False))
        return [self.fast.encode_ordinary(c) if e else next(hard).ids for c, e in zip(chunks, easy, strict=True)]

    def of_text(self, text: str) -> list[int]:
        """The ids of a whole text: at once where the fast reader may have it, else chunk by chunk."""
        if self.fast is None:
            return self.exact.encode(text, add_special_tokens=False).ids
        if self._is_easy(text):
            return self.fast.encode_ordinary(text)
        first, *rest = _CUT.split(text)
        return [i for ids in self.ids([first, *(" " + c for c in rest)]) for i in ids]

    def _is_easy(self, text: str) -> bool:
        """Whether the fast reader may have the whole text."""
        return (text.isascii() or _EASY.fullmatch(text) is not None) and _LONG_SPACE not in text.encode().translate(_SPACES) and not (self.added and self.added.search(text))

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, as :meth:`of_text` gives them. Texts that the fast reader may have are cut into chunks, and
        each distinct chunk of them all is read once."""
        easy = [self.fast is not None and self._is_easy(t) for t in texts]
        together = iter(self._by_distinct_chunks([t.encode() for t, e in zip(texts, easy, strict=True) if e]))
        return [next(together) if e else np.frombuffer(array("I", self.of_text(t)), np.uint32) for t, e in zip(texts, easy, strict=True)]

    def _by_distinct_chunks(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"".join(texts)
        if not data:
            return [np.zeros(0, np.uint32)] * len(texts)
        text_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        kind = np.frombuffer(data.translate(_KIND), np.uint8)
        begins = np.zeros(len(data), bool)
        # a token with a letter ends with its letters, one with any character but white space has white space only in front
        begins[1:] = ((kind[1:] == _BLANK) & (kind[:-1] != _BLANK)) | ((kind[1:] == _SIGN) & (kind[:-1] == _LETTER))
        begins[text_at[:-1][text_at[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(begins), len(data))
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        ids, id_at = self._of_chunks(held.dictionary)
        chunk = held.indices.to_numpy(zero_copy_only=False)
        # ids of all chunks in a row, and where each text begins among them
        flat = pa.LargeListArray.from_arrays(pa.array(id_at), pa.array(ids)).take(held.indices).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum((id_at[1:] - id_at[:-1])[chunk])])[np.searchsorted(at, text_at)]
        return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def _of_chunks(self, chunks: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the chunks in a row, and where each begins. Chunks that begin with a space before another character and end
        with none are read as one text, as no token reaches over such a place; the bytes of its tokens tell them apart."""
        at = np.frombuffer(chunks.buffers()[1], np.int64)[: len(chunks) + 1]
        data = chunks.buffers()[2].to_pybytes()
        solid = np.frombuffer(data.translate(_KIND), np.uint8) != _BLANK
        inner = (at[1:] - at[:-1] > 1) & (np.frombuffer(data, np.uint8)[at[:-1]] == 32) & solid[np.minimum(at[:-1] + 1, at[-1] - 1)] & solid[at[1:] - 1]
        row = chunks.filter(pa.array(inner))
        row_at = np.frombuffer(row.buffers()[1], np.int64)[: len(row) + 1] if len(row) else np.zeros(1, np.int64)
        text = row.buffers()[2].to_pybytes()[: row_at[-1]].decode() if len(row) else ""
        ids = np.frombuffer(array("I", self.fast.encode_ordinary(text)), np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.token_sizes[ids])])
        cut = np.searchsorted(ends, row_at)
        assert np.array_equal(ends[cut], row_at), "a token reaches over the end of a chunk"
        alone = [self.fast.encode_ordinary(c.decode()) for c in chunks.filter(pa.array(~inner)).to_pylist()]
        sizes, order = np.zeros(len(chunks), np.int64), np.argsort(~inner, kind="stable")
        sizes[inner], sizes[~inner] = cut[1:] - cut[:-1], np.fromiter(map(len, alone), np.int64, len(alone))
        held = np.concatenate([ids, np.fromiter((i for a in alone for i in a), np.uint32)])
        # back into the order of the chunks
        begin = np.empty(len(chunks), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        id_at = np.concatenate([[0], np.cumsum(sizes)])
        return held[np.arange(id_at[-1]) + np.repeat(begin - id_at[:-1], sizes)], id_at

    @cached_property
    def token_sizes(self) -> np.ndarray:
        """How many bytes each id has."""
        return np.fromiter(map(len, self.token_bytes()), np.int64, self.size)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; byte-level vocabularies write a byte as a printable character."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        out = [b""] * self.size
        special = {i: t.content for i, t in self.exact.get_added_tokens_decoder().items()}
        for token, i in self.exact.get_vocab().items():
            out[i] = special[i].encode() if i in special else bytes(byte_of[c] for c in token)
        return out


def _ranked(path: str):
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    with open(path, encoding="utf-8") as file:
        kind = json.load(file)
    pre = kind.get("pre_tokenizer") or {}
    if kind.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def byte_tokens(path: str, plain: bool) -> ByteTokens:
    return ByteTokens(path, plain=plain)


class Pieces:
    """A sentencepiece model. ``chunked`` tells that a text may be cut: no piece has a marker behind other characters, and the
    model keeps texts as they are but for markers."""

    TOGETHER = 32

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        odd = "ﬁ a  Ω　\tb\n é "
        kept = self.model.normalize(odd) == "▁" + odd.replace(" ", "▁")
        self.chunked = kept and not any(re.search("[^▁]▁", p) for p in self.pieces)
        self.leads = [p.startswith("▁") for p in self.pieces]

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Chunks without spaces are read 32 in a row, and told apart by the piece that begins with a marker."""
        if not self.chunked:
            return self.model.encode(chunks, num_threads=1)
        out: list[list[int]] = []
        simple = [c for c in chunks if c and " " not in c and "▁" not in c]
        rest = iter(self.model.encode([c for c in chunks if not (c and " " not in c and "▁" not in c)], num_threads=1))
        leads, told = self.leads, []
        for ids in self.model.encode([" ".join(simple[i : i + self.TOGETHER]) for i in range(0, len(simple), self.TOGETHER)], num_threads=1):
            at = [i for i, x in enumerate(ids) if leads[x]]
            told += [ids[a:b] for a, b in zip(at, [*at[1:], len(ids)], strict=True)]
        one = iter(told)
        for c in chunks:
            out.append(next(one) if c and " " not in c and "▁" not in c else next(rest))
        return out

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: of pieces, with U+2581 as a space, or the byte that a piece stands for."""
        model = self.model
        return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)
