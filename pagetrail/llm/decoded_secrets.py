"""Secret scanning through nested encodings.

A text is the first layer of a worklist.  Every layer is scanned; then its URL
escapes, Unicode escapes and base64 runs (whose bytes may be compressed) are
unwrapped into further layers, until no new layer appears.  A base64 run goes
on over line ends and is read at all four alignments of its letters.  Layers that were
seen before are not entered again, which also ends cycles of self-reproducing
archives.  Every character of a layer knows the span of the text that it came
from, so that a finding deep inside maps back to the text.

Bytes of base64 and compressed layers stand for the characters of their codes,
whatever they are: all that is looked for is ASCII, which every encoding but the
wide ones has in place.  A layer with NULs is also read without them, for UTF-16
and UTF-32.

Compressed data is found by what it starts with, anywhere in bytes: gzip, bz2, xz,
lzma, zlib with any window, and deflated members of ZIP archives.  Bare deflate
streams have no such start and count where they fill a base64 run or a stream.  What
inflates is a stream that is opened anew from where it begins, however deep, and
read in chunks of ``CHUNK_BYTES`` that overlap, each a layer of its own; what goes
on behind a chunk, base64 runs or further compressed data, is a stream as well.

Defined results: a null text counts as empty; an empty text has no spans.
Positions are code points, ends are exclusive.  Of spans with one place and kind
the shallowest is kept.  Repeated rows give repeated results; an empty table gives
no rows; texts are read whole, however long; keys may be of any type and other
columns may have any name.  There is no limit of depth.  A text whose streams hold
more than ``MOST_BYTES`` in all (an archive that grows without end) is not read to
their end: it is reported as unfinished, and such streams are masked as a whole.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.shared import mapped, slices

KINDS = ("assign", "access", "hex")
CHUNK_BYTES = 1 << 22
MOST_BYTES = 1 << 32
_OVERLAP, _PIECE, _FED = 1 << 16, 1 << 20, 256
_LEAST = 12  # bytes of the shortest secret

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_UNICODE = re.compile(rf"(?:{_ESCAPE.pattern})+")
#: A line end inside a base64 run, also a written one, with quotes, indents and comment signs around it.
_BREAK = r"""["'\x20\t]*(?:\\?\r*\n|\\?\r|(?:\\r)?\\n)["'\x20\t>\#*|]*"""
_BREAKS = re.compile(_BREAK)
#: A run with its further lines, or a run within a line. 16 letters hold the shortest secret.
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++(?:{_BREAK}[A-Za-z0-9+/_-]++)+|[A-Za-z0-9+/_-]{{16,}}+)={{0,2}}")
_RUN_LETTERS = 16
_LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
_RUN_ENDS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_BREAK_ENDS = " \t\r\n\"'>#*|\\"
#: Wide characters in a row.
_WIDE = re.compile("(?:[\x09-\x7e]\0{1,3}){8}")
_BREAK_LETTERS = 512
_ZLIB_HEADS = b"".join(bytes([first, second]) for first in range(0x08, 0x80, 0x10) for second in range(256) if (first * 256 + second) % 31 == 0 and not second & 32)
#: What starts compressed data: gzip, bz2, xz, lzma, zlib with any window, and a member of a ZIP archive.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x5d\x00\x00|PK\x03\x04|" + b"|".join(re.escape(_ZLIB_HEADS[i : i + 2]) for i in range(0, len(_ZLIB_HEADS), 2)))


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    depth: int
    via: str


class Layer(NamedTuple):
    """begin, end: where each character comes from; None: it is the text itself. cut: places in whose base64 runs, which go
    on in other chunks, are streams of their own."""

    text: str
    begin: np.ndarray | None
    end: np.ndarray | None
    via: tuple[str, ...]
    cut: tuple[int, ...] = ()

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.begin is None else (int(self.begin[start]), int(self.end[end - 1]))


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of one layer, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def _characters(raw: bytes) -> Iterator[tuple[str, int]]:
    """Characters of bytes with the bytes that each takes; bytes that aren't UTF-8 stand for themselves."""
    try:
        for ch in raw.decode("utf-8"):
            yield ch, len(ch.encode("utf-8"))
    except UnicodeDecodeError:
        for b in raw:
            yield chr(b), 1


def _rewritten(layer: Layer, matches: list[re.Match], decode, via: str) -> Layer:
    """The layer with matches replaced by what they stand for. decode: gives characters and their source widths."""
    parts, begins, ends, at = [], [], [], 0
    source_begin = np.arange(len(layer.text)) if layer.begin is None else layer.begin
    source_end = np.arange(1, len(layer.text) + 1) if layer.end is None else layer.end
    for m in matches:
        parts.append(layer.text[at : m.start()])
        begins.append(source_begin[at : m.start()])
        ends.append(source_end[at : m.start()])
        chars, widths = zip(*decode(m), strict=True)
        stop = m.start() + np.cumsum(widths)
        parts += chars
        begins.append(source_begin[stop - widths])
        ends.append(source_end[stop - 1])
        at = m.end()
    parts.append(layer.text[at:])
    begins.append(source_begin[at:])
    ends.append(source_end[at:])
    return Layer("".join(parts), np.concatenate(begins), np.concatenate(ends), (*layer.via, via))


def _from_url(m: re.Match) -> Iterator[tuple[str, int]]:
    for ch, n in _characters(bytes.fromhex(m[0].replace("%", ""))):
        yield ch, 3 * n


def _from_unicode(run: re.Match) -> Iterator[tuple[str, int]]:
    for m in _ESCAPE.finditer(run[0]):
        digits = m[0].strip("\\uUx&#;{}")
        code = int(digits, 10 if m[0][0] == "&" and m[0][2] != "x" else 16)
        yield chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", len(m[0])


class Stream(NamedTuple):
    """Bytes that can be read again and again. begin, end: the span of the text that they come from."""

    open: Callable[[], Iterator[bytes]]
    begin: int
    end: int
    via: tuple[str, ...]


class Found(NamedTuple):
    """All streams inside a part of a layer."""

    streams: Iterator[Stream]


def _opened(head: bytes):
    """A decompressor for data that starts so, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0" or head[:3] == b"\x5d\0\0":
        return lzma.LZMADecompressor()
    if len(head) > 2 and head[0] & 15 == 8 and head[0] < 128 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    return None


def _member(head: bytes) -> int:
    """Where the deflated data of a member of a ZIP archive begins, from its local head; 0 if this is none."""
    if len(head) < 30 or head[:4] != b"PK\x03\x04" or head[8:10] != b"\x08\x00":
        return 0
    return 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def _inflated(pieces: Iterator[bytes], at: list[int] | None = None, bare: bool = False) -> Iterator[bytes]:
    """What compressed data holds, in pieces, over all members that follow each other; of broken data what comes before.

    at: its items are set to where the last whole member ends, and to whether the data is broken behind it. bare: the data
    is one deflate stream."""
    worker, data, read = zlib.decompressobj(-15) if bare else None, b"", 0
    more = iter(pieces)
    ended, is_zlib = False, bare
    while True:
        if worker is None:
            if bare:
                return
            while not ended and len(data) < 8:
                piece = next(more, None)
                ended = piece is None
                data += piece or b""
            if read and data[:1] == b"\0":  # padding between members
                short = data.lstrip(b"\0")
                read += len(data) - len(short)
                data = short
                continue
            if (worker := _opened(data[:8])) is None:
                return
            is_zlib = not hasattr(worker, "needs_input")
        elif not data and not ended:
            data = next(more, b"")
            ended = not data
        fed, data = data[:_FED], data[_FED:]
        read += len(fed)
        try:
            out = worker.decompress(fed, _PIECE)
            while out or (is_zlib and worker.unconsumed_tail):
                if out:
                    yield out
                if worker.eof or len(out) < _PIECE and not (is_zlib and worker.unconsumed_tail):
                    break
                out = worker.decompress(worker.unconsumed_tail if is_zlib else b"", _PIECE)
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
            if at is not None:
                at[1] = 1
            return
        if worker.eof:
            read -= len(worker.unused_data)
            data, worker = worker.unused_data + data, None
            if at is not None:
                at[0] = read
        elif not data:
            data = next(more, b"")
            if not data:
                return


def _fed(raw: bytes, start: int) -> Iterator[bytes]:
    for i in range(start, len(raw), 1 << 16):
        yield raw[i : i + (1 << 16)]


def _behind(pieces: Iterator[bytes], skip: int) -> Iterator[bytes]:
    """The pieces from a place on."""
    for piece in pieces:
        if skip < len(piece):
            yield piece[skip:]
        skip = max(skip - len(piece), 0)


def _chunks(pieces: Iterator[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """Pieces put together, with their place and whether more follow. Each chunk begins in the end of the one before."""
    held, place = bytearray(), 0
    for piece in pieces:
        while len(held) >= CHUNK_BYTES:
            yield place, bytes(held), True
            place += len(held) - _OVERLAP
            del held[:-_OVERLAP]
        held += piece
    if held:
        yield place, bytes(held), False


def _decoding(raw: bytes, start: int, bare: bool) -> tuple[int, bool, int]:
    """How many bytes from start are whole compressed members, whether what follows is broken, and how much inflates."""
    at = [0, 0]
    size = sum(map(len, _inflated(_fed(raw, start), at, bare)))
    return at[0], bool(at[1]), size


def _compressed(raw: bytes, place: Callable[[int, int], tuple[int, int]], via: tuple[str, ...], longer: Stream | None = None, at: int = 0, known: set[int] | None = None) -> Iterator[Stream]:
    """The streams of all compressed data in raw. place: the span of the text for a range of raw. longer: raw is a chunk of
    it, at that place, and the data may go on; known: where in it streams were found."""
    starts = [0] if _opened(raw[:8]) else []
    starts += [m.start() for m in _MAGIC.finditer(raw) if m.start() or not starts]
    known = set() if known is None else known
    done = max([0, *(k - at for k in known)])
    for start in starts:
        bare = raw[start : start + 4] == b"PK\x03\x04"
        start += _member(raw[start : start + 30]) if bare else 0
        if start < done or at + start in known:
            continue
        whole, broken, size = _decoding(raw, start, bare)
        if size < _LEAST:
            continue
        inner = (*via, "compressed")
        if whole or broken or longer is None:
            done = start + whole
            yield Stream(lambda start=start, bare=bare: _inflated(_fed(raw, start), None, bare), *place(start, done if whole else len(raw)), inner)
        else:
            yield Stream(lambda start=start, bare=bare: _inflated(_behind(longer.open(), at + start), None, bare), *place(start, len(raw)), inner)
        known.add(at + start)


def _letters(pieces: Iterator[bytes]) -> Iterator[str]:
    """The letters of a base64 run, over its line ends, until it ends."""
    text, more = "", iter(pieces)
    ended = False
    while True:
        at = 0
        while True:
            if m := _LETTERS.match(text, at):
                yield m[0]
                at = m.end()
            b = _BREAKS.match(text, at)
            if b and b.end() < len(text) and _LETTERS.match(text, b.end()):
                at = b.end()
                continue
            break
        text = text[at:]
        if ended or len(text) > _BREAK_LETTERS:
            return
        piece = next(more, b"")
        ended = not piece
        text += piece.decode("latin-1")


def _of_letters(letters: Iterator[str], skip: int) -> Iterator[bytes]:
    """The bytes of a base64 run, less the first letters."""
    held, n = [], 0
    for part in letters:
        held.append(part[skip:])
        skip = max(skip - len(part), 0)
        n += len(held[-1])
        if n >= 1 << 16:
            text = "".join(held)
            whole = len(text) // 4 * 4
            yield _decoded(text[:whole]) or b""
            held, n = [text[whole:]], len(text) - whole
    yield _decoded("".join(held)) or b""


def _read(stream: Stream, state: _State) -> Iterator[Layer | Stream]:
    """The chunks of a stream as layers, and the streams inside them."""
    known: set[int] = set()
    span = stream.begin, stream.end
    before, goes_on = 0, False  # where the last chunk ended, and whether in a run
    for at, chunk, more in _chunks(stream.open()):
        if not state.may_read(len(chunk), span):
            return
        text = chunk.decode("latin-1")
        start = _open_run(text) if more else len(text)
        same = goes_on and at + start <= before
        cuts = (before - at,) * goes_on + (len(text),) * more
        layer = Layer(text, np.broadcast_to(stream.begin, len(chunk)), np.broadcast_to(stream.end, len(chunk)), stream.via, cuts)
        before, goes_on = at + len(text), start < len(text)
        if state.is_new(layer):
            yield layer
            yield from _compressed(chunk, lambda *_: span, stream.via, stream, at, known)
            if goes_on and not same:
                yield from _runs(stream, at + start)
    if _is_deflated(stream.open):
        yield Stream(lambda: _inflated(stream.open(), None, True), *span, (*stream.via, "compressed"))


def _open_run(text: str) -> int:
    """Where the base64 run begins that may go on behind the text; its length if there is none."""
    tail = len(text.rstrip(_RUN_ENDS + _BREAK_ENDS))
    last = None
    for last in _BASE64.finditer(text, tail):
        pass
    return last.start() if last and not text[last.end() :].strip(_BREAK_ENDS) else len(text)


def _runs(stream: Stream, start: int) -> Iterator[Stream]:
    """A base64 run that goes on behind a chunk, at each alignment."""
    for skip in range(4):
        opened = lambda skip=skip: _of_letters(_letters(_behind(stream.open(), start)), skip)
        yield Stream(opened, stream.begin, stream.end, (*stream.via, "base64"))


def _leads_on(text: str) -> bool:
    """Whether a layer has findings or layers below it."""
    return bool(_WIDE.search(text) or plain_spans(text) or _URL.search(text) or _UNICODE.search(text) or _BASE64.search(text))


def _from_base64(layer: Layer, m: re.Match) -> Iterator[Layer | Found]:
    """The layers inside a base64 run, compressed or not, at each of the four alignments, as other letters may stand before it."""
    run = m[0].rstrip("=")
    breaks = [(0, 0), *(x.span() for x in _BREAKS.finditer(run)), (len(run), len(run))]
    lines = [(a, b) for (_, a), (b, _) in zip(breaks, breaks[1:], strict=False)]
    letters = "".join(run[a:b] for a, b in lines)
    if len(letters) < _RUN_LETTERS:
        return
    at = m.start() + np.concatenate([np.arange(a, b) for a, b in lines])
    for skip in range(min(4, len(letters) - _RUN_LETTERS + 1)):
        if (raw := _decoded(letters[skip:])) is not None:
            yield from _of_bytes(layer, raw, at[skip:], m.end())


def _decoded(letters: str) -> bytes | None:
    """The bytes of base64 letters in either alphabet; a last letter that completes no byte is left out."""
    letters = letters.replace("-", "+").replace("_", "/")
    letters = letters[: len(letters) - (len(letters) % 4 == 1)]
    try:
        return binascii.a2b_base64(letters + "=" * (-len(letters) % 4))
    except binascii.Error:
        return None


def _of_bytes(layer: Layer, raw: bytes, at: np.ndarray, end: int) -> Iterator[Layer | Found]:
    """The layers of the bytes that letters decode to. at: where the letters stand in the layer; end: where their run ends."""
    via = (*layer.via, "base64")
    text = raw.decode("latin-1")
    if _leads_on(text):
        byte = np.arange(len(raw))
        first, last = at[byte * 8 // 6], at[(byte * 8 + 7) // 6]
        yield Layer(text, first if layer.begin is None else layer.begin[first], last + 1 if layer.end is None else layer.end[last], via)

    def place(start: int, stop: int) -> tuple[int, int]:
        last = (stop * 8 + 5) // 6
        return layer.span(int(at[start * 8 // 6]), end if stop == len(raw) or last >= len(at) else int(at[last - 1]) + 1)

    if _opened(raw[:8]) or _MAGIC.search(raw):
        yield Found(_compressed(raw, place, via))
    if _is_deflated(lambda: _fed(raw, 0)):
        yield Found(iter([Stream(lambda: _inflated(_fed(raw, 0), None, True), *place(0, len(raw)), (*via, "compressed"))]))


def _is_deflated(opened: Callable[[], Iterator[bytes]]) -> bool:
    """Whether bytes are a whole bare deflate stream, which has no start to be known by. The bits that another letter may
    have added stand behind it."""
    worker, behind, begun = zlib.decompressobj(-15), 0, False
    try:
        for piece in opened():
            if not begun and (len(piece) < 12 or piece[0] & 6 == 6):
                return False
            begun = True
            while piece and not worker.eof:
                worker.decompress(piece, _PIECE)
                piece = worker.unconsumed_tail
            behind += len(worker.unused_data) if worker.eof and not behind else len(piece)
            if behind > 3:
                return False
    except zlib.error:
        return False
    return worker.eof


def _escaped_bytes(layer: Layer, matches: list[re.Match], raw_of: Callable[[re.Match], bytes | None], via: str) -> Iterator[Found]:
    """Compressed data in the bytes of escapes."""
    for m in matches:
        raw = raw_of(m)
        if raw and len(raw) >= 12 and (_opened(raw[:8]) or _MAGIC.search(raw)):
            span = layer.span(m.start(), m.end())
            yield Found(_compressed(raw, lambda *_, span=span: span, (*layer.via, via)))


def _byte_escapes(run: re.Match) -> bytes | None:
    try:
        return "".join(ch for ch, _ in _from_unicode(run)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def _without_nul(layer: Layer) -> Layer:
    """What a layer of wide characters (UTF-16, UTF-32) says in ASCII."""
    held = np.flatnonzero(np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), np.uint32))
    return Layer(layer.text.replace("\0", ""), held if layer.begin is None else layer.begin[held], held + 1 if layer.end is None else layer.end[held], layer.via)


def unwrapped(layer: Layer) -> Iterator[Layer | Found]:
    """The layers directly below a layer; those of compressed data as streams, as they can be large."""
    text = layer.text
    if "%" in text and (found := list(_URL.finditer(text))):
        yield _rewritten(layer, found, _from_url, "url")
        yield from _escaped_bytes(layer, found, lambda m: bytes.fromhex(m[0].replace("%", "")), "url")
    if ("\\" in text or "&#" in text) and (found := list(_UNICODE.finditer(text))):
        yield _rewritten(layer, found, _from_unicode, "unicode")
        yield from _escaped_bytes(layer, found, _byte_escapes, "unicode")
    if _WIDE.search(text):
        yield _without_nul(layer)
    for m in _BASE64.finditer(text):
        if not any(m.start() <= c <= m.end() for c in layer.cut):
            yield from _from_base64(layer, m)


class _State:
    """What was seen of a text, how much its streams may still hold, and which of them were not read to their end."""

    def __init__(self, most: int):
        self.left, self.seen, self.unfinished = most, set(), []

    def is_new(self, layer: Layer) -> bool:
        start = layer.begin[0] if len(layer.begin) else -1
        token = hashlib.blake2b(f"{start}:{layer.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if not layer.text or token in self.seen:
            return False
        self.seen.add(token)
        return True

    def may_read(self, size: int, span: tuple[int, int]) -> bool:
        self.left -= size
        if self.left < 0:
            self.unfinished.append(span)
        return self.left >= 0


def scanned(text: str | None, most: int | None = None) -> tuple[list[Span], list[tuple[int, int]]]:
    """All spans of a text, those of its own layer with depth 0; and the spans of streams that hold too much to be read."""
    state, spans = _State(MOST_BYTES if most is None else most), {}
    work: deque = deque([Layer(text or "", None, None, ())])
    while work:
        layer = work.popleft()
        if isinstance(layer, Found):
            work.extend(layer.streams)
            continue
        if isinstance(layer, Stream):
            layer = _read(layer, state)
        if not isinstance(layer, Layer):  # one chunk at a time
            rest, layer = layer, next(layer, None)
            if layer is None:
                continue
            work.append(rest)
            if isinstance(layer, Stream):
                work.append(layer)
                continue
        elif layer.via and not state.is_new(layer):
            continue
        for start, end, kind in plain_spans(layer.text):
            place = (*layer.span(start, end), kind)
            if place not in spans or len(layer.via) < spans[place].depth:
                spans[place] = Span(*place, len(layer.via), ">".join(layer.via))
        work.extend(unwrapped(layer))
    return sorted(spans.values(), key=lambda s: (s.start, KINDS.index(s.kind), s.end)), sorted(set(state.unfinished))


def scan(text: str | None) -> list[Span]:
    return scanned(text)[0]


def masked(text: str) -> str:
    """The text with secrets masked, and with them streams that were not read to their end."""
    spans, unfinished = scanned(text)
    return redact(text, sorted([*spans, *(Span(a, b, "assign", 1, "") for a, b in unfinished)]))


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every maximal run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], mask]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if out else text


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("depth", pa.int32()), ("via", pa.string())]))


def find_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, ``secrets``, an array of (start, end, kind, depth, via), and ``unfinished``: whether
    streams inside the text hold too much to be read to their end."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t")):
            found = [scanned(t) for t in batch.column("t").to_pylist()]
            spans = pa.array([[s._asdict() for s in own] for own, _ in found], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("k"), spans, pa.array([bool(rest) for _, rest in found])], ["k", "secrets", "unfinished"])

    return mapped(rows, work, f"k {rows.schema['k'].dataType.simpleString()}, secrets array<struct<start: long, end: long, kind: string, depth: int, via: string>>, unfinished boolean").withColumnRenamed("k", key)


def mask_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same rows and columns, with all secrets in the text masked; a null text stays null. A column ``n_chars`` is
    brought in line with the masked text."""
    at = docs.columns.index(text)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, text)):
            clean = [t if t is None else masked(t) for t in batch.column(at).to_pylist()]
            lengths = [n if t is None or t == old else len(t) for t, old, n in zip(clean, batch.column(at).to_pylist(), batch.column(chars).to_pylist(), strict=True)]
            columns = [pa.array(clean, batch.schema.types[i]) if i == at else pa.array(lengths, batch.schema.types[i]) if i == chars else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return mapped(docs, work, docs.schema)


def digest(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Counts and position strings from the output of :func:`find_secrets`."""
    listed = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("secrets", lambda s: s["depth"] == 0)

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        key,
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), 256).alias("base_sha256"),
        F.array_join(listed, ",").alias("spans"),
        F.array_max(F.transform("secrets", lambda s: s["depth"])).alias("deepest"),
        "unfinished",
    )
