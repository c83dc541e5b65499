"""Each operator against a plain version, and its defined edge cases."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import io
import itertools
import lzma
import math
import re
import textwrap
import zipfile
import zlib
from collections import Counter, defaultdict
from functools import cache
from urllib.parse import quote, unquote

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetrail.llm import components, decoded_secrets, fingerprints, kd_shards, langid, license_match, mixing, near_duplicates, packing, quality_model, quality_rules, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
EDGE = [
    (1, None, "en", None, None),
    (2, "", None, "b", 0),
    (3, "  \n\t ", "en", "b", 5),
    (4, "one two", "en", "a", 7),
    (5, "one two", "en", "a", 7),
    (5, "one two", "en", "a", 7),
    (7, LONG, "en", "a", len(LONG)),
    (8, LONG + " tail", "en", None, len(LONG) + 5),
    (9, "12345 !!! 678", "xx", "c", 13),
    (10, "naïve café token = \"abcdef1234\" ünd \U0001f600 more", "fr", "c", 40),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(df):
    return [r.asDict() for r in df.collect()]


# 1 language identification


def test_language_held_out_accuracy(spark):
    found = {r["doc_id"]: r for r in rows(queries.op1_kneser_ney_language(spark, SF))}
    real = {r["doc_id"]: r for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))}
    held = [i for i, r in found.items() if r["held_out"] and real[i]["lang"] and len(real[i]["text"] or "") > 40]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == found[i]["held_out"] for i in found)
    assert np.mean([found[i]["lang_pred"] == real[i]["lang"] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_edges(spark, edge, empty):
    model = langid.train_language_model(edge.where("doc_id <> 9"))
    out = {r["doc_id"]: r for r in rows(langid.identify(edge, model))}
    assert {i for i, r in out.items() if r["lang_pred"] == "und"} == {1, 2, 3, 9}
    assert all(out[i]["score"] == 0 and not out[i]["accepted"] for i in (1, 2, 3, 9))
    assert langid.identify(empty, model).count() == 0
    none = langid.train_language_model(empty)
    assert {r["lang_pred"] for r in rows(langid.identify(edge, none))} == {"und"}


def plain_kneser_ney(streams, letters, order=4):
    """A function that gives the probability of a character after three others, from counts in dictionaries."""
    counts = {order: Counter(s[i - 3 : i + 1] for s in streams for i in range(3, len(s)))}
    for n in range(order - 1, 0, -1):  # distinct left neighbours
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(gram):
        if not gram:
            return 1 / (letters + 1)
        own = counts[len(gram)]
        ones, twos = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = [v for g, v in own.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

    return p


@pytest.mark.parametrize("wide", ["", "\U00010020\U00020020\U0001d400"])
def test_language_model_is_kneser_ney(wide):
    """Also with letters beyond 16 bits."""
    texts = {"a": ["abcab cab bca" + wide, "bb cab, abc"], "b": ["xyzzy" + wide[::-1] + " xyx zyx", "Éxy 12 zy"]}
    alphabet = langid.Alphabet(langid.letters_of(sum(texts.values(), []))[0])
    grams = []
    for own in texts.values():
        stream, begin, _ = langid.letter_stream(own, alphabet)
        inside = np.ones(len(stream), bool)
        for k in range(3):
            inside[begin + k] = False
        grams.append(np.unique(langid._grams(stream, 4)[inside[3:]], return_counts=True))
    model = langid.LanguageModel.train(["a", "b"], alphabet, np.repeat([0, 1], [len(g[0]) for g in grams]), np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]))
    plain = lambda t: "   " + re.sub(r"[\W\d_]+", " ", t.lower()).lstrip()
    asked = ["cab abx", "zy" + wide, "ünknown xyz", "1a"]
    entropy, letters = model.cross_entropies(asked)
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in asked]
    for i, own in enumerate(texts.values()):
        p = plain_kneser_ney([plain(t) for t in own], len({c for other in texts.values() for t in other for c in plain(t)[3:]}))
        for t, got in zip(asked, entropy[:, i], strict=True):
            s = plain(t)
            assert got == pytest.approx(-np.mean([math.log(p(s[k - 3 : k + 1])) for k in range(3, len(s))]), rel=1e-4)


def test_letters_beyond_16_bits_are_letters(spark):
    learned = spark.createDataFrame([(1, "hello world", "en", "s", 1), (2, "\U00010020\U00020020", "xx", "s", 1)], SCHEMA)
    out = rows(langid.identify(learned, langid.train_language_model(learned)))
    assert {r["lang_pred"] for r in out} <= {"en", "xx"} and all(r["score"] > 0 for r in out)


# 2 secrets


def base_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_secrets_base(spark, docs):
    for r in rows(queries.op2_decoded_secrets(spark, SF)):
        plain = base_spans(docs[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(plain).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(p.startswith(k) for p in plain) for k in ("assign", "access", "hex"))
        assert set(plain) <= set(r["spans"].split(",")) | {""}


@pytest.mark.parametrize("text", ["token=token:abcdefgh", "secret=tok token=abcdef", "passwordpassword: 'abc.def-1'", "AKIAAKIA" + "A" * 15, "K" + "api_Key=abcdefg", "ſecret=abcdefg", "f" * 23, "f" * 24 + "g" + "0" * 30])
def test_secrets_base_corner(text):
    assert [f"{s.kind}:{s.start}:{s.end}" for s in decoded_secrets.scan(text) if s.depth == 0] == base_spans(text)


@pytest.mark.parametrize(
    ("wrap", "via"),
    [
        (lambda s: quote(s, safe=""), "url"),
        (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "unicode"),
        (lambda s: base64.b64encode(s.encode()).decode(), "base64"),
        (lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), "base64>compressed"),
        (lambda s: quote(base64.b64encode(base64.b64encode(zlib.compress(s.encode()))).decode(), safe=""), "url>base64>base64>compressed"),
    ],
)
def test_secrets_inside_layers(wrap, via):
    inner = "é password = hunter2hunter2 end"
    text = f"préface {wrap(inner)} suite"
    found = [s for s in decoded_secrets.scan(text) if s.kind == "assign" and s.depth]
    assert found and found[0].via in (via, via.removeprefix("url>"))
    assert 8 <= found[0].start < found[0].end <= len(text) - 6
    if via in ("url", "unicode"):
        piece = text[found[0].start : found[0].end]
        assert wrap("password = hunter2hunter2") == piece or "hunter2" in piece
    masked = decoded_secrets.redact(text, decoded_secrets.scan(text))
    assert "[SECRET]" in masked and not any(s.kind == "assign" for s in decoded_secrets.scan(masked))


@pytest.mark.parametrize(
    "raw",
    [
        "é password = hunter2hunter2\u00a0\u200d\x00\x0c".encode(),
        "é password = hunter2hunter2 ".encode("latin-1"),
        "password = hunter2hunter2".encode("utf-16"),
        gzip.compress(b"a first member") + gzip.compress(b"password = hunter2hunter2 "),
        gzip.compress(b"password = hun") + gzip.compress(b"ter2hunter2 "),
        bz2.compress(b"password = hunter2hunter2 "),
        lzma.compress(b"\xff password = hunter2hunter2 "),
        zlib.compress(b"password = hunter2hunter2 and more words", wbits=-15),
        gzip.compress(b"0g " * (6 << 20) + b"password = hunter2hunter2"),
    ],
)
def test_secrets_in_any_bytes(raw):
    text = f"word {base64.b64encode(raw).decode()} word"
    found = decoded_secrets.scan(text)
    assert any(s.kind == "assign" and s.depth for s in found) and all(5 <= s.start < s.end <= len(text) - 5 for s in found)


@pytest.mark.parametrize("width", [19, 64, 76])
@pytest.mark.parametrize("between", ["\n", "\r\n", "\n    ", "\n> ", '" \\\n "', "\\n"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_secrets_in_wrapped_base64(width, between, pack):
    inner = pack("é plain words ".encode() * 3 + b"password = hunter2hunter2 " + bytes(range(256)))
    code = base64.b64encode(inner).decode()
    text = "word " + between.join(code[i : i + width] for i in range(0, len(code), width)) + " word"
    found = [s for s in decoded_secrets.scan(text) if s.kind == "assign" and s.depth]
    assert found and all(5 <= s.start < s.end <= len(text) - 5 for s in found)


@pytest.mark.parametrize("before", ["path/", "key_", "name-", "a", "ab", "abc", "a line\nwith "])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_secrets_in_glued_base64(before, pack):
    code = base64.b64encode(pack(b"password = hunter2hunter2 ")).decode().rstrip("=")
    for after in ("", "x", "xy", "\nword"):
        text = f"{before}{code}{after} word"
        found = [s for s in decoded_secrets.scan(text) if s.kind == "assign" and s.depth]
        assert found and all(len(before) <= s.start < s.end <= len(before + code) for s in found)


def test_chunks_overlap(monkeypatch):
    monkeypatch.setattr(decoded_secrets, "CHUNK_BYTES", 4096)
    monkeypatch.setattr(decoded_secrets, "_OVERLAP", 256)
    for before in range(4000, 4200, 7):
        raw = zlib.compress(b"." * before + b"password = hunter2hunter2 " + b"." * 9000)
        assert [s.kind for s in decoded_secrets.scan(base64.b64encode(raw).decode()) if s.depth] == ["assign"]


def deflated(raw, window=-15, level=6):
    worker = zlib.compressobj(level, zlib.DEFLATED, window)
    return worker.compress(raw) + worker.flush()


def zipped(raw):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("a.txt", b"nothing here, nothing at all")
        archive.writestr("folder/b.txt", raw)
    return held.getvalue()


def members(raw):
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        return b"\n".join(archive.read(n) for n in archive.namelist())


PACKERS = [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda raw: lzma.compress(raw, lzma.FORMAT_ALONE), deflated, lambda raw: deflated(raw, 9), lambda raw: deflated(raw, 12), zipped]
OPENERS = [bytes, gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda raw: zlib.decompress(raw, -15), members]


def plain_layers(text, depth=0):
    """All texts inside a text, by plain recursion over all codecs."""
    yield text
    if depth == 5:
        return
    for plain in {unquote(text), re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)} - {text}:
        yield from plain_layers(plain, depth + 1)
    for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
        try:
            raw = base64.b64decode(m[0], validate=True)
        except ValueError:
            continue
        yield from plain_bytes(raw, depth)


def plain_bytes(raw, depth):
    for inflate in OPENERS:
        try:
            inner = inflate(raw)
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zipfile.BadZipFile, NotImplementedError, RuntimeError):
            continue
        if inner != raw and depth < 5:
            yield from plain_bytes(inner, depth + 1)
        try:
            yield from plain_layers(inner.decode(), depth + 1)
        except ValueError:
            pass


def test_secrets_of_all_layers_against_plain_recursion(docs):
    """Whatever kinds plain recursion finds in wrapped documents, the worklist finds."""
    rng = np.random.default_rng(6)
    wraps = [lambda s: quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" if ord(c) < 65536 else c for c in s)]
    wraps += [lambda s, pack=pack: base64.b64encode(pack(s.encode())).decode() for pack in PACKERS]
    wraps += [lambda s, pack=pack, other=other: base64.b64encode(pack(other(s.encode()))).decode() for pack, other in itertools.pairwise(PACKERS)]
    texts = [t[:400] for t in docs.values() if t and base_spans(t[:400])][:12] + ["token: abcdef123456 é", "AKIA" + "B" * 16]
    for text in texts:
        for _ in range(8):
            wrapped = text
            for k in rng.integers(0, len(wraps), int(rng.integers(1, 4))):
                wrapped = f"before {wraps[k](wrapped)} after"
            held = {x.split(":")[0] for layer in plain_layers(wrapped) for x in base_spans(layer)}
            assert held and held <= {s.kind for s in decoded_secrets.scan(wrapped)}


def prose(rng, size):
    words = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9))))) for _ in range(2000)]
    held = [words[i] for i in rng.integers(0, len(words), size // 6)]
    held.insert(int(rng.integers(0, len(held))), "password = hunter2hunter2")
    return " ".join(held).encode()


@pytest.mark.parametrize(("size", "times"), [(1_000, 100), (5_000, 100), (20_000, 100), (60_000, 100), (1_000_000, 4)])
def test_no_bare_deflate_is_lost(size, times):
    rng = np.random.default_rng(size)
    for _ in range(times):
        raw = deflated(prose(rng, size), -15, 9)
        found = decoded_secrets.scan(f"see {base64.b64encode(raw).decode()} end")
        assert [s for s in found if s.kind == "assign" and s.via == "base64>compressed"]


@pytest.mark.parametrize("pack", PACKERS[1:6] + PACKERS[7:])
def test_secrets_in_compressed_data_behind_other_bytes(pack):
    raw = b"HEADER" + pack(prose(np.random.default_rng(4), 3_000)) + b"tail"
    text = f"x {base64.b64encode(raw).decode()} y"
    assert [s for s in decoded_secrets.scan(text) if s.kind == "assign" and "compressed" in s.via]
    assert [s for s in decoded_secrets.scan("".join(f"%{b:02x}" for b in raw)) if s.kind == "assign" and "compressed" in s.via]
    assert [s for s in decoded_secrets.scan("".join(f"\\x{b:02x}" for b in raw)) if s.kind == "assign" and "compressed" in s.via]
    masked = decoded_secrets.masked(text)
    assert "[SECRET]" in masked and not [s for s in decoded_secrets.scan(masked) if s.kind == "assign"]


@pytest.mark.parametrize("depth", [3, 64, 70, 150])
def test_there_is_no_limit_of_depth(depth):
    raw = b"password = hunter2hunter2"
    for k in range(depth):
        raw = (zlib.compress, gzip.compress, deflated)[k % 3 if k + 1 < depth and k % 3 < 2 else 0](raw)
    assert [s.depth for s in decoded_secrets.scan(base64.b64encode(raw).decode()) if s.depth] == [depth + 1]


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, deflated])
def test_runs_over_many_chunks(monkeypatch, pack):
    """Compressed data in base64 runs that go on over chunks of a compressed layer, wrapped or not."""
    monkeypatch.setattr(decoded_secrets, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(decoded_secrets, "_OVERLAP", 1_000)
    rng = np.random.default_rng(3)
    plain = rng.integers(0, 256, 40_000, np.uint8).tobytes() + b" password = hunter2hunter2 " + rng.integers(0, 256, 5_000, np.uint8).tobytes()
    for wrap in (base64.b64encode, base64.encodebytes):
        text = base64.b64encode(gzip.compress(b"words " * 3_500 + wrap(pack(plain)) + b" more")).decode()
        assert "assign" in {s.kind for s in decoded_secrets.scan(text)}


def test_compressed_data_over_many_chunks(monkeypatch):
    monkeypatch.setattr(decoded_secrets, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(decoded_secrets, "_OVERLAP", 1_000)
    rng = np.random.default_rng(8)
    for before in (0, 100, 19_990, 30_000):
        inner = gzip.compress(rng.integers(0, 256, 90_000, np.uint8).tobytes()[:90_000] + b" password = hunter2hunter2 ")
        text = base64.b64encode(zlib.compress(b"." * before + inner)).decode()
        assert "assign" in {s.kind for s in decoded_secrets.scan(text)}


def test_archives_that_grow_without_end_are_reported(spark):
    text = "see " + base64.b64encode(gzip.compress(b"\0" * 30_000_000)).decode() + " end"
    assert decoded_secrets.scanned(text, 1 << 20) == ([], [(4, len(text) - 4)])
    assert decoded_secrets.scanned(text)[1] == []
    docs = spark.createDataFrame([(1, "plain password=abcdef1")], "doc_id long, text string")
    assert not decoded_secrets.find_secrets(docs).first()["unfinished"]


def test_decoding_needs_little_memory():
    import tracemalloc

    text = "%41" * 700_000
    tracemalloc.start()
    decoded_secrets.scan(text)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_secrets_edges(edge, empty):
    out = rows(decoded_secrets.digest(decoded_secrets.find_secrets(edge)))
    assert len(out) == len(EDGE)
    assert {r["base_sha256"] for r in out if r["doc_id"] in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert decoded_secrets.find_secrets(empty).count() == 0
    masked = decoded_secrets.mask_secrets(edge)
    assert masked.columns == edge.columns and masked.where("text like '%abcdef1234%'").count() == 0
    assert masked.where("text is null").count() == 1


# 3 near-duplicates


def shingle_bag(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(a, b):
    place = {x: i for i, x in enumerate(b)}
    run = [place[x] for x in a if x in place]
    best = []
    for i, x in enumerate(run):
        best.append(1 + max((best[j] for j in range(i) if run[j] < x), default=0))
    return max(best, default=0)


def test_near_duplicates_against_brute_force(spark, docs):
    out = rows(queries.op3_order_minhash(spark, SF))
    assert len(out) == len(docs)
    bags = {i: shingle_bag(t) for i, t in docs.items()}
    held = defaultdict(set)
    for i, b in bags.items():
        for x in b:
            held[x].add(i)
    overlap = Counter()
    for who in held.values():
        overlap.update(itertools.combinations(sorted(who), 2))
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in overlap.items():
        if n / (len(bags[a]) + len(bags[b]) - n) >= 0.8:
            m = lcs(bags[a], bags[b])
            if m / (len(bags[a]) + len(bags[b]) - m) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    wanted = {i: root(i) for i in docs}
    wordless = defaultdict(list)
    for i, t in docs.items():
        if not bags[i]:
            wordless[t or ""].append(i)
    for same in wordless.values():
        wanted |= {i: min(same) for i in same}
    assert {r["doc_id"]: r["class_id"] for r in out} == wanted
    sizes = Counter(wanted.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in out)


def test_near_duplicates_edges(edge, empty):
    out = {r["doc_id"]: r["class_id"] for r in rows(near_duplicates.near_duplicate_classes(edge))}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 7: 7, 8: 7, 9: 9, 10: 10}
    assert near_duplicates.near_duplicate_classes(empty).count() == 0
    kept = near_duplicates.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] for r in rows(kept)) == [1, 3, 4, 7, 9, 10]


def plain_classes(texts):
    """Class ids by comparing all pairs."""
    bags, parent = {i: shingle_bag(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        m = lcs(bags[a], bags[b])
        if m and m / (len(bags[a]) + len(bags[b]) - m) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def test_chain_of_near_duplicates_is_one_class(spark):
    """Neighbours of the chain are near, its ends are not."""
    words = [f"w{i}" for i in range(200)]
    data = []
    for k in range(12):
        changed = list(words)
        for j in range(k):
            changed[7 + 16 * j % 190] = f"x{j}"
        data.append((k, " ".join(changed), "en", "s", 1))
    ends = [shingle_bag(data[k][1]) for k in (0, 11)]
    assert lcs(*ends) / (2 * len(ends[0]) - lcs(*ends)) < 0.8
    out = rows(near_duplicates.near_duplicate_classes(spark.createDataFrame(data, SCHEMA)))
    assert {r["class_id"] for r in out} == {0} and {r["class_size"] for r in out} == {12}


@pytest.mark.parametrize("leaders", [1, 32])
def test_rest_is_compared_like_brute_force(spark, monkeypatch, leaders):
    """Texts that share passages, without any link before: the rounds alone find all classes."""
    monkeypatch.setattr(near_duplicates, "_LEADERS", leaders)
    monkeypatch.setattr(near_duplicates, "_FURTHER", 4)
    rng = np.random.default_rng(8)
    passages = [[f"p{k}_{i}" for i in range(40)] for k in range(5)]
    texts = {}
    for i in range(70):
        words = sum((passages[k] for k in rng.choice(5, 3, replace=False)), [])
        for at in rng.choice(len(words), int(rng.integers(0, 5)), replace=False):
            words[at] = f"new{i}_{at}"
        texts[i] = " ".join(words)
    held = spark.createDataFrame([(bytes([i]), t) for i, t in texts.items()], "node binary, t string")
    none = spark.createDataFrame([], "a binary, b binary, similarity double")
    links, merged = near_duplicates._rest_compared(held, spark.createDataFrame([], "node binary, lead binary"), none, components.connected_components(none), 0.8)
    found = {i: i for i in texts} | {r["node"][0]: r["component"][0] for r in merged.collect()}
    assert found == plain_classes(texts) and 1 < len(set(found.values())) < 70
    assert all(r["similarity"] >= 0.8 for r in links.collect())


def test_near_duplicates_with_repeated_rows_and_text_ids(spark):
    base = " ".join(f"w{i}" for i in range(100))
    data = [("b", base, 1)] * 3 + [("a", base + " x", 1)] * 2 + [("c", "other words", 2)] * 2 + [(None, "", 3)]
    docs = spark.createDataFrame(data, "doc_id string, text string, node int").withColumn("own", F.lit(1)).withColumn("k", F.lit("k"))
    out = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in rows(near_duplicates.near_duplicate_classes(docs)))
    assert out == {("b", "a", 5): 3, ("a", "a", 5): 2, ("c", "c", 2): 2, (None, None, 1): 1}
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in rows(kept)) == ["None", "a", "c"]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 10), (10, 11), (2, 1)]
    out = {r["node"]: r["component"] for r in rows(components.connected_components(spark.createDataFrame(links, "a long, b long")))}
    assert out == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 8: 8, 9: 8}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 shards


def test_shards(spark, docs):
    out = rows(queries.op4_kd_shards(spark, SF))
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    size = Counter()
    slots = defaultdict(list)
    for r in out:
        code = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(code) + 16 and r["text_crc32"] == zlib.crc32(code)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 40, max(r["size"] for r in out)
    assert max(size.values()) - mean < largest and mean - min(size.values()) < largest


def test_shards_edges(edge, empty):
    out = rows(kd_shards.shard_documents(edge, shards=4))
    assert len(out) == len(EDGE) and {r["shard"] for r in out} <= set(range(4))
    assert kd_shards.shard_documents(empty, shards=4).count() == 0


def plain_tree(points, weights, count, spans):
    """Leaves (lists of row numbers) by recursive weighted medians along the widest dimension, in plain Python."""

    def split(own, c):
        if c == 1:
            return [own]
        widths = [(max(points[i][d] for i in own) - min(points[i][d] for i in own)) / spans[d] for d in range(len(spans))] if own else [0]
        d, total, left, right = widths.index(max(widths)), sum(weights[i] for i in own), [], []
        goal, running = total * (c // 2) / c, 0
        for i in sorted(own, key=lambda i: points[i][d]):
            running += weights[i]
            (left if running - weights[i] / 2 < goal else right).append(i)
        return split(left, c // 2) + split(right, c - c // 2)

    return split(list(range(len(points))), count)


@pytest.mark.parametrize(("per_node", "in_literals"), [(20, 64), (20, 2), (40_000, 64)])
def test_tree_against_a_plain_one(spark, per_node, in_literals):
    rng = np.random.default_rng(4)
    points = rng.uniform(size=(600, 2)) * [1, 3]
    weights = rng.integers(1, 50, 600)
    data = spark.createDataFrame([(i, float(x), float(y), int(n), 0) for i, ((x, y), n) in enumerate(zip(points, weights, strict=True))], "id long, x double, y double, weight int, f int")
    target = -(-int(weights.sum()) // 13)
    out = rows(kd_shards.kd_shards(data, ["x", "y"], "weight", F.xxhash64("id"), target=target, rows_per_node=per_node, nodes_in_literals=in_literals))
    leaves = plain_tree(points.tolist(), weights.tolist(), 13, np.ptp(points, axis=0).tolist())
    found = defaultdict(set)
    for r in out:
        found[r["shard"]].add(r["id"])
    assert len(out) == 600 and set(found) == set(range(13)) and set(out[0]) == {"id", "x", "y", "weight", "f", "shard"}
    if per_node == 40_000:
        assert [found[i] for i in range(13)] == [set(x) for x in leaves]
    sizes = [sum(int(weights[i]) for i in found[k]) for k in range(13)]
    assert max(sizes) - min(sizes) < 120


def test_repeated_rows_are_divided(spark):
    data = spark.createDataFrame([("id", "the same text", "en", "s", 13)] * 800, "doc_id string, text string, lang string, source string, n_chars long")
    out = Counter(r["shard"] for r in rows(kd_shards.shard_documents(data, shards=8)))
    assert set(out) == set(range(8)) and max(out.values()) - min(out.values()) <= 2


# 5 licences


def test_license_key_words_are_unavoidable():
    keys = set(license_match.key_words())
    for own in license_match.template_bigrams().values():
        free = [b for b in own if not keys & set(b.split())]
        assert len(free) < 0.8 / 1.2 * len(own)


def test_license_edges(spark, edge, empty):
    assert all(r["n_matches"] == 0 and r["license"] is None for r in rows(license_match.document_licenses(edge)))
    assert license_match.document_licenses(empty).count() == 0
    data = [(1, "x\nReleased under the MIT  license!\ny", "en", "s", 1), (2, license_match.TEMPLATES["MIT-grant"].replace("to deal in", "to deal with"), "en", "s", 1)]
    out = {r["doc_id"]: r for r in rows(license_match.document_licenses(spark.createDataFrame(data, SCHEMA)))}
    assert out[1]["license"] == "MIT" and out[1]["dice"] == 1.0
    assert out[2]["license"] == "MIT-grant" and 0.9 < out[2]["dice"] < 1


def test_licenses_of_one_key(spark):
    mit = "Released under the MIT license"
    docs = spark.createDataFrame([(1, mit, 5), (1, "a text without any", 6), (1, None, 7), (None, mit, 8), (None, "x", 9), (2, mit, 1), (2, mit, 1)], "doc_id long, text string, dice int")
    out = Counter((r["doc_id"], r["license"], r["n_matches"]) for r in rows(license_match.document_licenses(docs)))
    assert out == {(1, "MIT", 1): 1, (1, None, 0): 2, (None, "MIT", 1): 1, (None, None, 0): 1, (2, "MIT", 1): 2}


def test_wrapped_licenses(spark):
    filler = "\n".join(f"line {i} of some other words about nothing at all" for i in range(40))
    names = ["MIT-grant", "BSD-grant", "ISC-grant", "GPL-3.0-header", "MPL-2.0-header", "Apache-2.0-header"]
    data = []
    for n, name in enumerate(names):
        for m, mark in enumerate(("", "# ")):
            notice = "\n".join(mark + x for x in textwrap.wrap(license_match.TEMPLATES[name], 76))
            data.append((2 * n + m, f"{filler}\n{notice}\n\n{filler}", "en", "s", 1))
    texts = [*license_match.FULL_TEXTS]
    data += [(100 + i, f"Title\n\nCopyright (c) 2020 Some One\n\n{textwrap.fill(license_match.FULL_TEXTS[name], 78)}\n", "en", "s", 1) for i, name in enumerate(texts)]
    data.append((200, data[0][1] + "\n" + data[0][1] + "\nReleased under the\nMIT License\nReleased under the MIT License", "en", "s", 1))
    out = {r["doc_id"]: r for r in rows(license_match.document_licenses(spark.createDataFrame(data, SCHEMA)))}
    for n, name in enumerate(names):
        for m in range(2):
            assert name in out[2 * n + m]["licenses"].split(",") and out[2 * n + m]["dice"] > 0.95
    for i, name in enumerate(texts):
        assert name in out[100 + i]["licenses"].split(",")
    found = Counter(r["license"] for r in rows(license_match.license_lines(spark.createDataFrame(data[-1:], SCHEMA))))
    assert found["MIT-grant"] == 2 and found["MIT"] == 2


# 6 fingerprints


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def test_fingerprints(spark, docs):
    out = sorted(rows(queries.op6_weighted_fingerprints(spark, SF)), key=lambda r: r["doc_id"])
    ids = sorted(docs)
    assert [r["doc_id"] for r in out] == ids
    errors, by_text = [], {}
    for i, r in enumerate(out):
        text, after = docs[ids[i]] or "", docs[ids[(i + 1) % len(ids)]] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        errors += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, after)]
    # documents of one corpus share words and so their draws: the mean error is that of few independent documents
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_fingerprints_are_unbiased():
    rng, texts, real = np.random.default_rng(5), [], []
    for i in range(1500):  # each pair of documents has words of its own, so that errors are independent
        a = Counter({f"t{i}_{k}": int(rng.integers(1, 6)) for k in range(40)})
        b = Counter({w: int(rng.integers(1, 6)) if rng.random() < 0.4 else n for w, n in a.items()})
        texts += [" ".join(a.elements()), " ".join(b.elements())]
        real.append(sum((a & b).values()) / sum((a | b).values()))
    got = fingerprints.fingerprints(pa.array(texts))
    errors, real = fingerprints.likeness(got[0::2], got[1::2]) - real, np.array(real)
    expected = np.sqrt((real * (1 - real) / fingerprints.SAMPLES).mean())
    assert abs(errors.mean()) < 4 * expected / len(real) ** 0.5 and errors.std() == pytest.approx(expected, rel=0.1)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_fingerprint_edges(edge, empty, ranges):
    out = sorted(rows(fingerprints.fingerprint_with_edits(edge, least_ranges=ranges)), key=lambda r: (r["doc_id"], r["n_chars"]))
    assert len(out) == len(EDGE)
    texts = [t or "" for _, t, *_ in EDGE]
    for i, r in enumerate(out):
        cut = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - cut] + texts[(i + 1) % len(texts)][:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprints.fingerprint_with_edits(empty).count() == 0
    assert fingerprints.fingerprint_documents(edge).where("doc_id in (4, 5)").select("fingerprint").distinct().count() == 1


def test_fingerprints_with_text_and_null_ids(spark):
    data = [("b", "x y z w", 1), (None, "first of all", 2), ("a", "some words", 3), ("c", "last one here", 4)]
    docs = spark.createDataFrame(data, "doc_id string, text string, p int").withColumn("at", F.lit(1)).withColumn("k", F.lit(2))
    out = {r["doc_id"]: r for r in rows(fingerprints.fingerprint_with_edits(docs, least_ranges=4))}
    order = [None, "a", "b", "c"]
    texts = {i: t for i, t, _ in data}
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        cut = len(texts[i]) // 4
        assert out[i]["edited_sha256"] == hashlib.sha256((texts[i][: len(texts[i]) - cut] + texts[after][:cut]).encode()).hexdigest()


# 7 and 8 quality


def test_quality_score_is_a_plain_forward_pass():
    """Every word the mean of its vectors' scores (itself and its character n-grams), a text the mean of words and pairs."""
    rng = np.random.default_rng(3)
    model = quality_model.QualityModel(rng.normal(size=(1 << 12, 2)).astype(np.float32), np.array([0.1, -0.2]), [0, 1])
    texts = ["é", "ab äöüß 漢字仮名交 ab", "", "one two  two", None, "naïve\ncafé x"]

    def bucket(text, lower=None):
        w = quality_model.Words.of(pa.array([text]))
        return w.span_hashes(np.array([0]), np.array([len(text.encode())]))

    for text, got in zip(texts, model.probabilities(pa.array(texts, pa.string())), strict=True):
        words = WORD.findall(text or "")
        parts = []
        for w in words:
            own = [int(bucket(w)[0] % np.uint64(1 << 12))]
            own += [int(quality_model.mix64(bucket(w[i : i + n]) + np.uint64(1))[0] % np.uint64(1 << 12)) for n in quality_model.NGRAMS for i in range(len(w) - n + 1)]
            parts.append(model.table[own].astype(float).mean(0))
        if len(words) > 1:
            pairs = quality_model.pair_buckets(quality_model.Words.of(pa.array([text])), 1 << 12)[0]
            parts += [model.table[i].astype(float) for i in pairs]
        score = (np.mean(parts, 0) if parts else 0) + model.bias
        assert got == pytest.approx(np.exp(score) / np.exp(score).sum())


def test_rules_are_applied_as_they_read(spark, docs):
    """The verdict of each document by the rules as plain comparisons."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.train_quality_rules(table, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rules
    for r in rows(quality_rules.judge(table, rules)):
        x = {"n_words": r["n_words"], "mean_word_chars": (r["word_chars"], "n_words"), "symbols_per_word": (r["n_symbols"], "n_words"), "duplicate_line_share": (r["n_dup_lines"], "n_lines")}
        x |= {"repeated_word_share": (r["n_repeat_words"], "n_words"), "upper_share": (r["n_upper"], "word_chars"), "marks_per_word": (r["n_marks"], "n_words"), "words_per_line": (r["n_words"], "n_lines")}
        x = {k: v if isinstance(v, int) else v[0] / r[v[1]] if r[v[1]] else 0.0 for k, v in x.items()}
        hit = [i for i, rule in enumerate(rules, 1) if all(x[t.feature] > t.threshold if t.above else x[t.feature] <= t.threshold for t in rule)]
        assert r["rule"] == (hit[0] if hit else None)
        assert r["kept"] == (not hit and r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"])


def test_clashing_names_in_rules(spark, edge):
    wide = edge.withColumns({"q_n_words": F.lit("x"), "q_kept": F.lit(7), "x_kept": F.lit(8), "c0": F.lit(9), "s0": F.lit(1)})
    kept = quality_rules.keep_good(wide, [])
    assert kept.columns == wide.columns and {(r["q_kept"], r["x_kept"], r["c0"]) for r in rows(kept)} <= {(7, 8, 9)}
    with pytest.raises(ValueError, match="q_kept, q_n_words"):
        quality_rules.judge(wide, [], prefix="q_")


def test_quality_model_held_out(spark):
    out = {r["doc_id"]: r for r in rows(queries.op7_subword_quality(spark, "/root/testdata/sf0.1"))}
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))}
    held = [i for i in labels if out[i]["held_out"]]
    bad = [i for i in held if labels[i] == 0]
    assert np.mean([out[i]["predicted"] == labels[i] for i in held]) > 0.95
    assert np.mean([out[i]["predicted"] == 0 for i in bad]) > 0.7
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (9, 0), (7, 1), (3, None)], "doc_id long, quality int")
    model = quality_model.train_labelled(edge, labels)
    assert quality_model.score_quality(edge, model).count() == len(EDGE)
    assert quality_model.score_quality(empty, model).count() == 0
    nothing = quality_model.train_labelled(edge, labels.where("false"))
    assert {r["score"] for r in rows(quality_model.score_quality(edge, nothing))} == {0.5}
    one = quality_model.train_labelled(edge, labels.where("quality = 1"))
    assert {r["score"] for r in rows(quality_model.score_quality(edge, one))} == {1.0}
    rules = quality_rules.train_quality_rules(edge, labels)
    wider = edge.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1))
    out = quality_rules.judge(wider, rules, prefix="q_")
    assert out.count() == len(EDGE) and {"n_words", "q_n_words", "kept", "q_kept"} <= set(out.columns)
    assert quality_rules.judge(empty, []).count() == 0


def plain_statistics(text):
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_statistics(spark, docs):
    out = rows(queries.op8_decision_list(spark, SF))
    assert len(out) == len(docs)
    for r in out:
        plain = plain_statistics(docs[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain
        assert r["base_failed"] == (plain[0] < 50 or 100 * plain[4] > 50 * plain[0])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["base_failed"] and r["rule"] is None)
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{SF}/labels.parquet"))}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in out if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([k for q, k in judged if q == 1]) > 0.98
    assert np.mean([not k for q, k in judged if q == 0]) > 0.5


def test_statistics_of_odd_texts():
    texts = ["", "a", "\n\n", "a\na\n a\n\na", " x y x y x y ", "é " * 7, "l1\nl2\nl1\nl2\nl1", LONG]
    got = quality_rules.text_statistics(pa.array([*texts, None]))
    for i, t in enumerate([*texts, ""]):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_statistics(t), t[:20]


def test_decision_list_finds_planted_rule():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(900, 3))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] < 0.5)) | (x[:, 2] > 0.95)
    rules = quality_rules.learn_rules(x, bad, ["a", "b", "c"])
    fired = np.zeros(len(x), bool)
    for r in rules:
        fired |= quality_rules._covered(r, x, ["a", "b", "c"])
    assert (fired == bad).mean() > 0.97


# 9 packing


def check_packing(out, texts, encode):
    """texts: (doc_id, text) of all rows."""
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    real = defaultdict(list)
    for i, t in texts:
        ids = [*encode(t or ""), 0]
        real[i, len(ids)].append(ids)
    assert set(real) == set(by_doc)
    for k, pieces in by_doc.items():
        if len(real[k]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
                assert zlib.crc32(np.array(real[k][0][p["start"] : at], "<u4").tobytes()) == p["ids_crc32"]
            assert at == k[1]
        else:
            assert sum(p["length"] for p in pieces) == k[1] * len(real[k])
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


@cache
def plain_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_encode(text):
    return plain_tokenizer().encode(text, add_special_tokens=False).ids


def test_packing(spark, docs):
    out = rows(queries.op9_bm25_packing(spark, SF))
    assert check_packing(out, docs.items(), plain_encode) < 1024 * 4


def test_packing_edges(edge, empty):
    out = rows(packing.pack_documents(edge))
    check_packing(out, [(i, t) for i, t, *_ in EDGE], plain_encode)
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("text", [" " * 5000, " " * 1_000_000, "a" * 3000, "\n \n\t x", "<|endoftext|> hi", "ñ€\U0001f600" * 50, "it's we'll I'd", "word " * 900_000, "\x00\x01 \x85\xa0  q"])
def test_fast_and_exact_tokens_agree(text):
    assert packing.encode([text], packing.default_byte_tokenizer())[0].tolist() == plain_encode(text)


def test_special_tokens_in_documents(spark):
    docs = [(1, "a <|endoftext|>"), (2, "<|endoftext|>é <|endoftext|>"), (3, "plain")]
    assert plain_encode("a <|endoftext|>")[-1] == 50256
    check_packing(rows(packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"))), docs, plain_encode)


def test_neighbours_are_lexical():
    rests = [np.array([1, 2, 3] * 5), np.array([7, 8, 9] * 5), np.array([1, 2, 3] * 2), np.array([7, 8] * 2)]
    bags = [np.unique(r, return_counts=True) for r in rests]
    groups = packing.pack([len(r) for r in rests], bags, np.ones(50), 10.0, window=21)
    assert [p[0] for p in groups[0]] == [0, 2]


def plain_bm25(bags, df, mean, seed, doc):
    """Of one document for the distinct terms of a seed, term by term."""
    count, total = bags[doc], sum(bags[doc].values())
    score = 0.0
    for term in bags[seed]:
        if n := count.get(term):
            idf = math.log(1 + (len(bags) - df[term] + 0.5) / (df[term] + 0.5))
            score += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * total / mean))
    return score


def test_scores_are_bm25(docs):
    bags = [Counter(plain_encode(t or "") + [0]) for t in list(docs.values())[:60]]
    df = Counter(term for b in bags for term in b)
    mean = np.mean([sum(b.values()) for b in bags])
    counted = np.array([df[i] for i in range(50_257)])
    index = packing.Index([(np.array(sorted(b)), np.array([b[i] for i in sorted(b)])) for b in bags], packing.inverse_frequencies(counted, len(bags)), mean)
    for seed in range(0, 60, 7):
        assert index.scores(seed) == pytest.approx([plain_bm25(bags, df, mean, seed, d) for d in range(60)])


def test_near_documents_share_a_shard(spark):
    """Of seeds (ids divisible by 100) whose best neighbour by BM25 over all documents has half the seed's own score or more, nine
    of ten find one that good in their shard. Also, the tokens of both readers are the same over these documents."""
    folder = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] or "" for r in rows(spark.read.parquet(f"{folder}/documents.parquet"))}
    ids = sorted(texts)
    path = packing.default_byte_tokenizer()
    bags = [np.unique(np.append(e, np.uint32(0)), return_counts=True) for e in packing.encode([texts[i] for i in ids], path)]
    df = np.bincount(np.concatenate([b[0] for b in bags]).astype(np.int64), minlength=packing.vocabulary_of(path))
    index = packing.Index(bags, packing.inverse_frequencies(df, len(bags)), np.mean([b[1].sum() for b in bags]))
    out = rows(queries.op9_bm25_packing(spark, folder))
    shards = defaultdict(set)
    for r in out:
        shards[r["doc_id"]].add(r["sequence_id"] >> 24)
    assert all(len(s) == 1 for s in shards.values())
    shard = np.array([min(shards[i]) for i in ids])
    assert np.bincount(np.unique(shard, return_inverse=True)[1]).max() <= 500
    hit = []
    for at in (k for k, i in enumerate(ids) if i % 100 == 0):
        score = index.scores(at)
        good = score >= score[at] / 2
        good[at] = False
        if good.any():
            hit.append((good & (shard == shard[at])).any())
    assert len(hit) > 5 and np.mean(hit) >= 0.9


# 10 mixing


def test_mixing_edges(edge, empty):
    out = rows(mixing.mix_documents(edge))
    assert len(out) == len(EDGE)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.mix_documents(empty).count() == 0
    text = mixing.mixed_texts(edge)
    assert text.columns == edge.columns and text.count() > 0


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", 7, "x"), (None, "e f", "t", 8, None)], "doc_id long, text string, source string, taken int, size string")
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns and {(r["taken"], r["size"]) for r in rows(out)} <= {(7, "x"), (8, None)}


def test_near_duplicates_without_ids(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(None, base), (None, base + " x"), (3, base + " y")], "doc_id long, text string")
    assert {r["class_id"] for r in rows(near_duplicates.near_duplicate_classes(docs))} == {3}
    assert near_duplicates.drop_near_duplicates(docs).count() == 1


def test_near_duplicates_keep_different_texts_of_one_key(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = b.replace("b59", "x")

    def kept(rows):
        out = near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    without = kept([(None, a), (None, b), (None, near), (None, c), (None, c)])
    assert len(without) == 3 and {a, c} < {t for _, t in without}
    assert kept([(1, a), (1, b), (1, b)]) == [(1, a), (1, b)]
    assert kept([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept([(None, a), (4, a), (None, b)]) == [(4, a), (None, b)]
    assert len(kept([(2, b), (2, near)])) == 1


def test_mixing_budgets(spark):
    for bins in (50, 20_000):
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(1.0).alias("weight"))
        out = rows(mixing.mix_sources(docs, rows_per_bin=bins))
        taken, target = Counter(), {}
        for r in out:
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert r["taken"] <= 3 * r["size"]
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)
        assert abs(sum(taken.values()) - sum(r["size"] for r in out)) <= len(target)


def test_mixing_is_the_plain_sample(spark):
    data = [(i % 40 if i % 7 else None, f"{'w ' * (1 + i % 5)}{'# ' * (i % 3)}", [None, "a", "b", "c"][(i * i) % 4]) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    sizes, groups = Counter(), defaultdict(list)
    for key, text, source in data:
        n, symbols = len(text.split()), text.count("#")
        digest = hashlib.md5(f"mix:{'' if key is None else key}".encode()).hexdigest()
        es_key = -math.log((int(digest[:12], 16) + 0.5) / 2**48) / (1 - 0.75 * min(symbols / n, 1))
        sizes[source] += n
        groups[source].append(((round(es_key, 9), key is not None, key or 0, n), key, n))
    want = Counter()
    for source, target in mixing.targets_of(dict(sizes)).items():
        epochs = min(int(target // sizes[source]), 3)
        left = round(target) - epochs * sizes[source]
        for _, key, n in sorted(groups[source]):
            part = max(min(left, n), 0)
            left -= n
            want[key, n, epochs * n + part] += 1
    for bins in (10, 20_000):
        assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows(mixing.mix_documents(docs, rows_per_bin=bins))) == want
    words = Counter()
    for r in rows(mixing.mixed_texts(docs, rows_per_bin=10)):
        words[r["doc_id"]] += len(r["text"].split())
    plain = Counter()
    for (key, _, taken), times in want.items():
        plain[key] += taken * times
    assert words == +plain


def test_targets():
    assert mixing.targets_of({"a": 10, "b": 10, "c": 10}) == {"a": 5, "b": 10, "c": 15}
    assert mixing.targets_of({"a": 100, "b": 1, None: 1}) == {"a": pytest.approx(96), "b": 3, None: 3}
    assert mixing.targets_of({"a": 0, "b": 6}) == {"a": 0, "b": 6}
