"""Cross-tokenizer alignment, sentencepiece encoding and spelling variants, each against a plain version."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagetrail.llm import alignment, chunks, packing, pieces, spelling
from pagetrail.llm.queries import QUERIES
from tests.conftest import SF

KIND = "doc_id long, text string"
ODD = [" ", "  ", "   ", "\t", "\n", "\r\n", " \n", "\n ", " ", "　", " ", "\u0085", "▁", "▁▁", "a", "word", "Der", "l'", "'s", "12", "3.5", "é", "é", "ß", "漢字", "ー", "🙂", "👩‍👩‍👧", "\x00", "\x1c", "\x1f", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "...", "--", "http://x.y/z?q=1", "ﬁ", "𝔘", "​", "﻿"]


def wild_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) + rng.choice(["", "", " "]) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    texts = ["", None, " ", "  ", "▁", " a", "a ", "a▁b c", "x" * 30_000, "many words " * 8_000, "a" + " " * 3_000 + "b", "<|endoftext|> and <s>", "same text", "same text"]
    return [(i if i != 5 else None, t) for i, t in enumerate(texts + wild_texts(400, 1))]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def read_documents(spark) -> list[tuple]:
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# sentencepiece


def plain_pieces(rows: list[tuple]) -> Counter:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=chunks.default_piece_model())
    out = Counter()
    for key, text in rows:
        ids = model.encode(text or "")
        out[key, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))] += 1
    return out


def test_pieces_equal_the_library_on_odd_texts(spark):
    rows = edge_rows()
    out = pieces.digest(pieces.encoded(spark.createDataFrame(rows, KIND).repartition(3))).collect()
    assert Counter(tuple(r) for r in out) == plain_pieces(rows)


def test_pieces_query_equals_the_library(spark):
    out = QUERIES["op12_sentencepiece_chunks"](spark, SF).collect()
    assert Counter(tuple(r) for r in out) == plain_pieces(read_documents(spark))


def test_pieces_round_trip_and_small_tables(spark, monkeypatch):
    rows = [(0, "a b  c"), (1, None), (2, ""), (3, " \t x\n")]
    docs = spark.createDataFrame(rows, KIND)
    assert {r.doc_id: r.decoded for r in pieces.encoded(docs).collect()} == {0: "a b  c", 1: "", 2: "", 3: " \t x\n"}
    assert pieces.encoded(docs.limit(0)).collect() == []
    # a text with markers is decoded with spaces
    assert pieces.encoded(spark.createDataFrame([(0, "a▁b")], KIND)).first().decoded == "a b"


def test_pieces_beside_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([("x", "one two", 5, "k", "t")], "k string, text string, ids int, decoded string, t string")
    out = pieces.encoded(docs, key="k").first()
    assert out.asDict() == {"k": "x", "ids": [624, 989], "decoded": "one two"}


def test_table_that_forgets_gives_the_same():
    made = []
    table = chunks.ChunkTable(lambda new: made.append(new) or [(len(c),) for c in new], limit=2)
    assert table.of(["a", "bb", "ccc"]) == [(1, 2, 3)]
    assert table.of(["bb", "dddd"]) == [(2, 4)]
    assert made == [["a", "bb", "ccc"], ["bb", "dddd"]]


def test_models_whose_pieces_cross_markers_get_whole_texts(spark, monkeypatch):
    of = chunks.pieces(chunks.default_piece_model())
    texts = wild_texts(60, 5)
    want = of.ids(texts)
    monkeypatch.setattr(of, "chunked", False)
    assert of.ids(texts) == want == [of.model.encode(t) for t in texts]
    assert chunks.Chunks(["a b", "c"], whole=True).distinct == ["a b", "c"]


# byte-level ids


def test_byte_ids_of_chunks_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    for plain in (True, False):
        whole = Tokenizer.from_file(chunks.default_byte_tokenizer())
        whole.encode_special_tokens = plain
        of = chunks.byte_tokens(chunks.default_byte_tokenizer(), plain)
        texts = wild_texts(600, 2 + plain)
        cut = chunks.Chunks(texts)
        split = [[cut.distinct[i] for i in cut.index[a:b]] for a, b in zip(cut.text_at, cut.text_at[1:], strict=False)]
        for text, own in zip(texts, split, strict=True):
            assert " ".join(own) == text
            assert [i for x in of.ids([own[0], *(" " + c for c in own[1:])]) for i in x] == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_the_characters_that_the_fast_reader_gets():
    from tokenizers import Tokenizer

    whole, of, rng = Tokenizer.from_file(chunks.default_byte_tokenizer()), chunks.byte_tokens(chunks.default_byte_tokenizer(), False), random.Random(6)
    every = [chr(c) for c in range(0x2100) if chunks._EASY.fullmatch(chr(c))]
    assert len(every) == 127 + 0xDF + 24
    for text in [*every, *("".join(rng.choice(every) for _ in range(rng.randrange(1, 50))) for _ in range(3000))]:
        assert of.of_text(text) == whole.encode(text, add_special_tokens=False).ids


def test_repeated_words_are_read_once(monkeypatch):
    of = chunks.byte_tokens(chunks.default_byte_tokenizer(), False)
    plain, read = of.fast, []

    class Counted:
        def encode_ordinary(self, text: str) -> list[int]:
            read.append(len(text))
            return plain.encode_ordinary(text)

    texts = ["Many of the same words, again and again (always);\nthe  same ones.\n"] * 500
    monkeypatch.setattr(of, "fast", Counted())
    got = packing.encode(texts, chunks.default_byte_tokenizer())
    assert {tuple(i) for i in got} == {tuple(plain.encode_ordinary(texts[0]))} and len(got) == 500
    assert sum(read) < len(texts[0]) * 2


def test_ids_of_many_texts_at_once():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(chunks.default_byte_tokenizer()), random.Random(8)
    parts = [*"ab Z9.,'-_\n\t\r\x0b\x0c\x1c\x1f\x00~", "  ", " ", "é", "×", "–", "'s", "'ll", "12", "¡"]
    texts = ["", *("".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)), *wild_texts(300, 5), "a" * 5000, " " * 500, ""]
    got = packing.encode(texts, chunks.default_byte_tokenizer())
    assert [i.tolist() for i in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.encode([], chunks.default_byte_tokenizer()) == [] and [len(i) for i in packing.encode(["", ""], chunks.default_byte_tokenizer())] == [0, 0]


def test_token_bytes_join_to_the_text():
    of = chunks.byte_tokens(chunks.default_byte_tokenizer(), True)
    held = of.token_bytes()
    for text in wild_texts(100, 9):
        assert b"".join(held[i] for i in of.exact.encode(text, add_special_tokens=False).ids) == text.encode()


# alignment


def plain_alignment(rows: list[tuple]) -> Counter:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(chunks.default_byte_tokenizer())
    first.encode_special_tokens = True
    bytes_a = chunks.byte_tokens(chunks.default_byte_tokenizer(), True).token_bytes()
    second = SentencePieceProcessor(model_file=chunks.default_piece_model())
    found, counts = [], Counter()
    for key, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        in_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != want or b"".join(in_b) != want:
            a, b, in_b = [], [], []
        ends_a, ends_b, at = {}, {}, 0
        for i in a:
            at += len(bytes_a[i])
            ends_a[at] = i
        at = 0
        for i, x in zip(b, in_b, strict=True):
            at += len(x)
            ends_b[at] = i
        both = sorted(ends_a.keys() & ends_b.keys())
        groups, low = [], 0
        for end in both:
            inside = [",".join(str(x[e]) for e in sorted(x) if low < e <= end) for x in (ends_a, ends_b)]
            groups.append("|".join(inside))
            low = end
        links = [(ends_a[e], ends_b[e]) for e in both]
        counts.update(links)
        found.append((key, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter((key, a, b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(";".join(groups)) if a else "") for key, a, b, groups, links in found)


def test_alignment_equals_the_plain_version_on_odd_texts(spark):
    rows = edge_rows()
    rows = [(k, t if t is None or len(t) < 5_000 else t[:5_000]) for k, t in rows]
    out = alignment.align_documents(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    assert Counter(tuple(r) for r in out) == plain_alignment(rows)


def test_alignment_query_equals_the_plain_version(spark):
    out = QUERIES["op11_cross_tokenizer_alignment"](spark, SF).collect()
    rows = read_documents(spark)
    # the plain version looks through all ends for each group; long texts are left to the test of parts below
    assert len(out) == len(rows)
    plain = plain_alignment([(k, t) for k, t in rows if len(t or "") < 3_000])
    own = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in out}
    for key, a, b, groups, links, _, _, digest in plain:
        assert own[key] == (a, b, groups, links, digest)
    small = spark.createDataFrame([r for r in rows if len(r[1] or "") < 3_000], KIND)
    assert Counter(tuple(r) for r in alignment.align_documents(small).collect()) == plain


def test_groups_of_one_text(spark):
    docs = spark.createDataFrame([(7, "unbelievable é\n")], KIND)
    row = alignment.aligned(docs, written=True).first()
    assert row.groups_sha256 == sha(row.groups)
    of_a, of_b = (x.token_bytes() for x in (chunks.byte_tokens(chunks.default_byte_tokenizer(), True), chunks.pieces(chunks.default_piece_model())))
    joined = [[b"".join(t[int(i)] for i in side.split(",")) for t, side in zip((of_a, of_b), group.split("|"), strict=True)] for group in row.groups.split(";")]
    assert all(a == b for a, b in joined)
    assert b"".join(a for a, _ in joined) == " unbelievable é\n".encode()
    assert len(joined) == row.n_groups == len(row.links) // 4


def test_labels_and_spans():
    import numpy as np

    labels = alignment.labels_of(5, np.array([1, 3, 5]), np.array([3, 4, 5]))
    assert labels == b"10323"
    assert alignment.span_ends(labels).tolist() == [3, 5]


def test_alignment_of_few_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁"), (None, "ab"), (None, "ab")], KIND)
    rows = alignment.align_documents(docs).collect()
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows if r.doc_id] == [(0, 0, 0, 0, 0, 0, "")] * 3
    twice = [r for r in rows if r.doc_id is None]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].count_sum == 2 * twice[0].n_links
    assert alignment.align_documents(docs.limit(0)).collect() == []
    clashing = docs.withColumns({c: F.lit(1) for c in ("k", "t", "links", "n_a", "groups", "code")})
    assert Counter(map(tuple, alignment.align_documents(clashing).collect())) == Counter(map(tuple, rows))


# spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_neighbours(words: list[str]) -> dict[str, set[str]]:
    """By what is left when one letter is taken out at a place; candidates are compared as they stand."""
    left = defaultdict(set)
    for w in words:
        left[w].add(w)
        for i in range(len(w)):
            left[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_edit(a, b)}
    return near


def plain_variants(counts: dict[str, int]) -> list[tuple]:
    near, form = plain_neighbours(list(counts)), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def plain_counts(rows: list[tuple]) -> dict[str, int]:
    import re

    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_variants_query_equals_the_plain_version(spark):
    out = QUERIES["op13_spelling_variants"](spark, SF).collect()
    want = plain_variants(plain_counts(read_documents(spark)))
    assert sorted(map(tuple, out)) == want
    assert sum(r.n_near for r in out) > 100


@pytest.mark.parametrize("rows_per_trie", [2, 7, 20_000])
def test_near_words_of_dense_vocabularies(spark, rows_per_trie):
    rng = random.Random(rows_per_trie)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(400)}
    counts = {w: rng.randrange(1, 5) for w in words}  # many ties
    near = plain_neighbours(sorted(words))
    out = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), rows_per_trie).collect()
    want = {w: (len(x), *min(((-counts[y], y)) for y in x)) for w, x in near.items() if x}
    assert {r.word: (r.n_near, -r.other_n, r.other) for r in out} == want


def test_trie_pairs_are_those_at_distance_one():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(200)})
    found = list(spelling.trie_pairs(words))
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}


def test_variants_of_few_texts(spark):
    rows = [(1, "Colours " * 30 + "colour " * 6), (2, None), (3, ""), (None, "coloure " * 5 + "short " * 9 + "ÉTÉSÉTÉS " * 5), (4, "étésétés")]
    docs = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("k", "t", "word", "n", "m")})
    assert sorted(map(tuple, spelling.spelling_variants(docs).collect())) == plain_variants(plain_counts(rows))
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    twice = spelling.spelling_variants(docs.union(docs)).collect()
    assert sorted(map(tuple, twice)) == plain_variants(plain_counts(rows + rows))


def test_roots_follow_long_chains_and_hot_forms(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}" if i < 20 else None) for i in range(21)]
    star = [(f"s{i:03}", "w00") for i in range(300)]
    out = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain + star, "word string, form string")).collect()}
    assert set(out.values()) == {"w20"} and len(out) == 321


def test_very_long_runs(spark):
    counts = plain_counts([(1, ("a" * 300 + "b" * 300 + " ") * 5 + ("a" * 300 + "b" * 301 + " ") * 25)])
    docs = spark.createDataFrame([(1, ("a" * 300 + "b" * 300 + " ") * 5 + ("a" * 300 + "b" * 301 + " ") * 25)], KIND)
    assert sorted(map(tuple, spelling.spelling_variants(docs).collect())) == plain_variants(counts)
