"""Columns whose names operators use inside, and ties, for the operators whose own tests don't cover them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.llm import decoded_secrets, fingerprints, langid, packing, pieces, quality_model, quality_rules, spelling
from pagetrail.llm.shared import DOCUMENT_COLUMNS
from tests.conftest import TINY

NAMES = ("k", "t", "l", "h", "y", "n", "key", "row", "score", "label", "lang_pred", "held_out", "secrets", "unfinished", "tokens", "keys", "rest", "bag", "shared", "own", "salt", "start", "length", "gram", "letter", "ids", "decoded", "word", "fingerprint")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet").select(*DOCUMENT_COLUMNS).limit(120).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"{c} 7") for c in NAMES}).cache()


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_clashing_names_in_languages(docs, clashing):
    model = langid.train_language_model(docs)
    assert counted(langid.identify(clashing, langid.train_language_model(clashing))) == counted(langid.identify(docs, model))


def test_clashing_names_in_secrets(docs, clashing):
    plain, other = (decoded_secrets.digest(decoded_secrets.find_secrets(x)) for x in (docs, clashing))
    assert counted(plain) == counted(other)
    masked = decoded_secrets.mask_secrets(clashing)
    assert masked.columns == clashing.columns and masked.where(" OR ".join(f"`{c}` <> '{c} 7'" for c in NAMES)).count() == 0


def test_clashing_names_in_quality(spark, docs, clashing):
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    scores = [quality_model.score_quality(x, quality_model.train_labelled(x, labels.withColumns({c: F.lit(1) for c in ("k", "t", "y", "n")}))) for x in (docs, clashing)]
    a, b = ({r["doc_id"]: r["score"] for r in x.collect()} for x in scores)
    assert a == pytest.approx(b)


def test_clashing_names_in_packing(docs, clashing):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces_of = lambda df: sorted(tuple(r) for r in packing.pack_documents(df).select(*columns).collect())
    assert pieces_of(docs) == pieces_of(clashing)


def test_clashing_names_in_pieces_and_words(docs, clashing):
    assert counted(pieces.digest(pieces.encoded(docs))) == counted(pieces.digest(pieces.encoded(clashing)))
    assert counted(spelling.word_counts(docs, occurrences=2)) == counted(spelling.word_counts(clashing, occurrences=2))


def test_ties_of_languages(spark):
    """Two languages with the same texts: the one that sorts first."""
    rows = [(i, f"der hund lief schnell {i % 7} durch den wald", lang) for i in range(60) for lang in ("zz", "aa")]
    model = langid.train_language_model(spark.createDataFrame([(2 * i + (lang == "zz"), t, lang) for i, t, lang in rows], "doc_id long, text string, lang string"), per_language=1000, calibration_share=0.0)
    best, _, _, _ = model.predict(["der hund lief durch den wald", "hund"])
    assert [model.languages[i] for i in best] == ["aa", "aa"]


def test_ties_of_spans():
    """One place of one kind, found plainly and through a layer: the plain one is kept. Places of two kinds both count."""
    spans = decoded_secrets.scan("token=%41%41AAAAAA" + "0123456789abcdef" * 2)
    assert len({(s.start, s.end, s.kind) for s in spans}) == len(spans)
    both = decoded_secrets.scan("secret=" + "0123456789abcdef" * 2)
    assert [(s.kind, s.depth) for s in both if s.depth == 0] == [("assign", 0), ("hex", 0)]


def test_ties_of_samples(spark):
    """Texts with equal bags of words in another order have one fingerprint, whichever word a draw takes first."""
    docs = spark.createDataFrame([(1, "aa bb aa bb cc"), (2, "aa bb aa bb cc"), (3, "dd")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_with_edits(docs).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] != out[3]["fingerprint"] and out[1]["near_next"] == 1.0


def test_ties_of_labels(spark):
    """The same text under both labels, as often: the score is between them, the same for every copy, and for every run."""
    docs = spark.createDataFrame([(i, "one and the same text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    runs = [{r["score"] for r in quality_model.score_quality(docs, quality_model.train_labelled(docs, labels)).collect()} for _ in range(2)]
    assert len(runs[0]) == 1 and runs[0] == runs[1] and 0.2 < runs[0].pop() < 0.8


def test_ties_of_gains(spark):
    """Learned twice from the same rows, the list is the same, also where several thresholds part them alike."""
    rows = [(i, ("good words of a calm text here " if i % 2 else "$$ ## && ") * 20) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    one, two = (quality_rules.train_quality_rules(docs, labels) for _ in range(2))
    assert str(one) == str(two)


def test_ties_of_neighbours():
    """Of neighbours with one score the one that stands first fills the window."""
    bag = (np.array([1, 2, 3]), np.array([5, 5, 5]))
    groups = packing.pack([15, 6, 6, 6], [bag] * 4, np.ones(50), 10.0, window=21)
    assert [p[0] for p in groups[0]] == [0, 1]
