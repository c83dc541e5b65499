"""Language identification with interpolated Kneser-Ney character models.

For every language a character model of order four is trained.  The models
stand side by side in one sorted hash array per order: a gram's row holds its
log probability in every language, already interpolated with the lower orders,
so that one search serves all languages.  A second array per order holds the
back-off weights of the contexts, for grams that no language has seen.  A text
gets the language with the lowest cross-entropy per character; a temperature
and a rejection threshold are calibrated on part of the training sample that
the counts don't use.

Letters are those of all Unicode.  The alphabet is that of the training rows, at
most 65,000 letters, the most frequent first; any other letter counts as one
unknown letter.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and is not accepted; ties go to the language that sorts first; with no
labelled text at all every text is ``und``; repeated rows get repeated results;
an empty table gives no rows; keys may be of any type, other columns don't
matter.  Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.shared import mapped, slices, uniform

ORDER = 4
UNKNOWN = "und"
_PAD = ORDER - 1
_WIDTH = np.uint64(16)


_OTHER, _SPACE = 0, 1  # codes of a letter outside the alphabet, and of anything but a letter
_MOST_LETTERS = 65_000


@lru_cache(1)
def _lower_letters() -> np.ndarray:
    """Code point to its lower-case letter, or to the space for anything but a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Alphabet:
    """Codes of 16 bits for the letters of the training rows, whatever their code points; all other letters are one."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters[:_MOST_LETTERS]

    def __getstate__(self) -> dict:
        return {"letters": self.letters}

    @cached_property
    def codes(self) -> np.ndarray:
        code = np.zeros(0x110000, np.uint16)
        code[self.letters] = np.arange(len(self.letters)) + 2
        code[32] = _SPACE
        return code[_lower_letters()]


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct lower-case letters of texts, and how often each occurs."""
    held = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found, n = np.unique(_lower_letters()[held], return_counts=True)
    return found[found != 32], n[found != 32]


def letter_stream(texts: list[str | None], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, runs of other characters as one space, three spaces before each text.

    Also the position where each text begins, before its three spaces, and how many letters it has.
    """
    texts = [t or "" for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    codes = alphabet.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == _SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    keep[begins] = ~blank[begins]
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[at]
    letters = np.concatenate([[0], np.cumsum(~blank, dtype=np.int64)])[at]
    begin = kept[:-1] + _PAD * np.arange(len(texts))
    out = np.full(kept[-1] + _PAD * len(texts), _SPACE, np.uint64)
    place = np.ones(len(out), bool)
    for k in range(_PAD):
        place[begin + k] = False
    out[place] = codes[keep]
    return out, begin, np.diff(letters)


def _grams(stream: np.ndarray, n: int) -> np.ndarray:
    """The gram of n characters that ends at each position from ORDER - 1 on."""
    end = len(stream)
    key = np.zeros(max(end - _PAD, 0), np.uint64)
    for k in range(_PAD - n + 1, _PAD + 1):
        key = (key << _WIDTH) | stream[k : end - _PAD + k]
    return key


@dataclass
class HashArray:
    """Keys by their hash in sorted order, with a directory over the leading bits."""

    hashes: np.ndarray
    rows: np.ndarray  # the row of each hash in the tables
    directory: np.ndarray
    shift: int
    deepest: int

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)

    @classmethod
    def of(cls, keys: np.ndarray) -> HashArray:
        h = cls._hash(keys)
        order = np.argsort(h)
        h = h[order]
        bits = max(1, int(np.ceil(np.log2(len(h) + 2))) + 1)
        starts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        deepest = int(np.diff(np.append(starts, len(h))).max(initial=0))
        return cls(np.append(h, np.zeros(max(deepest, 1), np.uint64)), np.append(order, np.zeros(max(deepest, 1), int)).astype(np.int32), starts, 64 - bits, deepest)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        h = self._hash(keys)
        at = self.directory[(h >> np.uint64(self.shift)).astype(np.int64)]
        found = np.full(len(keys), -1, np.int32)
        if not self.deepest:
            return found
        n = len(self.hashes) - max(self.deepest, 1)
        hit = (self.hashes[at] == h) & (at < n)
        found[hit] = self.rows[at[hit]]
        left = np.flatnonzero(~hit)
        for k in range(1, self.deepest):
            if not len(left):
                break
            pos = at[left] + k
            ok = (self.hashes[pos] == h[left]) & (pos < n)
            found[left[ok]] = self.rows[pos[ok]]
            left = left[~ok]
        return found


@dataclass
class LanguageModel:
    languages: list[str]
    alphabet: Alphabet
    grams: list[tuple[HashArray, np.ndarray]]  # by order: log probabilities
    contexts: list[tuple[HashArray, np.ndarray]]  # by order: log back-off weights
    floor: np.ndarray  # log probability of a character that was never seen, before the back-off weight
    temperature: float = 1.0
    accept_from: float = 0.0

    @classmethod
    def train(cls, languages: list[str], alphabet: Alphabet, lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> LanguageModel:
        """lang: index into languages, gram: key of ORDER characters, count: of the gram in that language."""
        floor = np.full(len(languages), -np.log(max(len(np.unique(gram & np.uint64(0xFFFF))), 1) + 1))
        by_lang = []
        for i in range(len(languages)):
            levels = {}
            keys, n = gram[lang == i], count[lang == i].astype(float)
            for order in range(ORDER, 0, -1):
                levels[order] = (keys, n)
                mask = np.uint64((1 << (16 * (order - 1))) - 1)
                keys, n = np.unique(keys & mask, return_counts=True)  # distinct left neighbours
                n = n.astype(float)
            by_lang.append(levels)
        grams, contexts = [], []
        below = None
        for order in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([levels[order][0] for levels in by_lang]))
            heads = np.unique(keys >> _WIDTH) if order > 1 else np.zeros(1, np.uint64)
            logp, logb = np.zeros((len(keys), len(languages)), np.float32), np.zeros((len(heads), len(languages)), np.float32)
            suffix = keys & np.uint64((1 << (16 * (order - 1))) - 1)
            for i, levels in enumerate(by_lang):
                own, n = levels[order]
                n1, n2 = (n == 1).sum(), (n == 2).sum()
                discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                head = np.searchsorted(heads, own >> _WIDTH) if order > 1 else np.zeros(len(own), int)
                total, kinds = np.bincount(head, n, len(heads)), np.bincount(head, minlength=len(heads))
                backoff = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                seen = np.zeros(len(keys))
                seen[np.searchsorted(keys, own)] = np.maximum(n - discount, 0)
                at = np.searchsorted(heads, keys >> _WIDTH) if order > 1 else np.zeros(len(keys), int)
                lower = np.exp(floor[i]) if below is None else np.exp(below[1][np.searchsorted(below[0], suffix), i])
                p = np.where(total[at] > 0, seen / np.maximum(total[at], 1), 0) + backoff[at] * lower
                logp[:, i], logb[:, i] = np.log(p), np.log(backoff)
            grams.append((HashArray.of(keys), logp))
            contexts.append((HashArray.of(heads), logb))
            below = (keys, logp.astype(float))
        return cls(list(languages), alphabet, grams, contexts, floor.astype(np.float32))

    def _log_probability(self, stream: np.ndarray, pick: np.ndarray, order: int) -> np.ndarray:
        """Of the characters at the picked positions (counted from ORDER - 1), in every language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(pick), len(self.languages)))
        key = np.zeros(len(pick), np.uint64)
        for k in range(_PAD - order + 1, _PAD + 1):
            key = (key << _WIDTH) | stream[pick + k]
        table, logp = self.grams[order - 1]
        row = table.find(key)
        out = logp[row]
        if len(left := np.flatnonzero(row < 0)):
            table, logb = self.contexts[order - 1]
            head = table.find(key[left] >> _WIDTH) if order > 1 else np.zeros(len(left), np.int32)
            out[left] = np.where((head >= 0)[:, None], logb[head], 0) + self._log_probability(stream, pick[left], order - 1)
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character in every language, and the number of letters, of each text."""
        stream, begin, letters = letter_stream(texts, self.alphabet)
        total = np.zeros((len(texts), len(self.languages)))
        ends = np.append(begin[1:], len(stream))
        owner = np.repeat(np.arange(len(texts)), ends - begin - _PAD)
        at = np.arange(len(owner)) + _PAD * owner  # position less ORDER - 1
        for k in range(0, len(at), 1 << 18):
            part, logp = owner[k : k + (1 << 18)], self._log_probability(stream, at[k : k + (1 << 18)], ORDER)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            total[part[first]] -= np.add.reduceat(logp, first, axis=0, dtype=np.float64)
        return total / np.maximum(ends - begin - _PAD, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index (-1: none), calibrated score, lowest cross-entropy, accepted."""
        entropy, letters = self.cross_entropies(texts)
        best = entropy.argmin(1)
        odds = np.exp(-self.temperature * (entropy - entropy.min(1, keepdims=True)))
        score = 1 / odds.sum(1)
        none = letters == 0
        return np.where(none, -1, best), np.where(none, 0, score), np.where(none, np.nan, entropy.min(1)), ~none & (score >= self.accept_from)

    def calibrate(self, texts: list[str], lang: np.ndarray, lose: float = 0.01) -> None:
        """Fit the temperature by likelihood; reject below the score that ``lose`` of the right answers stay under."""
        if not len(texts):
            return
        entropy, letters = self.cross_entropies(texts)
        entropy, lang = entropy[letters > 0], lang[letters > 0]
        if not len(lang):
            return
        gap, row = entropy - entropy.min(1, keepdims=True), np.arange(len(lang))
        grid = 2.0 ** np.arange(-1, 9, 0.5)
        loss = [(t * gap[row, lang] + np.log(np.exp(-t * gap).sum(1))).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        score = 1 / np.exp(-self.temperature * gap).sum(1)
        right = entropy.argmin(1) == lang
        self.accept_from = float(np.quantile(score[right], lose)) if right.any() else 0.0


def train_language_model(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, calibration_share: float = 0.25, seed: int = 11) -> LanguageModel:
    """Train on a bounded sample of labelled rows: ``per_language`` rows of each language are expected.

    The share to draw is known from the count of each language, rows are drawn by a hash of the key.
    Gram counts are summed by Spark; the driver gets the distinct grams of that bounded sample.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], Alphabet(np.zeros(0, np.uint32)), [], [], np.zeros(0, np.float32))
    share: Column = F.lit(1.0)
    for name in languages:
        share = F.when(F.col("l") == name, F.lit(min(1.0, per_language / sizes[name]))).otherwise(share)
    sample = rows.where(uniform("k", seed=seed) < share)
    held = uniform("k", seed=seed + 1) < calibration_share

    def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t")):
            letter, n = letters_of(batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(letter.astype(np.int32)), pa.array(n, pa.int64())], ["letter", "n"])

    # at most one row per letter that there is
    often = mapped(sample.where(~held), count_letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).toPandas()
    alphabet = Alphabet(often.sort_values(["n", "letter"], ascending=[False, True])["letter"].to_numpy(np.uint32))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t")):
            names = np.array(batch.column("l").to_pylist(), object)
            for name in set(names):
                stream, begin, _ = letter_stream([t for t, l in zip(batch.column("t").to_pylist(), names, strict=True) if l == name], alphabet)
                inside = np.ones(len(stream), bool)
                for k in range(_PAD):
                    inside[begin + k] = False
                keys, n = np.unique(_grams(stream, ORDER)[inside[_PAD:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["l", "gram", "n"])

    grams = mapped(sample.where(~held), count_grams, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")).toPandas()
    index = {name: i for i, name in enumerate(languages)}
    model = LanguageModel.train(languages, alphabet, grams["l"].map(index).to_numpy(int), grams["gram"].to_numpy(np.int64).view(np.uint64), grams["n"].to_numpy(np.int64))
    kept = sample.where(held).select("l", "t").toPandas()
    model.calibrate(kept["t"].tolist(), kept["l"].map(index).to_numpy(int))
    return model


def identify(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """lang_pred, score, cross_entropy (nats per character, null for ``und``) and accepted for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in (s for b in batches for s in slices(b, "t")):
            if m.languages:
                best, value, entropy, accepted = m.predict(batch.column("t").to_pylist())
            else:
                n = batch.num_rows
                best, value, entropy, accepted = np.full(n, -1), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(names[best], pa.string()), pa.array(value, pa.float64()), pa.array(entropy, pa.float64(), from_pandas=True), pa.array(accepted)], ["k", "lang_pred", "score", "cross_entropy", "accepted"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = mapped(rows, score, f"k {rows.schema['k'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, accepted boolean")
    return out.withColumnRenamed("k", key)
