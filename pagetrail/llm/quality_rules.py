"""Quality rules: learned decision lists over document statistics.

Sequential covering grows one conjunction of thresholds after the other on two
thirds of a labelled sample, prunes each on the remaining third, and keeps it
while it is precise there.  The list becomes an ordered Spark ``CASE WHEN``.

Defined results: a null or empty text has zero statistics and fails the base
rule for short texts; ratios over no words are 0; repeated rows get repeated
verdicts; without labelled rows of both classes the list is empty, so that only
the base rules decide; of repeated labels of a key the least is learned, and one
row of each key; ties of tests go to the feature that stands first; an empty table
gives no rows.  Statistics cover whole texts, however long.  Columns whose names
clash with those that are added are an error that asks for another prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.shared import SMALL_SLICE, by_position, mapped, slices, uniform
from pagetrail.llm.words import Words, keyed, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_bytes")
#: Features of rules as Spark SQL over the counts.
FEATURES = {
    "n_words": "n_words * 1.0D",
    "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0D)",
    "symbols_per_word": "coalesce(n_symbols / nullif(n_words, 0), 0D)",
    "duplicate_line_share": "coalesce(n_dup_lines / nullif(n_lines, 0), 0D)",
    "repeated_word_share": "coalesce(n_repeat_words / nullif(n_words, 0), 0D)",
    "upper_share": "coalesce(n_upper / nullif(word_chars, 0), 0D)",
    "marks_per_word": "coalesce(n_marks / nullif(n_words, 0), 0D)",
    "words_per_line": "coalesce(n_words / nullif(n_lines, 0), 0D)",
}

_WORD_CHAR = np.ones(256, bool)
_WORD_CHAR[[32, *range(9, 14), *range(0x80, 0xC0)]] = False  # not spaces, not continuation bytes
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:")] = True


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    words = Words.of(column)
    n, hashes = len(column), words.hashes()
    # lines: cut at newlines and at text boundaries
    breaks = np.flatnonzero(words.data == 10)
    begin = np.unique(np.concatenate([words.text_at[:-1], breaks + 1]))
    begin = begin[begin < len(words.data)]
    end = np.minimum(np.append(begin[1:], len(words.data)), len(words.data))
    end[np.isin(end - 1, breaks)] -= 1  # without the newline
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[full], end[full]
    line_owner = np.searchsorted(words.text_at, begin, side="right") - 1
    _, pick = np.unique(keyed(words.span_hashes(begin, end), line_owner), return_index=True)
    lines = np.bincount(line_owner, minlength=n)
    # words in windows of three that stand there twice or more
    grams, owner, at = windows(hashes, words.word_at, 3)
    _, index, times = np.unique(keyed(grams, owner), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[index] > 1)
    first = twice - at[owner[twice]] + words.word_at[owner[twice]]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[first + k] = True
    return {
        "n_words": words.counts,
        "word_chars": words.count_bytes(_WORD_CHAR),
        "n_symbols": words.count_bytes(_SYMBOL),
        "n_dup_lines": lines - np.bincount(line_owner[pick], minlength=n),
        "n_repeat_words": np.bincount(words.owner[covered], minlength=n),
        "n_lines": lines,
        "n_upper": words.count_bytes(_UPPER),
        "n_marks": words.count_bytes(_MARK),
        "n_bytes": np.diff(words.text_at),
    }


def with_statistics(docs: DataFrame, *, text: str = "text", prefix: str = "") -> DataFrame:
    """The rows with the counts of their texts added; clashing names are avoided with a prefix."""
    at, width = docs.columns.index(text), len(docs.columns)
    rows = docs.toDF(*(f"c{i}" for i in range(width)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, f"c{at}", SMALL_SLICE)):
            found = text_statistics(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c], pa.int64()) for c in COUNTS)], [*batch.schema.names, *(f"s{i}" for i in range(len(COUNTS)))])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"s{i} long" for i in range(len(COUNTS))])
    return mapped(rows, work, schema).toDF(*docs.columns, *(f"{prefix}{c}" for c in COUNTS))


def base_failed(prefix: str = "", least_words: int = 50, most_repeated: int = 50) -> Column:
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < least_words) | (100 * repeated > most_repeated * words)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def sql(self, prefix: str = "") -> str:
        return f"{_prefixed(FEATURES[self.feature], prefix)} {'>' if self.above else '<='} {self.threshold!r}D"


def _prefixed(expression: str, prefix: str) -> str:
    for c in COUNTS if prefix else ():
        expression = expression.replace(c, prefix + c)
    return expression


Rule = tuple[Test, ...]


def _gain(before: tuple[int, int], after: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """FOIL's information gain of narrowing from (p, n) to (p, n)."""
    p, n = after
    with np.errstate(divide="ignore", invalid="ignore"):
        got = p * (np.log2(p / (p + n)) - np.log2(before[0] / sum(before)))
    return np.where(p > 0, got, -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most_tests: int) -> Rule:
    inside, rule = np.ones(len(y), bool), ()
    while len(rule) < most_tests and (y[inside] == 0).any():
        best, best_gain = None, 1e-9
        have = int(y[inside].sum()), int((~y[inside].astype(bool)).sum())
        for j, name in enumerate(names):
            v = x[inside, j]
            order = np.argsort(v, kind="stable")
            v, p, n = v[order], np.cumsum(y[inside][order]), np.cumsum(1 - y[inside][order])
            edge = np.flatnonzero(v[1:] > v[:-1])
            if not len(edge):
                continue
            for above, got in ((False, (p[edge], n[edge])), (True, (p[-1] - p[edge], n[-1] - n[edge]))):
                gain = _gain(have, got)
                if gain[i := int(np.argmax(gain))] > best_gain:
                    best, best_gain = Test(name, above, float((v[edge[i]] + v[edge[i] + 1]) / 2)), gain[i]
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x, names)
    return rule


def _covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.holds(x, names)
    return out


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    """Drop final tests while (p - n) / (p + n) on the pruning rows doesn't fall."""

    def worth(r: Rule) -> float:
        hit = _covered(r, x, names)
        p, n = y[hit].sum(), (1 - y[hit]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], *, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, least: int = 2, seed: int = 3) -> list[Rule]:
    """Rules for bad rows, in the order learned. x: features by column; bad: 0 or 1."""
    rng, rules = np.random.default_rng(seed), []
    left = np.arange(len(bad))
    bad = bad.astype(int)
    while bad[left].sum() >= least and len(rules) < most_rules:
        draw = rng.permutation(left)
        split = -(-2 * len(draw) // 3)
        grow, prune = draw[:split], draw[split:]
        rule = _prune(_grow(x[grow], bad[grow], names, most_tests), x[prune], bad[prune], names)
        hit = _covered(rule, x[left], names) if rule else np.zeros(len(left), bool)
        check = _covered(rule, x[prune], names) if rule else np.zeros(len(prune), bool)
        if hit.sum() < least or bad[left][hit].mean() < precision or check.any() and bad[prune][check].mean() < precision:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def train_quality_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 12_000, seed: int = 29, **options) -> list[Rule]:
    """Learn from a bounded sample: ``rows`` labelled documents are expected, drawn by a hash of the key.

    Texts that fail the base rules already are left out.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.col(label).cast("int")).alias("y"))
    share = rows / max(known.count(), 1)
    drawn = known.where(uniform("k", seed=seed) < share) if share < 1 else known
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if share < 1:
        texts = texts.where(uniform("k", seed=seed) < share)
    joined = texts.join(F.broadcast(drawn), "k")  # bounded by ``rows``
    stats = with_statistics(joined, text="t").where(~base_failed())
    one = stats.groupBy("k").agg(F.min(F.struct("y", *COUNTS)).alias("one")).select("k", "one.*")  # of repeated rows
    sample = one.select("k", "y", *(F.expr(e).alias(f) for f, e in FEATURES.items())).toPandas().sort_values("k", kind="stable")
    names = list(FEATURES)
    return learn_rules(sample[names].to_numpy(float), (sample["y"] == 0).to_numpy(), names, **options)


def rejected_by(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    chain = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        chain = F.when(F.expr(" AND ".join(t.sql(prefix) for t in rules[i - 1])), F.lit(i)).otherwise(chain)
    return chain


def _judged(docs: DataFrame, rules: list[Rule], text: str) -> tuple[DataFrame, list[str]]:
    """The rows by position (c0, c1, ...), then counts, base_failed, rule and kept under names that no column has."""
    rows, t = by_position(docs, text)
    out = with_statistics(rows, text=t, prefix="x_")
    out = out.withColumns({"x_base_failed": base_failed("x_"), "x_rule": rejected_by(rules, "x_")})
    return out.withColumn("x_kept", ~F.col("x_base_failed") & F.col("x_rule").isNull()), [*COUNTS, "base_failed", "rule", "kept"]


def judge(docs: DataFrame, rules: list[Rule], *, text: str = "text", prefix: str = "") -> DataFrame:
    """The rows with counts, base_failed, rule (the first learned rule that rejects) and kept. A column of docs whose name
    is one of these with the prefix is an error; choose another prefix."""
    out, added = _judged(docs, rules, text)
    if clash := sorted({c.lower() for c in docs.columns} & {f"{prefix}{c}".lower() for c in added}):
        raise ValueError(f"columns {', '.join(clash)} are there already; choose another prefix")
    return out.toDF(*docs.columns, *(f"{prefix}{c}" for c in added))


def keep_good(docs: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """The rows that are kept, with the columns of docs, whatever their names."""
    out, _ = _judged(docs, rules, text)
    return out.where("x_kept").select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
