"""Spelling variants: words at edit distance one, by self-joins of tries with active-node sets.

Words are counted over all texts.  Two words differ by one edit at a place: where the shorter one, of m characters, stops
being the beginning of the other.  A vocabulary is dealt by windows: a group holds the words of m and m + 1 characters
that have the same prefix in front of a window and the same suffix behind it, and looks for pairs whose place lies in the
window.  First the window is the second half of the words (parts of the trie below one prefix) or the first half (parts of
the reversed trie).  Groups of more than ``rows_per_trie`` words are dealt again with each half of their window until they
are small or their window is one place wide; then they hold at most as many words as an alphabet has letters, and their
square.  Every pair has one place and so is found once.

A group builds a trie of what its words have inside the window and walks it from the root.  Each node knows its active
nodes, those at distance one, from its parent's: an active node stays, as the other side has one letter more; siblings
(another letter), own children (a letter less) and the children of the parent's active nodes by the same letter.  Words
that end in a node and in an active node of it are a pair.

Defined results: a null text has no words; a null id counts as an empty one in the checksum that deletes a letter; repeated
rows count as often as they stand there; a word that lost its only letter is no word; of near words of one count the
smallest in code point order is the form; words with no near words have no form and are their own root; texts are read
whole, whatever their length; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.shared import cut, mapped

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
LETTERS, OCCURRENCES, TIMES, DELETES = 6, 5, 5, 199
_HELD = 300_000


def runs_of(text: str | None) -> Counter:
    """The letter runs of a text in lower case (A to Z only)."""
    return Counter(_RUN.findall((text or "").translate(_LOWER)))


def thinned(run: str, name: str) -> str:
    """The run as it counts in the document of that name: one in 199 loses the letter that its checksum points at."""
    h = zlib.crc32(f"{name}:{run}".encode())
    at = h % len(run)
    return run if h % DELETES else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n. Counted in each task before they are shuffled."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for name, value in zip(batch.column("k").to_pylist(), batch.column("t"), strict=True):
                prefix = zlib.crc32(f"{name}:".encode())
                for run, n in runs_of(value.as_py()).items():
                    h = zlib.crc32(run.encode(), prefix)
                    counts[run if h % DELETES else thinned(run, name)] += n
                if len(counts) > _HELD:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    counted = mapped(rows, work, "word string, n long").where(F.length("word") >= letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places (of distinct words) at edit distance one, each in both orders."""
    children: list[dict[str, int]] = [{}]
    ends = {}
    for i, word in enumerate(words):
        node = 0
        for c in word:
            nxt = children[node].get(c)
            if nxt is None:
                nxt = children[node][c] = len(children)
                children.append({})
            node = nxt
        ends[node] = i
    waiting: list[tuple[int, list[int]]] = [(0, list(children[0].values()))]
    while waiting:
        node, active = waiting.pop()
        own = ends.get(node)
        if own is not None:
            for other in active:
                if other in ends:
                    yield own, ends[other]
        below = children[node]
        for c, child in below.items():
            near = [node]
            near += [x for x in below.values() if x != child]
            near += children[child].values()
            near += [x for x in (children[v].get(c) for v in active) if x is not None]
            waiting.append((child, list(dict.fromkeys(near))))


def place_of(short: str, long: str) -> int:
    """Where the shorter word stops being the beginning of the other, its last letter at most."""
    at = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return min(at, len(short) - 1)


def window_pairs(rows: Iterable[tuple[str, int]], m: int, begin: int, end: int) -> Iterator[tuple[str, int, str, int]]:
    """rows: words with their counts that agree in front of and behind the window. Pairs whose shorter word has m letters and
    whose place lies in the window, each in both orders."""
    held = list(rows)
    inside = [word[begin : len(word) - (m - end)] for word, _ in held]
    for i, j in trie_pairs(inside):
        (a, n_a), (b, n_b) = held[i], held[j]
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if len(short) == m and begin <= place_of(short, long) < end:
            yield a, n_a, b, n_b


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds what the words of a group share: m, the window, the prefix in front of it and the suffix behind it."""
    behind = F.col("m") - F.col("end")
    return rows.withColumn("prefix", F.expr("left(word, begin)")).withColumn("suffix", F.when(behind > 0, F.expr("right(word, m - end)")).otherwise(""))


_GROUP = ["m", "begin", "end", "prefix", "suffix"]


def _windows(words: DataFrame, rows_per_trie: int) -> Iterator[DataFrame]:
    """Groups that are small enough, round by round; larger ones have their windows halved."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    half = F.expr("int(ceil(m / 2))")
    both = F.explode(F.array(F.struct(half.alias("begin"), F.col("m").alias("end")), F.struct(F.lit(0).alias("begin"), half.alias("end"))))
    rows = words.select("word", "n", lengths.alias("m")).where("m > 0").select("*", both.alias("w")).select("word", "n", "m", "w.begin", "w.end").where("begin < end")
    while True:
        rows = _keyed(rows)
        sizes = rows.groupBy(*_GROUP).agg(F.count("*").alias("size")).where((F.col("size") > rows_per_trie) & (F.col("end") - F.col("begin") > 1))
        large = cut(sizes.select(*_GROUP), small=True)
        if large.isEmpty():
            yield rows
            return
        yield rows.join(large, _GROUP, "left_anti")
        middle = F.expr("int((begin + end) / 2)")
        halves = F.explode(F.array(F.struct("begin", middle.alias("end")), F.struct(middle.alias("begin"), "end")))
        rows = cut(rows.join(large, _GROUP, "left_semi").select("word", "n", "m", halves.alias("w")).select("word", "n", "m", "w.begin", "w.end"), small=True)


def near_words(words: DataFrame, rows_per_trie: int = 20_000) -> DataFrame:
    """words: word (distinct) and n. Per word that has near words: n_near, the most frequent of these and its count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (*_GROUP, "word", "n")), strict=True))
        out: list[tuple] = []
        for (m, begin, end, _, _), group in groupby(rows, key=lambda row: row[:5]):
            for pair in window_pairs(((r[5], r[6]) for r in group), m, begin, end):
                out.append(pair)
                if len(out) >= 50_000:
                    yield made(out)
                    out = []
        yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        a, _, b, n_b = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n_b, pa.int64())], ["word", "other", "other_n"])

    pairs = None
    for rows in _windows(words, rows_per_trie):
        sorted_rows = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).select(*_GROUP, "word", "n")
        part = mapped(sorted_rows, work, "word string, other string, other_n long")
        pairs = part if pairs is None else pairs.unionByName(part)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.n")).alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word and form, which may be null. Adds root, the last word that forms lead to. Counts grow along forms, so that
    they have no cycles; each round doubles the steps that a word has followed."""
    up = cut(forms.select("word", "form", F.coalesce("form", "word").alias("root")), small=True)
    while True:
        further = up.where("form IS NOT NULL").select(F.col("word").alias("via"), F.col("root").alias("further"))
        nxt = up.join(further, up["root"] == further["via"], "left").select("word", "form", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        nxt = cut(nxt, small=True)
        moved = not nxt.where("moved").isEmpty()
        up = nxt.drop("moved")
        if not moved:
            return up


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, rows_per_trie: int = 20_000) -> DataFrame:
    """Per word: form, root, n, n_near, form_n. A word's form is its most frequent near word, if that occurs ``times`` as often."""
    words = cut(word_counts(docs, key=key, text=text, letters=letters, occurrences=occurrences), small=True)
    near = words.join(near_words(words, rows_per_trie), "word", "left")
    enough = F.col("other_n") >= times * F.col("n")
    found = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("other")).alias("form"), F.when(enough, F.col("other_n")).alias("form_n"))
    found = cut(found, small=True)
    return found.join(roots(found).select("word", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")
