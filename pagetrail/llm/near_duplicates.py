"""Near-duplicate classes with order MinHash.

Shingles are runs of five words (ASCII letters lowered), labelled with their
occurrence so that repeats count.  Each sample of a sketch takes the two
shingles with the least hash values and keeps them in text order, which makes
it sensitive to edits and to moved passages.  ``BANDS`` groups of ``ROWS``
samples are keys; texts that share a key are candidates.

Candidates are compared by alignment of their shingle sequences within the
band that the threshold leaves: the longest common subsequence M of sequences
of lengths a and b must reach M / (a + b - M) >= 0.8.  The labelled shingles of
a text are distinct, so that M is a longest increasing run of match positions.

Equal texts become one node first, named by the MD5 of their bytes.  In a group
of nodes with an equal key, all are compared with one leader.  Nodes of groups
that still hold different components afterwards are compared where they share a
rare shingle: by the prefix filter, which loses no link, two texts that are near
share one of the rarest 20% of their shingles.  The lists of nodes by rare
shingle are worked off in rounds: a round compares a few members of each list
(about 32, then 480, ... as long as a list has more) with those behind them, then
components are formed anew and lists that lie within one component are left out.
So all pairs of a list are compared only where its texts are not near each other.

Defined results: null texts count as empty; all texts without words and equal
bytes are copies; texts of one to four words have one shingle of all words;
repeated rows are copies of each other; ties of leaders go to the greater node;
class ids are the least doc_id of the class, null only where none of its rows has
one; keys may be of any type that can be ordered; whole texts are compared,
however long; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.components import connected_components
from pagetrail.llm.shared import SMALL_SLICE, by_position, cut, mapped, slices, uniform
from pagetrail.llm.words import Words, keyed, mix64, windows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 2
_GROUP = 64  # members that one copy of a leader's text serves
_SLOTS = 1 << 18  # counters by which shingles are ordered; their number bounds what the driver gets
_LEADERS, _FURTHER = 32, 16  # members of a list that the first round compares with the others; how many times more each round takes


def labelled_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingles of all texts in text order, and text boundaries."""
    words = Words.of(column)
    hashes = words.hashes(lower=True)
    grams, owner, at = windows(hashes, words.word_at, SHINGLE)
    few = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(SHINGLE - 1):
            pos, there = words.word_at[few] + k, words.counts[few] > k
            short[there] = mix64(short[there] * np.uint64(31) + hashes[pos[there]])
        grams, owner = np.concatenate([grams, short]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
        at = np.searchsorted(owner, np.arange(len(words.counts) + 1))
    own = keyed(grams, owner)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(own) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    times = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    occurrence = np.zeros(len(own), np.uint64)
    occurrence[order] = times.astype(np.uint64)
    # also where no text of the slice repeats a shingle: a label tells nothing of the texts beside it
    return mix64(grams + occurrence * np.uint64(0x9FB21C651E98DF25)), at


def sketch_keys(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The band keys of each text that has shingles, as rows."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    begin, owner = at[:-1][full], np.repeat(np.arange(len(full)), sizes[full])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    keys = np.zeros((len(full), BANDS), np.uint64)
    if not len(full):
        return keys
    salts = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
    for band in range(BANDS):
        for row in range(ROWS):
            x = (shingles ^ salts[band * ROWS + row]) * (salts[-1 - band * ROWS - row] | np.uint64(1))
            least = np.minimum.reduceat(x, begin)
            first = np.flatnonzero(x == least[owner])
            first = first[np.concatenate([[True], owner[first][1:] != owner[first][:-1]])]
            x[first] = top
            second_value = np.minimum.reduceat(x, begin)
            second = np.flatnonzero(x == second_value[owner])
            second = second[np.concatenate([[True], owner[second][1:] != owner[second][:-1]])]
            ahead = first <= second
            one, two = np.where(ahead, least, second_value), np.where(ahead, second_value, least)
            keys[:, band] = mix64(keys[:, band] * np.uint64(31) + mix64(one) * np.uint64(3) + two)
    return mix64(keys + np.arange(BANDS, dtype=np.uint64))


def aligned_similarity(a: np.ndarray, b_sorted: np.ndarray, b_order: np.ndarray, threshold: float) -> float:
    """Of labelled shingle sequences, by alignment within the band that the threshold allows; 0.0 if it can't be reached.

    a: a sequence; b_sorted, b_order: the other one sorted, with the position of each."""
    n, m = len(a), len(b_order)
    if not n or not m:
        return 0.0
    needed = math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    width = max(n, m) - needed
    if width < 0 or min(n, m) < needed:
        return 0.0
    at = np.searchsorted(b_sorted, a)
    at[at == m] = m - 1
    hit = b_sorted[at] == a
    i = np.flatnonzero(hit)
    j = b_order[at[i]]
    inside = np.abs(i - j) <= width
    j = j[inside]
    if len(j) < needed:
        return 0.0
    if len(j) > 1 and (j[1:] < j[:-1]).any():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    else:
        common = len(j)
    return common / (n + m - common)


def _node(text: str) -> Column:
    """What names a text: the MD5 of its bytes, of none if it is null."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, node (of the text's bytes), n (shingles), keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t", SMALL_SLICE)):
            shingles, at = labelled_shingles(batch.column("t"))
            keys, full = sketch_keys(shingles, at), np.diff(at) > 0
            ends = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("node"), pa.array(np.diff(at), pa.int32()), listed], ["k", "node", "n", "keys"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), _node(text).alias("node"))
    return mapped(rows, work, f"k {rows.schema['k'].dataType.simpleString()}, node binary, n int, keys array<long>")


def _texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, repeated: bool) -> DataFrame:
    """node and text t of the wanted nodes, from the row of each whose key is rep. repeated: several rows may be that row."""
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts = texts.withColumn("own", _node("t"))
    found = texts.join(wanted.select("rep", "node"), F.col("k").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("node"))).select("node", "t")
    return cut(found.dropDuplicates(["node"]) if repeated else found)


def _compared(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs: node, lead. Returns those that reach the threshold as a, b, similarity.

    A leader's text goes once to each group of up to ``_GROUP`` members, not to each member.
    """
    sizes = cut(pairs.groupBy("lead").agg(F.ceil(F.count("*") / _GROUP).cast("long").alias("groups")), small=True)
    members = pairs.join(sizes, "lead").select("lead", F.pmod(F.xxhash64("node"), "groups").alias("part"), F.lit(1).alias("role"), "node")
    leaders = sizes.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(0).alias("role"), F.col("lead").alias("node"))
    dealt = members.unionByName(leaders).join(texts, "node").select("lead", "part", "role", "node", "t")
    dealt = dealt.repartition("lead", "part").sortWithinPartitions("lead", "part", "role", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead_sorted, lead_order = None, None, None
        for batch in (s for b in batches for s in slices(b, "t", SMALL_SLICE)):
            shingles, at = labelled_shingles(batch.column("t"))
            a, b, sim = [], [], []
            heads = zip(*(batch.column(c).to_pylist() for c in ("lead", "part", "role", "node")), strict=True)
            for i, (lead, part, role, node) in enumerate(heads):
                own = shingles[at[i] : at[i + 1]]
                if role == 0:
                    order = np.argsort(own)
                    now, lead_sorted, lead_order = (lead, part), own[order], order
                elif now == (lead, part) and (s := aligned_similarity(own, lead_sorted, lead_order, threshold)) >= threshold:
                    a.append(node)
                    b.append(lead)
                    sim.append(s)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    return mapped(dealt, work, "a binary, b binary, similarity double")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - _SLOTS.bit_length() + 1)).astype(np.int64)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """About how often each shingle occurs: a counter for each of ``_SLOTS`` ranges of hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for batch in (s for b in batches for s in slices(b, "t", SMALL_SLICE)):
            total += np.bincount(_slot(labelled_shingles(batch.column("t"))[0]), minlength=_SLOTS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["slot", "n"])

    found = mapped(texts.select("t"), work, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # a row per slot at most
    out = np.zeros(_SLOTS, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """shingle, node, n, place for the prefix of each text's shingles.

    Any one order of all shingles will do for the prefix filter; rare ones come first here, as far as counters tell,
    since their lists are short.  A near pair shares 80% of the shingles of either text, so that it shares one within
    the first 20% (and one) of each.  A text is ordered inside its task; no exchange gathers shingles by text.
    """
    often = texts.sparkSession.sparkContext.broadcast(_frequencies(texts))  # _SLOTS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t", SMALL_SLICE)):
            shingles, at = labelled_shingles(batch.column("t"))
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((shingles, often.value[_slot(shingles)], owner))
            place = np.arange(len(owner)) - at[owner] + 1
            length = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            kept = place <= length[owner]
            owner, place, shingles = owner[kept], place[kept], shingles[order][kept]
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), batch.column("node").take(pa.array(owner)), pa.array(size[owner], pa.int32()), pa.array(place, pa.int32())], ["shingle", "node", "n", "place"])

    return mapped(texts.select("node", "t"), work, "shingle long, node binary, n int, place int")


def _with_components(rows: DataFrame, components: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """A node without links is a component of its own. merged: node, component of components that became one later."""
    out = rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if merged is None:
        return out
    later = merged.select(F.col("node").alias("component"), F.col("component").alias("later"))
    return out.join(later, "component", "left").withColumn("component", F.coalesce("later", "component")).drop("later")


def _rest_compared(texts: DataFrame, pairs: DataFrame, links: DataFrame, components: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """texts: of the nodes that leaders left open; pairs: compared already. Returns links with those that texts with a
    common rare shingle add, and which components these join."""
    joins = merged = None
    work = cut(_prefixes(texts, threshold))
    low, high = 0, _LEADERS
    while True:
        placed = _with_components(work.select("shingle", "node", "n", "place"), components, merged)
        apart = placed.groupBy("shingle").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y"))
        apart = apart.where((F.col("x") != F.col("y")) & (F.col("c") > low)).select("shingle", "c")
        # lists stay whole while they are open; the same nodes lead in all lists, so that their pairs are found once
        work = cut(placed.join(apart, "shingle").withColumn("u", uniform("node") * F.col("c")), small=True)
        if work.isEmpty():
            return links, merged
        lead = work.where(F.col("u").between(low, high) & (F.col("u") < high)).select("shingle", F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("place").alias("lead_place"), F.col("component").alias("lead_component"), F.col("u").alias("lead_u"))
        # from the first shingle that a pair shares on, enough must be left in both
        enough = 1 + F.least(F.col("n") - F.col("place"), F.col("lead_n") - F.col("lead_place")) >= F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("lead_n")) - 1e-9)
        behind = F.struct("u", "node") > F.struct("lead_u", "lead")
        more = work.join(lead, "shingle").where(behind & (F.col("component") != F.col("lead_component")) & enough).select("node", "lead").distinct()
        either = pairs.unionByName(pairs.select(F.col("lead").alias("node"), F.col("node").alias("lead")))
        more = cut(more.join(either, ["node", "lead"], "left_anti"), small=True)
        extra = cut(_compared(texts, more, threshold), small=True)
        if not extra.isEmpty():
            links = links.unionByName(extra)
            ends = _with_components(extra.select(F.col("a").alias("node"), "b"), components).select(F.col("component").alias("a"), F.col("b").alias("node"))
            ends = _with_components(ends, components).select("a", F.col("component").alias("b"))
            joins = ends if joins is None else joins.unionByName(ends)
            merged = connected_components(joins)
        pairs = pairs.unionByName(more)
        low, high = high, high * _FURTHER


def _classes(docs: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (k, node) and one row per node: node, class_id, class_size, n_links, first (the node that stands for the class)."""
    base = cut(_sketched(docs, key, text))
    repeated = not base.groupBy("k", "node").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    # equal texts have equal keys
    nodes = cut(base.groupBy("node").agg(F.min("k").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    bands = nodes.select("node", "n", F.explode("keys").alias("band"))
    groups = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    shared = cut(bands.join(groups, "band"))
    # the leader of a group is the text that meets most others over all groups, as it stands nearest to the middle
    led = shared.join(shared.groupBy("node").agg(F.sum("c").alias("met")), "node")
    leaders = led.groupBy("band").agg(F.max(F.struct("met", "node", "n")).alias("x")).select("band", F.col("x.node").alias("lead"), F.col("x.n").alias("lead_n"))
    near_size = F.least("n", "lead_n") >= threshold * F.greatest("n", "lead_n")
    pairs = cut(shared.join(leaders, "band").where((F.col("node") != F.col("lead")) & near_size).select("node", "lead").distinct(), small=True)
    grouped = shared.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = _texts_of(docs, grouped, key, text, repeated)
    links = cut(_compared(texts, pairs, threshold))
    components = connected_components(links)
    # what one leader didn't join: nodes of groups that hold several components
    placed = _with_components(shared.select("band", "node"), components)
    open_bands = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    left = cut(placed.join(open_bands, "band", "left_semi").select("node").distinct(), small=True)
    merged = None
    if not left.isEmpty():
        links, merged = _rest_compared(cut(texts.join(left, "node")), pairs, links, components, threshold)
    placed = _with_components(nodes.select("node", "rep", "copies"), components, merged)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    # the text with the least key stands for its class, one without a key only where no text of the class has one
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("least")
    totals = placed.groupBy("component").agg(least, F.sum("copies").alias("class_size"))
    totals = totals.select("component", F.col("least.rep").alias("class_id"), F.col("least.node").alias("first"), "class_size")
    classes = placed.join(totals, "component").join(degree, "node", "left").select("node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("node") == F.col("first")).alias("first"))
    return base.select("k", "node"), cut(classes, small=True)


def near_duplicate_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, class_id, class_size (documents), n_links (of its text to other texts that were
    verified), representative (its id is the class id)."""
    base, classes = _classes(docs, key, text, threshold)
    out = base.join(classes, "node")
    return out.select(F.col("k").alias(key), "class_id", "class_size", "n_links", F.col("k").eqNullSafe(F.col("class_id")).alias("representative"))


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the least key, with the columns of docs.

    Documents are found again by key and text, as keys may be null or stand at different texts."""
    base, classes = _classes(docs, key, text, THRESHOLD)
    kept = base.join(classes.where("first").select("node", "class_id"), "node").where(F.col("k").eqNullSafe(F.col("class_id")))
    kept = cut(kept.groupBy("k", "node").agg(F.count("*").alias("n_rows")), small=True)
    rows, k, t = by_position(docs, key, text)
    own = rows.withColumn("own", _node(t))
    out = own.join(kept, own[k].eqNullSafe(kept["k"]) & (own["own"] == kept["node"]), "left_semi")
    if not kept.where("n_rows > 1").isEmpty():  # repeated rows of one key and text
        out = out.dropDuplicates([k, "own"])
    return out.drop("own").toDF(*docs.columns)
