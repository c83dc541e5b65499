"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the total of all sizes by weight; a target stops at a multiple
of its source's size and the excess is reshared.  A source takes as many
complete epochs as fit its target; the rest of the target is a weighted sample
without replacement: each document gets an exponential key divided by its
quality weight, and documents are taken in key order until the prefix sum of
their sizes reaches the budget.  The document at the budget is taken in part.

Keys come from hashes of the document id, so that reruns agree.  The row at
which a budget ends is found in two steps: sums per source and bin of the key,
whose bounds are quantiles of the source's keys, then rows inside the one bin
where the budget ends; a source is never sorted in one task.  After that a row
knows from its own key how much of it is taken, so that no text is shuffled.
DataFrame functions only.

Defined results: a null text has size 0 and takes 0; a null source is a source
of its own, last in order; equal keys are ordered by id (null first), then by
size; rows that agree in all of these are taken in turn; a source of size 0 has
target 0; texts are counted and copied whole, however long; other columns may
have any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.llm.kd_shards import with_slots
from pagetrail.llm.shared import by_position, cut
from pagetrail.operators.ranking import bucket_sums, bucketed

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MOST_BROADCAST = 200_000  # sources


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """Between 0.25 and 1: less for texts with many symbols to the word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    share = F.least(F.coalesce(symbols / F.nullif(words, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    return F.lit(1.0) - F.lit(0.75) * share


def exponential_key(key: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight, with u in (0, 1) from 48 bits of the MD5 of the id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def targets_of(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """The target of each source. Sources count in code point order, null last; weights repeat."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, budget, target = list(names), float(sum(sizes.values())), {}
    while left:
        rate = budget / sum(weight[s] for s in left)
        full = [s for s in left if rate * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: rate * weight[s] for s in left}
        for s in full:
            target[s] = most * sizes[s]
            budget -= target[s]
        left = [s for s in left if s not in target]
    return target


def _small(table: DataFrame, n: int) -> DataFrame:
    """A table of n rows, sent to all executors while it is small; beyond that the join is left to Spark."""
    return F.broadcast(table) if n <= MOST_BROADCAST else table


def _plan(rows: DataFrame, weights: tuple[float, ...], most: float, rows_per_bin: int) -> tuple[DataFrame, int, bool] | None:
    """rows: k, source, size, es_key.  Per source: its number s_no, s_name, source_size, target, epochs, and the row at which
    the budget ends, as ``cut`` (null where nothing is left after the epochs), with ``left``, what of the budget remains
    there.  With it, how many sources there are, and whether several rows agree with such a row.  None without rows.

    The driver sees one row per source.
    """
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    if not stats:
        return None
    sizes = {r["source"]: int(r["size"] or 0) for r in stats}
    target = targets_of(sizes, weights, most)
    plan = []
    for number, (name, own) in enumerate(sizes.items()):
        epochs = min(int(target[name] // own), int(most)) if own else 0
        plan.append((number, name, own, target[name], epochs, round(target[name]) - epochs * own if own else 0))
    spark = rows.sparkSession
    table = spark.createDataFrame(plan, "s_no int, s_name string, source_size long, target double, epochs long, budget long")
    small = _small(table.where("budget > 0").select("s_no", "s_name", "budget"), len(plan))
    placed = rows.join(small, F.col("source").eqNullSafe(F.col("s_name"))).select("s_no", "k", "size", "es_key", "budget")
    placed = bucketed(placed, ["s_no"], "es_key", rows_per_bucket=rows_per_bin)
    ends = bucket_sums(placed, ["s_no"], F.col("size")).join(table.select("s_no", F.col("budget").alias("goal")), "s_no")
    ends = ends.where("offset < goal AND offset + amount >= goal").select(F.col("s_no").alias("e_no"), F.col("bucket").alias("e_bucket"), "offset")
    inner = placed.join(_small(ends, len(plan)), (F.col("s_no") == F.col("e_no")) & (F.col("bucket") == F.col("e_bucket")))
    # rows that agree in all of the order are one step of the prefix sum
    steps = inner.groupBy("s_no", "es_key", "k", "size").agg(F.count("*").alias("ties"), F.max("budget").alias("budget"), F.max("offset").alias("offset"))
    running = F.sum(F.col("size") * F.col("ties")).over(Window.partitionBy("s_no").orderBy("es_key", "k", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = steps.withColumn("end", F.col("offset") + running).withColumn("left", F.col("budget") - F.col("end") + F.col("size") * F.col("ties"))
    last = steps.where("left > 0 AND end >= budget").select("s_no", F.struct("es_key", "k", "size").alias("cut"), "left", "ties")
    found = last.collect()
    columns = ["s_no", "s_name", "source_size", "target", "epochs", "cut", "left"]
    cuts = _small(spark.createDataFrame(found, last.schema), len(plan))
    return table.join(cuts, "s_no", "left").select(*columns), len(plan), any(r["ties"] > 1 for r in found)


def _taken(rows: DataFrame, plan: tuple[DataFrame, int, bool]) -> DataFrame:
    """rows: k, source, size, es_key and others. Adds source_size, target and taken."""
    table, sources, ties = plan
    names = rows.columns
    met = rows.join(_small(table, sources), F.col("source").eqNullSafe(F.col("s_name")))
    me = F.struct("es_key", "k", "size")
    met = met.withColumn("side", F.when(F.col("cut").isNull() | (me > F.col("cut")), 1).when(me < F.col("cut"), -1).otherwise(0))
    if ties:
        turn = with_slots(met.where("side = 0"), "s_no", ["size"])
        met = met.where("side <> 0").withColumn("slot", F.lit(0).cast("long")).unionByName(turn)
    else:
        met = met.withColumn("slot", F.lit(0).cast("long"))
    part = F.greatest(F.least(F.col("left") - F.col("slot") * F.col("size"), F.col("size")), F.lit(0))
    part = F.when(F.col("side") < 0, F.col("size")).when(F.col("side") > 0, F.lit(0)).otherwise(part)
    taken = (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    return met.select(*names, "source_size", F.round("target", 6).alias("target"), taken)


def mix_sources(rows: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "size", weight: str = "weight", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, rows_per_bin: int = 20_000) -> DataFrame:
    """rows: with key, source, size (long) and weight (double). Adds source_size, target and taken (long)."""
    names, kept = rows.columns, [f"c{i}" for i in range(len(rows.columns))]
    placed, k, s, n, w = by_position(rows, key, source, size, weight)
    placed = cut(placed.select(*kept, F.col(k).alias("k"), F.col(s).alias("source"), F.col(n).alias("size"), exponential_key(F.col(k), F.col(w)).alias("es_key")))
    plan = _plan(placed, weights, most, rows_per_bin)
    if plan is None:
        return rows.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long")})
    return _taken(placed, plan).select(*kept, "source_size", "target", "taken").toDF(*names, "source_size", "target", "taken")


def _sized(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Adds k, source, size and es_key."""
    sized = rows.withColumns({"k": F.col(key), "source": F.col(source), "size": word_count(F.col(text))})
    return sized.withColumn("es_key", exponential_key(F.col("k"), F.coalesce(quality_weight(F.col(text), F.col("size")), F.lit(1.0))))


def mix_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, rows_per_bin: int = 20_000) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    rows, k, t, s = by_position(docs, key, text, source)
    rows = cut(_sized(rows, k, t, s).select("k", "source", "size", "es_key"))
    plan = _plan(rows, weights, most, rows_per_bin)
    if plan is None:
        return rows.select(F.col("k").alias("doc_id"), "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    return _taken(rows, plan).select(F.col("k").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, rows_per_bin: int = 20_000) -> DataFrame:
    """The mix itself, with the columns of docs: whole copies, and the cut copy of the document where a budget ends."""
    rows, k, t, s = by_position(docs, key, text, source)
    sized = _sized(rows, k, t, s)
    plan = _plan(cut(sized.select("k", "source", "size", "es_key")), weights, most, rows_per_bin)
    if plan is None:
        return docs
    taken = _taken(sized, plan).where("taken > 0")
    body, size = F.col(t), F.col("size")
    whole = F.floor(F.col("taken") / size).cast("int")
    rest = (F.col("taken") - whole * size).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(rest, F.lit(0))), " ")
    copies = F.concat(F.array_repeat(body, whole), F.when(rest > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    out = taken.withColumn("copy", F.explode(copies))
    columns = {text: F.col("copy"), "n_chars": F.length("copy").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {text: F.col("copy")}
    return out.select(*(columns.get(c, F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(docs.columns))).toDF(*docs.columns)
