"""Reproducible draws: every random choice is an MD5 of what is drawn and a seed, never of the partitioning, so that
any engine with MD5 draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrail.operators.candidates import candidate_bands
from pagetrail.operators.pages import Paged
from pagetrail.operators.ranking import ROWS_PER_BUCKET, bucket_sums, row_numbers

PARTS = 4096
SPLIT_PARTS = 1 << 16


def random_bits(*cols: Column | str, seed: int) -> Column:
    """A long from 0 to 2**60 - 1: the first 15 hex digits of the MD5 of ``seed:value:value...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hashed(*cols: Column | str, seed: int) -> Column:
    """A uniform number in [0, 1)."""
    return F.shiftright(random_bits(*cols, seed=seed), 8) * F.lit(2.0**-52)


def draw(bands: DataFrame, start: str, stop: str, n: int, *, key: str, seed: int, stream: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """n pairs per trial, with replacement, uniform over all pairs (record, position in [start, stop)).

    Returns trial_id, draw, key and e_idx.  Records are ranges on the line of all pairs, dealt to ``PARTS`` buckets by a
    hash of their keys and ordered by key inside; a draw is a point on the line and finds its range by an as-of lookup:
    first among the sums of the buckets, then inside one bucket.  A trial without pairs gives none.
    """
    width = F.greatest(F.col(stop) - F.col(start), F.lit(0))
    ranges = bands.select("trial_id", key, F.col(start).alias("start"), width.alias("n_pairs")).where("n_pairs > 0")
    placed = ranges.withColumn("bucket", random_bits(key, seed=0) % PARTS)
    sums = bucket_sums(placed, ["trial_id"], F.col("n_pairs"))
    # n draws for each trial: one total per trial meets the numbers of the draws
    totals = sums.where("offset = 0").select("trial_id", "total")
    draws = totals.crossJoin(bands.sparkSession.range(n).withColumnRenamed("id", "draw"))
    points = draws.select("trial_id", "draw", (random_bits(F.lit(stream), "trial_id", "draw", seed=seed) % F.col("total")).alias("at"), F.lit(1).alias("kind"))
    marks = sums.select("trial_id", F.col("offset").alias("at"), F.lit(0).alias("kind"), "bucket", "offset")
    order = lambda *by: Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(points, allowMissingColumns=True)
    mark = F.when(F.col("bucket").isNotNull(), F.struct("offset", "bucket"))
    # the points of a trial and its marks are put in order by several tasks where there are many
    paged = Paged.of(both.withColumn("mark", mark), ["trial_id"], ["at", "kind"], rows_per_bucket) if n > rows_per_bucket else None
    if paged is not None and paged.is_cut:
        ahead = F.coalesce(F.max("mark").over(paged.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_earlier")
        marked = paged.carrying(_earlier=(F.col("mark"), "before")).withColumn("last", ahead)
    else:
        marked = both.withColumn("last", F.last(mark, ignorenulls=True).over(order("trial_id")))
    found = marked.select("trial_id", "draw", "at", "kind", "last.bucket", "last.offset")
    found = found.where("kind = 1").select("trial_id", "bucket", "draw", (F.col("at") - F.col("offset")).alias("at"), "kind")
    own = Window.partitionBy("trial_id", "bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.withColumn("at", F.coalesce(F.sum("n_pairs").over(own), F.lit(0)))
    spans = spans.select("trial_id", "bucket", "at", F.lit(0).alias("kind"), F.struct(key, "start", "at").alias("span"))
    hit = F.last("span", ignorenulls=True).over(order("trial_id", "bucket"))
    out = spans.unionByName(found, allowMissingColumns=True).withColumn("hit", hit).where("kind = 1")
    return out.select("trial_id", "draw", F.col(f"hit.{key}").alias(key), (F.col("hit.start") + F.col("at") - F.col("hit.at")).alias("e_idx"))


def sample_candidates(access: DataFrame, eviction: DataFrame, *, horizon: int, cap: int | None, n: int, balanced: bool, key: str, seed: int, features: list[str], bands: DataFrame | None = None) -> DataFrame:
    """Sampled (access, eviction) rows per trial: label, the features of the access, and the time since it.

    key: a number that names one access. bands: those of the accesses, where they are there already."""
    if bands is None:
        bands = candidate_bands(access, eviction, horizon=horizon, cap=cap, key=key)
    if balanced:
        positive = draw(bands, "pos_lo", "hi", n // 2, key=key, seed=seed, stream=1).withColumn("label", F.lit(1))
        negative = draw(bands, "lo", "pos_lo", n - n // 2, key=key, seed=seed, stream=2).withColumn("label", F.lit(0))
        drawn = positive.unionByName(negative)
    else:
        drawn = draw(bands, "lo", "hi", n, key=key, seed=seed, stream=3).join(bands.select("trial_id", key, "pos_lo"), ["trial_id", key])
        drawn = drawn.withColumn("label", (F.col("e_idx") >= F.col("pos_lo")).cast("int")).drop("pos_lo")
    numbered = row_numbers(eviction.select("trial_id", "ts"), ["trial_id"], "ts", []).select("trial_id", (F.col("rn") - 1).alias("e_idx"), F.col("ts").alias("e_ts"))
    out = drawn.join(numbered, ["trial_id", "e_idx"]).join(access.select("trial_id", key, "ts", *features), ["trial_id", key])
    return out.withColumn("time_since_last_access_at_eviction", (F.col("e_ts") - F.col("ts")).cast("float")).select("trial_id", "draw", key, "e_idx", "e_ts", "label", *features, "time_since_last_access_at_eviction")


def choose(rows: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    """n rows without replacement: those with the least hashes, which are numbered in buckets."""
    ranked = row_numbers(rows.withColumns({"draw_hash": hashed(*key, seed=seed), "draw_all": F.lit(0)}), ["draw_all"], "draw_hash", key)
    return ranked.where(F.col("rn") <= n).select(*rows.columns)


def shuffled(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Adds place, from 0: a permutation of all rows by the hashes of their keys."""
    ranked = row_numbers(rows.withColumns({"draw_hash": hashed(*key, seed=seed), "draw_all": F.lit(0)}), ["draw_all"], "draw_hash", key)
    return ranked.withColumn("place", F.col("rn") - 1).drop("rn", "n_rows", "draw_hash", "draw_all")


def random_split(rows: DataFrame, share: float, key: list[str], seed: int) -> DataFrame:
    """Adds is_test, true for about that share of the rows."""
    return rows.withColumn("is_test", hashed(*key, seed=seed) < share)


def stratified_split(rows: DataFrame, share: float, by: str, key: list[str], seed: int, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds is_test, true for that share of each class (null is one), exactly up to rounding.

    Rows are counted by ranges of their hash while the plan is built; only the range in which the share ends is put in order.
    """
    placed = rows.withColumn("split_hash", hashed(*key, seed=seed)).withColumn("split_part", F.floor(F.col("split_hash") * SPLIT_PARTS).cast("int"))
    counts = placed.groupBy(F.col(by).alias("split_by"), "split_part").agg(F.count("*").alias("split_n"))
    own = Window.partitionBy("split_by").orderBy("split_part")
    summed = counts.withColumns({"split_upto": F.sum("split_n").over(own), "split_all": F.sum("split_n").over(Window.partitionBy("split_by"))})
    left = F.floor(F.col("split_all") * share + 0.5) - F.col("split_upto") + F.col("split_n")
    ends = summed.withColumn("split_left", left).where("split_left >= 0 AND split_left < split_n").select("split_by", F.col("split_part").alias("split_end"), "split_left", "split_n")
    found = ends.collect()  # one row per class; none where the whole class is drawn
    ends = rows.sparkSession.createDataFrame(found, ends.schema)
    met = placed.join(F.broadcast(ends), F.col(by).eqNullSafe(F.col("split_by")), "left").drop("split_by")
    inside = F.coalesce(F.col("split_part") == F.col("split_end"), F.lit(False))
    # classes by name, as a null class is one too
    within = met.where(inside).withColumn("split_class", F.to_json(F.struct(by)))
    if any(r["split_n"] > rows_per_bucket for r in found):
        within = row_numbers(within, ["split_class"], "split_hash", key, rows_per_bucket=rows_per_bucket)
    else:
        within = within.withColumn("rn", F.row_number().over(Window.partitionBy("split_class").orderBy("split_hash", *key)))
    clear = met.where(~inside).select(*rows.columns, F.coalesce(F.col("split_part") < F.col("split_end"), F.lit(True)).alias("is_test"))
    return clear.unionByName(within.select(*rows.columns, (F.col("rn") <= F.col("split_left")).alias("is_test")))


def random_pairs(spark: SparkSession, rows: DataFrame, target: str, features: list[str], n: int, *, order: list[str], seed: int) -> DataFrame:
    """n random pairs of different rows: <feature>_a, <feature>_b, label: whether the first has the lower target.

    Ties of the target are dropped.  Rows are found by number; the second number is a shift of the first, so that a
    row never meets itself.
    """
    numbered = row_numbers(rows.withColumn("all", F.lit(0)), ["all"], order[0], order[1:]).select((F.col("rn") - 1).alias("i"), target, *features)
    total = rows.count()
    if total < 2:
        raise ValueError("pairs need two rows at least")
    pairs = spark.range(n).select(F.col("id").alias("pair"), (random_bits("id", seed=seed) % total).alias("a"), (random_bits("id", seed=seed + 1) % (total - 1)).alias("step"))
    pairs = pairs.withColumn("b", F.pmod(F.col("a") + 1 + F.col("step"), F.lit(total)))
    side = lambda s: numbered.select(F.col("i").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in (target, *features)))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col(f"{target}_a") != F.col(f"{target}_b"))
    return joined.withColumn("label", (F.col(f"{target}_a") < F.col(f"{target}_b")).cast("int")).drop("step")
