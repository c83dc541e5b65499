"""Candidates: evictions between an access and the next access of its page.

The interval join is never materialised.  Every access asks for three ranks
among the sorted evictions of its trial: where its band begins (``lo``), where
positives begin (``pos_lo``) and where it ends (``hi``).  Ranks are prefix sums:
events of one time are counted, probes and events are put into buckets of time
that hold about as many rows each, buckets are summed, and only the rows of one
bucket are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.operators.pages import next_value
from pagetrail.operators.quantiles import quantiles
from pagetrail.operators.ranking import ROWS_PER_BUCKET, bounds_of, row_numbers, with_bucket

#: Order among equal times: a probe that counts events before it, the event, a probe that counts events up to it.
BEFORE, EVENT, UP_TO = 0, 1, 2
FAR = (1 << 63) - 1  # the time of a probe without an end
SALTS = 1024
LAST = (1 << 31) - 1
TIMES_PER_ARRAY, ACCESSES_PER_PART, PAIRS_PER_TASK, MOST_TASKS = 4096, 5_000, 20_000_000, 20_000
PARTS_PER_TASK = 4


def next_access(access: DataFrame, keys: tuple[str, ...] = ("trial_id", "page"), *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds next_ts, the next access of the same page; null if there is none."""
    return next_value(access, list(keys), ["ts"], "ts", "next_ts", rows_per_bucket=rows_per_bucket)


def valid_evictions(access: DataFrame, eviction: DataFrame, horizon: int) -> DataFrame:
    """Right-censoring: evictions that leave a whole horizon before the last access of their trial."""
    last = access.groupBy("trial_id").agg(F.max("ts").alias("last_ts"))
    return eviction.join(F.broadcast(last), "trial_id").where(F.col("ts") <= F.col("last_ts") - horizon).drop("last_ts")


def temporal_split(eviction: DataFrame, holdout: float) -> DataFrame:
    """Adds is_eval: the trial's evictions from the (1 - holdout) quantile on; never with holdout 0 or under two events."""
    cut = quantiles(eviction, ["trial_id"], "ts", {"cut": 1.0 - holdout}).join(eviction.groupBy("trial_id").agg(F.count("*").alias("n")), "trial_id")
    enough = (F.lit(holdout) > 0) & (F.col("n") >= 2)
    # one row per trial, which would else gather all events of a trial in one task
    return eviction.join(F.broadcast(cut), "trial_id").withColumn("is_eval", enough & (F.col("ts") >= F.col("cut"))).drop("cut", "n")


def _ranked(rows: DataFrame, events: DataFrame, spread: DataFrame, rows_per_bucket: int) -> DataFrame:
    """rows: trial_id, x, side and more; events: trial_id, x and n, how many stand at that time. Adds rank: the events of the
    trial ahead of the row.

    A time with very many rows has a bucket of its own, whose rows need no order: those on side UP_TO have all its events
    ahead, the others none of them.  So have rows without an end.  A hash of the row deals these out.
    """
    bounds = bounds_of(spread, ["trial_id"], "x", rows_per_bucket=rows_per_bucket)
    bucket = lambda df: with_bucket(df, bounds, ["trial_id"], "x").withColumn("bucket", F.when(F.col("x") == FAR, LAST).otherwise(F.col("bucket")))
    extra = [c for c in rows.columns if c not in ("trial_id", "x", "side")]
    marks = bucket(events)
    # every bucket has a size, also one without events
    empty = events.select("trial_id").distinct().select("trial_id", F.lit(LAST).alias("bucket"), F.lit(0).cast("long").alias("n"))
    if bounds is not None:
        empty = empty.unionByName(bounds.select("trial_id", F.explode(F.sequence(F.lit(0), 2 * F.size("bounds"))).alias("bucket"), F.lit(0).cast("long").alias("n")))
    sizes = marks.select("trial_id", "bucket", "n").unionByName(empty).groupBy("trial_id", "bucket").agg(F.sum("n").alias("in_bucket"))
    before = Window.partitionBy("trial_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("trial_id", "bucket", "in_bucket", F.sum("in_bucket").over(before).alias("ahead"))
    marks = marks.select("trial_id", "x", F.lit(EVENT).alias("side"), "n", "bucket", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra))
    both = bucket(rows).withColumn("n", F.lit(0).cast("long")).unionByName(marks)
    alone = F.col("bucket") % 2 == 1
    dealt = both.withColumn("dealt", F.when(alone, F.pmod(F.xxhash64(*both.columns), F.lit(SALTS))).otherwise(0))
    inside = F.sum("n").over(Window.partitionBy("trial_id", "bucket", "dealt").orderBy("x", "side"))
    own = F.when(~alone, F.col("inside")).when(F.col("side") == UP_TO, F.col("in_bucket")).otherwise(0)
    ranked = dealt.withColumn("inside", inside).where(F.col("side") != EVENT).join(ahead, ["trial_id", "bucket"], "left")
    return ranked.select(*rows.columns, (F.coalesce("ahead", F.lit(0)) + F.coalesce(own, F.lit(0))).alias("rank"))


def event_rank(probes: DataFrame, events: DataFrame, *, rows_per_bucket: int = ROWS_PER_BUCKET, spread: DataFrame | None = None) -> DataFrame:
    """probes: trial_id, x, side and more. Adds rank: events of the trial with ts < x, or <= x where side is UP_TO.

    A null x ranks behind all events.  spread: a cheaper table of trial_id and x, spread over time like the probes and
    events, from which the bounds of buckets are taken.
    """
    counted = events.groupBy("trial_id", F.col("ts").alias("x")).agg(F.count("*").alias("n"))
    both = probes.select("trial_id", "x").unionByName(events.select("trial_id", F.col("ts").alias("x")))
    ranked = _ranked(probes.withColumn("x", F.coalesce("x", F.lit(FAR))), counted, both if spread is None else spread, rows_per_bucket)
    return ranked.withColumn("x", F.nullif("x", F.lit(FAR)))


def band_points(horizon: int, cap: int | None) -> dict[str, Column]:
    """The three probes of an access with next_ts, as (x, side), already in order lo <= pos_lo <= hi.

    Ranks grow with their probes, so that ordering the probes orders the ranks.  A null x comes last.
    """
    far = F.lit(FAR)
    end = F.least("next_ts", F.col("ts") + cap) if cap is not None else F.col("next_ts")
    point = lambda x, side: F.struct(x.alias("x"), F.lit(side).alias("side"))
    lo = point(F.col("ts"), UP_TO)
    hi = F.greatest(point(F.coalesce(end, far), BEFORE), lo)
    pos = F.when(F.col("next_ts").isNull(), hi).otherwise(F.least(F.greatest(point(F.col("next_ts") - horizon, UP_TO), lo), hi))
    return {"lo": lo, "pos_lo": pos, "hi": hi}


def _probes(access: DataFrame, horizon: int, cap: int | None, keep: list[str]) -> DataFrame:
    points = F.explode(F.array(*(F.struct(F.lit(name).alias("probe"), p.alias("p")) for name, p in band_points(horizon, cap).items())))
    return access.select("trial_id", *keep, points.alias("q")).select("trial_id", *keep, F.col("q.probe").alias("probe"), F.expr("nullif(q.p.x, 9223372036854775807L)").alias("x"), F.col("q.p.side").alias("side"))


def _spread(access: DataFrame, eviction: DataFrame) -> DataFrame:
    """Times of accesses and evictions, near which the three probes of an access fall."""
    return access.select("trial_id", F.col("ts").alias("x")).unionByName(eviction.select("trial_id", F.col("ts").alias("x")))


def candidate_totals(access: DataFrame, eviction: DataFrame, *, horizon: int, cap: int | None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """trial_id, n_pos, n_neg. Sums of ranks are enough, so that no access is put together again: probes of one time are
    counted before they are ranked, and a rank is multiplied by how often hi, pos_lo and lo stand there."""
    probes = _probes(next_access(access, rows_per_bucket=rows_per_bucket), horizon, cap, [])
    places = {name: F.count_if(F.col("probe") == name) for name in ("lo", "pos_lo", "hi")}
    asked = probes.groupBy("trial_id", F.coalesce("x", F.lit(FAR)).alias("x"), "side").agg(*(n.alias(name) for name, n in places.items()))
    counted = eviction.groupBy("trial_id", F.col("ts").alias("x")).agg(F.count("*").alias("n"))
    ranked = _ranked(asked, counted, _spread(access, eviction), rows_per_bucket)
    total = lambda upper, lower: F.sum((F.col(upper) - F.col(lower)) * F.col("rank"))
    return ranked.groupBy("trial_id").agg(total("hi", "pos_lo").alias("n_pos"), total("pos_lo", "lo").alias("n_neg"))


def candidate_bands(access: DataFrame, eviction: DataFrame, *, horizon: int, cap: int | None, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per access, named by key: lo, pos_lo and hi, as ranks among the evictions of its trial."""
    accesses = next_access(access, rows_per_bucket=rows_per_bucket)
    ranked = event_rank(_probes(accesses, horizon, cap, [key]), eviction, rows_per_bucket=rows_per_bucket, spread=_spread(access, eviction))
    return ranked.groupBy("trial_id", key).agg(*(F.max(F.when(F.col("probe") == name, F.col("rank"))).alias(name) for name in ("lo", "pos_lo", "hi")))


def candidate_pairs(access: DataFrame, eviction: DataFrame, *, horizon: int, cap: int | None, slot: int) -> DataFrame:
    """The join itself: each access with each of its candidates and the label.

    A band join: an access goes to all slots of time (``slot`` long) that its band touches, and meets the evictions of
    these only.  An access without an end is followed up to the last eviction of its trial.  Evictions of a slot stand in
    arrays of at most ``TIMES_PER_ARRAY`` times, accesses of a slot are dealt to parts, and there are as many tasks as the
    number of comparisons asks for, so that memory is bounded.  Slots are counted once, by a job while the plan is built,
    which gives the driver those of several parts, some ``PARTS_PER_TASK`` for each task at most.  Evictions are numbered
    only if some slot needs several arrays.  The output itself grows with accesses times evictions.
    """
    last = eviction.groupBy("trial_id").agg(F.max("ts").alias("last_eviction"))
    end = F.coalesce(F.least("next_ts", F.col("ts") + cap) if cap is not None else F.col("next_ts"), F.lit((1 << 63) - 1))
    a = next_access(access).join(F.broadcast(last), "trial_id").withColumn("band_end", F.least(end, F.col("last_eviction") + 1)).where(F.col("band_end") > F.col("ts")).drop("last_eviction")
    a = a.withColumn("slot", F.explode(F.sequence(F.floor(F.col("ts") / slot), F.floor((F.col("band_end") - 1) / slot))))
    here = ["trial_id", "slot"]
    in_slot = lambda df: df.withColumn("slot", F.floor(F.col("ts") / slot))
    e = eviction.select("trial_id", "ts")
    accesses = a.groupBy(*here).agg(F.count("*").alias("accesses"))
    met = in_slot(e).groupBy(*here).agg(F.count("*").alias("evictions")).join(accesses, here, "left")
    work = F.coalesce(F.col("accesses") * F.col("evictions"), F.lit(0))
    parts = F.least(F.ceil(F.col("accesses") / ACCESSES_PER_PART), F.ceil(work * PARTS_PER_TASK / PAIRS_PER_TASK)).cast("int")
    met = met.select(*here, "evictions", work.alias("work"), parts.alias("parts"))
    wide = met.select(*here, "parts")
    found = met.agg(F.sum("work").alias("work"), F.max("evictions").alias("most"), F.collect_list(F.when(F.col("parts") > 1, F.struct(*wide.columns))).alias("wide")).first()
    tasks = int(min(MOST_TASKS, max(1, -(-(found["work"] or 0) // PAIRS_PER_TASK))))
    wide = F.broadcast(access.sparkSession.createDataFrame(found["wide"], wide.schema))
    # of the accesses of a page at one time only the last has a band
    part = F.coalesce(F.pmod(F.xxhash64("page", "ts"), F.col("parts")), F.lit(0)).cast("int")
    dealt = a.join(wide, here, "left").withColumn("part", part).drop("parts").repartition(tasks, *here, "part")
    several = (found["most"] or 0) > TIMES_PER_ARRAY
    e = in_slot(row_numbers(e, ["trial_id"], "ts", []) if several else e).withColumn("array", F.floor(F.col("rn") / TIMES_PER_ARRAY) if several else F.lit(0))
    e = e.groupBy(*here, "array").agg(F.collect_list("ts").alias("times"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    arrays = e.join(wide, here, "left").select(*here, "times", "first", "last", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")).repartition(tasks, *here, "part")
    arrays = arrays.select(*(F.col(c).alias(f"e_{c}") for c in arrays.columns))
    same = (F.col("trial_id") == F.col("e_trial_id")) & (F.col("slot") == F.col("e_slot")) & (F.col("part") == F.col("e_part"))
    joined = dealt.join(arrays, same & (F.col("e_last") > F.col("ts")) & (F.col("e_first") < F.col("band_end")))
    pairs = joined.select(*access.columns, "next_ts", "band_end", F.explode("e_times").alias("e_ts")).where((F.col("e_ts") > F.col("ts")) & (F.col("e_ts") < F.col("band_end"))).drop("band_end")
    return pairs.withColumn("label", F.coalesce((F.col("next_ts") - F.col("e_ts") < horizon).cast("int"), F.lit(0)))
