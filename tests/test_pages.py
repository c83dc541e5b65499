"""Windows and numbers of pages, times and values that fill many buckets, against plain versions; and that they are split."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import asof, candidates, insertions, pages, ranking, sampling, statistics

KEYS = ["trial_id", "page"]


@pytest.fixture(scope="module")
def data():
    """Page 0 has most rows, and half of these one time; other pages have a few."""
    rng = random.Random(11)
    hot = [(0, 0, 50 if rng.random() < 0.5 else rng.randint(0, 100), i, rng.choice([None, rng.randint(0, 9)])) for i in range(600)]
    return hot + [(rng.randint(0, 1), rng.randint(0, 20), rng.randint(0, 100), 1000 + i, i) for i in range(150)]


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "trial_id int, page long, ts long, id long, v long").cache()


def by_page(data):
    out = defaultdict(list)
    for r in data:
        out[r[:2]].append(r)
    return out


@pytest.mark.parametrize("per", [6, 40, 10_000])
def test_next_value(rows, data, per):
    got = {r["id"]: r["y"] for r in pages.next_value(rows, KEYS, ["ts", "id"], "v", "y", rows_per_bucket=per).collect()}
    for own in by_page(data).values():
        own = sorted(own, key=lambda r: (r[2], r[3]))
        for r, after in zip(own, [*own[1:], None], strict=True):
            assert got[r[3]] == (after[4] if after else None)


@pytest.mark.parametrize("per", [6, 40])
def test_next_access_with_ties(rows, data, per):
    got = defaultdict(list)
    for r in candidates.next_access(rows, rows_per_bucket=per).collect():
        got[r["trial_id"], r["page"]].append((r["ts"], r["next_ts"]))
    for page, own in by_page(data).items():
        times = sorted(r[2] for r in own)
        far = 1 << 62
        assert sorted((a, b if b is not None else far) for a, b in got[page]) == sorted((a, b if b is not None else far) for a, b in zip(times, [*times[1:], None], strict=True))


@pytest.mark.parametrize("per", [6, 40, 10_000])
def test_ordinals(rows, data, per, monkeypatch):
    got = {r["id"]: (r["ordinal"], r["before"]) for r in pages.ordinals(rows, KEYS, ["ts", "id"], rows_per_bucket=per).collect()}
    for own in by_page(data).values():
        own = sorted(own, key=lambda r: (r[2], r[3]))
        for k, r in enumerate(own):
            assert got[r[3]] == (k + 1, own[k - 1][2] if k else None)


@pytest.mark.parametrize("per", [6, 40])
def test_as_of_over_buckets(spark, rows, data, per):
    rng = random.Random(4)
    ins = [(0, rng.choice([0, 0, 0, 3]), rng.choice([50, rng.randint(-5, 110)]), i) for i in range(200)]
    i = spark.createDataFrame(ins, "trial_id int, page long, ts long, event_id long")
    after = {r["event_id"]: (r["first_ts"], r["second_ts"]) for r in asof.accesses_after(rows, i, "event_id", rows_per_bucket=per).collect()}
    before = {r["event_id"]: r["before_ts"] for r in asof.access_before(rows, i, "event_id", rows_per_bucket=per).collect()}
    times = {k: sorted(r[2] for r in own) for k, own in by_page(data).items()}
    for trial, page, t, k in ins:
        own = times.get((trial, page), [])
        later = [x for x in own if x > t]
        assert after[k] == ((later + [None, None])[0], (later + [None, None])[1])
        assert before[k] == max((x for x in own if x < t), default=None)


def test_empty_buckets_between(spark):
    """Times in two clusters, with nothing between."""
    times = [*range(100), *range(10**12, 10**12 + 100)]
    access = spark.createDataFrame([(0, 1, t) for t in times], "trial_id int, page long, ts long")
    got = {r["ts"]: r["next_ts"] for r in candidates.next_access(access, rows_per_bucket=10).collect()}
    assert got == dict(zip(times, [*times[1:], None], strict=True))


def largest(placed, by):
    return placed.groupBy(*by).count().agg(F.max("count")).first()[0]


def test_a_hot_page_is_split(spark):
    """One page of two hundred thousand rows, half of them at one time, and many small ones."""
    hot = spark.range(200_000).select(F.lit(0).alias("trial_id"), F.lit(7).cast("long").alias("page"), F.when(F.col("id") % 2 == 0, 500).otherwise(F.col("id") % 1000).cast("long").alias("ts"), "id")
    small = spark.range(20_000).select(F.lit(0).alias("trial_id"), (F.col("id") % 5000 + 100).alias("page"), "id").withColumn("ts", F.col("id")).select("trial_id", "page", "ts", "id")
    access = hot.unionByName(small)
    for order in (["ts"], ["ts", "id"]):
        paged = pages.Paged.of(access, KEYS, order, 5_000)
        assert paged.is_cut and largest(paged.rows, paged.by) <= 15_000
    plain = pages.next_value(access, KEYS, ["ts", "id"], "id", "y", rows_per_bucket=10**9)
    split = pages.next_value(access, KEYS, ["ts", "id"], "id", "y", rows_per_bucket=5_000)
    assert split.exceptAll(plain).isEmpty() and plain.exceptAll(split).isEmpty()
    gaps = insertions.insertion_ordinals(access, ["id"])
    assert gaps.count() == 220_000


def test_one_value_is_split(spark):
    """Numbers, sums and shares of a table of a single time."""
    rows = spark.range(50_000).select(F.lit(0).alias("g"), F.lit(33).cast("long").alias("v"), F.lit(2).cast("long").alias("a"), "id")
    for ties in ([], ["id"]):
        placed, is_cut = ranking.spread(rows, ["g"], ["v", *ties], rows_per_bucket=1_000)
        assert is_cut and largest(placed, ["g", "bucket"]) <= 3_000
        numbered = ranking.row_numbers(rows, ["g"], "v", ties, rows_per_bucket=1_000)
        assert numbered.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn"), F.max("n_rows")).first() == (50_000, 1, 50_000, 50_000)
        if ties:
            assert numbered.where(F.col("rn") != F.col("id") + 1).isEmpty()
        sums = ranking.prefix_sums(rows, ["g"], "v", "a", ties, rows_per_bucket=1_000)
        assert sums.agg(F.count_distinct("before"), F.min("before"), F.max("before")).first() == (50_000, 0, 99_998)
    assert statistics.ecdf(rows, "v", ["g"], ["id"]).agg(F.max("share")).first()[0] == 1.0


def test_events_of_one_time_are_split(spark, monkeypatch):
    """Ranks of probes at one time, at which half of the events stand."""
    seen = []
    windows = candidates.with_bucket
    monkeypatch.setattr(candidates, "with_bucket", lambda *a, **k: seen.append(windows(*a, **k)) or seen[-1])
    probes = spark.range(40_000).select(F.lit(0).alias("trial_id"), F.lit(500).cast("long").alias("x"), (F.col("id") % 2 * 2).cast("int").alias("side"), "id")
    events = spark.range(20_000).select(F.lit(0).alias("trial_id"), F.when(F.col("id") < 10_000, 500).otherwise(F.col("id")).cast("long").alias("ts"))
    events = events.unionByName(spark.range(100).select(F.lit(0).alias("trial_id"), F.col("id").alias("ts")))
    ranked = candidates.event_rank(probes, events, rows_per_bucket=1_000)
    assert sorted(map(tuple, ranked.groupBy("side", "rank").count().collect())) == [(0, 100, 20_000), (2, 10_100, 20_000)]
    rows = next(x for x in seen if "id" in x.columns)
    dealt = rows.where("bucket % 2 = 1").withColumn("dealt", F.pmod(F.xxhash64(*rows.columns), F.lit(candidates.SALTS)))
    assert largest(dealt, ["trial_id", "bucket", "dealt"]) <= 200


def test_bounds_in_two_levels(spark, monkeypatch):
    """Beyond the drawn values that one task may order, rough quantiles part them first."""
    monkeypatch.setattr(ranking, "IN_ONE_TASK", 500)
    monkeypatch.setattr(ranking, "PARTS", 16)
    rows = spark.range(30_000).select(F.lit(0).alias("g"), F.xxhash64("id").alias("v"), "id")
    bounds = ranking.bounds_of(rows, ["g"], "v", rows_per_bucket=100).first()["bounds"]
    assert 250 <= len(bounds) <= 400 and bounds == sorted(set(bounds))
    placed, _ = ranking.spread(rows, ["g"], ["v"], rows_per_bucket=100)
    assert largest(placed, ["g", "bucket"]) <= 300
    order = {r["id"]: r["rn"] for r in ranking.row_numbers(rows, ["g"], "v", [], rows_per_bucket=100).collect()}
    want = sorted((r["v"], r["id"]) for r in rows.collect())
    assert order == {i: k for k, (_, i) in enumerate(want, 1)}


@pytest.mark.parametrize("kind", ["long", "double", "string", "date", "decimal(20,2)"])
def test_any_type_orders(spark, kind):
    rng = random.Random(9)
    values = [None if rng.random() < 0.05 else rng.choice([rng.randint(0, 300), 42]) for _ in range(400)]
    column = F.expr("date_add(DATE'2024-01-01', cast(v as int))") if kind == "date" else F.format_string("%05d", "v") if kind == "string" else F.col("v").cast(kind)
    rows = spark.createDataFrame([(0, v, i) for i, v in enumerate(values)], "g int, v long, id long").withColumn("w", F.when(F.col("v").isNotNull(), column))
    got = {r["id"]: r["rn"] for r in ranking.row_numbers(rows, ["g"], "w", ["id"], rows_per_bucket=9).collect()}
    want = sorted(range(400), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: k for k, i in enumerate(want, 1)}


def test_many_points_of_one_trial(spark):
    """Draws are the same whether one task or many order them."""
    bands = spark.range(500).select(F.lit(0).alias("trial_id"), F.col("id").alias("key"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + F.col("id") % 4).alias("b"))
    plain = sampling.draw(bands, "a", "b", 20_000, key="key", seed=1)
    split = sampling.draw(bands, "a", "b", 20_000, key="key", seed=1, rows_per_bucket=1_000)
    assert plain.count() == 20_000 and plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()
    assert split.where("e_idx < key * 3 OR e_idx >= key * 3 + key % 4").isEmpty()


def test_shuffles(spark):
    rows = spark.range(3000).withColumn("v", F.col("id") * 2)
    one, other = (sampling.shuffled(rows, ["id"], seed) for seed in (1, 2))
    assert one.columns == ["id", "v", "place"] and sorted(r["place"] for r in one.collect()) == list(range(3000))
    moved = one.withColumnRenamed("place", "p").join(other, "id")
    assert abs(moved.stat.corr("p", "place")) < 0.1 and abs(moved.stat.corr("p", "id")) < 0.1
