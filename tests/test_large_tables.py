"""What keeps jobs on large tables bounded: cells instead of rows, arrays of times, splits without a sort, few rows of few trials."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from pagetrail.operators import candidates, features, sampling, statistics
from pagetrail.plans import training


def test_pairs_through_small_arrays_and_parts(spark, monkeypatch):
    for name, value in (("TIMES_PER_ARRAY", 3), ("ACCESSES_PER_PART", 2), ("PAIRS_PER_TASK", 10)):
        monkeypatch.setattr(candidates, name, value)
    rng = random.Random(4)
    access = [(t, f"p{rng.randint(0, 3)}", rng.randint(0, 99)) for t in (0, 1) for _ in range(20)]
    events = [(t, rng.choice([rng.randint(0, 99), 50])) for t in (0, 1) for _ in range(30)]
    a, e = spark.createDataFrame(access, "trial_id int, page string, ts long"), spark.createDataFrame(events, "trial_id int, ts long")
    for cap in (15, None):
        want = []
        for page in {x[:2] for x in access}:
            times = sorted(x[2] for x in access if x[:2] == page)
            for t, after in zip(times, [*times[1:], None], strict=True):
                want += [(*page, t, x, int(after is not None and after - x < 8)) for k, x in events if k == page[0] and t < x and (after is None or x < after) and (cap is None or x < t + cap)]
        got = candidates.candidate_pairs(a, e, horizon=8, cap=cap, slot=10)
        assert sorted(tuple(r) for r in got.select("trial_id", "page", "ts", "e_ts", "label").collect()) == sorted(want)


def test_slots_are_counted_once_and_columns_not_asked_for_stay_behind(spark):
    a = spark.createDataFrame([(0, f"p{t % 3}", t, float(t)) for t in range(40)], "trial_id int, page string, ts long, unused double")
    e = spark.createDataFrame([(0, t) for t in range(40)], "trial_id int, ts long")
    pairs = candidates.candidate_pairs(a, e, horizon=8, cap=15, slot=10).select("page", "ts", "e_ts")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # one window for the next access; none for a second count of the slots, or for numbers of evictions that fit one array
    assert sum("Window [" in line for line in plan) == 1
    assert not any("unused" in line for line in plan if "Project" in line or "xxhash64" in line)


def test_pairs_of_tied_accesses_through_parts(spark, monkeypatch):
    for name, value in (("ACCESSES_PER_PART", 2), ("PAIRS_PER_TASK", 10)):
        monkeypatch.setattr(candidates, name, value)
    rng = random.Random(5)
    times = {p: sorted(rng.choice([7, 7, 21, rng.randint(0, 60)]) for _ in range(15)) for p in ("p", "q", "r")}
    events = [rng.choice([8, 22, rng.randint(0, 99)]) for _ in range(40)]
    a = spark.createDataFrame([(0, p, t) for p, of in times.items() for t in of], "trial_id int, page string, ts long")
    e = spark.createDataFrame([(0, t) for t in events], "trial_id int, ts long")
    for cap in (15, None):
        want = [(p, t, x) for p, of in times.items() for t, after in zip(of, [*of[1:], 1000], strict=True) for x in events if t < x < after and (cap is None or x < t + cap)]
        got = candidates.candidate_pairs(a, e, horizon=8, cap=cap, slot=10)
        assert sorted(tuple(r) for r in got.select("page", "ts", "e_ts").collect()) == sorted(want)
        assert candidates.candidate_pairs(a, e.limit(0), horizon=8, cap=cap, slot=10).count() == candidates.candidate_pairs(a.limit(0), e, horizon=8, cap=cap, slot=10).count() == 0


def test_split_counts_each_class_also_null(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(300)], "id long, c int")
    for share, n in ((0.2, 20), (0.0, 0), (1.0, 100)):
        for per in (1_000_000, 0):
            got = sampling.stratified_split(rows, share, "c", ["id"], 1, **({"rows_per_bucket": 1} if per == 0 else {}))
            assert got.count() == 300 and {r["c"]: r["n"] for r in got.groupBy("c").agg(F.count_if("is_test").alias("n")).collect()} == {None: n, 1: n, 2: n}


def test_cells_stand_for_rows(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(rng.randint(0, 1), float(rng.randint(0, 4))) for _ in range(500)], "label int, p double")
    cells = features.cells_of(rows, ["label", "p"])
    assert cells.count() == 10 and statistics.roc_auc(cells, "label", "p", "n").first() == statistics.roc_auc(rows, "label", "p").first()
    assert training.pair_balance(cells, "n").first() == training.pair_balance(rows).first()


def test_many_edges(spark):
    x = [float(i) / 3 for i in range(300)] + [float("nan")]
    rows = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    for n in (2, 10, 60):
        edges = np.linspace(0, 90, n + 1).tolist()
        got = [r["x_bin"] for r in features.discretise(rows, {"x": edges}).collect()]
        assert got == [*np.searchsorted(edges[1:-1], x, side="right").tolist(), None]


def test_rows_of_a_trial_are_not_gathered(spark):
    a = spark.createDataFrame([(0, "p", t) for t in range(9)], "trial_id int, page string, ts long")
    e = spark.createDataFrame([(0, t) for t in range(9)], "trial_id int, ts long")
    for rows in (candidates.valid_evictions(a, e, 2), candidates.temporal_split(e, 0.2)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.splitlines()[0] and "strategy=broadcast" in plan
