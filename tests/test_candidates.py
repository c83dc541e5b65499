"""Candidate bands against their definition, and the micro-cases that pin it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import asof, candidates, sampling

ACCESS = "trial_id int, page string, ts long, key long, pd double"
EVENTS = "trial_id int, ts long"
FAR = 1 << 62


def frames(spark, access, events):
    a = spark.createDataFrame([(0, p, t, i, float(pd)) for i, (p, t, pd) in enumerate(access)], ACCESS)
    return a, spark.createDataFrame([(0, t) for t in events], EVENTS)


def bands(spark, access, events, horizon, cap):
    a, e = frames(spark, access, events)
    return {r["key"]: (r["lo"], r["pos_lo"], r["hi"]) for r in candidates.candidate_bands(a, e, horizon=horizon, cap=cap, key="key").collect()}


def test_bounds(spark):
    got = bands(spark, [("p", 10, 0), ("p", 30, 0)], [5, 12, 25, 28, 40], 5, None)
    assert got[0] == (1, 3, 4)
    assert got[1][1] == got[1][2]  # no next access, no positives


@pytest.mark.parametrize(("cap", "n"), [(None, 3), (25, 2)])
def test_cap(spark, cap, n):
    lo, pos, hi = bands(spark, [("p", 10, 0)], [15, 30, 60], 5, cap)[0]
    assert (hi - lo, hi - pos) == (n, 0)


@pytest.mark.parametrize(("cap", "n"), [(None, 2), (30, 1)])
def test_stale(spark, cap, n):
    a, e = frames(spark, [("p1", 10, 0), ("p2", 200, 0)], [15, 90])
    r = candidates.candidate_totals(a, e, horizon=5, cap=cap).first()
    assert (r["n_pos"], r["n_neg"]) == (0, n)


def test_label_and_features(spark):
    a, e = frames(spark, [("p1", 10, 11), ("p1", 20, 22), ("p2", 100, 0)], [15])
    e = candidates.valid_evictions(a, e, 8)
    rows = sampling.sample_candidates(a, e, horizon=8, cap=8, n=6, balanced=True, key="key", seed=1, features=["pd"]).collect()
    assert len(rows) == 3 and {(r["label"], r["time_since_last_access_at_eviction"], r["pd"]) for r in rows} == {(1, 5.0, 11.0)}


def test_censoring(spark):
    a, e = frames(spark, [("p1", 5, 0), ("p1", 20, 0)], [8, 18])
    r = candidates.candidate_totals(a, candidates.valid_evictions(a, e, 10), horizon=10, cap=None).first()
    assert (r["n_pos"], r["n_neg"]) == (0, 1)


def test_features_come_from_the_access_before(spark):
    a, e = frames(spark, [("p1", 10, 11), ("p1", 70, 1), ("p2", 1000, 0)], [60])
    rows = sampling.sample_candidates(a, candidates.valid_evictions(a, e, 15), horizon=15, cap=None, n=4, balanced=False, key="key", seed=1, features=["pd"]).collect()
    assert {(r["label"], r["time_since_last_access_at_eviction"], r["pd"]) for r in rows} == {(1, 50.0, 11.0)}


def test_against_brute_force(spark):
    rng = random.Random(7)
    access, events, want = [], [], {}
    key = 0
    settings = {}
    for trial in range(20):
        horizon, cap = rng.randint(1, 29), rng.randint(5, 49) if trial % 2 else None
        settings.setdefault((horizon, cap), []).append(trial)
        own = [(f"p{rng.randint(0, 3)}", rng.randint(0, 249)) for _ in range(15)]
        ev = [rng.randint(0, 249) for _ in range(25)]
        events += [(trial, t) for t in ev]
        for p, t in own:
            access.append((trial, p, t, key, 0.0))
            key += 1
        want[trial] = (own, ev, horizon, cap)
    a, e = spark.createDataFrame(access, ACCESS), spark.createDataFrame(events, EVENTS)
    for trial, (own, ev, horizon, cap) in want.items():
        if trial % 3:
            continue  # one job each
        n_pos = n_neg = 0
        for page in {p for p, _ in own}:
            times = sorted(t for p, t in own if p == page)
            for t, after in zip(times, [*times[1:], None], strict=True):
                for x in ev:
                    inside = t < x and (after is None or x < after) and (cap is None or x < t + cap)
                    positive = inside and after is not None and after - x < horizon
                    n_pos, n_neg = n_pos + positive, n_neg + (inside and not positive)
        one = candidates.candidate_totals(a.where(F.col("trial_id") == trial), e.where(F.col("trial_id") == trial), horizon=horizon, cap=cap).first()
        assert (one["n_pos"], one["n_neg"]) == (n_pos, n_neg)


def test_draw_stays_in_its_band(spark):
    b = spark.createDataFrame([(0, 0, 100, 100), (0, 1, 200, 203), (0, 2, 300, 300), (0, 3, 400, 402)], "trial_id int, key long, a long, b long")
    rows = sampling.draw(b, "a", "b", 500, key="key", seed=3).collect()
    assert len(rows) == 500 and {r["key"] for r in rows} == {1, 3}
    assert {r["e_idx"] for r in rows} == {200, 201, 202, 400, 401}
    assert sampling.draw(b.withColumn("b", F.col("a")), "a", "b", 10, key="key", seed=3).count() == 0


def test_as_of_with_ties(spark):
    rng = random.Random(3)
    access = [(0, f"p{rng.randint(0, 2)}", rng.randint(0, 12), i, 0.0) for i in range(40)]
    ins = [(0, f"p{rng.randint(0, 3)}", rng.randint(0, 12), i) for i in range(25)]
    a, i = spark.createDataFrame(access, ACCESS), spark.createDataFrame(ins, "trial_id int, page string, ts long, event_id long")
    after = {r["event_id"]: (r["first_ts"], r["second_ts"]) for r in asof.accesses_after(a, i, "event_id").collect()}
    before = {r["event_id"]: r["before_ts"] for r in asof.access_before(a, i, "event_id").collect()}
    again = {r["event_id"]: r["is_reaccessed"] for r in asof.reaccessed(a, i).collect()}
    for _, page, t, k in ins:
        later = sorted(x for _, p, x, *_ in access if p == page and x > t)
        assert after[k] == ((later + [None, None])[0], (later + [None, None])[1])
        assert before[k] == max((x for _, p, x, *_ in access if p == page and x < t), default=None)
        assert again[k] == bool(later)
