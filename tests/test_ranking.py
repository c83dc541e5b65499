"""Numbers and sums through many small buckets."""

from __future__ import annotations

import random

import pytest

from pagetrail.operators import ranking, turnover


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    return [(i % 2, rng.choice([rng.randint(0, 50), 40, 10_000]), rng.randint(1, 9), i) for i in range(300)]


def test_row_numbers_and_prefix_sums(spark, data):
    rows = spark.createDataFrame(data, "g int, v long, a long, id long")
    for per in (7, 100_000):
        got = {r["id"]: r for r in ranking.row_numbers(rows, ["g"], "v", ["id"], rows_per_bucket=per).collect()}
        sums = {r["id"]: r["before"] for r in ranking.prefix_sums(rows, ["g"], "v", "a", ["id"], rows_per_bucket=per).collect()}
        for g in (0, 1):
            total = 0
            own = sorted((v, i, a) for gg, v, a, i in data if gg == g)
            for k, (_, i, a) in enumerate(own, 1):
                assert (got[i]["rn"], got[i]["n_rows"], sums[i]) == (k, len(own), total)
                total += a


def test_gaps_across_buckets(spark, data):
    rows = spark.createDataFrame([(g, v) for g, v, *_ in data], "trial_id int, ts long")
    for per in (5, 100_000):
        got = sorted((r["trial_id"], r["ts"], -1 if r["gap"] is None else r["gap"]) for r in turnover.insertion_gaps(rows, rows_per_bucket=per).collect())
        want = []
        for g in (0, 1):
            own = sorted(v for gg, v, *_ in data if gg == g)
            want += [(g, t, -1 if k == 0 else t - own[k - 1]) for k, t in enumerate(own)]
        assert got == sorted(want)


def test_empty(spark):
    rows = spark.createDataFrame([], "g int, v long, a long")
    assert ranking.row_numbers(rows, ["g"], "v", []).count() == 0 and ranking.prefix_sums(rows, ["g"], "v", "a", []).count() == 0


def test_position_bins(spark):
    rows = spark.createDataFrame([(0, i) for i in range(23)], "g int, v long")
    placed = ranking.row_numbers(rows, ["g"], "v", []).withColumn("bin", ranking.position_bin(10))
    edges = [23 * k // 10 for k in range(11)]
    want = {v: next(b for b in range(10) if edges[b] <= v < edges[b + 1]) for v in range(23)}
    assert {r["v"]: r["bin"] for r in placed.collect()} == want
