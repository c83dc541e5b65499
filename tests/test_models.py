"""Turnover, features, statistics and training."""

from __future__ import annotations

import json
import math
import random
from statistics import NormalDist, fmean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrail.cli import parser
from pagetrail.functions import scalars, student
from pagetrail.operators import epochs, features, statistics, turnover
from pagetrail.plans import training
from pagetrail.sources.binary_logs import first_trial, trial_logs
from pagetrail.streaming.active_time import active_sessions
from tests.test_sources import write

MS, NS = 1_000_000, 1_000_000_000


def turnover_frames(spark, evictions):
    times = [i * MS for i in range(100)] + [10 * NS + i * MS for i in range(100)]
    ins = spark.createDataFrame([(0, t) for t in times], "trial_id int, ts long")
    access = spark.createDataFrame([(0, 20 * NS)], "trial_id int, ts long")
    return access, spark.createDataFrame([(0, times[150] - MS // 2)] if evictions else [], "trial_id int, ts long"), ins


def test_turnover(spark):
    row = turnover.turnover_estimate(*turnover_frames(spark, True), second=NS).first()
    assert (row["capacity_pages"], row["n_insertions"], row["capacity_estimated"], row["problem"]) == (150, 200, True, None)
    assert row["active_seconds"] == pytest.approx(0.198) and row["insertion_rate"] == pytest.approx(199 / 0.198) and row["turnover_seconds"] == pytest.approx(150 / (199 / 0.198))
    given = turnover.turnover_estimate(*turnover_frames(spark, True), second=NS, capacity=600).first()
    assert given["turnover_seconds"] == pytest.approx(600 / (199 / 0.198)) and not given["capacity_estimated"]
    with pytest.raises(turnover.TurnoverError, match="never filled"):
        turnover.checked(turnover.turnover_estimate(*turnover_frames(spark, False), second=NS))
    rescued = turnover.turnover_estimate(*turnover_frames(spark, False), second=NS, capacity=100).first()
    assert rescued["problem"] is None and rescued["label_window"] is None
    a, e, i = turnover_frames(spark, True)
    for ins, what in ((i.limit(1), "two insertions"), (i.where(F.col("ts") > 10 * NS + 60 * MS), "before the first eviction"), (i.where((F.col("ts") == 0) | (F.col("ts") == 10 * NS)), "active")):
        with pytest.raises(turnover.TurnoverError, match=what):
            turnover.checked(turnover.turnover_estimate(a, e, ins, second=NS))


def test_active_sessions_agree(spark):
    _, _, ins = turnover_frames(spark, True)
    out = active_sessions(ins.withColumn("event_time", F.timestamp_micros((F.col("ts") / 1000).cast("long"))))
    assert out.agg(F.sum("active_seconds")).first()[0] == pytest.approx(0.198) and out.count() == 2


def test_edges_and_bins(spark):
    rng = np.random.default_rng(0)
    for n in (7, 100):
        x = np.round(rng.normal(size=n), 1)
        rows = spark.createDataFrame([(float(v), 3.0) for v in x], "x double, constant double")
        for method in ("linear", "averaged_inverted_cdf"):
            got = features.quantile_edges(rows, ["x", "constant"], 5, method=method)
            want = features.merged(np.quantile(x, [i / 5 for i in range(6)], method=method).tolist())
            assert got["x"] == pytest.approx(want) and got["constant"] == [3.0]
        edges = features.quantile_edges(rows, ["x", "constant"], 5)
        bins = [r["x_bin"] for r in features.discretise(rows, edges).collect()]
        assert bins == np.searchsorted(edges["x"][1:-1], x, side="right").tolist()
    with pytest.raises(ValueError, match="127"):
        features.quantile_edges(rows, ["x"], 500)
    with pytest.raises(ValueError, match="missing"):
        features.discretise(rows, {"nope": [0.0, 1.0]})


def test_one_hot(spark):
    rows = spark.createDataFrame([(0, 2), (1, 0)], "a_bin int, b_bin int")
    assert [r["hot"] for r in features.one_hot_positions(rows, {"a": 2, "b": 3}).collect()] == [[0, 4], [1, 2]]
    with pytest.raises(Exception, match="out of range"):
        features.one_hot_positions(rows, {"a": 2, "b": 2}).collect()
    with pytest.raises(ValueError):
        features.one_hot_positions(rows, {})


def test_export():
    names = features.FEATURE_ORDER
    model = features.LinearModel(names, {f: [0.0, 2.5, 2.0**64, 9e30, 1e31] for f in names}, {f: [0.12345, -0.12345, 1.0, 0.0] for f in names}, 0.00025)
    doc = features.export_document(model, weight_scale=1000, threshold=0.5)
    assert doc["threshold_int"] == 500 and doc["bias_int"] == 0 and doc["n_features"] == 9
    assert all((f["n_bins"], len(f["weights_int"]), len(f["bin_edges"])) == (4, 4, 3) for f in doc["features"])
    assert doc["features"][0]["weights_int"] == [123, -123, 1000, 0] and doc["features"][0]["bin_edges"] == [2, 2**64 - 1, 2**64 - 1]
    assert json.loads(json.dumps(doc)) == doc
    with pytest.raises(ValueError, match="feature_names"):
        features.export_document(model, feature_names=("a", "b", "c"))


def test_scalars(spark):
    row = spark.sql("SELECT 2.5D AS a, -1.5D AS b, '18446744073709551616' AS big, 'x_20240102_030405.csv' AS name").select(
        scalars.round_half_even(F.col("a")).alias("r"), scalars.truncate(F.col("b")).alias("t"), scalars.clamp_u64(F.col("big").cast("decimal(30,0)")).alias("c"), scalars.run_stamp(F.col("name")).alias("s"), scalars.share_label(F.lit(10), F.lit(20)).alias("l"), scalars.seconds_to_ns(F.lit(1.5)).alias("n")
    ).first()
    assert (row["r"], row["t"], int(row["c"]), row["s"], row["l"], row["n"]) == (2, -1, 2**64 - 1, "20240102_030405", "10–20%", 1_500_000_000)


def plain_beta(a, b, x):
    """The regularised incomplete beta function, by its power series on the side where it converges fast."""
    if x > (a + 1) / (a + b + 2):
        return 1 - plain_beta(b, a, 1 - x)
    term = total = 1.0 / a
    for k in range(1, 3000):
        term *= (k - b) * x / k * (a + k - 1) / (a + k)
        total += term
    return total * math.exp(a * math.log(x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))


def plain_power(d, n, edge):
    """By the definition of the noncentral t: the mean of the normal distribution over the chi scale."""
    normal, df = NormalDist(), n - 1
    grid = [max(1e-9, 1 - 12 / math.sqrt(2 * df)) + i * (1 + 12 / math.sqrt(2 * df)) / 20_000 for i in range(20_000)]
    weights = [math.exp(math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * math.log(s) - df * s * s / 2) for s in grid]
    inside = sum(w * (normal.cdf(edge * s - d * math.sqrt(n)) - normal.cdf(-edge * s - d * math.sqrt(n))) for w, s in zip(weights, grid, strict=True))
    return 1 - inside * (grid[1] - grid[0])


def test_student(spark):
    cases = [(float(t), df) for t in (0.0, 0.3, -1.7, 2.0, 5.5, 40.0) for df in (1, 2, 3, 10, 49, 400)] + [(2.0, 60_000)]
    rows = spark.createDataFrame(cases, "t double, df long").select("t", "df", student.two_sided(F.col("t"), F.col("df")).alias("p"), student.quantile(F.lit(0.975), F.col("df")).alias("edge")).collect()
    for r in rows[:-1]:
        x = r["df"] / (r["df"] + r["t"] ** 2)
        assert r["p"] == pytest.approx(plain_beta(r["df"] / 2, 0.5, x) if x < 1 else 1.0, rel=1e-8, abs=1e-14)
    edges = {r["df"]: r["edge"] for r in rows}
    assert [edges[k] for k in (1, 2, 10, 49)] == pytest.approx([12.7062047, 4.3026527, 2.2281389, 2.0095752], abs=1e-6)
    assert edges[60_000] == pytest.approx(1.9600, abs=1e-4) and rows[-1]["p"] == pytest.approx(0.045503, abs=3e-6)


def test_normal_distribution(spark):
    xs = [x / 7 for x in range(-270, 271)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(student.normal_cdf(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([NormalDist().cdf(x) for x in xs], rel=1e-11, abs=1e-15)


def test_power(spark):
    cases = [(0.5, 34), (0.1, 20), (-0.3, 12), (1.2, 5), (2.0, 2), (0.01, 5000), (0.0, 10)]
    rows = spark.createDataFrame(cases, "d double, n long").select("d", "n", student.power(F.col("d"), F.col("n"), 0.05).alias("power"), student.quantile(F.lit(0.975), F.col("n") - 1).alias("edge")).collect()
    for r in rows:
        assert r["power"] == pytest.approx(plain_power(r["d"], r["n"], r["edge"]), abs=1e-5)
    assert rows[0]["power"] == pytest.approx(0.808, abs=0.002) and rows[6]["power"] == pytest.approx(0.05, abs=1e-9)


def test_effect_classes(spark):
    rows = spark.createDataFrame([(0.1,), (-0.3,), (0.6,), (2.0,), (None,)], "d double").select(student.effect_class(F.col("d")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["negligible", "small", "medium", "large", None]


def test_paired_verdicts_of_many_workloads(spark):
    rng = random.Random(2)
    rows = [(w, rng.gauss(w / 4, 1), rng.gauss(0, 1)) for w in range(4) for _ in range(20)] + [(7, 1.0, 0.5), (8, 2.0, 1.0), (8, 3.0, 2.0)]
    pairs = spark.createDataFrame(rows, "workload long, a double, b double")
    out = {r["workload"]: r for r in statistics.paired_verdict(statistics.paired_test(pairs, F.col("a"), F.col("b"), ["workload"])).collect()}
    for w in range(4):
        d = [a - b for k, a, b in rows if k == w]
        mean, sd = fmean(d), stdev(d)
        assert out[w]["t"] == pytest.approx(mean / (sd / math.sqrt(20)))
        assert out[w]["p"] == pytest.approx(plain_beta(9.5, 0.5, 19 / (19 + out[w]["t"] ** 2)), rel=1e-7)
        assert (out[w]["ci_low"], out[w]["ci_high"]) == pytest.approx((mean - 2.0930240544 * sd / math.sqrt(20), mean + 2.0930240544 * sd / math.sqrt(20)), abs=1e-7)
        assert out[w]["significant"] == (out[w]["p"] < 0.05) and out[w]["power"] == pytest.approx(plain_power(mean / sd, 20, 2.0930240544), abs=1e-5)
    one, equal = out[7], out[8]
    assert [one[c] for c in ("t", "p", "ci_low", "ci_high", "power")] == [None] * 5 and not one["significant"] and one["n_pairs"] == 1
    assert equal["t"] is None and equal["p"] is None and equal["ci_low"] == equal["ci_high"] == 1.0


def test_independent_verdict(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", float(x) + 3) for x in range(10)], "policy string, v double")
    row = statistics.independent_verdict(statistics.independent_test(rows, "v", "policy", "a", "b")).first()
    assert row["t"] == pytest.approx(-2.215647, abs=1e-5) and row["p"] == pytest.approx(0.039883, abs=1e-4) and row["effect_class"] == "large"
    scored = statistics.normal_scores(statistics.qq_points(rows.where("policy = 'a'"), "v", ["policy"], [])).orderBy("v").collect()
    assert scored[0]["theoretical"] == pytest.approx(-1.644854, abs=1e-5) and scored[9]["theoretical"] == pytest.approx(1.644854, abs=1e-5)


def test_auc_of_one_class(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert statistics.roc_auc(rows, "y", "s").first()["auc"] is None
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert statistics.roc_auc(tied, "y", "s").first()["auc"] == 0.5


def trial(folder, spark, insertions=()):
    folder.mkdir(parents=True)
    rng, access, evictions = random.Random(1), [], []
    for i in range(80):
        own = {f: rng.randint(1, 999) for f in training.LOG_FEATURES}
        at = 10 + 12 * i
        access.append({"ts": at, "in": i, "dm": 8, **own})
        evictions.append({"ts": at + 1})
        if i < 40:
            access.append({"ts": at + 2, "in": i, "dm": 8, **own})
    write(folder / "trace_access_x.bin", "access", access)
    write(folder / "trace_eviction_x.bin", "eviction", evictions)
    write(folder / "trace_insertion_x.bin", "insertion", [{"ts": t} for t in insertions])


def test_training_end_to_end(spark, tmp_path):
    trial(tmp_path / "data" / "w" / "iter_0", spark)
    options = training.Options(horizon=5, n_bins=4, target_rows=400, disc_sample_size=300, eval_rows=200)
    result = training.train(spark, str(tmp_path / "data"), str(tmp_path / "out"), options=options)["w"]
    out = tmp_path / "out" / "w"
    doc = json.loads((out / "model_weights.json").read_text())
    assert doc["feature_names"] == list(features.FEATURE_ORDER) and (out / "eval_report.txt").exists() and (out / "bin_edges").exists()
    from pyspark.ml.classification import LogisticRegressionModel

    assert len(LogisticRegressionModel.load(str(out / "model")).coefficients) == sum(f["n_bins"] for f in doc["features"] if f["n_bins"] > 1)
    assert {k: v.count() for k, v in first_trial(spark, str(tmp_path / "data"), "w").items()} == {"access": 120, "eviction": 80, "insertion": 0}
    assert doc["model_type"] == "binary_reuse_classifier"
    metrics = json.loads((out / "metrics.json").read_text())
    assert metrics == result["metrics"] and metrics["residency_cap_ns"] == metrics["horizon_ns"] == 5 and metrics["horizon_source"] == "manual"
    assert set(metrics["confusion"]) == {"tn", "fp", "fn", "tp"} and sum(metrics["confusion"].values()) == metrics["n_eval"] and metrics["prob_threshold"] == 0.5
    assert result["n_pos"] > 0 and result["n_neg"] > 0 and result["n_train_rows"] == 400
    from pagetrail.sources.text_logs import read_reports

    report = read_reports(spark, str(tmp_path / "out")).first()
    assert report["model"] == "w" and report["support"] == metrics["n_eval"] and report["auc"] == pytest.approx(metrics["auc"], abs=1e-4)
    assert training.summary(spark, {"w": result}).count() == 1


def test_nothing_to_train_on(spark, tmp_path):
    """Evictions that no access precedes leave no candidates."""
    folder = tmp_path / "data" / "w" / "iter_0"
    folder.mkdir(parents=True)
    write(folder / "t_access_x.bin", "access", [{"ts": t, "in": t} for t in range(100, 110)])
    write(folder / "t_eviction_x.bin", "eviction", [{"ts": t} for t in range(1, 9)])
    with pytest.raises(ValueError, match="nothing to train on"):
        training.train(spark, str(tmp_path / "data"), str(tmp_path / "out"), options=training.Options(horizon=5, n_bins=4, target_rows=40, disc_sample_size=30, eval_rows=20))


def test_early_stopping_gives_the_best_epoch_back(spark):
    """A feature that speaks for the label in the training rows and against it in the holdout: each epoch that learns more of it
    makes the holdout worse, so that the best epoch is not the last."""
    rng = random.Random(5)
    rows = lambda n, turn: [(a, b, int(rng.random() < (0.8 if a else 0.2)) if b == 0 else int(rng.random() < (0.5 + turn * (0.02 * b)))) for a, b in ((rng.randint(0, 1), rng.choice([0, 0, 1, 5, 9])) for _ in range(n))]
    train, held = (spark.createDataFrame(rows(3000, t), "a_bin int, b_bin int, label int") for t in (1, -4))
    found = epochs.fit_in_epochs(train, held, {"b": 10, "a": 2}, max_epochs=30, patience=5)
    best = epochs.best_of(found)
    assert best.auc == max(e.auc for e in found) and best.number < found[-1].number
    assert found[-1].number in (30, best.number + 5) and len(found) == found[-1].number
    again = epochs.fit_in_epochs(train, held, {"b": 10, "a": 2}, max_epochs=best.number, patience=5)
    assert all(again[-1].weights[f] == pytest.approx(own) for f, own in best.weights.items())


def test_epochs_reach_the_fit(spark):
    """Run to its end, the epochs find what the logistic regression finds."""
    rng = random.Random(8)
    data = [(a, b, int(rng.random() < 1 / (1 + math.exp(1 - a + 0.7 * b)))) for a, b in ((rng.randint(0, 3), rng.randint(0, 2)) for _ in range(4000))]
    rows = spark.createDataFrame(data, "a_bin int, b_bin int, label int")
    last = epochs.fit_in_epochs(rows, rows, {"a": 4, "b": 3}, max_epochs=25, patience=25, class_weights={0: 1.0, 1: 2.0})[-1]
    edges = {"a": [0.0, 0.5, 1.5, 2.5, 3.5], "b": [0.0, 0.5, 1.5, 2.5]}
    model = training.fit_classifier(rows, edges, training.Options(max_iterations=500), {0: 1.0, 1: 2.0})
    for a in range(4):
        for b in range(3):
            assert last.weights["a"][a] + last.weights["b"][b] == pytest.approx(model.bias + model.weights["a"][a] + model.weights["b"][b], abs=1e-4)


def test_effective_cap():
    assert [training.effective_cap(x, 5) for x in (None, 0, -1, 9)] == [5, None, None, 9]


def test_rules_of_stopping():
    assert epochs.stopped([0.5], 5) == (0, False)
    assert epochs.stopped([0.5, 0.7, 0.7, 0.6], 2) == (1, True)
    assert epochs.stopped([None, None, 0.2], 5) == (2, False)
    assert epochs.stopped([None] * 6, 5) == (0, True)


def test_training_in_epochs(spark, tmp_path):
    trial(tmp_path / "data" / "w" / "iter_0", spark)
    options = training.Options(horizon=5, n_bins=4, target_rows=400, disc_sample_size=300, eval_rows=200, early_stopping=True, max_epochs=3)
    result = training.train(spark, str(tmp_path / "data"), str(tmp_path / "out"), options=options)["w"]
    areas = [a for a in result["epochs"] if a is not None]  # none where the holdout has one class
    assert 1 <= len(result["epochs"]) <= 3 and result["metrics"]["auc"] == (pytest.approx(max(areas)) if areas else None)
    assert json.loads((tmp_path / "out" / "w" / "model_weights.json").read_text())["bias"] == 0.0
    assert parser().parse_args(["train", "a", "b", "--early-stopping", "--max-epochs", "7"]).max_epochs == 7


def test_automatic_horizon(spark, tmp_path):
    trial(tmp_path / "data" / "w" / "iter_0", spark, insertions=[0, 1, 2, 3, 4, *range(20, 620)])
    iters = [str(tmp_path / "data" / "w" / "iter_0")]
    est = turnover.turnover_estimate(*(trial_logs(spark, iters, k) for k in ("access", "eviction", "insertion")), second=NS)
    assert est.first()["capacity_pages"] == 5 and est.first()["capacity_estimated"]
    auto = turnover.auto_horizon(est, NS).first()
    assert auto["horizon_seconds"] == pytest.approx(min(est.first()["turnover_seconds"], est.first()["label_window"] / NS / 2))
    options = training.Options(n_bins=4, target_rows=100, disc_sample_size=100, eval_rows=100)
    metrics = training.train(spark, str(tmp_path / "data"), str(tmp_path / "out"), options=options)["w"]["metrics"]
    assert metrics["horizon_source"] == "auto" and metrics["capacity_pages"] == 5 and metrics["capacity_estimated"] and metrics["n_insertions"] == 605
    assert metrics["horizon_clamped"] is False and metrics["horizon_ns"] <= metrics["turnover_ns"] and metrics["insertion_rate_per_s"] > 0 and metrics["active_seconds"] > 0


def test_trial_without_insertions_is_an_error(spark, tmp_path):
    trial(tmp_path / "w" / "iter_0", spark, insertions=[0, 1, 2, *range(20, 90)])
    trial(tmp_path / "w" / "iter_1", spark)
    iters = [str(tmp_path / "w" / f"iter_{i}") for i in range(2)]
    logs = [trial_logs(spark, iters, k) for k in ("access", "eviction", "insertion")]
    est = turnover.turnover_estimate(*logs, second=NS)
    assert [r["n_insertions"] for r in est.orderBy("trial_id").collect()] == [73, 0]
    with pytest.raises(turnover.TurnoverError, match="trial 1: fewer than two insertions"):
        turnover.checked(est)
    with pytest.raises(turnover.TurnoverError, match="trial 0: fewer than two"):
        training.train_workload(spark, "w", iters[1:], str(tmp_path / "out"), training.Options())


def test_equal_accesses_keep_the_sample_whole(spark):
    access = spark.createDataFrame([(0, "p", 10, 1.0)] * 3 + [(0, "p", 30, 2.0), (0, "q", 500, 0.0)], "trial_id int, page string, ts long, value double")
    eviction = spark.createDataFrame([(0, t) for t in (12, 15, 25, 28)], "trial_id int, ts long")
    sample = training.collect_sample(access, eviction, training.Options(features=("value",), horizon=5, target_rows=50, disc_sample_size=20, holdout_frac=0.0))
    assert sample.train.count() == 50 and sample.discretizer.count() == 20
    assert {r["label"] for r in sample.train.collect()} == {0, 1} and sample.evaluation is None


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="lacks pd"):
        training.require_columns(spark.range(1), ["id", "pd"])


def test_cli_defaults():
    a = parser().parse_args(["train", "in", "out"])
    assert (a.target_rows, a.n_bins, a.weight_scale, a.holdout_frac, a.seed, a.balanced) == (2_000_000, 10, 10_000, 0.2, 42, True)
