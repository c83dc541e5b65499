"""From the logs of workloads to exported classifiers."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pagetrail.operators import features as feats
from pagetrail.operators.epochs import Epoch, best_of, fit_in_epochs
from pagetrail.operators.candidates import candidate_bands, temporal_split, valid_evictions
from pagetrail.operators.ranking import row_numbers
from pagetrail.operators.sampling import choose, random_pairs, random_split, sample_candidates, stratified_split
from pagetrail.operators.statistics import confusion, roc_auc
from pagetrail.operators.turnover import auto_horizon, checked, turnover_estimate
from pagetrail.sources.artifacts import edges_table, eval_report, write_json, write_text
from pagetrail.sources.binary_logs import discover, trial_logs

NS = 1_000_000_000
TOLERANCE = 1e-9  # fits run until the loss stands still, so that any other way to the optimum gives the same figures
CELLS_PER_TASK = 10_000
LOG_FEATURES = feats.FEATURE_ORDER[:-1]
TSA = feats.FEATURE_ORDER[-1]


@dataclass
class Options:
    """Times are in the unit of the trace (nanoseconds for binary logs)."""

    features: tuple[str, ...] = LOG_FEATURES
    horizon: int | None = None
    capacity_pages: int | None = None
    target_rows: int = 2_000_000
    balanced: bool = True
    n_bins: int = 10
    threshold: float = 0.0
    weight_scale: int = 10_000
    disc_sample_size: int = 200_000
    eval_rows: int = 300_000
    holdout_frac: float = 0.2
    residency_cap: int | None = None
    random_state: int = 42
    max_iterations: int = 100
    regularisation: float = 1e-6
    early_stopping: bool = False
    max_epochs: int = 50
    patience: int = 5
    second: int = NS


@dataclass
class WorkloadSample:
    train: DataFrame
    evaluation: DataFrame | None
    discretizer: DataFrame
    n_pos: int
    n_neg: int
    class_weights: dict[int, float] | None = field(default=None)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Frees what was persisted for the fit."""
        for rows in self.held:
            rows.unpersist()

    @property
    def true_positive_rate(self) -> float:
        return self.n_pos / (self.n_pos + self.n_neg) if self.n_pos + self.n_neg else 0.0


def require_columns(rows: DataFrame, needed: list[str]) -> None:
    if missing := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"the access log lacks {', '.join(missing)}")


def collect_sample(access: DataFrame, eviction: DataFrame, options: Options) -> WorkloadSample:
    """Sampled rows of all trials: for training, for the holdout (later evictions), and for the bin edges.

    access: trial_id, page, ts, the features and access_key, a number that names a row (binary logs have the place of
    the record in its trial); without one, rows are numbered here in the order of all their values.  eviction:
    trial_id, ts.  Trials share nothing but the seed.
    """
    require_columns(access, ["trial_id", "page", "ts", *options.features])
    horizon, cap, seed = options.horizon, options.residency_cap, options.random_state
    keyed = access
    if "access_key" not in access.columns:
        keyed = row_numbers(access, ["trial_id"], "ts", ["page", *options.features]).withColumnRenamed("rn", "access_key").drop("n_rows")
    # read several times below; equal rows are numbered once
    keyed = keyed.select("trial_id", "page", "ts", "access_key", *options.features).persist(StorageLevel.MEMORY_AND_DISK)
    split = temporal_split(valid_evictions(keyed, eviction, horizon), options.holdout_frac).persist(StorageLevel.MEMORY_AND_DISK)
    early, late = split.where("NOT is_eval").select("trial_id", "ts"), split.where("is_eval").select("trial_id", "ts")
    common = {"horizon": horizon, "cap": cap, "key": "access_key"}
    # read by the sums and by the samples of both kinds
    bands = candidate_bands(keyed, early, **common).persist(StorageLevel.MEMORY_AND_DISK)
    sums = bands.groupBy("trial_id").agg(F.sum(F.col("hi") - F.col("pos_lo")).alias("pos"), F.sum(F.col("pos_lo") - F.col("lo")).alias("neg"))
    per_trial = sums.agg(F.count("*").alias("trials"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    trials, n_pos, n_neg = per_trial["trials"], per_trial["pos"] or 0, per_trial["neg"] or 0
    each = -(-options.target_rows // max(trials, 1))
    common |= {"features": list(options.features)}
    train = sample_candidates(keyed, early, n=each, balanced=options.balanced, seed=seed, bands=bands, **common)
    if trials > 1 and trials * each > options.target_rows:
        train = choose(train, options.target_rows, ["trial_id", "label", "draw"], seed)
    disc = sample_candidates(keyed, early, n=options.disc_sample_size, balanced=False, seed=seed + 1, bands=bands, **common)
    evaluation = sample_candidates(keyed, late, n=options.eval_rows, balanced=False, seed=seed + 2, **common) if options.holdout_frac > 0 else None
    # read several times below: by the bin edges, the fit's passes, and the figures
    train, disc = train.persist(StorageLevel.MEMORY_AND_DISK), disc.persist(StorageLevel.MEMORY_AND_DISK)
    evaluation = evaluation.persist(StorageLevel.MEMORY_AND_DISK) if evaluation is not None else None
    total = n_pos + n_neg
    weights = {0: total / (2 * n_neg), 1: total / (2 * n_pos)} if n_pos and n_neg else None
    held = [x for x in (train, disc, evaluation, bands, split, keyed) if x is not None]
    return WorkloadSample(train, evaluation, disc, n_pos, n_neg, weights, held)


def weighted_cells(binned: DataFrame, columns: list[str], weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells with ``w``, their weight in a fit, over which the passes of the fit run, in few tasks where they are few; and
    what is persisted of them."""
    held = feats.cells_of(binned, columns).persist(StorageLevel.MEMORY_AND_DISK)
    cells = held.coalesce(max(1, -(-held.count() // CELLS_PER_TASK)))
    return cells.withColumn("w", F.col("n").cast("double") if weight is None else weight), held


def fit_classifier(binned: DataFrame, edges: dict[str, list[float]], options: Options, class_weights: dict[int, float] | None = None, save_to: str | None = None) -> feats.LinearModel:
    """Logistic regression over one-hot bins, to convergence; features of one bin get weight 0. save_to: a folder for
    the fitted Spark ML model."""
    n_bins = feats.n_bins_of(edges)
    weight = F.col("n").cast("double")
    if class_weights:
        weight = weight * F.when(F.col("label") == 1, F.lit(class_weights[1])).otherwise(F.lit(class_weights[0]))
    cells, held = weighted_cells(binned, ["label", *(f"{f}_bin" for f in n_bins)], weight)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=options.max_iterations, regParam=options.regularisation, standardization=False, tol=TOLERANCE)
    model = lr.fit(feats.with_vectors(cells, n_bins))
    held.unpersist()
    if save_to:
        model.write().overwrite().save(save_to)
    flat, at, weights = model.coefficients.toArray().tolist(), 0, {}
    for f, n in n_bins.items():
        weights[f] = flat[at : at + n] if n > 1 else [0.0]
        at += n if n > 1 else 0
    return feats.LinearModel(tuple(edges), edges, weights, float(model.intercept))


def fit_early_stopped(binned: DataFrame, held: DataFrame, edges: dict[str, list[float]], options: Options, class_weights: dict[int, float] | None = None) -> tuple[feats.LinearModel, list[Epoch]]:
    """The weights of the epoch with the largest area over the holdout, and all epochs; it is over ``patience`` epochs later."""
    found = fit_in_epochs(binned, held, feats.n_bins_of(edges), max_epochs=options.max_epochs, patience=options.patience, ridge=options.regularisation, class_weights=class_weights)
    return feats.LinearModel(tuple(edges), edges, best_of(found).weights, 0.0), found


def evaluate(rows: DataFrame, model: feats.LinearModel, threshold: float) -> dict:
    """Figures of the holdout, under the names of the metrics file; the area is null where only one class occurs."""
    scored = feats.float_score(rows, model).withColumn("predicted", feats.decide(F.col("probability"), threshold).cast("int"))
    row = confusion(scored, F.col("label"), F.col("predicted")).first().asDict()
    cells = {c: row[c] for c in ("tn", "fp", "fn", "tp")}
    n = sum(cells.values())
    return {
        "auc": roc_auc(scored, "label", "probability").first()["auc"], "precision": row["precision"], "recall": row["recall"], "f1": row["f1"], "confusion": cells,
        "n_eval": n, "positive_rate": (cells["tp"] + cells["fn"]) / n if n else 0.0, "prob_threshold": 1 / (1 + math.exp(-threshold)),
    }


def effective_cap(given: int | None, horizon: int) -> int | None:
    """How long a page stays at most: the horizon where nothing is given, no limit where 0 or less is."""
    return horizon if given is None else given if given > 0 else None


def horizon_facts(first: Row, auto: Row, second: int) -> dict:
    """Where an automatic horizon comes from; capacity, rate and active time are those of the first trial."""
    turnover, horizon = auto["mean_turnover"], auto["horizon_seconds"]
    return {
        "horizon_source": "auto", "turnover_ns": turnover * NS, "horizon_clamped": horizon < turnover,
        "capacity_pages": first["capacity_pages"], "capacity_estimated": first["capacity_estimated"],
        "insertion_rate_per_s": first["insertion_rate"], "active_seconds": first["active_seconds"], "n_insertions": first["n_insertions"],
        "label_window_ns": None if first["label_window"] is None else first["label_window"] * NS / second,
    }


def train_workload(spark: SparkSession, name: str, iters: list, output: str, options: Options) -> dict:
    """Train, evaluate and export one workload; returns what the summary shows, with the metrics that are also written."""
    out = f"{output}/{name}"
    access, eviction = trial_logs(spark, iters, "access"), trial_logs(spark, iters, "eviction")
    metrics: dict = {"horizon_source": "manual"}
    horizon = options.horizon
    if horizon is None:
        trials = spark.createDataFrame([(i,) for i in range(len(iters))], "trial_id int")
        estimate = turnover_estimate(access, eviction, trial_logs(spark, iters, "insertion"), second=options.second, capacity=options.capacity_pages, trials=trials)
        first = checked(estimate)[0]
        auto = auto_horizon(estimate, options.second).first()
        horizon = int(auto["horizon_seconds"] * options.second)
        metrics = horizon_facts(first, auto, options.second)
    cap = effective_cap(options.residency_cap, horizon)
    options = Options(**asdict(options) | {"horizon": horizon, "residency_cap": cap})
    sample = collect_sample(access, eviction, options)
    if sample.train.isEmpty():
        sample.release()
        raise ValueError(f"{name} leaves nothing to train on: no eviction lies between an access and the horizon's end")
    edges = feats.quantile_edges(sample.discretizer, [*options.features, TSA], options.n_bins)
    weights = None if options.balanced else sample.class_weights
    held = sample.evaluation is not None and not sample.evaluation.isEmpty()
    epochs = None
    if options.early_stopping and held:
        model, epochs = fit_early_stopped(feats.discretise(sample.train, edges), feats.discretise(sample.evaluation, edges), edges, options, weights)
    else:
        model = fit_classifier(feats.discretise(sample.train, edges), edges, options, weights, save_to=f"{out}/model")
    unit = NS / options.second
    metrics = {"horizon_ns": horizon * unit, "residency_cap_ns": None if cap is None else cap * unit} | metrics
    if held:
        metrics |= evaluate(sample.evaluation, model, options.threshold)
    document = feats.export_document(model, weight_scale=options.weight_scale, threshold=options.threshold)
    write_json(spark, f"{out}/model_weights.json", document)
    write_json(spark, f"{out}/metrics.json", metrics)
    write_text(spark, f"{out}/eval_report.txt", eval_report(name, metrics))
    edges_table(spark, edges).write.mode("overwrite").parquet(f"{out}/bin_edges")
    feats.weight_table(spark, model).write.mode("overwrite").parquet(f"{out}/weight_table")
    result = {
        "workload": name, "output_dir": out, "n_train_rows": sample.train.count(), "n_encoded_features": sum(feats.n_bins_of(edges).values()),
        "n_pos": sample.n_pos, "n_neg": sample.n_neg, "true_positive_rate": sample.true_positive_rate, "metrics": metrics,
        "epochs": None if epochs is None else [e.auc for e in epochs],
    }
    sample.release()
    return result


def train(spark: SparkSession, data: str, output: str, *, workloads: list[str] | None = None, options: Options | None = None) -> dict[str, dict]:
    """Train every workload below a folder."""
    return {name: train_workload(spark, name, iters, str(output), options or Options()) for name, iters in discover(spark, data, workloads).items()}


def summary(spark: SparkSession, results: dict[str, dict]) -> DataFrame:
    """One row per workload."""
    rows = [(n, r["n_train_rows"], r["metrics"]["horizon_ns"] / NS, r["n_pos"], r["n_neg"], r["true_positive_rate"], r["metrics"].get("auc"), r["metrics"].get("f1")) for n, r in results.items()]
    return spark.createDataFrame(rows, "workload string, n_train_rows long, horizon_seconds double, n_pos long, n_neg long, true_positive_rate double, auc double, f1 double")


def pair_balance(pairs: DataFrame, count: str | None = None) -> DataFrame:
    """One row: how many labelled pairs there are, and the share whose first row has the lower target. count: how many pairs
    a row stands for."""
    own = F.lit(1) if count is None else F.col(count)
    return pairs.agg(F.coalesce(F.sum(own), F.lit(0)).alias("n_pairs"), (F.sum(F.col("label") * own) / F.sum(own)).alias("balance"))


def pairwise_ranker(spark: SparkSession, rows: DataFrame, features: list[str], target: str, *, order: list[str], n_bins: int = 5, multiplier: int = 5, seed: int = 42) -> tuple[feats.LinearModel, dict]:
    """A linear ranker on differences of one-hot bins, without bias: whether the first of two rows has the lower target.

    Rows are split 80 to 20 first; edges come from the training rows by averaged inverted quantiles.
    """
    used = list(dict.fromkeys([*order, target, *features]))
    # read several times below; pairs are counted by bins and label, so that each part is drawn once
    split = random_split(rows.where(F.col(target).isNotNull()).select(*used), 0.2, order, seed).persist(StorageLevel.MEMORY_AND_DISK)
    learn, test = split.where("NOT is_test"), split.where("is_test")
    edges = feats.quantile_edges(learn, features, n_bins, method="averaged_inverted_cdf")
    n = feats.n_bins_of(edges)
    bins = [f"{f}_bin" for f in features]
    sides = [f"{b}_{s}" for b in bins for s in ("a", "b")]

    def differences(part: DataFrame, s: int) -> tuple[DataFrame, DataFrame]:
        binned = feats.discretise(part, edges)
        pairs = random_pairs(spark, binned, target, bins, max(1, multiplier * part.count()), order=order, seed=s)
        counted, held = weighted_cells(pairs, ["label", *sides])
        cells = [((F.col(f"{f}_bin_a") == b).cast("double") - (F.col(f"{f}_bin_b") == b).cast("double")) for f in features for b in range(n[f])]
        return counted.select("label", "n", "w", array_to_vector(F.array(*cells)).alias("features")), held

    (train_pairs, held_train), (test_pairs, held_test) = differences(learn, seed), differences(test, 123)
    model = LogisticRegression(fitIntercept=False, weightCol="w", maxIter=500, regParam=1e-6, standardization=False, tol=TOLERANCE).fit(train_pairs)
    flat, at, weights = model.coefficients.toArray().tolist(), 0, {}
    for f in features:
        own = flat[at : at + n[f]]
        weights[f] = [w - sum(own) / n[f] for w in own]  # the same for all bins of a feature makes no difference
        at += n[f]
    scored = model.transform(test_pairs).withColumn("p", F.element_at(vector_to_array("probability"), 2))
    area = roc_auc(scored, "label", "p", "n").first()
    balance = {f"{name}_{k}": v for name, part in (("train", train_pairs), ("test", test_pairs)) for k, v in pair_balance(part, "n").first().asDict().items()}
    hit = F.when(feats.decide_at_half(F.col("p")).cast("int") == F.col("label"), F.col("n")).otherwise(0)
    right = scored.agg((F.sum(hit) / F.sum("n")).alias("a")).first()["a"]
    for rows in (held_train, held_test, split):
        rows.unpersist()
    return feats.LinearModel(tuple(features), edges, weights, 0.0), {"auc": area["auc"], "accuracy": right} | balance


def class_of_reuse(rows: DataFrame, target: str, n_classes: int = 5) -> DataFrame:
    """Adds ``reuse_class``: the quantile class of the next reuse."""
    edges = feats.quantile_edges(rows, [target], n_classes)[target]
    return rows.withColumn("reuse_class", feats.bin_index(F.col(target), edges))


def class_model(rows: DataFrame, features: list[str], label: str, *, n_bins: int = 5, key: list[str], seed: int = 42) -> DataFrame:
    """A linear model of any number of classes over one-hot bins: the test rows (a fifth of each class) with their
    ``predicted`` class. Edges come from the training rows."""
    used = list(dict.fromkeys([*key, label, *features]))
    split = stratified_split(rows.where(F.col(label).isNotNull()).select(*used), 0.2, label, key, seed).persist(StorageLevel.MEMORY_AND_DISK)
    learn, test = split.where("NOT is_test"), split.where("is_test")
    edges = feats.quantile_edges(learn, features, n_bins, method="averaged_inverted_cdf")
    n = feats.n_bins_of(edges)
    cells, held = weighted_cells(feats.discretise(learn, edges), [label, *(f"{f}_bin" for f in features)])
    model = LogisticRegression(labelCol=label, weightCol="w", maxIter=500, regParam=1e-6, standardization=False, tol=TOLERANCE).fit(feats.with_vectors(cells, n))
    held.unpersist()
    return model.transform(feats.with_vectors(feats.discretise(test, edges), n)).select(*key, F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
