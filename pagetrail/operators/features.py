"""Quantile bins, one-hot vectors, the integer model and its scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions.scalars import keep_or_evict, sigmoid
from pagetrail.operators.quantiles import METHODS, quantiles

#: The features of the deployed classifier, in the order that its consumer expects.
FEATURE_ORDER = ("pd", "sz", "fq", "sd", "p2", "id", "i2", "ie", "time_since_last_access_at_eviction")
MERGE_BELOW = 1e-8
MOST_NESTED = 32  # interior edges that go into nested conditions; more are counted in an array
#: Fixed value: the name by which the deployment's loader knows this kind of model.
MODEL_TYPE = "binary_reuse_classifier"


def quantile_edges(rows: DataFrame, features: list[str], n_bins: int = 10, *, method: str = "linear", strategy: str = "quantile") -> dict[str, list[float]]:
    """Bin edges of each feature, outer ones included; edges closer than 1e-8 to the one before are merged.

    n_bins + 1 numbers per feature reach the driver.
    """
    if not 2 <= n_bins <= 127:
        raise ValueError("n_bins must be 2 to 127, so that a bin index fits a signed byte")
    shares = [i / n_bins for i in range(n_bins + 1)]
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)))).alias("x")).select("x.*")
    if strategy == "uniform":
        spans = {features[r["feature"]]: r for r in long.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()}
        found = {f: [r["low"] + (r["high"] - r["low"]) * s for s in shares] for f, r in spans.items() if r["low"] is not None}
    elif strategy == "quantile":
        if method not in METHODS:
            raise ValueError(f"unknown quantile method {method}")
        names = {f"q{i}": s for i, s in enumerate(shares)}
        # the rows are read once; buckets are made of their distinct values
        counted = long.groupBy("feature", "v").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = {features[r["feature"]]: [r[n] for n in names] for r in quantiles(counted, ["feature"], "v", names, method=method, count="n").collect()}
        finally:
            counted.unpersist()
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return {f: merged(found.get(f, [])) for f in features}


def merged(edges: list[float]) -> list[float]:
    kept = edges[:1]
    for before, edge in zip(edges, edges[1:], strict=False):
        if edge - before > MERGE_BELOW:
            kept.append(edge)
    return kept


def n_bins_of(edges: dict[str, list[float]]) -> dict[str, int]:
    return {f: max(1, len(e) - 1) for f, e in edges.items()}


def bin_index(value: Column, edges: list[float]) -> Column:
    """How many interior edges the value reaches."""
    inner, v = [float(e) for e in edges[1:-1]], value.cast("double")
    if len(inner) > MOST_NESTED:
        return F.when(value.isNotNull(), F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e <= v)))

    def reached(low: int, high: int) -> Column:
        """By halving; a sum over all edges makes methods that the JVM doesn't compile where several features are binned."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.call_function("if", v < inner[middle], reached(low, middle), reached(middle + 1, high))

    return F.when(value.isNotNull(), reached(0, len(inner)))


def discretise(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Adds <feature>_bin for each feature."""
    if missing := sorted(set(edges) - set(rows.columns)):
        raise ValueError(f"missing features: {', '.join(missing)}")
    return rows.withColumns({f"{f}_bin": bin_index(F.col(f), e) for f, e in edges.items()})


def cells_of(binned: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are equal in bins and label, with their number ``n``: all that a fit or an area needs of them."""
    return binned.groupBy(*columns).agg(F.count("*").alias("n"))


def one_hot_positions(binned: DataFrame, n_bins: dict[str, int]) -> DataFrame:
    """Adds ``hot``: the positions that are 1 in the one-hot vector, one per feature, blocks in feature order."""
    if not n_bins:
        raise ValueError("there are no features to encode")
    start, parts = 0, []
    for f, n in n_bins.items():
        col = F.col(f"{f}_bin")
        parts.append(F.when((col >= 0) & (col < n), col + start).otherwise(F.raise_error(F.concat(F.lit(f"bin of {f} out of range: "), F.coalesce(col.cast("string"), F.lit("null")))).cast("int")))
        start += n
    return binned.withColumn("hot", F.array(*parts))


def with_vectors(binned: DataFrame, n_bins: dict[str, int], out: str = "features") -> DataFrame:
    """Sparse vectors for Spark ML, assembled by its own one-hot encoder."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    width = {f: n for f, n in n_bins.items() if n > 1}
    encoder = OneHotEncoder(inputCols=[f"{f}_bin" for f in width], outputCols=[f"{f}_hot" for f in width], dropLast=False)
    # the encoder learns its widths from a row that holds each feature's last bin
    last = binned.sparkSession.range(1).select(*(F.lit(n - 1).cast("double").alias(f"{f}_bin") for f, n in width.items()))
    model = encoder.fit(last)
    return VectorAssembler(inputCols=[f"{f}_hot" for f in width], outputCol=out).transform(model.transform(binned))


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    edges: dict[str, list[float]]
    weights: dict[str, list[float]]
    bias: float = 0.0


def _u64(x: float) -> int:
    return min(max(int(x), 0), (1 << 64) - 1)


def export_document(model: LinearModel, *, feature_names: tuple[str, ...] | None = None, weight_scale: int = 10_000, threshold: float = 0.0) -> dict:
    """The model as the deployment reads it: integer weights are truncated, bias and threshold rounded half to even."""
    names = tuple(feature_names or model.features)
    if len(names) != len(model.features):
        raise ValueError(f"feature_names has {len(names)} names for {len(model.features)} features")
    return {
        "model_type": MODEL_TYPE, "feature_names": list(names), "n_features": len(names), "weight_scale": weight_scale,
        "bias": model.bias, "bias_int": round(model.bias * weight_scale), "threshold": threshold, "threshold_int": round(threshold * weight_scale),
        "features": [
            {"index": i, "name": name, "n_bins": len(model.weights[f]), "bin_edges": [_u64(e) for e in model.edges[f][1:-1]], "weights_float": model.weights[f], "weights_int": [int(w * weight_scale) for w in model.weights[f]]}
            for i, (f, name) in enumerate(zip(model.features, names, strict=True))
        ],
    }


def integer_score(rows: DataFrame, document: dict, columns: dict[str, str] | None = None) -> DataFrame:
    """Adds score_int, the sum of integer weights and bias, and keep: whether it exceeds the threshold."""
    total: Column = F.lit(document["bias_int"]).cast("long")
    for f in document["features"]:
        value = F.col((columns or {}).get(f["name"], f["name"]))
        index = bin_index(value, [0.0, *f["bin_edges"], 0.0])
        total = total + F.element_at(F.array(*(F.lit(w).cast("long") for w in f["weights_int"])), index + 1)
    return rows.withColumn("score_int", total).withColumn("keep", F.col("score_int") > document["threshold_int"])


def float_score(rows: DataFrame, model: LinearModel) -> DataFrame:
    """Adds probability, by the float weights over the float edges."""
    total: Column = F.lit(float(model.bias))
    for f in model.features:
        total = total + F.element_at(F.array(*(F.lit(float(w)) for w in model.weights[f])), bin_index(F.col(f), model.edges[f]) + 1)
    return rows.withColumn("probability", sigmoid(total))


def decide(probability: Column, threshold: float = 0.0) -> Column:
    """The trained classifier's decision: strictly above the sigmoid of the threshold."""
    return probability > sigmoid(F.lit(float(threshold)))


def decide_at_half(probability: Column) -> Column:
    """The rankers' decision: one half is enough."""
    return probability >= 0.5


def weight_table(spark, model: LinearModel) -> DataFrame:
    """One row per bin: feature, bin, label, weight and what it speaks for."""
    rows = [(f, b, float(w)) for f in model.features for b, w in enumerate(model.weights[f])]
    out = spark.createDataFrame(rows, "feature string, bin int, weight double")
    return out.withColumn("label", F.concat_ws("_", "feature", "bin")).withColumn("tag", keep_or_evict(F.col("weight")))
