"""A linear classifier over one-hot bins that learns in epochs and stops when a holdout stops to improve.

Rows are summed to cells, one for each combination of bins, once.  An epoch takes a Newton step on the bins of one feature
after another; the bins of a feature exclude each other, so that its curvature is a number per bin.  A step is one
aggregation over the cells, of which one row per bin reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions.scalars import sigmoid
from pagetrail.operators.features import cells_of
from pagetrail.operators.statistics import roc_auc

_LONGEST_STEP = 2.0


@dataclass(frozen=True)
class Epoch:
    number: int
    auc: float | None
    weights: dict[str, list[float]]


def _probability(weights: dict[str, list[float]]) -> Column:
    total = F.lit(0.0)
    for f, own in weights.items():
        total = total + F.element_at(F.array(*(F.lit(float(w)) for w in own)), F.col(f"{f}_bin") + 1)
    return sigmoid(total)


def stopped(areas: list[float | None], patience: int) -> tuple[int, bool]:
    """The place of the best area so far, the first of equal ones, and whether ``patience`` epochs have passed since."""
    best = max(range(len(areas)), key=lambda i: (areas[i] is not None, areas[i] or 0.0, -i))
    return best, len(areas) - 1 - best >= patience


def fit_in_epochs(train: DataFrame, holdout: DataFrame, n_bins: dict[str, int], *, max_epochs: int = 50, patience: int = 5, ridge: float = 1e-6, class_weights: dict[int, float] | None = None) -> list[Epoch]:
    """train, holdout: <feature>_bin for each feature and label. All epochs that were run, up to ``patience`` behind the best one.

    There is no bias: the first feature's bins hold it. An area is null where the holdout has one class only."""
    bins = [f"{f}_bin" for f in n_bins]
    weight = F.when(F.col("label") == 1, F.lit(float(class_weights[1]))).otherwise(F.lit(float(class_weights[0]))) if class_weights else F.lit(1.0)
    cells = train.groupBy(*bins).agg(F.sum(weight * F.col("label")).alias("n1"), F.sum(weight).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    held = cells_of(holdout, ["label", *bins]).persist(StorageLevel.MEMORY_AND_DISK)
    pull = ridge * (cells.agg(F.sum("n")).first()[0] or 0.0)
    weights, epochs = {f: [0.0] * n for f, n in n_bins.items()}, []
    try:
        for number in range(1, max_epochs + 1):
            for f in n_bins:
                scored = cells.withColumn("p", _probability(weights))
                sums = scored.groupBy(f"{f}_bin").agg(F.sum(F.col("n1") - F.col("n") * F.col("p")).alias("g"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h")).collect()
                own = list(weights[f])
                for r in sums:
                    step = (r["g"] - pull * own[r[f"{f}_bin"]]) / (r["h"] + pull) if r["h"] + pull > 0 else 0.0
                    own[r[f"{f}_bin"]] += max(-_LONGEST_STEP, min(_LONGEST_STEP, step))
                weights = weights | {f: own}
            area = roc_auc(held.withColumn("p", _probability(weights)), "label", "p", "n").first()["auc"]
            epochs.append(Epoch(number, area, weights))
            if stopped([e.auc for e in epochs], patience)[1]:
                break
    finally:
        cells.unpersist()
        held.unpersist()
    return epochs


def best_of(epochs: list[Epoch]) -> Epoch:
    return epochs[stopped([e.auc for e in epochs], 0)[0]]
