"""Distributions, tests and model figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import student
from pagetrail.functions.scalars import normal_quantile
from pagetrail.operators.quantiles import quantiles
from pagetrail.operators.ranking import prefix_sums, row_numbers


def histogram(rows: DataFrame, value: str, bins: int, by: list[str], *, density: bool = False) -> DataFrame:
    """Equal bins over each group's own range; the last bin is closed."""
    spans = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("total"))
    width = (F.col("high") - F.col("low")) / bins
    index = F.least(F.floor(F.coalesce((F.col(value) - F.col("low")) / F.nullif(width.cast("double"), F.lit(0.0)), F.lit(0.0))), F.lit(bins - 1))
    out = rows.where(F.col(value).isNotNull()).join(F.broadcast(spans) if not by else spans, by) if by else rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(spans))
    out = out.groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"), F.first("total").alias("total"), F.first(width).alias("width"))
    if density:
        out = out.withColumn("density", F.col("n") / (F.col("total") * F.col("width")))
    return out.drop("total", "width")


def log_histogram(rows: DataFrame, value: str, edges: int = 50) -> DataFrame:
    """edges - 1 bins with equal ratios between the least and the largest positive value of all rows."""
    some = rows.where(F.col(value) > 0).withColumn("lg", F.log10(value))
    span = some.agg(F.min("lg").alias("low"), F.max("lg").alias("high"))  # one row
    place = F.coalesce((F.col("lg") - F.col("low")) / F.nullif((F.col("high") - F.col("low")) / (edges - 1), F.lit(0.0)), F.lit(0.0))
    return some.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor(place), F.lit(edges - 2)))


def ecdf(rows: DataFrame, value: str, by: list[str], ties: list[str]) -> DataFrame:
    """Adds share: k / n for the k-th value of n (equal values have different shares)."""
    return row_numbers(rows, by, value, ties).withColumn("share", F.col("rn") / F.col("n_rows"))


def qq_points(rows: DataFrame, value: str, by: list[str], ties: list[str]) -> DataFrame:
    """ecdf with the plotting position (k - 1/2) / n, which :func:`normal_scores` turns into a quantile."""
    return row_numbers(rows, by, value, ties).withColumn("position", (F.col("rn") - 0.5) / F.col("n_rows"))


def normal_scores(points: DataFrame) -> DataFrame:
    """Adds theoretical, the standard normal quantile of each plotting position."""
    return points.withColumn("theoretical", normal_quantile(F.col("position")))


def describe(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """nobs, min, max, mean, sample variance, population skewness and excess kurtosis."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("nobs"), F.min(v).alias("least"), F.max(v).alias("largest"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))


def describe_table(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation and exact quartiles."""
    v = F.col(value)
    moments = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("largest"))
    return moments.join(quantiles(rows, by, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}), by)


def box_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, the whiskers (the last values within 1.5 quartile ranges) and the number of outliers."""
    quart = quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(quart, by).groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low_whisker"), F.max(F.when(inside, F.col(value))).alias("high_whisker"), F.count_if(~inside).alias("n_outliers"))


def paired_runs(runs: DataFrame, first: str, second: str, most: int | None = None) -> DataFrame:
    """runs: policy, stamp, accesses, insertions. The k-th run of one policy with the k-th of the other, by stamp.

    Runs are few (one row each), so that numbering them in one task is no burden."""
    numbered = runs.withColumn("pair_index", F.row_number().over(Window.partitionBy("policy").orderBy("stamp")) - 1)
    side = lambda name: numbered.where(F.col("policy") == name).select("pair_index", *(F.col(c).alias(f"{name}_{c}") for c in ("stamp", "accesses", "insertions", "insertion_rate")))
    out = side(first).join(side(second), "pair_index")
    return out.where(F.col("pair_index") < most) if most is not None else out


def run_summaries(accesses: DataFrame, insertions: DataFrame) -> DataFrame:
    """Both: policy, stamp. Runs with their counts; a run without insertions has 0, one without accesses rate 0."""
    a = accesses.groupBy("policy", "stamp").agg(F.count("*").alias("accesses"))
    i = insertions.groupBy("policy", "stamp").agg(F.count("*").alias("insertions"))
    out = a.join(i, ["policy", "stamp"], "left").withColumn("insertions", F.coalesce("insertions", F.lit(0)))
    return out.withColumn("insertion_rate", F.when(F.col("accesses") > 0, F.col("insertions") / F.col("accesses")).otherwise(0.0))


def paired_test(pairs: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group: n, mean difference, its deviation, t, standard error, and the effect size (0 without deviation)."""
    d = a - b
    out = pairs.groupBy(*(by or [])).agg(F.count(d).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    se = F.col("sd_diff") / F.sqrt("n")
    return out.withColumn("se", se).withColumn("t", F.col("mean_diff") / F.nullif(F.col("se"), F.lit(0.0))).withColumn("effect_size", F.when(F.col("sd_diff") > 0, F.col("mean_diff") / F.col("sd_diff")).otherwise(0.0))


def paired_verdict(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The records of paired comparisons, from rows of :func:`paired_test` with any further columns. One pair, or equal
    differences, have no t; one pair has no interval and no power either."""
    df = F.col("n") - 1
    reach = student.quantile(F.lit(1 - alpha / 2), df) * F.col("se")
    known = tests.withColumns({"p": student.two_sided(F.col("t"), df), "reach": reach, "power": student.power(F.col("effect_size"), F.col("n"), alpha)})
    more = {
        "ci_low": F.col("mean_diff") - F.col("reach"), "ci_high": F.col("mean_diff") + F.col("reach"), "effect_class": student.effect_class(F.col("effect_size")),
        "significant": F.coalesce(F.col("p") < alpha, F.lit(False)), "alpha": F.lit(alpha),
    }
    return known.withColumns(more).drop("reach", "se").withColumnRenamed("n", "n_pairs")


def independent_test(rows: DataFrame, value: str, policy: str, first: str, second: str) -> DataFrame:
    """One row: sizes, means, medians, population deviations, pooled t and its degrees of freedom, relative difference
    in percent, and Cohen's d over the root mean of the population variances."""
    v = F.col(value)
    is_first, is_second = F.col(policy) == first, F.col(policy) == second
    pick = lambda f, c: f(F.when(c, v))
    out = rows.agg(
        *(e.alias(f"{n}_{k}") for k, c in (("a", is_first), ("b", is_second)) for n, e in (("n", pick(F.count, c)), ("mean", pick(F.avg, c)), ("var", pick(F.var_samp, c)), ("pop", pick(F.var_pop, c)))),
    )
    middle = quantiles(rows.where(is_first | is_second), [policy], value, {"m": 0.5})
    out = out.crossJoin(F.broadcast(middle.agg(F.max(F.when(is_first, F.col("m"))).alias("median_a"), F.max(F.when(is_second, F.col("m"))).alias("median_b"))))  # one row each
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2)
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    d = (F.col("mean_a") - F.col("mean_b")) / F.sqrt((F.col("pop_a") + F.col("pop_b")) / 2)
    return out.select("n_a", "n_b", "mean_a", "mean_b", "median_a", "median_b", F.sqrt("pop_a").alias("std_a"), F.sqrt("pop_b").alias("std_b"), t.alias("t"), (F.col("n_a") + F.col("n_b") - 2).alias("df"), (100 * (F.col("mean_a") - F.col("mean_b")) / F.col("mean_b")).alias("relative_percent"), d.alias("cohens_d"))


def independent_verdict(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds p, significant, effect class and power to rows of :func:`independent_test`.

    The power is that of a one-sample test with the size of the first sample, as the comparison reports it.
    """
    known = tests.withColumns({"p": student.two_sided(F.col("t"), F.col("df")), "effect_class": student.effect_class(F.col("cohens_d")), "power": student.power(F.col("cohens_d"), F.col("n_a"), alpha)})
    return known.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def linear_fit(rows: DataFrame, y: str, x: Column) -> DataFrame:
    """One row: slope, intercept, r and r squared of y on x."""
    y_, x_ = F.col(y), x
    return rows.agg(F.count("*").alias("n"), F.regr_slope(y_, x_).alias("slope"), F.regr_intercept(y_, x_).alias("intercept"), F.corr(y_, x_).alias("r"), F.regr_r2(y_, x_).alias("r2"))


def residual_stats(rows: DataFrame, name: str, y: str, x: Column) -> DataFrame:
    """One row: mean and sample deviation of the residuals of the fit, and the names of the largest and least."""
    fit = linear_fit(rows, y, x).select("slope", "intercept")  # one row
    res = rows.crossJoin(F.broadcast(fit)).withColumn("residual", F.col(y) - (F.col("slope") * x + F.col("intercept")))
    return res.agg(F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("std"), F.max_by(name, F.struct("residual", name)).alias("best"), F.min_by(name, F.struct("residual", name)).alias("worst"))


def confusion(scored: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row: tn, fp, fn, tp, with precision, recall and F1 of the positive class (0 on a zero division)."""
    y, p = label == 1, predicted == 1
    out = scored.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def roc_auc(scored: DataFrame, label: str, score: str, count: str | None = None) -> DataFrame:
    """One row: n_pos, n_neg and the exact area by average ranks; null with one class only. count: how many rows a row stands for."""
    own = F.lit(1) if count is None else F.col(count)
    values = scored.groupBy(F.col(score).alias("s")).agg(F.sum(own).alias("n"), F.sum(F.when(F.col(label) == 1, own).otherwise(0)).alias("pos")).withColumn("all", F.lit(0))
    ranked = prefix_sums(values, ["all"], "s", "n", [])
    rank = F.col("before") + (F.col("n") + 1) / 2
    out = ranked.agg(F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"), F.sum(F.col("pos") * rank).alias("ranks"))
    area = (F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))
    return out.select("n_pos", "n_neg", area.alias("auc"))


def class_report(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class: precision, recall, F1, support, and the share of right answers among its rows."""
    cells = scored.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    right = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    # a cell counts for the class of its label and for the predicted one, so that rows are judged once; null is a class without rows
    sides = F.array(F.struct(F.col("y").alias("class"), right.alias("hit"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")))
    known = lambda c: F.sum(F.when(F.col("class").isNotNull(), F.col(c)).otherwise(0)).alias(c)
    out = cells.select(F.explode(sides).alias("x")).select("x.*").groupBy("class").agg(known("hit"), known("support"), known("claimed"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("hit"), F.col("claimed"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.select("class", "precision", "recall", f1.alias("f1"), "support")


def averaged_report(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a class report, with accuracy (the weighted recall)."""
    w = F.col("support") / F.nullif(F.sum("support").over(Window.partitionBy()), F.lit(0))
    per = report.withColumn("w", w)  # one row per class
    return per.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(F.sum(F.col("w") * F.col(c)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")), F.sum("support").alias("support"), F.sum(F.col("w") * F.col("recall")).alias("accuracy"))
