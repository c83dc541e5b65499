"""Registered queries on distributions, policy tests, model figures, features and samples."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from pagetrail.functions import scalars
from pagetrail.operators import candidates, features, sampling, statistics
from pagetrail.operators.ranking import prefix_sums, row_numbers
from pagetrail.plans.adapters import DAY, EVENTS_SQL, HOUR, ORDERS_SQL, events_trace, orders_trace, table
from pagetrail.plans.registry import query

# A20, A21, A23, A34, A42, W9, W11


@query(
    """WITH s AS (SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS total FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(least(floor((l_quantity - low) / ((high - low) / 20)), 19) AS BIGINT) AS bin, count(*) AS n,
       round(count(*) / (any_value(total) * any_value((high - low) / 20)), 9) AS density FROM lineitem JOIN s USING (l_returnflag) GROUP BY ALL"""
)
def histogram_linear(spark, d):
    out = statistics.histogram(table(spark, d, "lineitem"), "l_quantity", 20, ["l_returnflag"], density=True)
    return out.withColumn("density", F.round("density", 9))


@query(
    """WITH v AS (SELECT o_orderstatus, log10(o_totalprice) AS lg FROM orders WHERE o_totalprice > 0), s AS (SELECT min(lg) AS low, max(lg) AS high FROM v)
SELECT o_orderstatus, CAST(least(floor((lg - low) / ((high - low) / 49)), 48) AS BIGINT) AS bin, count(*) AS n FROM v, s GROUP BY ALL"""
)
def histogram_log(spark, d):
    return statistics.log_histogram(table(spark, d, "orders"), "o_totalprice").groupBy("o_orderstatus", "bin").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, round(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) / count(*) OVER (PARTITION BY o_orderpriority), 9) AS share FROM orders")
def ecdf(spark, d):
    rows = statistics.ecdf(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"], ["o_orderkey"])
    return rows.select("o_orderpriority", "o_orderkey", F.col("rn").alias("k"), F.round("share", 9).alias("share"))


@query("SELECT c_custkey, round((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 0.5) / count(*) OVER (), 9) AS position FROM customer")
def qq_positions(spark, d):
    rows = statistics.qq_points(table(spark, d, "customer").withColumn("all", F.lit(0)), "c_acctbal", ["all"], ["c_custkey"])
    return rows.select("c_custkey", F.round("position", 9).alias("position"))


#: The normal distribution by Simpson's rule on a grid, inverted by a step of second order from the grid point below.
_NORMAL_SQL = """
cells AS (SELECT i, i * 0.001 AS z, 0.3989422804014327 * exp((i * 0.001) ** 2 / -2) AS f0, 0.3989422804014327 * exp((i * 0.001 + 0.0005) ** 2 / -2) AS f1, 0.3989422804014327 * exp((i * 0.001 + 0.001) ** 2 / -2) AS f2 FROM range(0, 6000) t(i)),
normal AS (SELECT z, f0, 0.5 + coalesce(sum((f0 + 4 * f1 + f2) / 6000) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cells)"""


@query(
    f"""WITH {_NORMAL_SQL}, p AS (SELECT c_custkey, c_acctbal, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 0.5) / count(*) OVER () AS p FROM customer),
u AS (SELECT *, greatest(p, 1 - p) AS q FROM p), d AS (SELECT u.*, n.z, (q - below) / f0 AS d FROM u ASOF JOIN normal n ON u.q >= n.below)
SELECT c_custkey, c_acctbal, round((z + d + z * d * d / 2) * CASE WHEN p < 0.5 THEN -1 ELSE 1 END, 5) + 0.0 AS theoretical FROM d"""
)
def qq_points(spark, d):
    scored = statistics.normal_scores(statistics.qq_points(table(spark, d, "customer").withColumn("all", F.lit(0)), "c_acctbal", ["all"], ["c_custkey"]))
    return scored.select("c_custkey", "c_acctbal", (F.round("theoretical", 5) + 0.0).alias("theoretical"))


@query(
    """WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS a, max(l_extendedprice) AS b, any_value(m) AS m, avg((l_extendedprice - m) ** 2) AS m2, avg((l_extendedprice - m) ** 3) AS m3, avg((l_extendedprice - m) ** 4) AS m4 FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, n AS nobs, a AS least, b AS largest, round(m, 4) AS mean, round(m2 * n / (n - 1), 2) AS variance, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM c"""
)
def describe_stats(spark, d):
    out = statistics.describe(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.withColumns({"mean": F.round("mean", 4), "variance": F.round("variance", 2), "skewness": F.round("skewness", 6), "kurtosis": F.round("kurtosis", 6)})


@query("SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS largest FROM orders GROUP BY 1")
def describe_table(spark, d):
    out = statistics.describe_table(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    """WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
r AS (SELECT *, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM orders JOIN q USING (o_orderstatus))
SELECT o_orderstatus, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, min(o_totalprice) FILTER (inside) AS low_whisker, max(o_totalprice) FILTER (inside) AS high_whisker, count(*) FILTER (NOT inside) AS n_outliers FROM r GROUP BY 1"""
)
def box_stats(spark, d):
    out = statistics.box_stats(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


# Runs are days; users with an even number run the model policy

_RUNS_SQL = """
r AS (SELECT CASE WHEN page % 2 = 0 THEN 'model' ELSE 'normal' END AS policy, CAST(floor(ts / 86400000000) AS BIGINT) AS stamp, kind FROM (SELECT page, ts, 'a' AS kind FROM access UNION ALL SELECT page, ts, 'i' FROM insertion)),
runs AS (SELECT policy, stamp, count(*) FILTER (kind = 'a') AS accesses, count(*) FILTER (kind = 'i') AS insertions FROM r GROUP BY ALL HAVING count(*) FILTER (kind = 'a') > 0),
rated AS (SELECT *, insertions / accesses AS insertion_rate, row_number() OVER (PARTITION BY policy ORDER BY stamp) AS rn FROM runs),
pairs AS (SELECT m.rn - 1 AS pair_index, m.stamp AS model_stamp, m.accesses AS model_accesses, m.insertions AS model_insertions, m.insertion_rate AS model_insertion_rate,
                 n.stamp AS normal_stamp, n.accesses AS normal_accesses, n.insertions AS normal_insertions, n.insertion_rate AS normal_insertion_rate
          FROM rated m JOIN rated n ON m.rn = n.rn WHERE m.policy = 'model' AND n.policy = 'normal' AND m.rn <= 50)
"""


def _runs(spark, d):
    t = events_trace(spark, d)
    tag = lambda rows: rows.select(F.when(F.col("page") % 2 == 0, "model").otherwise("normal").alias("policy"), F.floor(F.col("ts") / DAY).alias("stamp"))
    return statistics.run_summaries(tag(t.access), tag(t.insertion))


def _pairs(spark, d):
    return statistics.paired_runs(_runs(spark, d), "model", "normal", most=50)


@query(f"+ {_RUNS_SQL} SELECT policy, stamp, accesses, insertions, round(insertion_rate, 9) AS insertion_rate FROM rated", EVENTS_SQL)
def run_summaries(spark, d):
    return _runs(spark, d).withColumn("insertion_rate", F.round("insertion_rate", 9))


@query(f"+ {_RUNS_SQL} SELECT * REPLACE (round(model_insertion_rate, 9) AS model_insertion_rate, round(normal_insertion_rate, 9) AS normal_insertion_rate) FROM pairs", EVENTS_SQL)
def paired_runs(spark, d):
    return _pairs(spark, d).withColumns({c: F.round(c, 9) for c in ("model_insertion_rate", "normal_insertion_rate")}).withColumn("pair_index", F.col("pair_index").cast("long"))


@query(
    f"""+ {_RUNS_SQL}, x AS (SELECT model_insertion_rate AS a, normal_insertion_rate AS b FROM pairs)
SELECT count(*) AS n, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg(a - b), 9) AS mean_diff, round(stddev_samp(a - b), 9) AS sd_diff,
       round(stddev_samp(a - b) / sqrt(count(*)), 9) AS se, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t, round(avg(a - b) / stddev_samp(a - b), 6) AS effect_size FROM x""",
    EVENTS_SQL,
)
def paired_ttest(spark, d):
    out = statistics.paired_test(_pairs(spark, d), F.col("model_insertion_rate"), F.col("normal_insertion_rate"))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_a", "mean_b", "mean_diff", "sd_diff", "se")} | {c: F.round(c, 6) for c in ("t", "effect_size")})


def _student_sql(edge: float = 0.975) -> str:
    """CTEs that turn a table ``tst`` of one row (df, t, effect, n_power) into ``judged`` (p, edge, power): densities over their
    gamma functions, the edge by bisection, the normal distribution as a second integral. Edge and power are those of n_power - 1."""
    weight = lambda i, steps: f"(CASE WHEN {i} IN (0, {steps}) THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END)"
    cosines = lambda a: f"exp((df - 1) * ln(greatest(cos({a}), 1e-300)))"
    mass = "exp(lgamma(0.5) + lgamma(df / 2.0) - lgamma(df / 2.0 + 0.5)) / 2"
    angle = "(low + high) / 2"
    return f"""turned AS (SELECT df, {mass} AS mass, atan(abs(t) / sqrt(df)) AS a, least(pi() / 2, atan(abs(t) / sqrt(df)) + 16 / sqrt(df)) AS b FROM tst),
tailed AS (SELECT sum({weight("i", 4000)} * {cosines("a + i * (b - a) / 4000")}) * any_value(b - a) / 12000 / any_value(mass) AS p FROM turned, range(4001) AS g(i)),
own AS (SELECT n_power - 1 AS df, effect * sqrt(n_power) AS shift FROM tst),
halved AS (SELECT df, {mass} * {2 * edge - 1} AS goal, 0.0::DOUBLE AS low, pi() / 2 AS high, 0 AS k FROM own
  UNION ALL SELECT df, goal, CASE WHEN m < goal THEN {angle} ELSE low END, CASE WHEN m < goal THEN high ELSE {angle} END, k + 1
  FROM (SELECT *, list_sum(list_transform(range(2001), lambda i: {weight("i", 2000)} * {cosines(f"{angle} * i / 2000")})) * {angle} / 6000 AS m FROM halved WHERE k < 55)),
edges AS (SELECT df, shift, sqrt(df) * tan(low) AS edge, greatest(1e-9, 1 - 12 / sqrt(2.0 * df)) AS low_s, 1 + 12 / sqrt(2.0 * df) AS high_s FROM halved JOIN own USING (df) WHERE k = 55),
points AS (SELECT *, low_s + i * (high_s - low_s) / 2000 AS s, {weight("i", 2000)} * (high_s - low_s) / 6000 AS w FROM edges, range(2001) AS g(i)),
spans AS (SELECT *, least(greatest(-edge * s - shift, -9), 9) AS z0, least(greatest(edge * s - shift, -9), 9) AS z1 FROM points),
parts AS (SELECT s, df, w, sum({weight("j", 800)} * exp(-pow(z0 + j * (z1 - z0) / 800, 2) / 2)) * any_value(z1 - z0) / 2400 / sqrt(2 * pi()) AS inside FROM spans, range(801) AS g(j) GROUP BY s, df, w),
missed AS (SELECT 1 - sum(w * inside * exp(ln(2) + df / 2.0 * ln(df / 2.0) - lgamma(df / 2.0) + (df - 1) * ln(s) - df * s * s / 2)) AS power FROM parts),
judged AS (SELECT p, edge, power FROM tailed, edges, missed)"""


def _effect_sql(d: str) -> str:
    return f"CASE WHEN abs({d}) < 0.2 THEN 'negligible' WHEN abs({d}) < 0.5 THEN 'small' WHEN abs({d}) < 0.8 THEN 'medium' ELSE 'large' END AS effect_class"


@query(
    f"""+ {_RUNS_SQL}, x AS (SELECT model_insertion_rate AS a, normal_insertion_rate AS b FROM pairs),
f AS (SELECT count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd_diff FROM x),
tst AS (SELECT n - 1 AS df, mean_diff / (sd_diff / sqrt(n)) AS t, mean_diff / sd_diff AS effect, n AS n_power FROM f),
{_student_sql()}
SELECT 'events' AS workload, n AS n_pairs, round(mean_a, 9) AS mean_a, round(mean_b, 9) AS mean_b, round(mean_diff, 9) AS mean_diff, round(sd_diff, 9) AS sd_diff, round(mean_diff / sd_diff * sqrt(n), 6) AS t, round(p, 7) AS p,
       round(mean_diff - edge * sd_diff / sqrt(n), 7) AS ci_low, round(mean_diff + edge * sd_diff / sqrt(n), 7) AS ci_high, round(mean_diff / sd_diff, 6) AS effect_size, {_effect_sql("mean_diff / sd_diff")},
       p < 0.05 AS significant, round(power, 7) AS power, 0.05::DOUBLE AS alpha FROM f, judged""",
    EVENTS_SQL,
    recursive=True,
)
def paired_verdict(spark, d):
    tests = statistics.paired_test(_pairs(spark, d), F.col("model_insertion_rate"), F.col("normal_insertion_rate")).withColumn("workload", F.lit("events"))
    digits = dict.fromkeys(("mean_a", "mean_b", "mean_diff", "sd_diff"), 9) | dict.fromkeys(("t", "effect_size"), 6) | dict.fromkeys(("p", "ci_low", "ci_high", "power"), 7)
    return statistics.paired_verdict(tests).withColumns({c: F.round(c, n) for c, n in digits.items()})


_TWO = """WITH x AS (SELECT o_totalprice AS v, o_orderpriority = '1-URGENT' AS a, o_orderpriority = '5-LOW' AS b FROM orders),
m AS (SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, avg(v) FILTER (a) AS mean_a, avg(v) FILTER (b) AS mean_b, var_samp(v) FILTER (a) AS va, var_samp(v) FILTER (b) AS vb,
             var_pop(v) FILTER (a) AS pa, var_pop(v) FILTER (b) AS pb, quantile_cont(v, 0.5) FILTER (a) AS median_a, quantile_cont(v, 0.5) FILTER (b) AS median_b FROM x)"""


@query(
    f"""{_TWO} SELECT n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(median_a, 4) AS median_a, round(median_b, 4) AS median_b, round(sqrt(pa), 4) AS std_a, round(sqrt(pb), 4) AS std_b,
round((mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)), 6) AS t, n_a + n_b - 2 AS df, round(100 * (mean_a - mean_b) / mean_b, 6) AS relative_percent, round((mean_a - mean_b) / sqrt((pa + pb) / 2), 6) AS cohens_d FROM m"""
)
def independent_ttest(spark, d):
    out = statistics.independent_test(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", "1-URGENT", "5-LOW")
    return out.withColumns({c: F.round(c, 4) for c in ("mean_a", "mean_b", "median_a", "median_b", "std_a", "std_b")} | {c: F.round(c, 6) for c in ("t", "relative_percent", "cohens_d")})


@query(
    f"""{_TWO.replace("WITH ", "WITH RECURSIVE ", 1)}, f AS (SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)) AS t, (mean_a - mean_b) / sqrt((pa + pb) / 2) AS d FROM m),
tst AS (SELECT n_a + n_b - 2 AS df, t, d AS effect, n_a AS n_power FROM f),
{_student_sql()}
SELECT n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(t, 6) AS t, n_a + n_b - 2 AS df, round(d, 6) AS cohens_d, round(p, 7) AS p, p < 0.05 AS significant, {_effect_sql("d")}, round(power, 7) AS power FROM f, judged"""
)
def independent_verdict(spark, d):
    tests = statistics.independent_test(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", "1-URGENT", "5-LOW")
    digits = dict.fromkeys(("mean_a", "mean_b"), 4) | dict.fromkeys(("t", "cohens_d"), 6) | dict.fromkeys(("p", "power"), 7)
    out = statistics.independent_verdict(tests).withColumns({c: F.round(c, n) for c, n in digits.items()})
    return out.select("n_a", "n_b", "mean_a", "mean_b", "t", "df", "cohens_d", "p", "significant", "effect_class", "power")


# A supplier is a model; its support is its number of line items

_MODELS_SQL = "m AS (SELECT l_suppkey AS model, count(*) AS support, avg(l_discount) AS auc FROM lineitem GROUP BY 1)"


def _models(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(F.count("*").alias("support"), F.avg("l_discount").alias("auc"))


@query(f"WITH {_MODELS_SQL} SELECT count(*) AS n, round(regr_slope(auc, log10(support)), 8) AS slope, round(regr_intercept(auc, log10(support)), 8) AS intercept, round(corr(auc, log10(support)), 8) AS r, round(regr_r2(auc, log10(support)), 8) AS r2 FROM m")
def linear_fit(spark, d):
    out = statistics.linear_fit(_models(spark, d), "auc", F.log10("support"))
    return out.withColumns({c: F.round(c, 8) for c in ("slope", "intercept", "r", "r2")})


@query(
    f"""WITH {_MODELS_SQL}, f AS (SELECT regr_slope(auc, log10(support)) AS s, regr_intercept(auc, log10(support)) AS i FROM m), r AS (SELECT model, auc - (s * log10(support) + i) AS residual FROM m, f)
SELECT abs(round(avg(residual), 8)) AS mean, round(stddev_samp(residual), 8) AS std, arg_max(model, residual) AS best, arg_min(model, residual) AS worst FROM r"""
)
def residual_stats(spark, d):
    out = statistics.residual_stats(_models(spark, d), "model", "auc", F.log10("support"))
    return out.withColumns({"mean": F.abs(F.round("mean", 8)), "std": F.round("std", 8)})


@query(f"WITH {_MODELS_SQL} SELECT model, support, round(auc, 9) AS auc, rank() OVER (ORDER BY round(auc, 9) DESC, model) AS place FROM m QUALIFY place <= 10")
def best_models(spark, d):
    top = _models(spark, d).withColumn("auc", F.round("auc", 9)).orderBy(F.desc("auc"), "model").limit(10).withColumn("all", F.lit(0)).withColumn("down", -F.col("auc"))
    return row_numbers(top, ["all"], "down", ["model"]).select("model", "support", "auc", F.col("rn").alias("place"))


# An event is scored by its value; purchases are positive

_SCORED_SQL = "s AS (SELECT event_id, value, value / (1 + abs(value)) AS score, CAST(event_type = 'purchase' AS INTEGER) AS label FROM access)"


def _scored(spark, d):
    a = events_trace(spark, d).access
    return a.select("event_id", "value", (F.col("value") / (1 + F.abs("value"))).alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))


@query(
    f"""+ {_SCORED_SQL}, c AS (SELECT count(*) FILTER (label = 0 AND score <= 0.98) AS tn, count(*) FILTER (label = 0 AND score > 0.98) AS fp, count(*) FILTER (label = 1 AND score <= 0.98) AS fn, count(*) FILTER (label = 1 AND score > 0.98) AS tp FROM s),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM c)
SELECT tn, fp, fn, tp, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1 FROM p""",
    EVENTS_SQL,
)
def confusion_prf(spark, d):
    out = statistics.confusion(_scored(spark, d), F.col("label"), (F.col("score") > 0.98).cast("int"))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    f"""+ {_SCORED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS ar FROM s),
t AS (SELECT CAST(sum(label) AS BIGINT) AS n_pos, count(*) - CAST(sum(label) AS BIGINT) AS n_neg, sum(label * ar) AS ranks FROM r)
SELECT n_pos, n_neg, round((ranks - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 9) AS auc FROM t""",
    EVENTS_SQL,
)
def roc_auc_exact(spark, d):
    return statistics.roc_auc(_scored(spark, d), "label", "value").withColumn("auc", F.round("auc", 9))


_CLASSES_SQL = """WITH x AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS y, CAST(floor(o_totalprice / 50000) AS INTEGER) % 5 AS p FROM orders),
k AS (SELECT DISTINCT y AS class FROM x UNION SELECT DISTINCT p FROM x),
c AS (SELECT class, (SELECT count(*) FROM x WHERE y = class AND p = class) AS hit, (SELECT count(*) FROM x WHERE y = class) AS support, (SELECT count(*) FROM x WHERE p = class) AS claimed FROM k),
r AS (SELECT class, coalesce(hit / nullif(claimed, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


def _classes(spark, d):
    return table(spark, d, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("y"), (F.floor(F.col("o_totalprice") / 50000).cast("int") % 5).alias("p"))


@query(f"{_CLASSES_SQL} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f")
def class_report(spark, d):
    out = statistics.class_report(_classes(spark, d), "y", "p")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    f"""{_CLASSES_SQL}, w AS (SELECT *, support / sum(support) OVER () AS w FROM f)
SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, round(sum(w * precision), 9) AS weighted_precision, round(sum(w * recall), 9) AS weighted_recall,
       round(sum(w * f1), 9) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support, round(sum(w * recall), 9) AS accuracy FROM w"""
)
def class_report_averages(spark, d):
    out = statistics.averaged_report(statistics.class_report(_classes(spark, d), "y", "p"))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "support"})


@query("SELECT CAST(o_orderkey % 5 AS INTEGER) AS y, round(avg(CAST(CAST(floor(o_totalprice / 50000) AS INTEGER) % 5 = o_orderkey % 5 AS INTEGER)), 9) AS accuracy, count(*) AS n FROM orders GROUP BY 1")
def per_class_accuracy(spark, d):
    return _classes(spark, d).groupBy("y").agg(F.round(F.avg((F.col("y") == F.col("p")).cast("int")), 9).alias("accuracy"), F.count("*").alias("n"))


# M1-M5, M9, M10, M14, M11 labels

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _edges(spark, d, n_bins=10, **options):
    return features.quantile_edges(table(spark, d, "lineitem"), _FEATURES, n_bins, **options)


def _edge_rows(spark, edges):
    return spark.createDataFrame([(f, i, round(e, 6)) for f, own in edges.items() for i, e in enumerate(own)], "feature string, i int, edge double")


_LONG_SQL = "l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM lineitem" for f in _FEATURES) + ")"
_EDGES_SQL = f"""{_LONG_SQL},
q AS (SELECT feature, unnest(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edge, unnest(range(11)) AS i FROM l GROUP BY feature),
kept AS (SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM (SELECT *, lag(edge) OVER (PARTITION BY feature ORDER BY i) AS before FROM q) WHERE before IS NULL OR edge - before > 1e-8)"""


@query(f"WITH {_EDGES_SQL} SELECT feature, CAST(i AS INTEGER) AS i, round(edge, 6) AS edge FROM kept")
def quantile_edges_linear(spark, d):
    return _edge_rows(spark, _edges(spark, d))


@query(
    f"""WITH {_LONG_SQL}, n AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS k, count(*) OVER (PARTITION BY feature) AS n FROM l),
q AS (SELECT feature, s.i, (any_value(v) FILTER (k = greatest(1, (n * s.i + 4) // 5)) + any_value(v) FILTER (k = least(n, n * s.i // 5 + 1))) / 2 AS edge FROM n, (SELECT unnest(range(6)) AS i) s GROUP BY feature, s.i),
kept AS (SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY i) - 1 AS i FROM (SELECT *, lag(edge) OVER (PARTITION BY feature ORDER BY i) AS before FROM q) WHERE before IS NULL OR edge - before > 1e-8)
SELECT feature, CAST(i AS INTEGER) AS i, round(edge, 6) AS edge FROM kept"""
)
def quantile_edges_aicdf(spark, d):
    return _edge_rows(spark, _edges(spark, d, 5, method="averaged_inverted_cdf"))


@query("WITH " + _LONG_SQL + ", m AS (SELECT feature, min(v) AS a, max(v) AS b FROM l GROUP BY feature) SELECT feature, CAST(i AS INTEGER) AS i, round(a + (b - a) * (i / 10.0), 6) AS edge FROM m, (SELECT unnest(range(11)) AS i)")
def quantile_edges_uniform(spark, d):
    return _edge_rows(spark, _edges(spark, d, strategy="uniform"))


# Artefacts are written and read again


@query(f"WITH {_EDGES_SQL} SELECT feature, CAST(i AS INTEGER) AS i, round(edge, 6) AS edge FROM kept")
def stored_bin_edges(spark, d):
    from pagetrail.sources.artifacts import edges_from, edges_table
    from pagetrail.sources.files import new_folder

    folder = new_folder(spark)
    edges_table(spark, _edges(spark, d)).write.parquet(folder)
    return _edge_rows(spark, edges_from(spark.read.parquet(folder)))


_WEIGHT = "(((bin * 7 + place * 3) % 11 - 5) * 0.123::DOUBLE)"


@query(
    f"""WITH {_EDGES_SQL}, named AS (SELECT feature, i, n, edge, list_position({_FEATURES}, feature) - 1 AS place FROM kept),
bins AS (SELECT DISTINCT feature, place, n, unnest(range(n - 1)) AS bin FROM named),
cut AS (SELECT feature, string_agg(CAST(trunc(edge) AS BIGINT)::VARCHAR, ',' ORDER BY i) AS bin_edges FROM named WHERE i BETWEEN 1 AND n - 2 GROUP BY feature),
weighed AS (SELECT feature, place, any_value(n) - 1 AS n_bins, string_agg(CAST(trunc({_WEIGHT} * 10000) AS BIGINT)::VARCHAR, ',' ORDER BY bin) AS weights_int FROM bins GROUP BY feature, place)
SELECT 'binary_reuse_classifier' AS model_type, 4::BIGINT AS n_features, 4567::BIGINT AS bias_int, 2500::BIGINT AS threshold_int, place::BIGINT AS index, feature AS name, n_bins::BIGINT AS n_bins, bin_edges, weights_int FROM weighed JOIN cut USING (feature)"""
)
def exported_model(spark, d):
    """The model file, feature by feature; weights follow from the places of feature and bin."""
    from pagetrail.sources.artifacts import write_json
    from pagetrail.sources.files import new_folder

    edges = _edges(spark, d)
    weights = {f: [((b * 7 + j * 3) % 11 - 5) * 0.123 for b in range(n)] for j, (f, n) in enumerate(features.n_bins_of(edges).items())}
    document = features.export_document(features.LinearModel(tuple(_FEATURES), edges, weights, 0.4567), threshold=0.25)
    path = f"{new_folder(spark)}/model_weights.json"
    write_json(spark, path, document)
    found = spark.read.json(path, multiLine=True).select("model_type", "n_features", "bias_int", "threshold_int", F.explode("features").alias("f"))
    return found.select("model_type", "n_features", "bias_int", "threshold_int", "f.index", "f.name", "f.n_bins", F.array_join("f.bin_edges", ",").alias("bin_edges"), F.array_join("f.weights_int", ",").alias("weights_int"))


_BINNED_SQL = f"""WITH {_EDGES_SQL}, b AS (SELECT l.feature, l.v, (SELECT count(*) FROM kept k WHERE k.feature = l.feature AND k.i BETWEEN 1 AND k.n - 2 AND k.edge <= l.v) AS bin FROM l)"""


@query(f"{_BINNED_SQL} SELECT feature, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS largest FROM b GROUP BY ALL")
def bin_assign(spark, d):
    binned = features.discretise(table(spark, d, "lineitem"), _edges(spark, d))
    long = binned.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_bin").alias("bin"), F.col(f).cast("double").alias("v")) for f in _FEATURES))).alias("x")).select("x.*")
    return long.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("largest"))


@query(
    f"""{_BINNED_SQL},
w AS (SELECT feature, any_value(n) - 1 AS width, list_position(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], feature) AS p FROM kept GROUP BY feature),
o AS (SELECT a.feature, CAST(coalesce(sum(c.width), 0) AS BIGINT) AS start FROM w a LEFT JOIN w c ON c.p < a.p GROUP BY a.feature)
SELECT CAST(start + bin AS INTEGER) AS position, count(*) AS n FROM b JOIN o USING (feature) GROUP BY 1"""
)
def one_hot_counts(spark, d):
    edges = _edges(spark, d)
    # rows of equal bins are encoded once; encoding inlines the bins of each feature several times
    cells = features.cells_of(features.discretise(table(spark, d, "lineitem"), edges), [f"{f}_bin" for f in edges])
    hot = features.one_hot_positions(cells, features.n_bins_of(edges))
    return hot.select(F.explode("hot").alias("position"), "n").groupBy("position").agg(F.sum("n").alias("n"))


def _fixed_model(edges):
    """Weights that follow from the bin's place, so that the oracle can state them."""
    n = features.n_bins_of(edges)
    return features.LinearModel(tuple(edges), edges, {f: [(b - 3) * (i + 1) / 7 for b in range(n[f])] for i, f in enumerate(edges)}, 0.125)


_WEIGHT_SQL = "(bin - 3) * list_position(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], feature) / 7.0"


@query(
    f"""WITH {_EDGES_SQL}, li AS (SELECT row_number() OVER () AS id, * FROM lineitem),
ll AS ({' UNION ALL '.join(f"SELECT id, '{f}' AS feature, {f} AS v FROM li" for f in _FEATURES)}),
b AS (SELECT id, l.feature, (SELECT count(*) FROM kept k WHERE k.feature = l.feature AND k.i BETWEEN 1 AND k.n - 2 AND trunc(k.edge) <= l.v) AS bin FROM ll l),
s AS (SELECT id, CAST(sum(CAST(trunc(10000 * ({_WEIGHT_SQL})) AS BIGINT)) AS BIGINT) + 1250 AS score_int FROM b GROUP BY id)
SELECT score_int, score_int > 0 AS keep, count(*) AS n FROM s GROUP BY ALL"""
)
def integer_score(spark, d):
    document = features.export_document(_fixed_model(_edges(spark, d)))
    return features.integer_score(table(spark, d, "lineitem"), document).groupBy("score_int", "keep").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES_SQL}, b AS (SELECT feature, unnest(range(any_value(n) - 1)) AS bin FROM kept GROUP BY feature) SELECT feature, CAST(bin AS INTEGER) AS bin, feature || '_' || bin AS label, round({_WEIGHT_SQL}, 9) AS weight, CASE WHEN {_WEIGHT_SQL} > 0 THEN 'keep' ELSE 'evict' END AS tag FROM b")
def weight_table(spark, d):
    return features.weight_table(spark, _fixed_model(_edges(spark, d))).withColumn("weight", F.round("weight", 9))


_REACHED = " + ".join(f"CAST(o_totalprice >= e[{k}] AS INTEGER)" for k in (2, 3, 4, 5))


@query(f"WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM orders) SELECT CAST({_REACHED} AS INTEGER) AS reuse_class, count(*) AS n FROM orders, q GROUP BY 1")
def reuse_classes(spark, d):
    from pagetrail.plans.training import class_of_reuse

    return class_of_reuse(table(spark, d, "orders"), "o_totalprice").groupBy("reuse_class").agg(F.count("*").alias("n"))


# X: scalars


@query(
    """SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS s, CAST(round_even(value, 0) AS BIGINT) AS half_even, CAST(trunc(value) AS BIGINT) AS truncated, round(log10(value + 1), 9) AS lg,
least(greatest(value, 20), 60) AS clipped, CASE WHEN value > 50 THEN 'keep' ELSE 'evict' END AS tag, event_type || '_' || event_id AS label, round(ts / 1e9, 6) AS seconds FROM access""",
    EVENTS_SQL,
)
def scalar_functions(spark, d):
    v = F.col("value")
    return events_trace(spark, d).access.select("event_id", F.round(scalars.sigmoid(v / 100), 9).alias("s"), scalars.round_half_even(v).alias("half_even"), scalars.truncate(v).alias("truncated"), F.round(F.log10(v + 1), 9).alias("lg"), scalars.clip(v, F.lit(20.0), F.lit(60.0)).alias("clipped"), scalars.keep_or_evict(v - 50).alias("tag"), scalars.bin_label(F.col("event_type"), F.col("event_id")).alias("label"), F.round(scalars.ns_to_seconds(F.col("ts")), 6).alias("seconds"))


@query("SELECT event_id, CAST(ts // 3600000000 AS BIGINT) AS hour FROM access WHERE value >= 10 AND value < 20", EVENTS_SQL)
def projected_filter(spark, d):
    return events_trace(spark, d).access.where((F.col("value") >= 10) & (F.col("value") < 20)).select("event_id", F.floor(F.col("ts") / HOUR).alias("hour"))


# Prefix sums and ranks


@query("SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders")
def prefix_sum(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(0).alias("all"))
    return prefix_sums(rows, ["all"], "o_orderkey", "o_custkey", []).select("o_orderkey", F.col("before").cast("long").alias("before"))


@query("+ p AS (SELECT DISTINCT page, ts FROM access) SELECT page, ts AS x, (SELECT count(*) FROM eviction e WHERE e.ts < p.ts) AS n_before, (SELECT count(*) FROM eviction e WHERE e.ts <= p.ts) AS n_up_to FROM p", ORDERS_SQL)
def event_rank(spark, d):
    t = orders_trace(spark, d)
    asked = t.access.select("trial_id", "page", F.col("ts").alias("x")).distinct().withColumn("side", F.explode(F.array(F.lit(candidates.BEFORE), F.lit(candidates.UP_TO))))
    ranked = candidates.event_rank(asked, t.eviction, spread=t.access.select("trial_id", F.col("ts").alias("x")))
    return ranked.groupBy("page", "x").agg(F.max(F.when(F.col("side") == candidates.BEFORE, F.col("rank"))).alias("n_before"), F.max(F.when(F.col("side") == candidates.UP_TO, F.col("rank"))).alias("n_up_to"))


# R: samples


def _bits(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


def _hash(*parts: str) -> str:
    return f"({_bits(*parts)} >> 8) / 4503599627370496.0"


_TRIAL_SQL = EVENTS_SQL.replace("0 AS trial_id", "CAST(event_id % 3 AS INTEGER) AS trial_id")
_SAMPLE_SQL = """
valid AS (SELECT e.* FROM eviction e JOIN (SELECT trial_id, max(ts) - 21600000000 AS last FROM access GROUP BY trial_id) USING (trial_id) WHERE ts <= last),
halves AS (SELECT trial_id, quantile_cont(ts, 0.8) AS cut, count(*) AS n FROM valid GROUP BY trial_id),
part AS ({part}),
nx AS (SELECT *, lead(ts) OVER (PARTITION BY trial_id, page ORDER BY ts) AS next_ts FROM access),
bands AS (SELECT a.trial_id, a.event_id, count(*) FILTER (e.ts <= a.ts) AS lo, count(*) FILTER (e.ts < least(a.next_ts, a.ts + 21600000000)) AS hi,
  count(*) FILTER (e.ts < least(a.next_ts, a.ts + 21600000000) AND (a.next_ts IS NULL OR e.ts <= greatest(a.ts, a.next_ts - 21600000000))) AS pos_lo FROM nx a JOIN part e USING (trial_id) GROUP BY ALL),
numbered AS (SELECT trial_id, ts AS e_ts, row_number() OVER (PARTITION BY trial_id ORDER BY ts) - 1 AS e_idx FROM part)"""


def _drawn_sql(start: str, stop: str, n: int, seed: int, stream: int, label: str) -> str:
    at = _bits(f"'{seed}'", f"'{stream}'", "trial_id", "draw")
    return f"""SELECT trial_id, draw, event_id, {start} + pt - ahead AS e_idx, {label} AS label FROM
  (SELECT trial_id, draw, {at} % total AS pt FROM (SELECT trial_id, sum({stop} - {start})::BIGINT AS total FROM bands GROUP BY trial_id HAVING sum({stop} - {start}) > 0), (SELECT unnest(range({n})) AS draw)) d
  JOIN (SELECT *, sum({stop} - {start}) OVER (PARTITION BY trial_id ORDER BY {_bits("'0'", "event_id")} % 4096, event_id)::BIGINT - ({stop} - {start}) AS ahead FROM bands) b USING (trial_id) WHERE pt >= ahead AND pt < ahead + {stop} - {start}"""


def _sample_sql(part: str, drawn: str) -> str:
    return f"""+ {_SAMPLE_SQL.format(part=part)}, drawn AS ({drawn})
SELECT trial_id, draw, event_id, e_idx, e_ts, CAST(label AS INTEGER) AS label, value, CAST(e_ts - a.ts AS FLOAT) AS time_since_last_access_at_eviction FROM drawn JOIN numbered USING (trial_id, e_idx) JOIN access a USING (trial_id, event_id)"""


_EARLY_SQL = "SELECT v.* FROM valid v JOIN halves USING (trial_id) WHERE NOT (n >= 2 AND ts >= cut)"
_LATE_SQL = "SELECT v.* FROM valid v JOIN halves USING (trial_id) WHERE n >= 2 AND ts >= cut"
_BALANCED_SQL = _drawn_sql("pos_lo", "hi", 500, 42, 1, "1") + " UNION ALL " + _drawn_sql("lo", "pos_lo", 500, 42, 2, "0")


def _draws(spark, d, balanced=False):
    t = events_trace(spark, d, trials=3)
    return sampling.sample_candidates(t.access, t.eviction, horizon=6 * HOUR, cap=6 * HOUR, n=1000, balanced=balanced, key="event_id", seed=42, features=["value"])


def _draws_of_part(spark, d, late, seed):
    t = events_trace(spark, d, trials=3)
    split = candidates.temporal_split(candidates.valid_evictions(t.access, t.eviction, 6 * HOUR), 0.2)
    part = split.where("is_eval" if late else "NOT is_eval").select("trial_id", "ts")
    return sampling.sample_candidates(t.access, part, horizon=6 * HOUR, cap=6 * HOUR, n=1000, balanced=False, key="event_id", seed=seed, features=["value"])


@query(_sample_sql("SELECT * FROM eviction", _BALANCED_SQL), _TRIAL_SQL)
def sample_balanced(spark, d):
    return _draws(spark, d, balanced=True)


@query(_sample_sql("SELECT * FROM eviction", _drawn_sql("lo", "hi", 1000, 42, 3, "lo + pt - ahead >= pos_lo")), _TRIAL_SQL)
def sample_natural(spark, d):
    return _draws(spark, d)


@query(_sample_sql(_EARLY_SQL, _drawn_sql("lo", "hi", 1000, 43, 3, "lo + pt - ahead >= pos_lo")), _TRIAL_SQL)
def sample_discretizer(spark, d):
    return _draws_of_part(spark, d, late=False, seed=43)


@query(_sample_sql(_LATE_SQL, _drawn_sql("lo", "hi", 1000, 44, 3, "lo + pt - ahead >= pos_lo")), _TRIAL_SQL)
def sample_holdout(spark, d):
    return _draws_of_part(spark, d, late=True, seed=44)


@query(
    f"""WITH h AS (SELECT o_orderkey, o_orderpriority, {_hash("'42'", "o_orderkey")} AS h FROM orders)
SELECT o_orderkey, o_orderpriority, h < 0.2 AS is_random_test, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.2::DOUBLE + 0.5) AS is_test FROM h"""
)
def sample_split(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_split(sampling.random_split(rows, 0.2, ["o_orderkey"], 42).withColumnRenamed("is_test", "is_random_test"), 0.2, "o_orderpriority", ["o_orderkey"], 42)


@query(f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY {_hash("'42'", "o_orderkey")}, o_orderkey LIMIT 1000""")
def sample_choice(spark, d):
    return sampling.choose(table(spark, d, "orders"), 1000, ["o_orderkey"], 42).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_hash("'42'", "o_orderkey")}, o_orderkey) - 1 AS place FROM orders""")
def row_shuffle(spark, d):
    """All rows in random order: written to files by ranges of their places and read again in the order of files and lines."""
    from pagetrail.sources.files import new_folder

    folder = new_folder(spark)
    rows = sampling.shuffled(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 42)
    rows.repartitionByRange("place").sortWithinPartitions("place").write.parquet(folder)
    return spark.read.parquet(folder)


@query(
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS t, o_custkey AS c FROM orders), m AS (SELECT count(*) AS m FROM n),
p AS (SELECT id AS pair, {_bits("'42'", "id")} % m AS a, {_bits("'43'", "id")} % (m - 1) AS step, m FROM (SELECT unnest(range(5000)) AS id), m)
SELECT pair, a, (a + 1 + step) % m AS b, x.t AS o_totalprice_a, x.c AS o_custkey_a, y.t AS o_totalprice_b, y.c AS o_custkey_b, CAST(x.t < y.t AS INTEGER) AS label FROM p JOIN n x ON x.i = a JOIN n y ON y.i = (a + 1 + step) % m WHERE x.t <> y.t"""
)
def random_pairs(spark, d):
    return sampling.random_pairs(spark, table(spark, d, "orders"), "o_totalprice", ["o_custkey"], 5000, order=["o_orderkey"], seed=42)


@query(
    f"""WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS t FROM orders), m AS (SELECT count(*) AS m FROM n),
p AS (SELECT {_bits("'42'", "id")} % m AS a, {_bits("'43'", "id")} % (m - 1) AS step, m FROM (SELECT unnest(range(5000)) AS id), m)
SELECT count(*) AS n_pairs, round(avg(CAST(x.t < y.t AS INTEGER)), 9) AS balance FROM p JOIN n x ON x.i = a JOIN n y ON y.i = (a + 1 + step) % m WHERE x.t <> y.t"""
)
def pair_balance(spark, d):
    from pagetrail.plans.training import pair_balance as balance

    return balance(random_pairs(spark, d)).withColumn("balance", F.round("balance", 9))


def _logit(features: int, bins: tuple[str, ...] = ("b",)) -> str:
    """The sum of weights over the bins of a cell; with two kinds of bins the difference of the sums."""
    sides = [" + ".join(f"w{f}[{kind}{f} + 1]" for f in range(features)) for kind in bins]
    return f"1 / (1 + exp(-({' - ('.join(sides)}{')' * (len(sides) - 1)})))"


def _fit_sql(features: int, n_bins: int, rounds: int, *, paired: bool = False) -> str:
    """CTE ``fit``: the weights w0, w1, ... of a logistic model over one-hot bins, from a table ``cells`` (b0, b1, ..., or a0, b0,
    ... for pairs; n1, n) by Newton steps on one feature's bins after another, with the ridge of the registered fits."""
    turn = lambda what: "CASE k % " + str(features) + " " + " ".join(f"WHEN {f} THEN {what(f)}" for f in range(features)) + " END"
    lists = [f"w{f}" for f in range(features)]
    here = f"({turn(lambda f: f'c.a{f}')} = b) <> ({turn(lambda f: f'c.b{f}')} = b)" if paired else f"{turn(lambda f: f'c.b{f}')} = b"
    sign = f"(CASE WHEN {turn(lambda f: f'c.a{f}')} = b THEN 1 ELSE -1 END)" if paired else "1"
    p, damp, own = _logit(features, ("a", "b") if paired else ("b",)), 0.5 if paired else 1.0, turn(lambda f: f"w{f}[b + 1]")
    return f"""total AS (SELECT sum(n) * 1e-6 AS ridge FROM cells),
fit AS (SELECT 0 AS k, {", ".join(f"list_transform(range({n_bins}), lambda i: 0.0::DOUBLE) AS {w}" for w in lists)}
  UNION ALL SELECT k + 1, {", ".join(f"CASE WHEN k % {features} = {f} THEN list_transform(new, lambda x: x - {'list_avg(new)' if paired else '0'}) ELSE {w} END AS {w}" for f, w in enumerate(lists))}
  FROM (SELECT k, {", ".join(lists)}, list(wb + {damp} * greatest(-2, least(2, coalesce((g - ridge * wb) / nullif(h + ridge, 0), 0))) ORDER BY b) AS new
    FROM (SELECT k, {", ".join(lists)}, b, any_value(ridge) AS ridge, {own} AS wb, coalesce(sum({sign} * (n1 - n * p)), 0) AS g, coalesce(sum(n * p * (1 - p)), 0) AS h
      FROM (SELECT s.*, c.n1, c.n, {sign} AS sgn, {p} AS p{", " + ", ".join(f"c.a{f}, c.b{f}" for f in range(features)) if paired else ""} FROM (SELECT fit.*, unnest(range({n_bins})) AS b FROM fit WHERE k < {rounds}) s LEFT JOIN cells c ON {here}) c, total
      GROUP BY k, {", ".join(lists)}, b) GROUP BY k, {", ".join(lists)})),
fitted AS (SELECT * FROM fit WHERE k = {rounds})"""


def _line_edges_sql(source: str, n_bins: int = 5) -> str:
    """CTE ``edges``: per feature the interior edges of lines by averaged inverted quantiles."""
    return f"""lf AS (SELECT 0 AS f, l_quantity AS v FROM {source} UNION ALL SELECT 1, l_discount FROM {source}),
ln AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS k, count(*) OVER (PARTITION BY f) AS n FROM lf),
le AS (SELECT f, s.i, (any_value(v) FILTER (k = greatest(1, (n * s.i + {n_bins - 1}) // {n_bins})) + any_value(v) FILTER (k = least(n, n * s.i // {n_bins} + 1))) / 2 AS edge FROM ln, (SELECT unnest(range({n_bins + 1})) AS i) s GROUP BY f, s.i),
lm AS (SELECT f, i, edge, row_number() OVER (PARTITION BY f ORDER BY i) AS k, count(*) OVER (PARTITION BY f) AS n FROM (SELECT *, lag(edge) OVER (PARTITION BY f ORDER BY i) AS before FROM le) WHERE before IS NULL OR edge - before > 1e-8),
edges AS (SELECT list(edge ORDER BY i) FILTER (f = 0 AND k > 1 AND k < n) AS e0, list(edge ORDER BY i) FILTER (f = 1 AND k > 1 AND k < n) AS e1 FROM lm)"""


_BIN_0, _BIN_1 = "len(list_filter(e0, lambda e: e <= l_quantity))", "len(list_filter(e1, lambda e: e <= l_discount))"
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_FIGURES = ("auc", "precision", "recall", "f1", "positive_rate")


def _drawn_points_sql(name: str, bands: str, start: str, stop: str, n: int, seed: int, stream: int, label: str) -> str:
    """As _drawn_sql for very many draws of one trial: each finds its range by an as-of join."""
    at = _bits(f"'{seed}'", f"'{stream}'", "trial_id", "draw")
    return f"""{name} AS (SELECT event_id, {start} + pt - ahead AS e_idx, {label} AS label FROM
  (SELECT {at} % total AS pt FROM (SELECT trial_id, sum({stop} - {start})::BIGINT AS total FROM {bands} GROUP BY trial_id), (SELECT unnest(range({n})) AS draw))
  ASOF JOIN (SELECT *, sum({stop} - {start}) OVER (ORDER BY {_bits("'0'", "event_id")} % 4096, event_id)::BIGINT - ({stop} - {start}) AS ahead FROM {bands} WHERE {stop} > {start}) ON pt >= ahead)"""


def _looked_up(drawn: str, numbered: str) -> str:
    return f"SELECT CAST(label AS INTEGER) AS label, value, event_id, CAST(e_ts - a.ts AS FLOAT)::DOUBLE AS tsa FROM {drawn} JOIN {numbered} USING (e_idx) JOIN access a USING (event_id)"


def _parts_sql() -> str:
    """The bands and numbered evictions of the earlier and of the later part."""
    bands, numbered = (_SAMPLE_SQL[_SAMPLE_SQL.index(x) :] for x in ("bands AS", "numbered AS"))
    bands = bands[: bands.index("numbered AS")].rstrip().rstrip(",")
    named = lambda text, suffix: text.replace("bands AS", f"bands_{suffix} AS", 1).replace("numbered AS", f"numbered_{suffix} AS", 1).replace("part e", f"{suffix} e").replace("FROM part", f"FROM {suffix}")
    head = _SAMPLE_SQL[: _SAMPLE_SQL.index("part AS")] + f"early AS ({_EARLY_SQL}), late AS ({_LATE_SQL}), " + _SAMPLE_SQL[_SAMPLE_SQL.index("nx AS") : _SAMPLE_SQL.index("bands AS")]
    return head + ", ".join(named(x, part) for part in ("early", "late") for x in (bands, numbered))


_TRIPLE = "len(list_filter(e0, lambda e: e <= value)) AS b0, len(list_filter(e1, lambda e: e <= event_id)) AS b1, len(list_filter(e2, lambda e: e <= tsa)) AS b2"
_CLASSIFIER_SQL = f"""+ {_parts_sql()},
{_drawn_points_sql("dp", "bands_early", "pos_lo", "hi", 1_000_000, 42, 1, "1")},
{_drawn_points_sql("dn", "bands_early", "lo", "pos_lo", 1_000_000, 42, 2, "0")},
{_drawn_points_sql("dd", "bands_early", "lo", "hi", 200_000, 43, 3, "0")},
{_drawn_points_sql("dh", "bands_late", "lo", "hi", 300_000, 44, 3, "lo + pt - ahead >= pos_lo")},
disc AS ({_looked_up("dd", "numbered_early")}),
edges AS (SELECT quantile_cont(value, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS e0, quantile_cont(event_id::DOUBLE, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS e1, quantile_cont(tsa, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS e2 FROM disc),
learn AS ({_looked_up("dp", "numbered_early")} UNION ALL {_looked_up("dn", "numbered_early")}),
cells AS (SELECT b0, b1, b2, sum(label)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM (SELECT label, {_TRIPLE} FROM learn, edges) GROUP BY ALL),
{_fit_sql(3, 10, 180)},
held AS (SELECT label, b0, b1, b2, count(*) AS n FROM (SELECT label, {_TRIPLE} FROM ({_looked_up("dh", "numbered_late")}), edges) GROUP BY ALL),
scored AS (SELECT label, n, {_logit(3)} AS p FROM held, fitted),
ranks AS (SELECT sum(n)::DOUBLE AS n, sum(n * label)::DOUBLE AS pos, sum(sum(n)) OVER (ORDER BY p)::DOUBLE - sum(n) + (sum(n) + 1) / 2.0 AS r FROM scored GROUP BY p),
areas AS (SELECT (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))) AS auc FROM ranks),
conf AS (SELECT coalesce(sum(n) FILTER (label = 0 AND p <= 0.5), 0)::BIGINT AS tn, coalesce(sum(n) FILTER (label = 0 AND p > 0.5), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (label = 1 AND p <= 0.5), 0)::BIGINT AS fn, coalesce(sum(n) FILTER (label = 1 AND p > 0.5), 0)::BIGINT AS tp FROM scored),
rates AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM conf)
SELECT round(auc, 6) AS auc, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, tn, fp, fn, tp, tn + fp + fn + tp AS n_eval, round((tp + fn) / (tn + fp + fn + tp), 6) AS positive_rate, 0.5::DOUBLE AS prob_threshold FROM rates, areas"""


@query(_CLASSIFIER_SQL, EVENTS_SQL, recursive=True)
def reuse_classifier(spark, d):
    from pagetrail.plans.training import Options, collect_sample, evaluate, fit_classifier

    t = events_trace(spark, d)
    options = Options(features=("value", "event_id"), horizon=6 * HOUR, residency_cap=6 * HOUR, random_state=42, max_iterations=500)
    sample = collect_sample(t.access.withColumn("access_key", F.col("event_id")), t.eviction, options)
    edges = features.quantile_edges(sample.discretizer, ["value", "event_id", "time_since_last_access_at_eviction"], 10)
    model = fit_classifier(features.discretise(sample.train, edges), edges, options)
    figures = evaluate(sample.evaluation, model, 0.0)
    return spark.createDataFrame([figures | figures.pop("confusion")]).withColumns({c: F.round(c, 6) for c in _FIGURES})


def _line_pairs_sql(name: str, part: str, seed: int) -> str:
    """CTE of random pairs of a part of the lines with their bins."""
    return f"""{name}_n AS (SELECT row_number() OVER (ORDER BY {", ".join(_LINE_KEY)}) - 1 AS i, l_extendedprice AS t, {_BIN_0} AS q, {_BIN_1} AS d FROM {part}, edges),
{name} AS (SELECT CAST(x.t < y.t AS INTEGER) AS label, x.q AS a0, x.d AS a1, y.q AS b0, y.d AS b1 FROM
  (SELECT {_bits(f"'{seed}'", "id")} % m AS a, {_bits(f"'{seed + 1}'", "id")} % (m - 1) AS step, m FROM (SELECT unnest(range(m)) AS id, m FROM (SELECT count(*) AS m FROM {name}_n))) p
  JOIN {name}_n x ON x.i = a JOIN {name}_n y ON y.i = (a + 1 + step) % m WHERE x.t <> y.t)"""


_RANKER_SQL = f"""WITH RECURSIVE split AS (SELECT *, {_hash("'42'", *_LINE_KEY)} < 0.2 AS is_test FROM lineitem),
learn AS (SELECT * FROM split WHERE NOT is_test), test AS (SELECT * FROM split WHERE is_test),
{_line_edges_sql("learn")},
{_line_pairs_sql("lp", "learn", 42)},
{_line_pairs_sql("tp", "test", 123)},
cells AS (SELECT a0, a1, b0, b1, sum(label)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM lp GROUP BY ALL),
{_fit_sql(2, 5, 160, paired=True)},
scored AS (SELECT label, round({_logit(2, ("a", "b"))}, 9) AS p FROM tp, fitted),
ranks AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (label = 1)::DOUBLE AS pos, sum(count(*)) OVER (ORDER BY p)::DOUBLE - count(*) + (count(*) + 1) / 2.0 AS r FROM scored GROUP BY p),
areas AS (SELECT (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))) AS auc FROM ranks),
listed AS (SELECT 'l_quantity' AS feature, unnest(range(5)) AS bin, unnest(w0) AS weight FROM fitted UNION ALL SELECT 'l_discount', unnest(range(5)), unnest(w1) FROM fitted)
SELECT feature, CAST(bin AS INTEGER) AS bin, round(weight, 4) AS weight, feature || '_' || bin AS label, CASE WHEN weight > 0 THEN 'keep' ELSE 'evict' END AS tag, round(auc, 6) AS auc,
  (SELECT round(avg(CAST((p >= 0.5) = (label = 1) AS INTEGER)), 6) FROM scored) AS accuracy, (SELECT count(*) FROM lp) AS train_n_pairs, (SELECT round(avg(label), 6) FROM lp) AS train_balance, (SELECT count(*) FROM tp) AS test_n_pairs, (SELECT round(avg(label), 6) FROM tp) AS test_balance FROM listed, areas"""


@query(_RANKER_SQL)
def pairwise_ranker(spark, d):
    from pagetrail.plans.training import pairwise_ranker as ranker

    model, figures = ranker(spark, table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", order=_LINE_KEY, multiplier=1)
    return features.weight_table(spark, model).withColumn("weight", F.round("weight", 4)).withColumns({k: F.lit(round(v, 6)) if isinstance(v, float) else F.lit(v).cast("long") for k, v in figures.items()})


_MEDIAN_MODEL_SQL = f"""WITH RECURSIVE halves AS (SELECT *, CAST(l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem) AS INTEGER) AS label FROM lineitem),
split AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash("'42'", *_LINE_KEY)}, {", ".join(_LINE_KEY)}) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) AS is_test FROM halves),
learn AS (SELECT * FROM split WHERE NOT is_test), test AS (SELECT * FROM split WHERE is_test),
{_line_edges_sql("learn")},
cells AS (SELECT {_BIN_0} AS b0, {_BIN_1} AS b1, sum(label)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM learn, edges GROUP BY ALL),
{_fit_sql(2, 5, 160)},
binned AS (SELECT label, {_BIN_0} AS b0, {_BIN_1} AS b1 FROM test, edges),
judged AS (SELECT label AS y, CAST({_logit(2)} > 0.5 AS INTEGER) AS p FROM binned, fitted),
found AS (SELECT c.class, count(*) FILTER (y = c.class AND p = c.class) AS hit, count(*) FILTER (y = c.class) AS support, count(*) FILTER (p = c.class) AS claimed FROM judged, (SELECT unnest([0, 1]) AS class) c GROUP BY 1),
rated AS (SELECT *, coalesce(hit / nullif(claimed, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM found)
SELECT CAST(class AS INTEGER) AS class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1, support FROM rated"""


def _report(found):
    return statistics.class_report(found, "label", "predicted").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query()
def reuse_class_model(spark, d):
    """Five classes of a target by quantiles, predicted by a multinomial model."""
    from pagetrail.plans.training import class_model, class_of_reuse

    found = class_model(class_of_reuse(table(spark, d, "lineitem"), "l_extendedprice"), ["l_quantity", "l_discount"], "reuse_class", key=_LINE_KEY)
    return _report(found)


_EPOCHS_SQL = _MEDIAN_MODEL_SQL[: _MEDIAN_MODEL_SQL.index("judged AS")].replace(_fit_sql(2, 5, 160), _fit_sql(2, 5, 40)) + f"""scored AS (SELECT k // 2 AS epoch, label, {_logit(2)} AS p FROM binned, fit WHERE k % 2 = 0 AND k > 0),
ranks AS (SELECT epoch, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS pos, sum(count(*)) OVER (PARTITION BY epoch ORDER BY p)::DOUBLE - count(*) + (count(*) + 1) / 2.0 AS r FROM scored GROUP BY epoch, p),
areas AS (SELECT epoch, round((sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))), 12) AS auc FROM ranks GROUP BY epoch),
sofar AS (SELECT epoch, auc, arg_max(struct_pack(e := -epoch), struct_pack(a := auc, e := -epoch)) OVER (ORDER BY epoch).e AS best FROM areas),
over AS (SELECT min(epoch) AS stop FROM (SELECT epoch FROM sofar WHERE epoch + best >= 5 UNION ALL SELECT 20))
SELECT CAST(epoch AS INTEGER) AS epoch, round(auc, 9) AS auc, epoch = -(SELECT best FROM sofar, over WHERE epoch = stop) AS is_best FROM areas, over WHERE epoch <= stop"""


def _halves_of_lines(spark, d):
    from pagetrail.operators.reuse import median_split

    rows = median_split(table(spark, d, "lineitem").withColumn("trial_id", F.lit(0)).withColumn("y", F.col("l_extendedprice")))
    split = sampling.stratified_split(rows.select(*_LINE_KEY, "l_discount", "label"), 0.2, "label", _LINE_KEY, 42).persist(StorageLevel.MEMORY_AND_DISK)
    learn, test = split.where("NOT is_test"), split.where("is_test")
    edges = features.quantile_edges(learn, ["l_quantity", "l_discount"], 5, method="averaged_inverted_cdf")
    return features.discretise(learn, edges), features.discretise(test, edges), edges, split


@query(_EPOCHS_SQL)
def training_epochs(spark, d):
    """The area over the holdout after each epoch, until five epochs bring no rise."""
    from pagetrail.operators.epochs import best_of, fit_in_epochs

    learn, test, edges, split = _halves_of_lines(spark, d)
    found = fit_in_epochs(learn, test, features.n_bins_of(edges), max_epochs=20)
    split.unpersist()
    best = best_of(found).number
    return spark.createDataFrame([(e.number, round(e.auc, 9), e.number == best) for e in found], "epoch int, auc double, is_best boolean")


@query(_MEDIAN_MODEL_SQL)
def median_split_model(spark, d):
    """Two classes of a target by its median."""
    from pagetrail.operators.reuse import median_split
    from pagetrail.plans.training import class_model

    rows = median_split(table(spark, d, "lineitem").withColumn("trial_id", F.lit(0)).withColumn("y", F.col("l_extendedprice")))
    return _report(class_model(rows, ["l_quantity", "l_discount"], "label", key=_LINE_KEY))
