"""Numbers and prefix sums over a whole group without sorting it in one task.

Rows are put into buckets of the ordering values.  Bounds between buckets are values of the group, drawn from a sample, so
that its buckets hold about as many rows whatever the values are; buckets are summed, and only rows of one bucket are
ordered.  A bound has a bucket of its own, between those of the values below and above, so that a value with very many rows
stands alone there.  Such a bucket is cut again by the next ordering column, and where none is left by a hash of the rows.

Only groups of more than ``rows_per_bucket`` rows have bounds, about one for so many rows, so that N rows give some
2 N / rows_per_bucket bounds.  They are found by small jobs while the plan is built, since a plan that holds its own
statistics several times over grows beyond use when operators are nested.  Bounds may lie anywhere without changing a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

ROWS_PER_BUCKET = 1_000_000
DRAWN = 200  # rows drawn for each bucket
IN_ONE_TASK = 1_000_000  # drawn values of a group that one task orders; beyond, they are parted by rough quantiles first
PARTS = 1024
_FEW = 256  # bounds that go into an expression; more are joined


def _drawn(rows: DataFrame, group: list[str], value: str, rows_per_bucket: int) -> tuple[DataFrame, float]:
    """Values of a sample with their counts (``_c``), and how many drawn rows stand for a full bucket."""
    share = min(1.0, DRAWN / rows_per_bucket)
    some = rows.where(F.col(value).isNotNull()).select(*group, value)
    some = some if share == 1.0 else some.sample(share, 7)
    return some.groupBy(*dict.fromkeys([*group, value])).agg(F.count("*").alias("_c")), rows_per_bucket * share


def bounds_of(rows: DataFrame, group: list[str], value: str, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame | None:
    """One row per group that needs several buckets, with ``bounds``, an ordered array of values; None if no group does."""
    spark = rows.sparkSession
    counted, full = _drawn(rows, group, value, rows_per_bucket)
    sizes = counted.groupBy(*group).agg(F.sum("_c").alias("_drawn"), F.count("*").alias("_values"))
    large = sizes.where(F.col("_drawn") > full).collect()  # one row per rows_per_bucket rows at most
    if not large:
        return None
    names = spark.createDataFrame(large, sizes.schema)
    held = counted.join(F.broadcast(names), group)
    part = F.lit(0)
    if any(r["_values"] > IN_ONE_TASK for r in large) and isinstance(rows.schema[value].dataType, NumericType):
        shares = ",".join(str(i / PARTS) for i in range(1, PARTS))
        wide = held.where(F.col("_values") > IN_ONE_TASK).groupBy(*group)
        rough = wide.agg(F.expr(f"percentile_approx(cast(`{value}` as double), cast(split('{shares}', ',') as array<double>), {4 * PARTS})").alias("_rough"))
        found = rough.collect()  # a thousand numbers for each group of billions of rows
        held = held.join(F.broadcast(spark.createDataFrame(found, rough.schema)), group, "left")
        part = F.coalesce(_reached("_rough", F.col(value).cast("double"), lambda b, v: b <= v), F.lit(0))
    placed = held.withColumn("_part", part)
    upto = F.sum("_c").over(Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = placed.withColumn("_upto", upto).where((F.floor((F.col("_upto") - F.col("_c")) / full) != F.floor(F.col("_upto") / full)) | (F.col("_c") * 2 > full))
    out = chosen.groupBy(*group).agg(F.sort_array(F.collect_set(value)).alias("bounds"))
    return spark.createDataFrame(out.collect(), out.schema)


def _reached(bounds: str, v: Column, below: callable) -> Column:
    """How many bounds of an ordered array stand before the value, by halving the range where the last of them may lie."""
    whole = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        hit = below(F.element_at(bounds, middle + 1), v)
        return F.when(s["low"] >= s["high"], s).when(hit, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds) + 1)).cast("int") + 1)
    return F.aggregate(steps, whole, halved, lambda s: s["low"])


def _searched(value: str, bounds: list) -> str:
    """SQL for the place of a value among bounds: twice the number of those below, one more on a bound."""
    text = lambda b: f"{b!r}D" if isinstance(b, float) else f"{b}L"

    def below(low: int, high: int) -> str:
        if low == high:
            return str(2 * low)
        middle = (low + high) // 2
        return f"if(`{value}` < {text(bounds[middle])}, {below(low, middle)}, if(`{value}` = {text(bounds[middle])}, {2 * middle + 1}, {below(middle + 1, high)}))"

    return below(0, len(bounds))


def with_bucket(rows: DataFrame, bounds: DataFrame | None, group: list[str], value: str, name: str = "bucket") -> DataFrame:
    """Adds the bucket: it grows with the value inside each group, and is odd for the values that are bounds. A group without
    bounds has bucket -1; nulls come first."""
    if bounds is None:
        return rows.withColumn(name, F.lit(-1))
    held = bounds.collect()  # local
    values = [b for r in held for b in r["bounds"]]
    if len(values) <= _FEW and len(held) <= _FEW // 4 and all(type(b) is int or type(b) is float and abs(b) < 1e300 for b in values):
        bucket = F.lit(-1)
        for r in held:
            own = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.lit(r[g])) for g in group))
            place = F.when(F.col(value).isNull(), 0).otherwise(F.expr(_searched(value, r["bounds"])))
            bucket = F.when(own, place).otherwise(bucket)
        return rows.withColumn(name, bucket)
    v = F.col(value)
    place = _reached("bounds", v, lambda b, x: b < x) + _reached("bounds", v, lambda b, x: b <= x)
    bucket = F.when(F.col("bounds").isNull(), -1).when(v.isNull(), 0).otherwise(place)
    return rows.join(F.broadcast(bounds), group, "left").withColumn(name, bucket).drop("bounds")


def _salted(rows: DataFrame, asked: DataFrame, group: list[str], name: str, rows_per_bucket: int) -> DataFrame | None:
    """rows with groups of ``asked`` that are still too large cut by a hash of the whole row; None if none is."""
    sample = asked.select(*group)
    share = min(1.0, DRAWN / rows_per_bucket)
    sizes = (sample if share == 1.0 else sample.sample(share, 7)).groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_bucket * share)
    found = sizes.select(*group, F.ceil(F.col("_n") / (rows_per_bucket * share)).cast("int").alias("_salts")).collect()
    if not found:
        return None
    salts = rows.sparkSession.createDataFrame(found, sizes.select(*group, F.lit(0).alias("_salts")).schema)
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")), F.lit(-1)).cast("int")
    return rows.join(F.broadcast(salts), group, "left").withColumn(name, salt).drop("_salts")


def spread(rows: DataFrame, group: list[str], order: list[str], *, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, bool]:
    """Adds ``bucket``, which grows with the ordering columns inside each group, and ``is_split``: whether the row's group has
    several buckets. Also tells whether any group has. Rows that are equal in all columns share a bucket."""
    names: list[str] = []
    for column in [*order, None]:
        asked = rows.where(F.col(names[-1]) % 2 == 1) if names else rows
        name, own = f"_bucket_{len(names)}", [*group, *names]
        if column is None:
            more = _salted(rows, asked, own, name, rows_per_bucket)
        else:
            bounds = bounds_of(asked, own, column, rows_per_bucket=rows_per_bucket)
            more = None if bounds is None else with_bucket(rows, bounds, own, column, name)
        if more is None:
            break
        rows = more
        names.append(name)
    if not names:
        return rows.withColumns({"bucket": F.lit(0), "is_split": F.lit(False)}), False
    return rows.withColumns({"bucket": F.struct(*names), "is_split": F.col(names[0]) >= 0}).drop(*names), True


def bucketed(rows: DataFrame, group: list[str], value: str, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``bucket``, which grows with the value inside each group; rows of one value share it."""
    return with_bucket(rows, bounds_of(rows, group, value, rows_per_bucket=rows_per_bucket), group, value)


def bucket_sums(placed: DataFrame, group: list[str], amount: Column) -> DataFrame:
    """Per group and bucket: ``amount``, ``offset`` (the amount in the buckets before) and ``total`` of the group."""
    own = Window.partitionBy(*group)
    before = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "bucket").agg(F.sum(amount).alias("amount"))
    return sums.select(*group, "bucket", "amount", F.coalesce(F.sum("amount").over(before), F.lit(0)).alias("offset"), F.sum("amount").over(own).alias("total"))


def row_numbers(rows: DataFrame, group: list[str], value: str, ties: list[str], *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``rn``, from 1 in each group in the order of the value, then of ties, and ``n_rows`` of the group."""
    placed = spread(rows, group, [value, *ties], rows_per_bucket=rows_per_bucket)[0].drop("is_split")
    numbered = placed.withColumn("inside", F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(value, *ties)))
    sums = bucket_sums(placed, group, F.lit(1)).drop("amount")
    return numbered.join(sums, [*group, "bucket"]).withColumns({"rn": (F.col("offset") + F.col("inside")).cast("long"), "n_rows": F.col("total")}).drop("bucket", "offset", "inside", "total")


def prefix_sums(rows: DataFrame, group: list[str], value: str, amount: str, ties: list[str], *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``before``: the sum of the amount over the rows of the group that stand ahead."""
    placed = spread(rows, group, [value, *ties], rows_per_bucket=rows_per_bucket)[0].drop("is_split")
    own = Window.partitionBy(*group, "bucket").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    sums = bucket_sums(placed, group, F.col(amount)).drop("amount", "total")
    return summed.join(sums, [*group, "bucket"]).withColumn("before", F.col("offset") + F.col("inside")).drop("bucket", "offset", "inside")


def position_bin(bins: int) -> Column:
    """The bin of a numbered row when the group is cut into equal shares by position."""
    return F.floor((F.col("rn") * bins - 1) / F.col("n_rows")).cast("int")
