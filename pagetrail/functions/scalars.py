"""Column expressions of the trace analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = (1 << 64) - 1


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp_u64(x: Column) -> Column:
    """Decimal of up to 20 digits, at least 0 and at most 2**64 - 1."""
    top = F.lit(str(U64_MAX)).cast("decimal(20,0)")
    return F.least(F.greatest(x.cast("decimal(30,0)"), F.lit(0).cast("decimal(30,0)")), top.cast("decimal(30,0)")).cast("decimal(20,0)")


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def truncate(x: Column) -> Column:
    return x.cast("long")


def run_stamp(name: Column) -> Column:
    """The first YYYYMMDD_HHMMSS in a file name, or null."""
    return F.nullif(F.regexp_extract(name, r"\d{8}_\d{6}", 0), F.lit(""))


def ns_to_seconds(x: Column) -> Column:
    return x / F.lit(1e9)


def seconds_to_ns(x: Column) -> Column:
    return (x * F.lit(1_000_000_000)).cast("long")


def share_label(low: Column, high: Column) -> Column:
    """A percent range, as of a position bin."""
    return F.format_string("%d–%d%%", low.cast("int"), high.cast("int"))


def bin_label(name: Column, index: Column) -> Column:
    return F.concat_ws("_", name, index)


# Coefficients of the rational approximations of the normal quantile by Wichura (AS 241), highest power first.
_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(powers: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    above, below = (reduce(lambda total, c: total * x + F.lit(c), rest, F.lit(first)) for first, *rest in powers)
    return above / below


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1), to about 16 digits; null elsewhere."""
    centre = p - 0.5
    root = F.sqrt(-F.log(F.least(p, 1 - p)))
    outside = F.when(root <= 5, _ratio(_MIDDLE, root - 1.6)).otherwise(_ratio(_TAIL, root - 5))
    found = F.when(F.abs(centre) <= 0.425, centre * _ratio(_CENTRE, F.lit(0.180625) - centre * centre)).when(centre < 0, -outside).otherwise(outside)
    return F.when((p > 0) & (p < 1), found)


def keep_or_evict(weight: Column) -> Column:
    """What a positive or other weight speaks for."""
    return F.when(weight > 0, F.lit("keep")).otherwise(F.lit("evict"))
