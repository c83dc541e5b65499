"""Windows over the rows of a page, of which one page may have very many.

Pages with more rows than a bucket holds are cut into buckets of their order (see :mod:`pagetrail.operators.ranking`); the
window runs inside a bucket.  What a row needs of other buckets is carried over from a table with one row per bucket of such
a page: the first row of the next bucket that has one, the last of the one before, or how many rows stand ahead.  Without
such pages the plan is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pagetrail.operators.ranking import ROWS_PER_BUCKET, spread


@dataclass(frozen=True)
class Paged:
    """Rows with the buckets of their pages."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    is_cut: bool

    @classmethod
    def of(cls, rows: DataFrame, keys: list[str], order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> Paged:
        placed, is_cut = spread(rows, keys, order, rows_per_bucket=rows_per_bucket)
        return cls(placed if is_cut else rows, keys, order, is_cut)

    @property
    def by(self) -> list[str]:
        return [*self.keys, "bucket"] if self.is_cut else self.keys

    def window(self, *order: Column | str) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*(order or self.order))

    def carrying(self, **parts: tuple[Column, str]) -> DataFrame:
        """The rows with, per name, an aggregate carried over: ``after`` is the least of the later buckets, ``before`` the
        largest of the earlier ones, ``sum`` the sum of these. Null where there are none, as on pages of one bucket."""
        if not self.is_cut:
            return self.rows.withColumns({name: F.lit(None) for name in parts})
        fold = {"after": F.min, "before": F.max, "sum": F.sum}
        own = self.rows.where("is_split").groupBy(*self.by).agg(*(fold[how](what).alias(name) for name, (what, how) in parts.items()))
        side = {how: Window.partitionBy(*self.keys).orderBy(F.desc("bucket") if how == "after" else "bucket").rowsBetween(Window.unboundedPreceding, -1) for how in fold}
        carried = own.select(*self.by, *(fold[how](name).over(side[how]).alias(name) for name, (_, how) in parts.items()))
        # one row per bucket of a page that has several: as few as the bounds that the driver has seen
        return self.rows.join(F.broadcast(carried), self.by, "left")


def next_value(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds the value of the page's next row, null behind the last one."""
    paged = Paged.of(rows, keys, order, rows_per_bucket)
    if not paged.is_cut:
        return rows.withColumn(out, F.lead(value).over(paged.window()))
    first = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(value).alias("v"))
    found = F.coalesce(F.lead(F.struct(F.col(value).alias("v"))).over(paged.window()), F.when(F.col("_later").isNotNull(), F.struct(F.col("_later.v").alias("v"))))
    return paged.carrying(_later=(first, "after")).withColumn(out, found["v"]).select(*rows.columns, out)


def ordinals(rows: DataFrame, keys: list[str], order: list[str], *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ordinal, from 1 per page, and before, the first ordering column of the page's row ahead."""
    paged = Paged.of(rows, keys, order, rows_per_bucket)
    number, before = F.row_number().over(paged.window()).cast("long"), F.lag(order[0]).over(paged.window())
    if not paged.is_cut:
        return rows.withColumns({"ordinal": number, "before": before})
    placed = paged.carrying(_ahead=(F.lit(1), "sum"), _last=(F.col(order[0]), "before"))
    return placed.withColumns({"ordinal": number + F.coalesce("_ahead", F.lit(0)), "before": F.coalesce(before, "_last")}).select(*rows.columns, "ordinal", "before")
