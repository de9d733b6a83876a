"""Tolerance joins as equi-joins on bands.

Spark plans a nested loop for ``abs(a - b) <= t``. Here each value is put into a band as wide as its tolerance, one side
is repeated for the bands next to its own, and the join is an equi-join on all bands, with the exact predicate as residue.
The other side carries one band per field, so each pair meets once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """``span``: values at most so far apart; or ``share``: apart by less than this share of the larger one."""

    field: str
    span: float | None = None
    share: float | None = None

    def of(self, v: Column) -> Column:
        # a hair wider than the tolerance, so that rounding at a bound loses no pair
        width = self.span * 1.0001 if self.span is not None else -math.log(1 - self.share) * 1.0001
        return F.floor((v if self.span is not None else F.log(v)) / width)

    def holds(self, a: Column, b: Column) -> Column:
        gap = F.abs(a - b)
        return gap <= self.span if self.span is not None else gap / F.greatest(a, b) < self.share


def band_join(left: DataFrame, right: DataFrame, bands: list[Band], equal: list[str] = [], residue: Column | None = None) -> DataFrame:  # noqa: B006
    """Join ``left`` (alias ``a``) with ``right`` (alias ``b``): all ``bands`` hold and ``equal`` columns are equal.

    Rows with a null, NaN or non-positive value in a band's field, or null in an equal column, join nothing. The right side is
    the repeated one (three times per band): give the smaller table there. Columns of both sides stay, under their alias.
    """
    usable = lambda df: df.where(reduce(Column.__and__, [~F.isnan(b.field) & (F.col(b.field) > 0) for b in bands]))
    a = usable(left).withColumns({f"__band{k}": b.of(F.col(b.field)) for k, b in enumerate(bands)})
    b = usable(right)
    for k, band in enumerate(bands):
        own = band.of(F.col(band.field))
        b = b.withColumn(f"__band{k}", F.explode(F.array(own - 1, own, own + 1)))
    on = [F.col(f"a.__band{k}") == F.col(f"b.__band{k}") for k in range(len(bands))] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in equal]
    exact = [band.holds(F.col(f"a.{band.field}"), F.col(f"b.{band.field}")) for band in bands] + ([residue] if residue is not None else [])
    return a.alias("a").join(b.alias("b"), reduce(Column.__and__, on)).where(reduce(Column.__and__, exact))


def open_band_join(left: DataFrame, right: DataFrame, bands: list[Band], equal: list[str], exact: Column) -> DataFrame:
    """As ``band_join`` for fields that may be unknown (null or not positive), which is near anything: ``exact`` is the
    predicate of a pair, false for known values farther apart than the bands say. Equal columns aren't null.

    The left side is repeated: under its band, or as unknown, for known values of the right, and under no band for unknown ones.
    """
    unknown, whatever = F.lit(-(10**12)), F.lit(-(10**12) - 1)
    a, b = left, right
    for k, band in enumerate(bands):
        v, own = F.col(band.field), band.of(F.col(band.field))
        a = a.withColumn(f"__band{k}", F.explode(F.array(F.when(v > 0, own).otherwise(unknown), whatever)))
        b = b.withColumn(f"__band{k}", F.explode(F.when(v > 0, F.array(own - 1, own, own + 1, unknown)).otherwise(F.array(whatever))))
    on = [F.col(f"a.__band{k}") == F.col(f"b.__band{k}") for k in range(len(bands))] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in equal]
    return a.alias("a").join(b.alias("b"), reduce(Column.__and__, on)).where(exact)
