"""Exact running totals and medians without a single-task sort.

Values are first reduced to one row per (keys, value).  When many distinct values
remain, the value axis is cut into slices at approximate quantiles; running totals
are taken inside each slice and shifted by the totals of the slices below.  The cut
points only balance the work - any cut points give the same exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftmap.operators.staging import stage

SLICES = 256
ONE_SLICE_ROWS = 100_000


def _cut_points(values: DataFrame, order: str, one_slice_rows: int, slices: int) -> list:
    if values.count() <= one_slice_rows:
        return []
    shares = [i / slices for i in range(1, slices)]
    cuts = values.agg(F.percentile_approx(order, shares, 20 * slices)).first()[0]
    return sorted(set(cuts))


def _slice_of(order: str, cuts: list, low: int = 0) -> Column:
    """Index of the slice holding the value, found by halving the cut points."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    below = _slice_of(order, cuts[:mid], low)
    above = _slice_of(order, cuts[mid + 1:], low + mid + 1)
    return F.when(F.col(order) < F.lit(cuts[mid]), below).otherwise(above)


def running_totals(
    values: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    one_slice_rows: int = ONE_SLICE_ROWS,
    slices: int = SLICES,
) -> DataFrame:
    """Adds ``<s>_through`` (sum over values up to this one) and ``<s>_total`` per key.

    ``values`` holds one row per (by, order) and no NULL order value.
    """
    values = stage(values, "values")
    cuts = _cut_points(values, order, one_slice_rows, slices)
    keys = list(by)
    if not cuts:
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        return values.select(
            "*",
            *[F.sum(s).over(upto).alias(f"{s}_through") for s in sums],
            *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
        )
    sliced = values.withColumn("slice", _slice_of(order, cuts))
    upto = Window.partitionBy(*keys, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.select("*", *[F.sum(s).over(upto).alias(f"{s}_inside") for s in sums])
    # At most `slices` rows per key from here on.
    per_slice = sliced.groupBy(*keys, "slice").agg(*[F.sum(s).alias(f"{s}_slice") for s in sums])
    lower = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_slice.select(
        *keys,
        "slice",
        *[F.coalesce(F.sum(f"{s}_slice").over(lower), F.lit(0)).alias(f"{s}_below") for s in sums],
        *[F.sum(f"{s}_slice").over(whole).alias(f"{s}_total") for s in sums],
    )
    return inside.join(offsets, [*keys, "slice"]).select(
        *values.columns,
        *[(F.col(f"{s}_inside") + F.col(f"{s}_below")).alias(f"{s}_through") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def exact_medians(
    df: DataFrame,
    measures: dict[str, Column],
    by: Sequence[str] = (),
    one_slice_rows: int = ONE_SLICE_ROWS,
    slices: int = SLICES,
) -> DataFrame:
    """One row per key with the exact interpolating median of every measure (NULLs skipped)."""
    keys = list(by)
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("double").alias("value")) for n, c in measures.items()])
    long = df.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull())
    counted = long.groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, "value", ["n"], [*keys, "measure"], one_slice_rows, slices)
    total, through = F.col("n_total"), F.col("n_through")
    out = []
    for name in measures:
        mine = F.col("measure") == name
        low = F.min(F.when(mine & (through * 2 > total - 1), F.col("value")))
        high = F.min(F.when(mine & (through * 2 > total), F.col("value")))
        out.append(((low + high) / 2).alias(name))
    return ranked.groupBy(*keys).agg(*out)
