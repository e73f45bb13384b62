"""Joins that bring per-group results back to the rows of the group.

A group may hold a third of all rows, so rows meet their group's result on
(keys, salt).  While the group is being aggregated it also records, as one LONG
bitmask, which salts its rows use; the result is then repeated once per used salt
only - at most ``SALTS`` times and never more often than the group has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
MASK = "salt_mask"


def salt_of(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salt_bit(*columns: str | Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), salt_of(*columns))


def salt_mask(*columns: str | Column) -> Column:
    """Aggregate: the salts used by the rows of a group."""
    return F.bit_or(salt_bit(*columns)).alias(MASK)


def repeat_per_salt(groups: DataFrame) -> DataFrame:
    used = F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)),
        lambda i: F.call_function("shiftright", F.col(MASK), i).bitwiseAND(F.lit(1)) == 1,
    )
    # A group has at least one salt; the outer form keeps the optimizer from adding a
    # filter that evaluates the array a second time.
    return groups.withColumn("salt", F.explode_outer(used)).drop(MASK)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], salted_by: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``groups`` (which carry ``salt_mask(*salted_by)``) on ``keys``."""
    salted = rows.withColumn("salt", salt_of(*salted_by))
    return salted.join(repeat_per_salt(groups), [*keys, "salt"], how).drop("salt")
