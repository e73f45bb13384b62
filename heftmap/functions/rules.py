"""Ordered first-match rules as one CASE chain."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Iterable[tuple[Column, object]], otherwise=None) -> Column:
    """The label of the first rule whose condition holds, else ``otherwise``."""
    chain = F
    for condition, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def rule_match(value: Column, labels: Iterable, test: Callable[[Column, str], Column]) -> Column:
    """Label of the first pattern for which ``test(value, pattern)`` holds.

    ``labels`` holds patterns, or (pattern, label) pairs.
    """
    pairs = [(item, item) if isinstance(item, str) else item for item in labels]
    return first_match((test(value, pattern), label) for pattern, label in pairs)


def any_of(value: Column, patterns: Iterable[str], test: Callable[[Column, str], Column]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | test(value, pattern)
    return hit


def contains(value: Column, pattern: str) -> Column:
    return value.contains(pattern)


def ends_with(value: Column, pattern: str) -> Column:
    return value.endswith(pattern)


def equals(value: Column, pattern: str) -> Column:
    return value == F.lit(pattern)
