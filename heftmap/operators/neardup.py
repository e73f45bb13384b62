"""Pairs of 64-bit fingerprints within a small Hamming distance.

Fingerprints are first reduced to distinct values with the number of images behind
each, so equal images never multiply.  Two values at distance <= r differ in at most r
of r + k bands, hence agree on at least k bands: every value is filed under each
choice of k bands, and only values of one drawer are compared.

A drawer with many values is filed again by the bits in which its values differ; the
bits they share cannot tell them apart.  Drawers holding the same values are kept
once.  Where so few bits differ that a good part of all pairs is close - the result
itself is that large - the drawer is compared in blocks spread over many tasks.  No
candidate is dropped at any point.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heftmap.operators import spread
from heftmap.operators.staging import stage

RADIUS = 6
AGREEING_BANDS = 3
CROWDED = 512
REFILE_BITS = 24
MAX_REFILES = 3
WORD = 64


def _signed(mask: int) -> int:
    return mask - (1 << WORD) if mask >= 1 << (WORD - 1) else mask


def _bands(bits: Sequence[int], count: int) -> list[int]:
    """Split bit positions into ``count`` nearly equal masks."""
    cuts = [round(i * len(bits) / count) for i in range(count + 1)]
    return [sum(1 << b for b in bits[cuts[i]:cuts[i + 1]]) for i in range(count)]


def drawer_masks(radius: int, agreeing: int, bits: Sequence[int]) -> list[int]:
    """Masks such that values at distance <= radius agree on all bits of at least one."""
    return [sum(chosen) for chosen in combinations(_bands(bits, radius + agreeing), agreeing)]


def distinct_hashes(hashes: DataFrame) -> DataFrame:
    return hashes.where(F.col("ahash").isNotNull()).groupBy("ahash").agg(F.count(F.lit(1)).alias("images"))


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows that are joined by a shuffle.  The planner takes a filed value for one row, not for one a drawer, and would send all drawers through the driver."""
    return rows.hint("merge")


def _file(values: DataFrame, masks: list[int]) -> DataFrame:
    """One row per value and drawer: the mask and the value's bits under it."""
    mask = F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])).alias("mask")
    return values.select("ahash", "images", mask).withColumn("bits", F.col("ahash").bitwiseAND(F.col("mask")))


def _drawers(filed: DataFrame) -> DataFrame:
    """Size of every drawer, the bits its values differ in, and a mark of its membership."""
    spreads = F.bit_or("ahash").bitwiseXOR(F.bit_and("ahash"))
    mark = F.struct(F.count(F.lit(1)), F.bit_xor("ahash"), F.bit_xor(F.xxhash64("ahash")))
    return filed.groupBy("mask", "bits").agg(
        F.count(F.lit(1)).alias("n"), spreads.alias("differ"), mark.alias("members"), spread.salt_mask("ahash")
    )


def _bands_of(differ: Column, count: int) -> list[Column]:
    """Masks of ``count`` bands that share out the set bits of a column."""
    places = F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)),
        lambda i: F.call_function("shiftright", differ, i).bitwiseAND(F.lit(1)) == 1,
    )
    width = F.ceil(F.size(places) / F.lit(count)).cast("int")
    part = lambda j: F.slice(places, width * j + 1, width)
    one = F.lit(1).cast("bigint")
    return [
        F.aggregate(part(j), F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", one, i)))
        for j in range(count)
    ]


def _refile(filed: DataFrame, drawers: DataFrame, radius: int, agreeing: int) -> DataFrame:
    """File the values of the given drawers again, by bands of the bits they differ in."""
    bands = _bands_of(F.col("differ"), radius + agreeing)
    banded = drawers.select("mask", "bits", spread.MASK, F.array(*bands).alias("bands"))
    picks = F.array(*[
        reduce(Column.bitwiseOR, [F.get("bands", F.lit(i)) for i in chosen], F.col("mask"))
        for chosen in combinations(range(radius + agreeing), agreeing)
    ])
    finer = banded.select("mask", "bits", spread.MASK, F.array_distinct(picks).alias("finer"))
    members = spread.attach(filed, _shuffled(finer), ["mask", "bits"], ["ahash"])
    mask = F.explode_outer("finer").alias("mask")
    return (
        members.select("ahash", "images", mask)
        .withColumn("bits", F.col("ahash").bitwiseAND(F.col("mask"))).distinct()
    )


def _close(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def _pairs_in(filed: DataFrame, radius: int) -> DataFrame:
    left = filed.select("mask", "bits", F.col("ahash").alias("hash_a"), F.col("images").alias("images_a"))
    right = filed.select("mask", "bits", F.col("ahash").alias("hash_b"), F.col("images").alias("images_b"))
    distance = _close(F.col("hash_a"), F.col("hash_b"))
    return (
        left.join(_shuffled(right), ["mask", "bits"])
        .where((F.col("hash_a") < F.col("hash_b")) & (distance <= radius))
        .select("hash_a", "hash_b", distance.cast("int").alias("distance"), "images_a", "images_b")
    )


def _pairs_in_blocks(filed: DataFrame, drawers: DataFrame, radius: int, block: int) -> DataFrame:
    """Pairs of large drawers, block against block; every block pair is a join key of its own."""
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    sized = drawers.select("mask", "bits", spread.MASK, blocks.alias("blocks"))
    members = spread.attach(filed, _shuffled(sized), ["mask", "bits"], ["ahash"]).withColumn(
        "own", F.pmod(F.xxhash64("ahash"), F.col("blocks")).cast("int")
    )
    keys = ["mask", "bits", "low", "high"]
    left = members.select(
        "mask", "bits", F.col("own").alias("low"), F.explode_outer(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("high"),
        F.col("ahash").alias("x"), F.col("images").alias("x_images"),
    )
    right = members.select(
        "mask", "bits", F.explode_outer(F.sequence(F.lit(0), F.col("own"))).alias("low"), F.col("own").alias("high"),
        F.col("ahash").alias("y"), F.col("images").alias("y_images"),
    )
    distance = _close(F.col("x"), F.col("y"))
    once = (F.col("low") < F.col("high")) | (F.col("x") < F.col("y"))
    ordered = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(ordered, F.col(a)).otherwise(F.col(b))
    return left.join(_shuffled(right), keys).where(once & distance.between(1, radius)).select(
        pick("x", "y").alias("hash_a"), pick("y", "x").alias("hash_b"), distance.cast("int").alias("distance"),
        pick("x_images", "y_images").alias("images_a"), pick("y_images", "x_images").alias("images_b"),
    )


def near_hash_pairs(
    hashes: DataFrame, radius: int = RADIUS, agreeing: int = AGREEING_BANDS, crowded: int = CROWDED
) -> DataFrame:
    """Distinct fingerprints at distance 1..radius, with the images behind each side.

    ``hashes`` holds one row per image with column ``ahash``.  The number of image pairs
    behind a row is images_a * images_b; equal fingerprints are no near pair.
    """
    values = stage(distinct_hashes(hashes), "hashes")
    filed = _file(values, drawer_masks(radius, agreeing, range(WORD)))
    found = []
    for refiles in range(MAX_REFILES + 1):
        drawers = _drawers(filed)
        full = stage(drawers.where(F.col("n") > crowded), "drawers")
        if full.isEmpty():
            break
        keys = ["mask", "bits"]
        found.append(_pairs_in(spread.attach(filed, _shuffled(full.select(*keys, spread.MASK)), keys, ["ahash"], "left_anti"), radius))
        full = full.dropDuplicates(["members"])
        dense = F.bit_count("differ") < REFILE_BITS if refiles < MAX_REFILES else F.lit(True)
        found.append(_pairs_in_blocks(filed, full.where(dense), radius, crowded))
        filed = stage(_refile(filed, full.where(~dense), radius, agreeing), "refiled")
    else:
        filed = None
    if filed is not None:
        found.append(_pairs_in(filed, radius))
    return reduce(DataFrame.unionByName, found).dropDuplicates(["hash_a", "hash_b"])


def near_duplicates(hashes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Number of image pairs at every distance 1..radius."""
    pairs = near_hash_pairs(hashes, radius)
    return pairs.groupBy("distance").agg(
        F.count(F.lit(1)).alias("hash_pairs"), F.sum(F.col("images_a") * F.col("images_b")).alias("image_pairs")
    )
