"""Image statistics over pixel tables.

``pixels`` holds one row per pixel: image_id, x, y and integer channels r, g, b (and a
where a function handles it).  ``sizes`` come from the pixels themselves (w, h columns).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftmap.functions.numbers import dequantize, int_div, quantize
from heftmap.functions.textures import codec_space, split_name
from heftmap.operators import spread

TILE = 64
PATCH = 8
HASH_EDGE = 8
COLOUR = ("r", "g", "b")


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), spread.salt_mask("y")
    )


def with_size(pixels: DataFrame) -> DataFrame:
    """Pixels with the width and height of their image; rows of one image stay spread out."""
    if {"w", "h"} <= set(pixels.columns):
        return pixels
    # Joined by a shuffle: the planner counts an image's sizes once, not once per salt, and would send all of them through the driver.
    return spread.attach(pixels, image_sizes(pixels).hint("merge"), ["image_id"], ["y"])


def high_pass_energy(pixels: DataFrame, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Mean absolute difference between a pixel and its four neighbours, colour channels only.

    Pixels go to square tiles, border pixels also to the tile beside them, so one shuffle
    brings all neighbours together and no task holds a whole image.  0 for images
    narrower or lower than three pixels.
    """
    tile = lambda v: int_div(v, TILE)
    owner = F.struct(tile(F.col("x")).alias("tx"), tile(F.col("y")).alias("ty"))
    edge = lambda v, at: F.pmod(v, F.lit(TILE)) == at
    x, y = F.col("x"), F.col("y")
    guests = [
        F.when(edge(x, 0) & (x > 0), F.struct((tile(x) - 1).alias("tx"), tile(y).alias("ty"))),
        F.when(edge(x, TILE - 1), F.struct((tile(x) + 1).alias("tx"), tile(y).alias("ty"))),
        F.when(edge(y, 0) & (y > 0), F.struct(tile(x).alias("tx"), (tile(y) - 1).alias("ty"))),
        F.when(edge(y, TILE - 1), F.struct(tile(x).alias("tx"), (tile(y) + 1).alias("ty"))),
    ]
    values = F.struct(*channels)
    tiles = pixels.select(
        "image_id", "x", "y", values.alias("v"), owner.alias("owner"),
        F.explode_outer(F.array_compact(F.array(owner, *guests))).alias("tile"),
    ).repartition("image_id", "tile")
    along = Window.partitionBy("image_id", "tile", "y").orderBy("x")
    down = Window.partitionBy("image_id", "tile", "x").orderBy("y")
    neighbours = tiles.select(
        "*",
        F.lag(F.struct("x", "v")).over(along).alias("left"), F.lead(F.struct("x", "v")).over(along).alias("right"),
        F.lag(F.struct("y", "v")).over(down).alias("up"), F.lead(F.struct("y", "v")).over(down).alias("below"),
    )
    surrounded = F.coalesce(
        (F.col("left.x") == x - 1) & (F.col("right.x") == x + 1)
        & (F.col("up.y") == y - 1) & (F.col("below.y") == y + 1),
        F.lit(False),
    )
    gap = lambda c: F.abs(
        F.col("v")[c] - int_div(F.col("up.v")[c] + F.col("below.v")[c] + F.col("left.v")[c] + F.col("right.v")[c], 4)
    )
    per_pixel = sum((gap(c) for c in channels), F.lit(0))
    measured = neighbours.where(F.col("tile") == F.col("owner")).groupBy("image_id").agg(
        F.sum(F.when(surrounded, per_pixel)).alias("total"), F.count_if(surrounded).alias("n")
    )
    energy = F.when(F.col("n") > 0, F.col("total") / (F.col("n") * len(channels))).otherwise(F.lit(0.0))
    return measured.select("image_id", energy.alias("hp_energy"))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Thousandths of luma as an integer."""
    return r * 299 + g * 587 + b * 114


def patch_variance(pixels: DataFrame, patch: int = PATCH) -> DataFrame:
    """Population variance of mean luma over whole patch x patch tiles; 0 when none is whole."""
    tiles = pixels.groupBy(
        "image_id", int_div(F.col("y"), patch).alias("ty"), int_div(F.col("x"), patch).alias("tx")
    ).agg(
        F.sum(int_div(luma(F.col("r"), F.col("g"), F.col("b")), 1000)).alias("luma"), F.count(F.lit(1)).alias("n")
    )
    mean = F.when(F.col("n") == patch * patch, F.col("luma") / F.lit(float(patch * patch)))
    return tiles.groupBy("image_id").agg(F.coalesce(F.var_pop(mean), F.lit(0.0)).alias("patch_variance"))


def codec_space_route(pixels: DataFrame) -> DataFrame:
    return high_pass_energy(pixels).withColumn("codec_space", codec_space(F.col("hp_energy")))


def average_hash(pixels: DataFrame) -> DataFrame:
    """64-bit fingerprint: one bit per cell of an 8 x 8 grid, set where the cell is not below the mean.

    Small images map one pixel to several cells, so each pixel lists the cells it is in.
    """
    w, h, g = F.col("w").cast("bigint"), F.col("h").cast("bigint"), HASH_EDGE

    def cells(value: Column, extent: Column) -> Column:
        first = lambda i: int_div(i * extent, g)
        past = lambda i: F.least(F.greatest(int_div((i + 1) * extent, g), first(i) + 1), extent)
        return F.filter(
            F.sequence(F.lit(0).cast("bigint"), F.lit(g - 1).cast("bigint")),
            lambda i: (value >= first(i)) & (value < past(i)),
        )

    # Images whose edges are multiples of 8 have exactly one cell per pixel.
    whole = (F.pmod(w, F.lit(g)) == 0) & (F.pmod(h, F.lit(g)) == 0)
    cx = F.when(whole, F.array(int_div(F.col("x") * g, w))).otherwise(cells(F.col("x"), w))
    cy = F.when(whole, F.array(int_div(F.col("y") * g, h))).otherwise(cells(F.col("y"), h))
    placed = (
        with_size(pixels)
        .select("image_id", luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"), cx.alias("cx"), F.explode_outer(cy).alias("cy"))
        .select("image_id", "luma", "cy", F.explode_outer("cx").alias("cx"))
    )
    cell = (F.col("cy") * g + F.col("cx")).cast("int")
    means = placed.groupBy("image_id", cell.alias("cell")).agg(
        (F.sum("luma") / (F.count(F.lit(1)) * 1000)).alias("mean")
    )
    return hash_of_means(means)


def hash_of_means(means: DataFrame) -> DataFrame:
    """The fingerprint of an image's 64 cell means (image_id, cell, mean)."""
    gathered = means.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("cell", "mean"))).alias("cells"))
    overall = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["mean"]) / F.lit(64.0)
    bits = F.aggregate(
        "cells", F.lit(0).cast("bigint"),
        lambda acc, c: F.when(
            c["mean"] >= F.col("overall"),
            acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c["cell"])),
        ).otherwise(acc),
    )
    return gathered.withColumn("overall", overall).select("image_id", bits.alias("ahash"))


def exact_duplicates(contents: DataFrame, content: str = "content") -> DataFrame:
    """Contents held more than once and their redundant copies."""
    return (
        contents.groupBy(F.sha2(content, 256).alias("content_sha256"))
        .agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
        .withColumn("redundant", F.col("copies") - 1)
    )


def multimap_groups(textures: DataFrame, name: str = "label") -> DataFrame:
    """Materials with two or more maps."""
    return (
        textures.groupBy(split_name(F.col(name))["material"].alias("material"))
        .agg(F.count(F.lit(1)).alias("maps")).where(F.col("maps") >= 2)
    )


def box_downsample(pixels: DataFrame, channels: Sequence[str] = COLOUR, times: int = 1) -> DataFrame:
    """Halve both edges by 2 x 2 means (rounded); odd last rows and columns fall away."""
    out = pixels
    for _ in range(times):
        out = (
            out.groupBy("image_id", int_div(F.col("x"), 2).cast("int").alias("x"), int_div(F.col("y"), 2).cast("int").alias("y"))
            .agg(*[int_div(F.sum(c) + 2, 4).cast("int").alias(c) for c in channels], F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == 4).drop("n")
        )
    return out


def crop_to_multiple(pixels: DataFrame, m: int) -> DataFrame:
    """Drop trailing rows and columns until both edges are multiples of m."""
    inside = lambda at, extent: F.col(at) < F.col(extent) - F.pmod(F.col(extent), F.lit(m))
    return with_size(pixels).where(inside("x", "w") & inside("y", "h"))


def bilinear_upsample(low: DataFrame, scale: int, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Enlarge every image ``scale`` times by bilinear sampling with aligned corners.

    Each low pixel is sent to the squares it is a corner of (at most four); a square then
    emits the target pixels inside it.  One shuffle, no lookup per target pixel.
    Arithmetic is single precision, results are rounded half up and clamped to 0..255.
    """
    sized = with_size(low)
    w, h = F.col("w"), F.col("h")

    def corner_of(at: Column) -> Column:
        # Squares start at every position; the last one reuses its start as its end.
        return F.array_distinct(F.array(F.greatest(at - 1, F.lit(0)), at))

    spreaded = sized.select(
        "image_id", "w", "h", "x", "y", F.struct(*channels).alias("v"),
        F.explode(corner_of(F.col("x"))).alias("qx"),
    ).select("*", F.explode(corner_of(F.col("y"))).alias("qy"))
    right = F.least(F.col("qx") + 1, w - 1)
    lower = F.least(F.col("qy") + 1, h - 1)
    pick = lambda cx, cy: F.max(F.when((F.col("x") == cx) & (F.col("y") == cy), F.col("v")))
    squares = spreaded.groupBy("image_id", "w", "h", "qx", "qy").agg(
        pick(F.col("qx"), F.col("qy")).alias("p00"), pick(right, F.col("qy")).alias("p10"),
        pick(F.col("qx"), lower).alias("p01"), pick(right, lower).alias("p11"),
    )
    as_float = lambda c: c.cast("float")
    one, one_i = F.lit(1.0).cast("float"), F.lit(1)

    def ratio(extent: Column) -> Column:
        # Division of floats gives a double in Spark.
        wide = extent * scale
        return as_float((as_float(extent) - one) / F.greatest(as_float(wide) - one, one))

    def targets(start: Column, extent: Column) -> Column:
        """Target positions whose sample falls into the square that begins at ``start``."""
        wide = extent * scale
        guess = F.floor(start / F.greatest(ratio(extent).cast("double"), F.lit(1e-9))).cast("int")
        low_end = F.when(extent == 1, F.lit(0)).otherwise(F.greatest(guess - 2, F.lit(0)))
        steps = F.when(extent == 1, wide).otherwise(
            F.ceil(F.lit(1.0) / F.greatest(ratio(extent).cast("double"), F.lit(1e-9))).cast("int") + 4
        )
        candidates = F.sequence(low_end, F.least(low_end + steps, wide - one_i))
        return F.filter(
            F.when(low_end <= wide - 1, candidates).otherwise(F.array().cast("array<int>")),
            lambda t: F.floor(as_float(t) * ratio(extent)) == start,
        )

    placed = (
        squares.select("*", F.explode_outer(targets(F.col("qx"), w)).alias("tx")).where(F.col("tx").isNotNull())
        .select("*", F.explode_outer(targets(F.col("qy"), h)).alias("ty")).where(F.col("ty").isNotNull())
    )
    fx, fy = as_float(F.col("tx")) * ratio(w), as_float(F.col("ty")) * ratio(h)
    weighted = placed.withColumns({"wx": fx - as_float(F.col("qx")), "wy": fy - as_float(F.col("qy"))})
    wx, wy = F.col("wx"), F.col("wy")

    def sample(c: str) -> Column:
        corner = lambda p: as_float(F.col(p)[c])
        top = corner("p00") * (one - wx) + corner("p10") * wx
        bottom = corner("p01") * (one - wx) + corner("p11") * wx
        value = top * (one - wy) + bottom * wy
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value.cast("double") + 0.5))).cast("int")

    return weighted.select(
        "image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *[sample(c).alias(c) for c in channels]
    )


def residual(top: DataFrame, predicted: DataFrame, step: int = 1, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Quantised difference of two rasters per pixel and channel."""
    other = predicted.select("image_id", "x", "y", *[F.col(c).alias(f"{c}_pred") for c in channels])
    return top.join(other, ["image_id", "x", "y"]).select(
        "image_id", "x", "y", *channels, *[f"{c}_pred" for c in channels],
        *[quantize(F.col(c) - F.col(f"{c}_pred"), step).alias(f"{c}_q") for c in channels],
    )


def reconstruct_check(residuals: DataFrame, step: int = 1, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Largest channel error after putting the residual back, and whether it is exact."""
    back = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(f"{c}_pred") + dequantize(F.col(f"{c}_q"), step)))
    errors = [F.abs(back(c) - F.col(c)) for c in channels]
    worst = F.greatest(*errors) if len(errors) > 1 else errors[0]
    return residuals.groupBy("image_id").agg(F.max(worst).alias("max_error")).withColumn(
        "exact", F.col("max_error") == 0
    )


def residual_symbols(residuals: DataFrame, channels: Sequence[str] = COLOUR) -> DataFrame:
    """The two little-endian bytes of every 16-bit residual."""
    value = F.explode(F.array(*[F.col(f"{c}_q") for c in channels])).alias("q")
    low = F.col("q").bitwiseAND(F.lit(255))
    high = F.call_function("shiftright", F.col("q"), F.lit(8)).bitwiseAND(F.lit(255))
    return residuals.select("image_id", value).select("image_id", F.explode(F.array(low, high)).alias("symbol"))


def shannon_entropy(symbols: DataFrame) -> DataFrame:
    """Bits per symbol of every image."""
    return entropy_of_counts(symbols.groupBy("image_id", "symbol").agg(F.count(F.lit(1)).cast("double").alias("n")))


def entropy_of_counts(counts: DataFrame) -> DataFrame:
    """Bits per symbol of every image, from how often it holds each symbol."""
    total = F.sum("n")
    return counts.groupBy("image_id").agg(
        F.greatest(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, F.lit(0.0)).alias("entropy_bits"),
        total.cast("bigint").alias("symbol_count"),
    )
