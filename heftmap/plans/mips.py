"""Texture-size plans: dropping mip levels above a size cap, and how to bring them back.

``textures`` holds asset_path, export_name, pixel_format, compression_settings and either
``mips`` or size_x / size_y / num_mips.  All per-texture work happens inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftmap.functions import textures as T

MIN_CAP, MAX_CAP = 1, 16384
CLASSES_SHOWN = 20


def _check_cap(cap: int) -> None:
    if not MIN_CAP <= cap <= MAX_CAP:
        raise ValueError(f"size cap must be {MIN_CAP}..{MAX_CAP}, got {cap}")


def with_mips(textures: DataFrame) -> DataFrame:
    """Adds the level array; drops rows without usable dimensions."""
    usable = textures.where((F.col("size_x") > 0) & (F.col("size_y") > 0) & (F.col("num_mips") > 0))
    if "mips" in textures.columns:
        return usable
    return usable.withColumn(
        "mips", T.mip_chain(F.col("pixel_format"), F.col("size_x"), F.col("size_y"), F.col("num_mips"))
    )


def _edge(level: Column) -> Column:
    return F.greatest(level["w"], level["h"])


def _projected(levelled: DataFrame, cap: Column) -> DataFrame:
    kept = levelled.withColumn("drop_mip_count", T.first_kept(F.col("mips"), cap))
    return kept.withColumns({
        "kept_mip_count": F.size("mips") - F.col("drop_mip_count"),
        "current_mip0_dim": _edge(F.get("mips", F.lit(0))),
        "kept_mip0_dim": _edge(F.get("mips", F.col("drop_mip_count"))),
        "save_bytes": T.bytes_before(F.col("mips"), F.col("drop_mip_count")),
        "original_bytes": T.total_mip_bytes(F.col("mips")),
    })


def plan_mip_strip(textures: DataFrame, cap: int) -> DataFrame:
    """Levels dropped and bytes saved per texture; textures that save nothing stay listed."""
    _check_cap(cap)
    return _projected(with_mips(textures), F.lit(cap))


def mip_strip_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("textures"),
        F.coalesce(F.sum("save_bytes"), F.lit(0)).alias("save_bytes"),
        F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("original_bytes"),
    )


def reproject(textures: DataFrame, caps: Sequence[int]) -> DataFrame:
    """The plan at several caps at once; rows with nothing to save are left out."""
    for cap in caps:
        _check_cap(cap)
    swept = with_mips(textures).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    return _projected(swept, F.col("cap")).where(F.col("save_bytes") > 0)


def reproject_totals(textures: DataFrame, caps: Sequence[int]) -> DataFrame:
    return reproject(textures, caps).groupBy("cap").agg(
        F.count(F.lit(1)).alias("textures"), F.sum("save_bytes").alias("save_bytes"),
        F.sum("original_bytes").alias("original_bytes"),
    )


def savings_curve(textures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(cap_from, cap_to, textures, save_bytes, original_bytes): what every cap from 1 to 16384 saves, as ranges of caps that save the same.

    A level goes under every cap below the smallest edge up to it, unless it is the last.  So each level is one event, at that edge, and
    a cap saves what all events above it hold; events of one edge are summed before anything is ordered, and edges end at
    the largest cap.  ``textures`` and ``original_bytes`` are of textures that save something, as in ``reproject_totals``.
    """
    keys = list(by)
    edges = F.transform("mips", lambda m: F.least(_edge(m), F.lit(MAX_CAP + 1)))
    running = F.aggregate(edges, F.array().cast("array<int>"), lambda acc, e: F.array_append(acc, F.least(e, F.coalesce(F.try_element_at(acc, F.lit(-1)), e)).cast("int")))
    # Negative indexes count from the end: the last level never goes.
    start = F.when(F.size("mips") > 1, F.sequence(F.lit(0), F.size("mips") - 2)).otherwise(F.array().cast("array<int>"))
    levels = with_mips(textures).withColumn("smallest", running).withColumn("levels", F.filter(
        F.transform(start, lambda i: F.struct(F.get("smallest", i).alias("edge"), F.get("mips", i)["bytes"].cast("bigint").alias("bytes"), i.alias("at"))),
        lambda e: (e["edge"] > MIN_CAP) & (e["bytes"] > 0)))
    total = T.total_mip_bytes(F.col("mips"))
    first = lambda e: e["at"] == F.get("levels", F.lit(0))["at"]
    events = levels.select(*keys, F.inline(F.transform("levels", lambda e: F.struct(
        e["edge"].alias("edge"), e["bytes"].alias("bytes"), F.when(first(e), 1).otherwise(0).alias("one"), F.when(first(e), total).otherwise(F.lit(0)).alias("original")))))
    sums = events.groupBy(*keys, "edge").agg(*[F.sum(c).alias(c) for c in ("bytes", "one", "original")])
    groups = textures.select(*keys).distinct() if keys else textures.sparkSession.range(1).select()
    start_row = groups.select(*keys, F.lit(MIN_CAP).alias("edge"), *[F.lit(0).cast("bigint").alias(c) for c in ("bytes", "one", "original")])
    # At most MAX_CAP + 1 rows a group.
    order = Window.partitionBy(*keys).orderBy("edge")
    above = order.rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0).cast("bigint"))
    steps = sums.unionByName(start_row).select(
        *keys, F.col("edge").alias("cap_from"), (F.coalesce(F.lead("edge").over(order), F.lit(MAX_CAP + 1)) - 1).alias("cap_to"),
        zero("one").alias("textures"), zero("bytes").alias("save_bytes"), zero("original").alias("original_bytes"))
    return steps.where(F.col("cap_from") <= MAX_CAP)


def savings_at(curve: DataFrame, caps: Sequence[int]) -> DataFrame:
    """The curve's values at some caps: (cap, textures, save_bytes, original_bytes)."""
    for cap in caps:
        _check_cap(cap)
    wanted = F.filter(F.array(*[F.lit(c) for c in caps]), lambda c: (c >= F.col("cap_from")) & (c <= F.col("cap_to")))
    return curve.withColumn("cap", F.explode(wanted)).drop("cap_from", "cap_to")


def mildest_cap(curve: DataFrame, wanted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For every row (save_at_least, and the columns ``by``) of ``wanted`` the largest cap that saves so much and what it saves; NULLs where none does.

    Savings fall as the cap rises, so this is the inverse of the curve: the last of its ranges that is not below the wish.
    """
    keys = list(by)
    named = curve.select(*keys, "cap_to", F.col("save_bytes").alias("saved"))
    reach = (wanted[keys[0]] == named[keys[0]]) if keys else F.lit(True)
    for k in keys[1:]:
        reach = reach & (wanted[k] == named[k])
    # The curve has at most MAX_CAP rows a group.
    met = wanted.join(named, reach & (named["saved"] >= wanted["save_at_least"]), "left")
    return met.groupBy(*[wanted[k] for k in keys], wanted["save_at_least"]).agg(F.max(F.struct("cap_to", "saved")).alias("best")).select(
        *keys, "save_at_least", F.col("best.cap_to").alias("cap"), F.col("best.saved").alias("save_bytes"))


def format_breakdown(plan: DataFrame) -> DataFrame:
    return plan.groupBy("pixel_format").agg(
        F.count(F.lit(1)).alias("textures"), F.sum("save_bytes").alias("save_bytes")
    ).orderBy(F.desc("save_bytes"), "pixel_format")


def class_histogram(textures: DataFrame, column: str = "class_name", top: int = CLASSES_SHOWN) -> DataFrame:
    return (
        textures.groupBy(column).agg(F.count(F.lit(1)).alias("textures"))
        .orderBy(F.desc("textures"), column).limit(top)
    )


def plan_restore(textures: DataFrame, policy: str = "smart") -> DataFrame:
    restore = T.restore_class(
        F.col("export_name"), F.col("compression_settings"), F.col("pixel_format"), policy
    )
    return textures.withColumn("restore_class", restore)


def restore_counts(routed: DataFrame) -> DataFrame:
    names = ("ai_upscale", "exact_backup", "no_strip")
    return routed.agg(*[F.count_if(F.col("restore_class") == n).alias(n) for n in names])


def _barred(exempt_backup: bool) -> list[str]:
    return ["no_strip", "exact_backup"] if exempt_backup else ["no_strip"]


def strictest_class(classes: DataFrame) -> DataFrame:
    """One class per asset: the strictest of its exports', as an asset is rewritten as a whole."""
    order = F.array(*[F.lit(c) for c in ("no_strip", "exact_backup", "ai_upscale")])
    strictness = F.array_position(order, F.col("restore_class"))
    return classes.where("restore_class IS NOT NULL").groupBy("asset_path").agg(F.min_by("restore_class", strictness).alias("restore_class"))


def route_targets(plan: DataFrame, classes: DataFrame, exempt_backup: bool = True) -> DataFrame:
    """Plan rows that may be stripped; assets without a class stay.

    ``classes`` holds asset_path and restore_class, a row per export or asset.
    """
    routed = plan.join(strictest_class(classes), "asset_path", "left")
    return routed.where(F.col("restore_class").isNull() | ~F.col("restore_class").isin(*_barred(exempt_backup)))


def eligible_targets(textures: DataFrame, cap: int, policy: str = "smart", exempt_backup: bool = True) -> DataFrame:
    """Re-projected plan rows that their own routing lets through; the class is found in the row."""
    routed = reproject(plan_restore(textures, policy), [cap])
    return routed.where(~F.col("restore_class").isin(*_barred(exempt_backup)))


def strip_eligibility(textures: DataFrame, cap: int) -> DataFrame:
    """What a write would do: strip, or skip because nothing is above the cap or nothing fits it."""
    _check_cap(cap)
    levelled = with_mips(textures).withColumn("level", T.fitting_level(F.col("mips"), F.lit(cap)))
    status = (
        F.when(F.col("level").isNull(), "no level small enough")
        .when(F.col("level") == 0, "already at or below cap").otherwise("strip")
    )
    saved = F.when(status == "strip", T.bytes_before(F.col("mips"), F.col("level")))
    return levelled.withColumns({"status": status, "saved_bytes": F.coalesce(saved, F.lit(0))}).drop("level")


def skip_histogram(eligibility: DataFrame) -> DataFrame:
    return (
        eligibility.where(F.col("status") != "strip").groupBy(F.col("status").alias("reason"))
        .agg(F.count(F.lit(1)).alias("textures")).orderBy(F.desc("textures"), "reason")
    )


def mip_table(textures: DataFrame) -> DataFrame:
    """One row per level with the texture's total bytes alongside."""
    levelled = with_mips(textures).withColumn("total_bytes", T.total_mip_bytes(F.col("mips")))
    return levelled.select(
        "asset_path", "export_name", "pixel_format", F.size("mips").alias("mip_count"), "total_bytes",
        F.posexplode("mips").alias("mip_index", "mip"),
    ).select("asset_path", "export_name", "pixel_format", "mip_count", "total_bytes", "mip_index",
             F.col("mip.w").alias("w"), F.col("mip.h").alias("h"), F.col("mip.bytes").alias("bytes"))
