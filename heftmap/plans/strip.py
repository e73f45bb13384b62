"""Language-removal and re-encoding plans, and before/after comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.functions import paths as P
from heftmap.operators import inventory as I
from heftmap.operators import spread


def plan_strip_loose(files: DataFrame, drop: Sequence[str]) -> DataFrame:
    """Loose files of the dropped languages."""
    path = F.col("path")
    return (
        I.only_files(files).where(P.ext(path) != "pak")
        .select("root_id", "path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
                P.detect_language(path).alias("lang"))
        .where(F.col("lang").isin(*drop))
    )


def plan_strip_totals(files: DataFrame, drop: Sequence[str]) -> DataFrame:
    return plan_strip_loose(files, drop).groupBy("root_id").agg(
        F.count(F.lit(1)).alias("loose_files"), F.sum("size_bytes").alias("loose_bytes"),
        F.lit(",".join(sorted(set(drop)))).alias("drop_languages"),
    )


def _all_container_status(files: DataFrame) -> DataFrame:
    status = P.container_status(F.col("probe_error"), F.col("has_sig"))
    return I.with_siblings(files).select(
        "root_id", F.col("path").alias("container_path"), "size_bytes", status.alias("status"),
        F.when(status == "unreadable", F.col("probe_error")).alias("reason"),
    )


def entries_by_status(entries: DataFrame, files: DataFrame, status: str = "readable") -> DataFrame:
    """Entries of the containers that have the given access status.

    A container may hold a large share of all entries, so entries meet their container
    on a salted key; a container is repeated once per salt that its entries use.
    """
    keys = ["root_id", "container_path"]
    used = entries.groupBy(*keys).agg(spread.salt_mask("path"))
    wanted = _all_container_status(files).where(F.col("status") == status).select(*keys).join(used, keys)
    return spread.attach(entries, wanted, keys, ["path"], "left_semi")


def plan_strip_containers(entries: DataFrame, files: DataFrame, drop: Sequence[str]) -> DataFrame:
    """Per readable container: entries dropped and kept; untouched containers are left out.

    Entries are counted per container before they meet the access status.
    """
    language = P.detect_language(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    dropped = F.coalesce(language.isin(*drop), F.lit(False))
    keys = ["root_id", "container_path"]
    counts = entries.groupBy(*keys).agg(
        F.count_if(dropped).alias("dropped_entries"), F.count_if(~dropped).alias("kept_entries")
    ).where(F.col("dropped_entries") > 0)
    readable = _all_container_status(files).where(F.col("status") == "readable").select(*keys)
    return counts.join(readable, keys, "left_semi").withColumn("becomes_empty", F.col("kept_entries") == 0)


def plan_strip_skipped(files: DataFrame) -> DataFrame:
    """Containers a language plan cannot open, with the reason."""
    return _all_container_status(files).where(F.col("status") != "readable")


def plan_recompress(files: DataFrame) -> DataFrame:
    """Loose images and sounds that have an encoder."""
    kind = P.recompress_kind(F.col("path"))
    return (
        I.only_files(files)
        .select("root_id", "path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), kind.alias("kind"))
        .where(F.col("kind").isNotNull())
        .withColumn("encoder", P.encoder_for(F.col("kind")))
    )


def recompress_totals(files: DataFrame) -> DataFrame:
    return plan_recompress(files).groupBy("root_id", "kind", "encoder").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("bytes")
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per path what happened between two inventories and the bytes it saved."""
    old = I.only_files(before).select("root_id", "path", F.col("size_bytes").alias("before_bytes"))
    new = I.only_files(after).select("root_id", "path", F.col("size_bytes").alias("after_bytes"))
    was, now = F.col("before_bytes"), F.col("after_bytes")
    change = (
        F.when(was.isNull(), "added").when(now.isNull(), "deleted").when(now < was, "shrunk")
        .when(now > was, "grown").otherwise("unchanged")
    )
    return old.join(new, ["root_id", "path"], "full").select(
        "root_id", "path", "before_bytes", "after_bytes", change.alias("change"),
        (F.coalesce(was, F.lit(0)) - F.coalesce(now, F.lit(0))).alias("saved_bytes"),
        (was.isNotNull() & now.isNotNull() & (now >= was)).alias("no_improvement"),
    )


def snapshot_diff_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    return snapshot_diff(before, after).groupBy("root_id", "change").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("saved_bytes").alias("saved_bytes")
    )
