"""Browsing the entries of containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heftmap.functions import paths as P

SHOWN = 300


def classified(entries: DataFrame) -> DataFrame:
    kind = P.entry_filter_class(F.col("path"), F.col("is_package"), F.col("is_payload"))
    return entries.withColumn("entry_class", kind)


def list_entries(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """First ``limit`` entries of every container by path, and whether there were more."""
    keys = ["root_id", "container_path"]
    counts = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("entry_count"))
    if not limit or limit <= 0:
        return entries.withColumn("position", F.lit(None).cast("int")).withColumn("truncated", F.lit(False))
    order = Window.partitionBy(*keys).orderBy("path")
    first = entries.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return first.join(counts, keys).withColumn("truncated", F.col("entry_count") > limit).drop("entry_count")


def entry_class_counts(entries: DataFrame) -> DataFrame:
    """Entries per class of every root; class ``all`` holds their number."""
    counts = classified(entries).groupBy("root_id", "entry_class").agg(F.count(F.lit(1)).alias("entry_count"))
    every = counts.groupBy("root_id").agg(F.sum("entry_count").alias("entry_count")).select(
        "root_id", F.lit("all").alias("entry_class"), "entry_count"
    )
    return counts.unionByName(every)


def search_entries(entries: DataFrame, query: str = "", entry_class: str = "all", top: int = SHOWN) -> DataFrame:
    """The ``top`` largest entries of every container whose path contains the text, ignoring case.

    Spark keeps ``top`` rows per container and task before it shuffles.
    """
    hits = classified(entries)
    if entry_class != "all":
        hits = hits.where(F.col("entry_class") == entry_class)
    text = query.strip().lower()
    if text:
        hits = hits.where(F.lower("path").contains(text))
    order = Window.partitionBy("root_id", "container_path").orderBy(F.desc("size_bytes"), "path")
    return hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
