"""Census and sibling operators over a FILES table, one result set per root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftmap.functions import paths as P
from heftmap.operators import spread

TOP_FILES = 50
SIDE_EXTENSIONS = ("sig", "utoc", "ucas")


def only_files(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_dir"))


def _size() -> Column:
    return F.coalesce(F.col("size_bytes"), F.lit(0))


# -- sibling and co-occurrence joins -------------------------------------------------


def with_siblings(files: DataFrame) -> DataFrame:
    """Containers (extension ``pak`` in any case) with flags for their side files.

    All names of one stem meet in one group; containers of a stem differ only in the
    letter case of three letters, so a group never carries more than eight of them.
    """
    extension, exact = P.ext(F.col("path")), P.raw_ext(F.col("path"))
    relevant = only_files(files).select(
        "root_id", "path", _size().alias("size_bytes"), "probe_error",
        P.stem(F.col("path")).alias("stem"), extension.alias("ext"), exact.alias("raw_ext"),
    ).where((F.col("ext") == "pak") | F.col("raw_ext").isin(*SIDE_EXTENSIONS))
    container = F.when(F.col("ext") == "pak", F.struct("path", "size_bytes", "probe_error", "raw_ext"))
    grouped = relevant.groupBy("root_id", "stem").agg(
        F.collect_list(container).alias("containers"),
        *[F.coalesce(F.bool_or(F.col("raw_ext") == e), F.lit(False)).alias(f"has_{e}") for e in SIDE_EXTENSIONS],
    )
    return grouped.select("root_id", F.explode("containers").alias("c"), *[f"has_{e}" for e in SIDE_EXTENSIONS]).select(
        "root_id", "c.*", *[f"has_{e}" for e in SIDE_EXTENSIONS]
    )


def satellite_dirs(files: DataFrame) -> DataFrame:
    """Language-named folders that directly hold a ``.dll``."""
    folder = P.parent_dir(F.col("path"))
    return (
        only_files(files)
        .where(P.raw_ext(F.col("path")) == "dll")
        .select("root_id", folder.alias("dir"))
        .where((F.col("dir") != "") & P.is_satellite_code(P.file_name(F.col("dir"))))
        .distinct()
    )


def size_collision_prefilter(files: DataFrame, min_size: int = 0) -> DataFrame:
    """Files whose size occurs at least twice in their root: the only hash candidates."""
    sized = only_files(files).where(F.col("size_bytes") >= min_size)
    repeated = (
        sized.groupBy("root_id", "size_bytes")
        .agg(F.count(F.lit(1)).alias("n"), spread.salt_mask("path"))
        .where(F.col("n") >= 2)
        .drop("n")
    )
    return spread.attach(sized, repeated, ["root_id", "size_bytes"], ["path"], "left_semi")


def chunk_files(files: DataFrame) -> DataFrame:
    name = P.file_name(F.col("path"))
    return (
        only_files(files)
        .select("root_id", "path", _size().alias("size_bytes"), P.chunk_id(name).alias("chunk_id"),
                P.is_patch_chunk(name).alias("is_patch"))
        .where(F.col("chunk_id").isNotNull())
    )


def chunk_members(chunks: DataFrame) -> DataFrame:
    """Rows of ``chunk_files`` whose chunk has a base and at least one more file.

    The base is the chunk's smallest non-patch path; further non-patch files of the
    chunk count as overlays.
    """
    base = F.min(F.when(~F.col("is_patch"), F.struct("path", "size_bytes")))
    bases = (
        chunks.groupBy("root_id", "chunk_id")
        .agg(base.alias("base"), F.count(F.lit(1)).alias("n"), spread.salt_mask("path"))
        .where(F.col("base").isNotNull() & (F.col("n") >= 2))
        .select("root_id", "chunk_id", F.col("base.path").alias("base_path"),
                F.col("base.size_bytes").alias("base_size"), spread.MASK)
    )
    return spread.attach(chunks, bases, ["root_id", "chunk_id"], ["path"])


def patch_to_base(files: DataFrame) -> DataFrame:
    """Every overlay file next to the base of its chunk."""
    return chunk_members(chunk_files(files)).where(F.col("path") != F.col("base_path")).select(
        "root_id", "chunk_id", "base_path", "base_size",
        F.col("path").alias("patch_path"), F.col("size_bytes").alias("patch_size"),
    )


# -- census --------------------------------------------------------------------------


def _classified(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return only_files(files).select(
        "root_id", "path", _size().alias("size_bytes"),
        P.file_kind(path).alias("kind"), P.detect_language(path).alias("lang"),
    )


def census_totals(files: DataFrame) -> DataFrame:
    return only_files(files).groupBy("root_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum(_size()).alias("total_bytes")
    )


def census_kinds(files: DataFrame) -> DataFrame:
    return (
        only_files(files).groupBy("root_id", P.file_kind(F.col("path")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum(_size()).alias("bytes"))
    )


def census_languages(files: DataFrame) -> DataFrame:
    return (
        only_files(files).select("root_id", "size_bytes", P.detect_language(F.col("path")).alias("lang"))
        .where(F.col("lang").isNotNull())
        .groupBy("root_id", "lang")
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum(_size()).alias("bytes"))
    )


def _saving(langs: Column, total: Column, largest: Column) -> Column:
    return F.when(langs >= 2, total - largest).otherwise(F.lit(0).cast("bigint"))


def l10n_savings(files: DataFrame) -> DataFrame:
    """Bytes beyond the largest language, for every root (0 with fewer than two languages)."""
    per_lang = (
        only_files(files).groupBy("root_id", P.detect_language(F.col("path")).alias("lang"))
        .agg(F.sum(_size()).alias("bytes"))
    )
    spoken = F.when(F.col("lang").isNotNull(), F.col("bytes"))
    return per_lang.groupBy("root_id").agg(
        F.count("lang").alias("languages"),
        _saving(F.count("lang"), F.sum(spoken), F.max(spoken)).alias("l10n_savings"),
    )


def top_files(files: DataFrame, n: int = TOP_FILES) -> DataFrame:
    """The n largest files per root; ties by path, both descending."""
    order = Window.partitionBy("root_id").orderBy(F.desc("size_bytes"), F.desc("path"))
    return (
        only_files(files).select("root_id", "path", _size().alias("size_bytes"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn("kind", P.file_kind(F.col("path")))
    )


def container_status(files: DataFrame) -> DataFrame:
    """Access status of every container outside embedded-browser folders."""
    status = P.container_status(F.col("probe_error"), F.col("has_sig"))
    return (
        with_siblings(files)
        .where(~P.is_embedded_browser(F.col("path")))
        .select("root_id", "path", "size_bytes", status.alias("status"),
                F.when(status == "unreadable", F.col("probe_error")).alias("reason"))
    )


def container_inventory(files: DataFrame) -> DataFrame:
    return container_status(files).groupBy("root_id", "status").agg(
        F.count(F.lit(1)).alias("container_count"), F.sum("size_bytes").alias("bytes")
    )


def savings_pct(files: DataFrame) -> DataFrame:
    """Whole-percent share of the root that language savings make up."""
    report = census_report(files)
    share = F.round(F.lit(100.0) * F.col("l10n_savings") / F.col("total_bytes"))
    return report.select(
        "root_id",
        F.when(F.col("total_bytes") > 0, share).otherwise(F.lit(0.0)).cast("int").alias("savings_pct"),
    )


def languages_ranked(files: DataFrame) -> DataFrame:
    """Languages by bytes; a root has one row per language code, so the window stays small."""
    order = Window.partitionBy("root_id").orderBy(F.desc("bytes"), "lang")
    ranked = census_languages(files).withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("is_largest", F.col("rank") == 1)


def census_report(files: DataFrame) -> DataFrame:
    """Totals, kinds, languages and language savings of every root from one scan."""
    cells = _classified(files).groupBy("root_id", "kind", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")
    )
    per_lang = cells.groupBy("root_id", "lang").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"),
        *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_n") for k in ("pak", "texture", "audio")],
        *[F.sum(F.when(F.col("kind") == k, F.col("bytes")).otherwise(0)).alias(f"{k}_bytes") for k in ("pak", "texture", "audio")],
    )
    spoken = F.when(F.col("lang").isNotNull(), F.col("bytes"))
    language = F.when(
        F.col("lang").isNotNull(),
        F.struct("lang", F.struct(F.col("n").alias("count"), F.col("bytes").alias("size"))),
    )
    kinds = [
        F.struct(F.sum(f"{k}_n").alias("count"), F.sum(f"{k}_bytes").alias("size")).alias(f"{k}_files")
        for k in ("pak", "texture", "audio")
    ]
    return per_lang.groupBy("root_id").agg(
        F.sum("n").alias("file_count"),
        F.sum("bytes").alias("total_bytes"),
        *kinds,
        F.map_from_entries(F.collect_list(language)).alias("languages"),
        _saving(F.count("lang"), F.sum(spoken), F.max(spoken)).alias("l10n_savings"),
    )


def full_census(files: DataFrame, n: int = TOP_FILES) -> DataFrame:
    """``census_report`` with the n largest files of every root and its containers by access status."""
    largest = top_files(files, n).groupBy("root_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "path", "size_bytes", "kind"))).alias("top_files")
    )
    access = container_inventory(files).groupBy("root_id").agg(
        F.map_from_entries(F.collect_list(F.struct("status", F.struct("container_count", "bytes")))).alias("containers")
    )
    return census_report(files).join(largest, "root_id", "left").join(access, "root_id", "left")
