"""Inventories, container entries, change manifests and benchmark files as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftmap import schemas
from heftmap.operators import detectors as D
from heftmap.operators import manifest as M
from heftmap.operators.audit import audit
from heftmap.operators.entries import list_entries
from heftmap.operators.inventory import size_collision_prefilter
from heftmap.operators.staging import stage


def read_inventory(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An inventory table with the FILES columns; optional columns may be missing in the data."""
    reader = spark.read.schema(schemas.FILES)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def scan_inventory(spark: SparkSession, roots: Sequence[tuple[int, str]], fan_out: int | None = None) -> DataFrame:
    """List live folder trees: one row per file and folder, links not followed, errors skipped.

    Spark's own file listing hides names starting with ``_`` or ``.`` and lists no
    folders, so folders are listed inside tasks, which must see the trees.  Level by level, every
    folder is a work item of its own; a level is written before the next is made from it, so
    no folder is listed twice.  Runs a job per level of the deepest tree while it is called.
    """
    level = spark.createDataFrame(
        [(int(i), os.path.abspath(p), os.path.abspath(p)) for i, p in roots],
        "root_id long, root string, dir string",
    )
    tasks = fan_out or spark.sparkContext.defaultParallelism
    listed = []
    while True:
        found = stage(level.repartition(tasks, "root_id", "dir").mapInPandas(_list_one, _LISTED), "level")
        listed.append(found)
        level = found.where("is_dir").select("root_id", "root", F.concat("root", F.lit("/"), "path").alias("dir"))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, listed).select(
        "root_id", "path", "is_dir", "size_bytes", F.lit(None).cast("string").alias("content_sha256"),
        F.lit(None).cast("string").alias("probe_error"),
    )


def hashed_inventory(spark: SparkSession, roots: Sequence[tuple[int, str]], min_size: int = D.MIN_DUPLICATE_SIZE) -> DataFrame:
    """A live scan in which the files that share their size with another have their hashes."""
    files = stage(scan_inventory(spark, roots), "scan")
    where = spark.createDataFrame([(int(i), os.path.abspath(p)) for i, p in roots], "root_id long, root string")
    hashes = hash_files(size_collision_prefilter(files, min_size), where).select("root_id", "path", "content_sha256")
    merged = files.drop("content_sha256").join(hashes, ["root_id", "path"], "left")
    return merged.select(*schemas.FILES.names)


def audit_roots(spark: SparkSession, roots: Sequence[tuple[int, str]], detectors: Sequence[str] = D.ROSTER,
                probes: DataFrame | None = None) -> DataFrame:
    """From folders to one scored row per root: scan, hash what may be copies, audit.

    ``probes`` (root_id, path, probe_error) holds what opening the containers gave.  Without it nothing is
    known about access, so the encryption detector is left out.
    """
    files = hashed_inventory(spark, roots)
    if probes is None:
        detectors = [d for d in detectors if d != "encryption"]
    else:
        files = files.drop("probe_error").join(probes.select("root_id", "path", "probe_error"), ["root_id", "path"], "left")
    return audit(files.select(*schemas.FILES.names), detectors)


_LISTED = "root_id long, root string, path string, is_dir boolean, size_bytes long"
_COLUMNS = ["root_id", "root", "path", "is_dir", "size_bytes"]
_BATCH = 10_000


def _entries_of(folder: str) -> Iterator[os.DirEntry]:
    try:
        with os.scandir(folder) as listing:
            yield from listing
    except OSError:
        return


def _row(root_id: int, root: str, item: os.DirEntry) -> tuple | None:
    try:
        is_dir = item.is_dir(follow_symlinks=False)
        if not is_dir and not item.is_file(follow_symlinks=False):
            return None
        size = 0 if is_dir else item.stat(follow_symlinks=False).st_size
    except OSError:
        return None
    return root_id, root, os.path.relpath(item.path, root).replace(os.sep, "/"), is_dir, size


def _in_batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    batch: list[tuple] = []
    for row in rows:
        batch.append(row)
        if len(batch) >= _BATCH:
            yield pd.DataFrame(batch, columns=_COLUMNS)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=_COLUMNS)


def _list_one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for root_id, root, folder in part.itertuples(index=False):
            rows = (_row(root_id, root, item) for item in _entries_of(folder))
            yield from _in_batches(r for r in rows if r is not None)


def hash_files(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """Stream SHA-256 over candidate files inside tasks, in blocks, whatever their size.

    ``candidates`` should be the output of ``size_collision_prefilter``; ``roots`` holds
    (root_id, root).  Files that cannot be read keep a NULL hash.
    """
    located = candidates.drop("content_sha256").join(roots, "root_id")

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for part in parts:
            hashes = []
            for root, path in zip(part["root"], part["path"]):
                try:
                    with open(os.path.join(root, path), "rb") as handle:
                        hashes.append(hashlib.file_digest(handle, "sha256").hexdigest())
                except OSError:
                    hashes.append(None)
            yield part.assign(content_sha256=hashes)[schemas.FILES.names]

    return located.select("root", *[c for c in schemas.FILES.names if c != "content_sha256"]).mapInPandas(
        digest, schemas.FILES
    )


def read_entries(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Container entries with their position and a flag for containers cut at ``limit``."""
    return list_entries(entries, limit)


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark CSV, one row per label: the row furthest down a file wins."""
    rows = (
        spark.read.schema(schemas.BENCH).option("header", True).csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_line"))
    )
    # Lines of one block have rising ids, and blocks of a file have rising offsets.
    place = F.struct("_file", "_block", "_line")
    names = schemas.BENCH.names
    latest = rows.groupBy("label").agg(F.max_by(F.struct(*names), place).alias("row"))
    return latest.select("row.*")


def read_manifest(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Change manifests, one JSON document per file or per line.

    ``manifest_id`` is made of the file, the root and the creation time, as a root may have any
    number of manifests.  A document of another version stops the read.
    """
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", not one_per_line).json(path)
    complaint = F.concat(F.lit("unsupported manifest version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))
    checked = F.when(F.col("version") == M.VERSION, F.col("version")).otherwise(F.raise_error(complaint).cast("int"))
    identity = F.concat_ws("#", F.col("_metadata.file_path"), "root", "created_at")
    return raw.select(identity.alias("manifest_id"), checked.alias("version"), "created_at", "root", "mode", "entries")
