"""Files and bytes below every folder, from intervals of the path tree.

Files are first summed up in the folder they are in.  Folders sorted by path (with a trailing slash) are in pre-order: what lies below
a folder is one interval.  Along that order runs a total; a folder is the difference of the total where its interval ends and where it
began.  A row opens the folders that the row before is not in and closes those that the next is not in, so every folder is
written twice, however many files or levels lie below it, and folders that only show up as parts of paths come out as well.  The order is
cut into ranges, each with a total of its own; a folder that spans several ranges has a difference in each, and they are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftmap.functions import paths as P

ROOT = ""


def own_sizes(files: DataFrame) -> DataFrame:
    """(root_id, folder, own_files, own_bytes): what lies directly in a folder; listed folders that hold nothing have zeros."""
    is_dir = F.col("is_dir")
    folder = F.when(is_dir, F.col("path")).otherwise(P.parent_dir(F.col("path")))
    return files.groupBy("root_id", folder.alias("folder")).agg(
        F.count_if(~is_dir).alias("own_files"), F.coalesce(F.sum(F.when(~is_dir, F.col("size_bytes"))), F.lit(0)).alias("own_bytes"))


def _above(key: Column) -> Column:
    """All folders a sort key ``a/b/`` is in, itself and the root included, as sort keys."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(ROOT)).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))


def folder_sizes(files: DataFrame, ranges: int | None = None) -> DataFrame:
    """(root_id, folder, depth, file_count, total_bytes, own_files, own_bytes) of every folder of every root; the root's own is ''.

    Empty folders need a row with ``is_dir``; NULL sizes count as 0 bytes.
    """
    own = own_sizes(files)
    key = F.when(F.col("folder") == ROOT, F.lit(ROOT)).otherwise(F.concat("folder", F.lit("/")))
    keyed = own.select("root_id", key.alias("key"), "own_files", "own_bytes")
    tasks = ranges or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = keyed.repartitionByRange(tasks, "root_id", "key").withColumn("range", F.spark_partition_id())
    order = Window.partitionBy("range", "root_id").orderBy("key")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = cut.select(
        "root_id", "key", "own_files", "own_bytes", F.lag("key").over(order).alias("before"), F.lead("key").over(order).alias("next"),
        F.sum("own_files").over(upto).alias("files"), F.sum("own_bytes").over(upto).alias("bytes"))
    outside = lambda other: lambda folder: F.coalesce(~F.startswith(other, folder), F.lit(True))
    opened, closed = F.filter(_above(F.col("key")), outside(F.col("before"))), F.filter(_above(F.col("key")), outside(F.col("next")))
    at = lambda folder, files, total: F.struct(folder.alias("key"), files.alias("files"), total.alias("bytes"))
    marks = F.concat(
        F.transform(opened, lambda f: at(f, F.col("own_files") - F.col("files"), F.col("own_bytes") - F.col("bytes"))),
        F.transform(closed, lambda f: at(f, F.col("files"), F.col("bytes"))))
    below = run.select("root_id", marks.alias("marks")).select("root_id", F.inline("marks"))
    # What is in a folder itself travels with the same rows.
    itself = keyed.select("root_id", "key", F.lit(0).cast("bigint").alias("files"), F.lit(0).cast("bigint").alias("bytes"), "own_files", "own_bytes")
    none = F.lit(0).cast("bigint")
    both = below.withColumns({"own_files": none, "own_bytes": none}).unionByName(itself)
    sums = both.groupBy("root_id", "key").agg(*[F.sum(c).alias(c) for c in ("files", "bytes", "own_files", "own_bytes")])
    folder = F.when(F.col("key") == ROOT, F.lit(ROOT)).otherwise(F.expr("left(key, length(key) - 1)"))
    depth = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    return sums.select("root_id", folder.alias("folder"), depth.alias("depth"), F.col("files").alias("file_count"), F.col("bytes").alias("total_bytes"), "own_files", "own_bytes")


def heaviest_folders(files: DataFrame, k: int = 20, depth: int | None = None) -> DataFrame:
    """The k folders of every root with the most bytes below them, of one level or of all below the root; equal bytes by path."""
    sizes = folder_sizes(files)
    chosen = sizes.where(F.col("depth") > 0 if depth is None else F.col("depth") == depth)
    order = Window.partitionBy("root_id").orderBy(F.desc("total_bytes"), "folder")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
