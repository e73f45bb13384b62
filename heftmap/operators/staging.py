"""Written intermediate tables in the shared folder the session names.

Every staged table is a folder below ``spark.checkpoint.dir``.  Its owner deletes it with
``discard`` once nothing reads it, or all at once with ``discard_all`` when the results
have been consumed.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_staged: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master (one machine, as in tests) gets a temporary folder that
    goes at exit; any other master is an error, as its executors could not see such a folder.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not folder:
        if not is_one_machine(spark.sparkContext.master):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _own[app], True)
        folder = _own[app]
    return folder.rstrip("/")


def is_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/heftmap-{name}-{uuid.uuid4().hex}"
    _staged.add(path)
    return path


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and read it back, so several branches share one computation."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(spark: SparkSession, *staged: DataFrame | str) -> None:
    """Delete staged tables, given as what ``stage`` returned or by path."""
    jvm = spark.sparkContext._jvm
    for table in staged:
        path = table if isinstance(table, str) else table.staged_at
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _staged.discard(path)


def keep(staged: DataFrame) -> DataFrame:
    """Leave a staged table out of ``discard_all``: its owner deletes it."""
    _staged.discard(staged.staged_at)
    return staged


def discard_all(spark: SparkSession) -> None:
    """Delete what this process has staged and not yet deleted; nothing may read it any more."""
    discard(spark, *sorted(_staged))
