"""Detectors of one's own as a table function of SQL.

    register(spark, Rule("raw_audio", ends_in("wav", "flac"), warn_at=100 * MIB))
    SELECT * FROM audit_rule(TABLE(files) PARTITION BY (root_id), 'raw_audio')
    SELECT * FROM audit_rule(TABLE(SELECT * FROM files WHERE root_id < 3) PARTITION BY (root_id), 'raw_audio')

A rule looks at Arrow batches of the table and marks rows; it never sees single rows.  The function keeps sums per root, so it may be
called with ``PARTITION BY (root_id)``, where every row it gives is a whole finding, or on the table as it is, where a root has a
row for every task: ``rule_findings`` adds those up, which a root of any size allows.  The table needs root_id, path and
size_bytes and whatever else the rule reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftmap.functions.numbers import format_bytes
from heftmap.operators import detectors as D
from heftmap.operators.tasks import ship_package

FUNCTION = "audit_rule"
COLUMNS = "root_id bigint, detector string, item_count bigint, total_bytes bigint, largest_bytes bigint, largest_path string, severity string"


@dataclass(frozen=True)
class Rule:
    """``matches`` marks the rows of a batch that count; from ``warn_at`` bytes on the finding is a warning.

    Unmarked (null) rows do not count, nor do folders if the table has ``is_dir``.
    """

    name: str
    matches: Callable[[pa.RecordBatch], pa.BooleanArray]
    warn_at: int
    reclaimable: bool = True


def ends_in(*extensions: str) -> Callable[[pa.RecordBatch], pa.BooleanArray]:
    """Marks paths with one of these extensions, whatever their case."""
    pattern = r"(?i)[^/]\.(" + "|".join(extensions) + r")$"
    return lambda batch: pc.match_substring_regex(batch.column("path"), pattern)


def _function(rules: dict[str, Rule]) -> type:
    class AuditRule:
        def __init__(self):
            self.sums: pa.Table | None = None
            self.rule: Rule | None = None

        def eval(self, batch: pa.RecordBatch, rule: pa.Array) -> Iterator[pa.Table]:
            if not batch.num_rows:
                return
            name = rule[0].as_py()
            if name not in rules:
                raise ValueError(f"unknown rule {name}; registered are {sorted(rules)}")
            self.rule = rules[name]
            chosen = pc.fill_null(self.rule.matches(batch), False)
            if "is_dir" in batch.schema.names:
                chosen = pc.and_(chosen, pc.invert(pc.fill_null(batch.column("is_dir"), False)))
            hits = pa.table({
                "root_id": batch.column("root_id").cast(pa.int64()), "n": pa.array([1] * batch.num_rows, pa.int64()),
                "bytes": pc.fill_null(batch.column("size_bytes"), 0).cast(pa.int64()), "path": batch.column("path")}).filter(chosen)
            hits = hits.append_column("largest", hits.column("bytes"))
            self.sums = self.summed(hits if self.sums is None else pa.concat_tables([self.sums, hits]))
            yield from ()

        @staticmethod
        def summed(hits: pa.Table) -> pa.Table:
            """One row per root: numbers added up, and the smallest path of the largest size."""
            totals = hits.group_by("root_id").aggregate([("n", "sum"), ("bytes", "sum"), ("largest", "max")])
            totals = totals.rename_columns({"n_sum": "n", "bytes_sum": "bytes", "largest_max": "top"})
            met = hits.select(["root_id", "largest", "path"]).join(totals, "root_id")
            first = met.filter(pc.equal(met.column("largest"), met.column("top"))).group_by(["root_id", "n", "bytes", "top"]).aggregate([("path", "min")])
            return first.rename_columns({"path_min": "path", "top": "largest"}).select(["root_id", "n", "bytes", "path", "largest"])

        def terminate(self) -> Iterator[pa.Table]:
            if self.sums is None or not self.sums.num_rows:
                return
            held = self.sums
            severity = pc.if_else(pc.greater_equal(held.column("bytes"), self.rule.warn_at), "warning", "info")
            yield pa.table({
                "root_id": held.column("root_id"), "detector": pa.array([self.rule.name] * held.num_rows), "item_count": held.column("n"), "total_bytes": held.column("bytes"),
                "largest_bytes": held.column("largest"), "largest_path": held.column("path"), "severity": severity})

    return AuditRule


def register(spark: SparkSession, *rules: Rule, name: str = FUNCTION) -> None:
    """Makes ``name(TABLE(...), 'rule')`` known to SQL; a later call replaces the rules of an earlier one."""
    ship_package(spark)
    spark.udtf.register(name, F.arrow_udtf(_function({r.name: r for r in rules}), returnType=COLUMNS))


def rule_findings(files: DataFrame, rule: Rule) -> DataFrame:
    """The rule's findings with the columns of ``detectors.findings``; tasks add up their rows, then roots theirs."""
    ship_package(files.sparkSession)
    partial = F.arrow_udtf(_function({rule.name: rule}), returnType=COLUMNS)(files.asTable(), F.lit(rule.name))
    sums = partial.groupBy("root_id").agg(F.sum("item_count").alias("item_count"), F.sum("total_bytes").alias("total_bytes"))
    severity = F.when(F.col("total_bytes") >= rule.warn_at, "warning").otherwise("info")
    return sums.select(
        "root_id", F.lit(rule.name).alias("detector"), F.lit(rule.name).alias("category"), severity.alias("severity"), "item_count",
        F.lit(1).cast("bigint").alias("group_count"), "total_bytes", (F.col("total_bytes") if rule.reclaimable else F.lit(None).cast("bigint")).alias("reclaimable_bytes"),
        F.lit(None).cast("string").alias("detail"), F.lit(len(D.ROSTER)).alias("detector_rank"), F.when(severity == "warning", 1).otherwise(0).alias("severity_rank"),
        F.format_string("%d files, %s", F.col("item_count"), format_bytes(F.col("total_bytes"))).alias("title"))
