"""Report and benchmark writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap import schemas
from heftmap.operators.audit import report_json, report_markdown


def write_report_json(report: DataFrame, path: str) -> None:
    """One JSON document per root and line."""
    report_json(report).select("json").write.text(path)


def render_report_markdown(report: DataFrame, path: str) -> None:
    """One Markdown document per root, in a folder per root."""
    documents = report_markdown(report)
    documents.select("root_id", F.col("markdown").alias("value")).write.partitionBy("root_id").text(path)


def bench_lines(runs: DataFrame) -> DataFrame:
    """Benchmark columns in file order; ratio with six and energy with four decimals."""
    fixed = {"ratio_vs_baseline": F.format_string("%.6f", "ratio_vs_baseline"),
             "hp_energy": F.format_string("%.4f", "hp_energy")}
    return runs.select(*[fixed.get(n, F.col(n)).alias(n) for n in schemas.BENCH.names])


def write_bench_csv(runs: DataFrame, path: str) -> None:
    """A headed CSV; the path column is always quoted."""
    lines = bench_lines(runs)
    quoted = F.concat(F.lit('"'), F.replace("path", F.lit('"'), F.lit('""')), F.lit('"'))
    rest = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in schemas.BENCH.names if n != "path"]
    text = lines.select(F.concat_ws(",", quoted, *rest).alias(",".join(schemas.BENCH.names)))
    text.write.option("header", True).option("quoteAll", False).option("quote", "\0").option(
        "escapeQuotes", False
    ).option("delimiter", "\x01").csv(path)
