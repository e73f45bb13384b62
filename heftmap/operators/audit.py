"""From findings to a per-root report."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftmap.functions.numbers import format_bytes, rfc3339, score_label
from heftmap.functions.rules import first_match
from heftmap.operators import detectors as D
from heftmap.operators import inventory as I
from heftmap.operators.staging import stage

SCHEMA_VERSION = 1
MARKDOWN_EVIDENCE = 5
SCREEN_EVIDENCE = 8


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def findings_by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("root_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def reclaimable_by_category(found: DataFrame) -> DataFrame:
    """Bytes per category; findings without an estimate do not appear."""
    return (
        found.where(F.col("reclaimable_bytes").isNotNull())
        .groupBy("root_id", "category").agg(F.sum("reclaimable_bytes").alias("bytes"))
    )


def category_table(found: DataFrame) -> DataFrame:
    """Non-zero categories ranked by bytes; at most one row per detector and root."""
    order = Window.partitionBy("root_id").orderBy(F.desc("bytes"), "category")
    return reclaimable_by_category(found).where(F.col("bytes") > 0).withColumn("rank", F.row_number().over(order))


def bloat_score(pct: Column, critical: Column, access_blocked: Column) -> Column:
    raw = (
        F.least(pct * 2.0, F.lit(60.0))
        + F.least(critical * 10.0, F.lit(30.0))
        + F.when(access_blocked, 10.0).otherwise(0.0)
    )
    return F.floor(F.greatest(F.lit(0.0), F.least(raw, F.lit(100.0)))).cast("int")


def aggregate(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts, reclaimable bytes, percentage and score for every root in ``totals``.

    Estimates of different detectors may cover the same bytes, so the percentage can
    exceed 100.
    """
    blocked = (F.col("category") == "encryption") & (F.col("severity") != "info")
    per_root = found.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_findings") for s in D.SEVERITIES],
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
        F.coalesce(F.bool_or(blocked), F.lit(False)).alias("access_blocked"),
    )
    joined = totals.join(per_root, "root_id", "left").fillna(
        0, ["total_findings", "reclaimable_bytes", *[f"{s}_findings" for s in D.SEVERITIES]]
    ).fillna(False, ["access_blocked"])
    pct = F.when(
        F.col("total_bytes") > 0, F.col("reclaimable_bytes") / F.col("total_bytes") * 100.0
    ).otherwise(F.lit(0.0))
    scored = joined.withColumn("reclaimable_pct", pct).withColumn(
        "score", bloat_score(F.col("reclaimable_pct"), F.col("critical_findings"), F.col("access_blocked"))
    )
    return scored.withColumn("score_label", score_label(F.col("score")))


def audit(files: DataFrame, detectors: Sequence[str] = D.ROSTER) -> DataFrame:
    """One scored row per root."""
    return aggregate(D.findings(files, detectors), I.census_totals(files))


def rank_evidence(shown: DataFrame, k: int) -> DataFrame:
    """The k largest evidence rows of every finding and how many more there are.

    Evidence is written once: it is read for the ranking, which keeps only k rows per
    finding and task before it shuffles, and again for the counts.
    """
    shown = stage(shown, "evidence")
    keys = ["root_id", "detector"]
    order = Window.partitionBy(*keys).orderBy(F.desc("size_bytes"), "path")
    top = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    counts = shown.groupBy(*keys).agg(F.count(F.lit(1)).alias("evidence_count"))
    return top.join(counts, keys).withColumn(
        "more", F.greatest(F.col("evidence_count") - k, F.lit(0).cast("bigint"))
    ).drop("evidence_count")


def detector_error_finding(roots: DataFrame, detector: str, message: str) -> DataFrame:
    """A warning for every root saying that a detector could not be planned, or failed."""
    return roots.select(
        "root_id", F.lit(detector).alias("detector"), F.lit("chunking_quality").alias("category"),
        F.lit("warning").alias("severity"), F.lit(0).cast("bigint").alias("item_count"),
        F.lit(0).cast("bigint").alias("group_count"), F.lit(0).cast("bigint").alias("total_bytes"),
        F.lit(None).cast("bigint").alias("reclaimable_bytes"), F.lit(message).alias("detail"),
        F.lit(D.ROSTER.index(detector) if detector in D.ROSTER else len(D.ROSTER)).alias("detector_rank"),
        F.lit(1).alias("severity_rank"),
        F.concat(F.lit("detector could not run: "), F.lit(detector)).alias("title"),
    )


def guarded_findings(files: DataFrame, roster: dict) -> DataFrame:
    """Findings of a roster of ``name -> function(files) -> findings``.

    A function that cannot be planned over this inventory (a column it needs is
    missing, say) turns into a warning finding; the others still run.  A failure while
    tasks run still fails the job.
    """
    parts = []
    for name, detect in roster.items():
        try:
            part = detect(files)
            part.schema  # noqa: B018 - forces analysis of the plan
        except AnalysisException as error:
            first_line = str(error).splitlines()[0]
            part = detector_error_finding(files.select("root_id").distinct(), name, first_line)
        parts.append(part)
    return union_findings(parts)


Detector = Callable[[DataFrame], DataFrame]


def _reason(error: Exception) -> str:
    """The innermost condition of a failed job, in one line."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    conditions = [m.group(0) for x in lines if (m := re.search(r"\[[A-Z][A-Z0-9_.]+\].*", x))]
    return (conditions or lines or [type(error).__name__])[-1][:300]


def isolated_findings(files: DataFrame, roster: Mapping[str, Detector | None] | None = None) -> DataFrame:
    """Findings of a roster in which a detector that fails, in planning or in its tasks, becomes a warning finding and the others stay whole.

    A roster names detectors of this library (value None) and others (a function of the inventory that gives findings).
    All run together first, the library's in one scan.  If that job fails, the roster is halved, and so on down to
    the detectors that fail; every part that succeeds is written and read from there.  Runs jobs while it is called.
    """
    roster = dict.fromkeys(D.ROSTER) if roster is None else roster
    spark = files.sparkSession
    roots = files.select("root_id").distinct()

    def plan(names: list[str]) -> DataFrame:
        shared = [n for n in names if roster[n] is None]
        own = [roster[n](files) for n in names if roster[n] is not None]
        return union_findings(([D.findings(files, shared)] if shared else []) + own)

    def run(names: list[str]) -> list[DataFrame]:
        try:
            return [stage(plan(names), "findings")]
        except (PySparkException, Py4JJavaError) as error:
            if spark.sparkContext._jsc.sc().isStopped():
                raise
            if len(names) == 1:
                return [stage(detector_error_finding(roots, names[0], _reason(error)), "findings")]
            half = len(names) // 2
            return run(names[:half]) + run(names[half:])

    return union_findings(run(list(roster)))


def isolated_audit(files: DataFrame, roster: Mapping[str, Detector | None] | None = None) -> DataFrame:
    """``audit`` from ``isolated_findings``."""
    return aggregate(isolated_findings(files, roster), I.census_totals(files))


# -- report shapes -------------------------------------------------------------------


ADVICE = {
    "patch_overlay": "Fold the overlays into their base chunk with the next full build, so that replaced data is no longer shipped twice.",
    "stale_version_dir": "Delete all but the newest version folder once the update has been verified.",
    "sharded_videos": "Pack the videos into fewer containers; each small one costs alignment and index space.",
    "large_chunk": "Split the chunk, so that a patch of a few files does not move the whole of it.",
    "encryption": "Provide keys or probe results for these containers; what they hold is not part of the estimate.",
    "editor_leftovers": "Leave debug symbols and intermediate files out of the shipping build.",
    "launcher_satellite": "Ship the launcher's language folders on demand and keep the one in use.",
    "shader_rhi_redundancy": "Keep the shader family that the target machines load and offer the others as an option.",
    "redist_installer": "Remove the bundled installers after the first start, or fetch them when they are missing.",
    "platform_siblings": "Ship only the binaries of the platform that is installed.",
    "mod_manager_artifacts": "Clear what the mod tool has disabled or left behind.",
    "duplicate_content": "Keep one copy of every file and point the other paths at it.",
    "cef_locales": "Keep the browser locales of the supported languages and drop the rest.",
}


def _summary() -> Column:
    saved = F.concat(format_bytes(F.col("reclaimable_bytes")), F.lit(" of them could go"))
    held = F.format_string("%d items hold %s", F.col("item_count"), format_bytes(F.col("total_bytes")))
    return F.concat_ws(", ", held, F.when(F.col("reclaimable_bytes") > 0, saved))


def report_rows(files: DataFrame, detectors: Sequence[str] = D.ROSTER, evidence_rows: int = MARKDOWN_EVIDENCE,
                generated_at: int | None = None) -> DataFrame:
    """One row per root: report meta, summary columns, and findings with their largest evidence rows.

    ``generated_at`` is in seconds since 1970, now where it is left out.  Runs jobs while it is called.  The nested arrays are small by construction: at most one finding per detector and
    ``evidence_rows`` rows per finding.  The complete evidence is ``D.evidence``.
    """
    signals = D.staged_signals(files, detectors)
    found = stage(D.findings_from(D.places(D.units(signals))), "findings")
    ranked = rank_evidence(D.evidence_from(signals, detectors), evidence_rows)
    top = ranked.groupBy("root_id", "detector").agg(
        F.sort_array(F.collect_list(F.struct("rank", "path", "size_bytes", "note"))).alias("evidence"),
        F.max("more").alias("more"),
    )
    full = found.join(top, ["root_id", "detector"], "left")
    advice = first_match((F.col("detector") == d, text) for d, text in ADVICE.items())
    listed = full.groupBy("root_id").agg(
        F.sort_array(F.collect_list(F.struct(
            (-F.col("severity_rank")).alias("order_key"), "detector_rank", "detector", "category", "severity",
            "title", _summary().alias("summary"), advice.alias("recommendation"), "detail", "item_count", "total_bytes", "reclaimable_bytes",
            F.coalesce("evidence", F.array().cast("array<struct<rank:int,path:string,size_bytes:bigint,note:string>>"))
            .alias("evidence"),
            F.coalesce(F.col("more"), F.lit(0)).alias("more"),
        ))).alias("findings")
    )
    when = F.lit(generated_at).cast("bigint") if generated_at is not None else F.unix_timestamp()
    return aggregate(found, I.census_totals(files)).join(listed, "root_id", "left").withColumns({
        "schema_version": F.lit(SCHEMA_VERSION), "generated_at": rfc3339(when), "detectors": F.array(*map(F.lit, detectors)),
    })


def report_json(report: DataFrame) -> DataFrame:
    shaped = F.struct(*[c for c in report.columns if c not in ("findings",)], F.transform(
        F.coalesce("findings", F.array().cast(report.schema["findings"].dataType)),
        lambda f: f.dropFields("order_key", "detector_rank"),
    ).alias("findings"))
    return report.select("root_id", F.to_json(shaped).alias("json"))


def _finding_markdown(f: Column) -> Column:
    lines = F.transform(
        f["evidence"],
        lambda e: F.concat(
            F.lit("- `"), e["path"], F.lit("`: "), format_bytes(e["size_bytes"]),
            F.coalesce(F.concat(F.lit(" _"), e["note"], F.lit("_")), F.lit("")),
        ),
    )
    more = F.when(f["more"] > 0, F.format_string("- … and %d more", f["more"]))
    saved = F.when(f["reclaimable_bytes"].isNotNull(), F.concat(F.lit("Reclaimable: "), format_bytes(f["reclaimable_bytes"])))
    head = F.format_string("### [%s] %s", f["severity"], f["title"])
    kind = F.format_string("Detector: `%s`", f["detector"])
    return F.concat_ws("\n", head, kind, f["summary"], saved, F.array_join(lines, "\n"), more, F.concat(F.lit("Advice: "), f["recommendation"]))


def report_markdown(report: DataFrame) -> DataFrame:
    """One Markdown document per root: header, categories, findings by falling severity, and a footer on how it was made."""
    categories = F.array_sort(
        F.filter("findings", lambda f: f["reclaimable_bytes"].isNotNull()),
        lambda a, b: F.when(a["reclaimable_bytes"] > b["reclaimable_bytes"], -1)
        .when(a["reclaimable_bytes"] < b["reclaimable_bytes"], 1).otherwise(0),
    )
    table = F.array_join(
        F.transform(categories, lambda f: F.format_string("| %s | %s |", f["category"], format_bytes(f["reclaimable_bytes"]))),
        "\n",
    )
    header = F.concat_ws(
        "\n",
        F.format_string("# Install audit: root %d", F.col("root_id")),
        F.concat(F.lit("Total size: "), format_bytes(F.col("total_bytes"))),
        F.format_string("Score: %d/100 (%s)", F.col("score"), F.col("score_label")),
        F.when(F.col("reclaimable_bytes") > 0, F.format_string(
            "Estimated reclaimable: %s (%.1f%%)", format_bytes(F.col("reclaimable_bytes")), F.col("reclaimable_pct"))),
    )
    sections = [
        F.when(
            F.exists("findings", lambda f: f["severity"] == s),
            F.concat(
                F.format_string(f"## {s.title()} findings (%d)\n\n", F.size(F.filter("findings", lambda f: f["severity"] == s))),
                F.array_join(F.transform(F.filter("findings", lambda f: f["severity"] == s), _finding_markdown), "\n\n"),
            ),
        )
        for s in reversed(D.SEVERITIES)
    ]
    body = F.when(F.size("findings") > 0, F.concat_ws("\n\n", *sections)).otherwise("## Findings\n\nNothing found.")
    footer = F.format_string("---\nGenerated %s, report format %d, detectors: %s.", "generated_at", "schema_version", F.array_join("detectors", ", "))
    by_category = F.when(F.size(categories) > 0, F.concat(
        F.lit("## Reclaimable by category\n\n| Category | Estimated savings |\n|---|---:|\n"), table))
    return report.withColumn(
        "findings", F.coalesce("findings", F.array().cast(report.schema["findings"].dataType))
    ).select("root_id", F.concat_ws("\n\n", header, by_category, body, footer).alias("markdown"))
