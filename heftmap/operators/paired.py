"""Paired benchmark analytics: two methods measured on the same labels.

Ratios are bytes relative to the baseline, so lower is better.  ``a`` is the method that
wins ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heftmap.functions import textures as T
from heftmap.operators.ranks import exact_medians, running_totals

WORTHWHILE_LIFT_PCT = 5.0
BACKUP_COST = 1.0
REAL_HEADROOM = 0.005
GATE_MARGIN = 0.02
GRID_STEPS = 200


def pair_benchmarks(a: DataFrame, b: DataFrame, a_name: str = "bilinear", b_name: str = "learned") -> DataFrame:
    """Rows of ``a`` and ``b`` with the same label; both hold one row per label."""
    left = a.select("label", F.col("ratio").alias("a_ratio"), "hp_energy")
    right = b.select("label", F.col("ratio").alias("b_ratio"))
    return left.join(right, "label").select(
        "label", T.content_class(F.col("label")).alias("content_class"), "a_ratio", "b_ratio", "hp_energy",
        F.lit(a_name).alias("a_name"), F.lit(b_name).alias("b_name"),
    )


def require_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs; an error where the two benchmarks have no label in common.  Runs a job that stops at the first pair."""
    if pairs.isEmpty():
        raise ValueError("the two benchmarks have no label in common")
    return pairs


def oracle_rows(pairs: DataFrame) -> DataFrame:
    """Adds the better ratio and who reached it."""
    winner = F.when(F.col("a_ratio") <= F.col("b_ratio"), F.col("a_name")).otherwise(F.col("b_name"))
    return pairs.withColumns({"oracle_ratio": F.least("a_ratio", "b_ratio"), "winner": winner})


def _summary(rows: DataFrame, by: list[str]) -> DataFrame:
    measures = {f"{n}_median": F.col(f"{n}_ratio") for n in ("a", "b", "oracle")}
    medians = exact_medians(rows, measures, by)
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("winner") == F.col("a_name")).alias("a_wins"),
        F.count_if(F.col("winner") == F.col("b_name")).alias("b_wins"),
    )
    return counts.join(medians, by) if by else _beside(counts, medians)


def _beside(one_row: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of a second one-row result as scalar subqueries."""
    return one_row.select("*", *[other.select(c).scalar().alias(c) for c in other.columns])


def oracle_summary(rows: DataFrame) -> DataFrame:
    return _summary(rows, [])


def oracle_by_class(rows: DataFrame) -> DataFrame:
    return _summary(rows, ["content_class"])


def oracle_lift(summary: DataFrame) -> DataFrame:
    """How much the per-label best improves on the better of the two fixed choices."""
    best = F.least("a_median", "b_median")
    lifted = summary.select("n", best.alias("best_forced_median"), "oracle_median").withColumn(
        "lift_abs", F.col("best_forced_median") - F.col("oracle_median")
    )
    pct = F.when(F.col("best_forced_median") != 0, F.col("lift_abs") / F.col("best_forced_median") * 100)
    return lifted.withColumn("lift_pct", pct).withColumn(
        "worthwhile", F.coalesce(F.col("lift_pct") > WORTHWHILE_LIFT_PCT, F.lit(False))
    )


def feature_range_by_winner(rows: DataFrame) -> DataFrame:
    medians = exact_medians(rows, {"feature_median": F.col("hp_energy")}, ["winner"])
    spans = rows.groupBy("winner").agg(
        F.count(F.lit(1)).alias("n"), F.min("hp_energy").alias("feature_min"), F.max("hp_energy").alias("feature_max")
    )
    return spans.join(medians, "winner")


def best_threshold(rows: DataFrame, feature: str, positive: Column, one_slice_rows: int | None = None) -> DataFrame:
    """Best single cut ``feature >= t`` for telling positives apart.

    Candidates lie midway between neighbouring values.  Below value x everything is
    called negative, so the number of right calls at the cut after x is the negatives
    up to x plus the positives beyond it - one running total instead of one pass per
    candidate.  The lowest of equally good cuts wins.  No row when only one class occurs.
    """
    counted = (
        rows.where(F.col(feature).isNotNull()).select(F.col(feature).cast("double").alias("x"), positive.alias("p"))
        .groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("pos"))
    )
    options = {} if one_slice_rows is None else {"one_slice_rows": one_slice_rows}
    totals = running_totals(counted, "x", ["n", "pos"], **options)
    negatives_below = F.col("n_through") - F.col("pos_through")
    positives_above = F.col("pos_total") - F.col("pos_through")
    scored = totals.where(
        (F.col("n_through") < F.col("n_total")) & (F.col("pos_total") > 0) & (F.col("pos_total") < F.col("n_total"))
    ).withColumn("correct", negatives_below + positives_above)
    best = scored.orderBy(F.desc("correct"), "x").limit(1)
    following = totals.where(F.col("x") > best.select("x").scalar()).agg(F.min("x").alias("next_x"))
    total = F.col("n_total")
    return best.select(
        ((F.col("x") + following.scalar()) / 2).alias("threshold"),
        (F.col("correct") / total).alias("accuracy"),
        (F.greatest(F.col("pos_total"), total - F.col("pos_total")) / total).alias("majority"),
    )


def router_gate(costs: DataFrame, cost: str = "ratio") -> DataFrame:
    """Mean cost of always re-coding against a perfect choice between re-coding and backup."""
    value = F.col(cost)
    means = costs.agg(
        F.count_if(value < BACKUP_COST).alias("codec_wins"),
        F.count_if(value >= BACKUP_COST).alias("backup_wins"),
        F.avg(value).alias("always_codec"),
        F.avg(F.least(value, F.lit(BACKUP_COST))).alias("perfect"),
    )
    return means.withColumns({
        "headroom": F.col("always_codec") - F.col("perfect"),
        "value_vs_backup": F.lit(BACKUP_COST) - F.col("perfect"),
    }).withColumn("headroom_is_real", F.col("headroom") > REAL_HEADROOM)


def grid_counts(rows: DataFrame, feature: str, positive: Column, steps: int = GRID_STEPS) -> DataFrame:
    """Right calls at every one of ``steps + 1`` evenly spaced thresholds.

    Each row is counted once in the grid cell of the last threshold it reaches; the
    calls at a threshold follow from sums over at most ``steps + 1`` cells.
    """
    values = rows.where(F.col(feature).isNotNull()).select(
        F.col(feature).cast("double").alias("x"), positive.alias("p")
    )
    span = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    placed = values.select("x", "p", lo.alias("lo"), hi.alias("hi"))

    def threshold(i: Column) -> Column:
        return F.col("lo") + (F.col("hi") - F.col("lo")) * (i / F.lit(float(steps)))

    guess = F.when(
        F.col("hi") > F.col("lo"),
        F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(steps))),
    ).otherwise(F.lit(steps))
    near = [F.greatest(F.lit(0), F.least(F.lit(steps), F.col("guess") + d)).cast("int") for d in (1, 0, -1)]
    cell = F.when(threshold(near[0]) <= F.col("x"), near[0]).when(threshold(near[1]) <= F.col("x"), near[1]).otherwise(near[2])
    cells = (
        placed.withColumn("guess", guess).groupBy(cell.alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("p").alias("pos"))
    )
    # From here on at most steps + 1 rows.
    folded = cells.agg(
        F.map_from_entries(F.collect_list(F.struct("step", F.struct("n", "pos")))).alias("by_step"),
        F.sum("n").alias("total"), F.sum("pos").alias("pos_total"),
    )
    empty = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"))
    at = lambda i: F.coalesce(F.try_element_at(F.col("by_step"), i), empty)
    from_here = lambda i: F.sequence(i, F.lit(steps))
    pos_at_or_above = lambda i: F.aggregate(from_here(i), F.lit(0).cast("bigint"), lambda acc, j: acc + at(j)["pos"])
    n_at_or_above = lambda i: F.aggregate(from_here(i), F.lit(0).cast("bigint"), lambda acc, j: acc + at(j)["n"])
    graded = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step")).select(
        "step", "total", "pos_total", pos_at_or_above(F.col("step")).alias("pos_above"),
        n_at_or_above(F.col("step")).alias("n_above"), lo.alias("lo"), hi.alias("hi"),
    )
    negatives_below = (F.col("total") - F.col("n_above")) - (F.col("pos_total") - F.col("pos_above"))
    return graded.select(
        "step", threshold(F.col("step")).alias("threshold"),
        (F.col("pos_above") + negatives_below).alias("correct"), "total", "pos_total",
    )


def grid_threshold(rows: DataFrame, feature: str, positive: Column, steps: int = GRID_STEPS) -> DataFrame:
    """First best grid threshold and whether it clearly beats always guessing the majority."""
    best = grid_counts(rows, feature, positive, steps).orderBy(F.desc("correct"), "step").limit(1)
    total = F.col("total")
    majority = F.greatest(F.col("pos_total"), total - F.col("pos_total")) / total
    scored = best.select(
        F.when(F.col("correct") > 0, F.col("threshold")).otherwise(F.lit(0.0)).alias("threshold"),
        (F.col("correct") / total).alias("accuracy"), majority.alias("majority"), "pos_total",
    )
    verdict = (
        F.when(F.col("pos_total") == 0, "no_decision")
        .when(F.col("accuracy") > F.col("majority") + GATE_MARGIN, "pass").otherwise("fail")
    )
    return scored.withColumn("verdict", verdict).drop("pos_total")


def mean_cost_by_class(costs: DataFrame, cost: str = "ratio") -> DataFrame:
    return costs.groupBy(T.label_suffix(F.col("label")).alias("label_class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(cost).alias("mean_cost")
    )


def _accounting() -> list[Column]:
    top, residual = F.col("top_bytes"), F.col("residual_bytes")
    sidecar = residual / F.greatest(top, F.lit(1))
    return [
        F.count(F.lit(1)).alias("n"), F.sum(top).alias("top_bytes"), F.sum(residual).alias("residual_bytes"),
        (F.sum(top) - F.sum(residual)).alias("net_bytes"), F.count_if(residual < top).alias("wins"),
        F.avg(sidecar).alias("mean_sidecar"), F.count_if("byte_exact").alias("byte_exact"),
    ]


def residual_accounting(runs: DataFrame) -> DataFrame:
    """Disk freed by dropping top levels against the cost of the residuals kept for them."""
    return runs.agg(*_accounting())


def residual_accounting_by_class(runs: DataFrame) -> DataFrame:
    return runs.groupBy(T.label_suffix(F.col("label")).alias("label_class")).agg(*_accounting())


def best_lossless(runs: DataFrame) -> DataFrame:
    """Smallest ratio among byte-exact runs at step 1; 0 without any."""
    exact = (F.col("quant_step") == 1) & F.col("byte_exact")
    return runs.agg(
        F.coalesce(F.min(F.when(exact, F.col("ratio"))), F.lit(0.0)).alias("best_ratio"),
        F.count_if(exact).alias("lossless_runs"), F.count(F.lit(1)).alias("total_runs"),
    )


def sorted_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("sample", "predictor", "quant_step")


def lossless_rate(runs: DataFrame) -> DataFrame:
    """Byte-exact share of the runs at step 1."""
    return runs.where(F.col("quant_step") == 1).agg(
        F.count_if("byte_exact").alias("passed"), F.count(F.lit(1)).alias("total")
    ).withColumn("rate", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(F.lit(0.0)))
