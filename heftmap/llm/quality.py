"""Quality rules with adaptive thresholds per language and source.

Rates of every document that passes the base rules go into histograms whose bins keep seven leading bits (a
relative error below 1/64): quantile sketches that merge by adding counts, to languages and to the whole
corpus.  A group's fences lie ``REACH`` interquartile ranges, or as many least spreads, outside its
quartiles; groups with fewer than ``MIN_GROUP`` documents use their language's sketch, and languages with fewer use
all.  Documents are then joined with their group's fences.  Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heftmap.llm.common import SPACE, SPACE_CLASS
from heftmap.operators.staging import stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
MIN_GROUP = 50
REACH = 3
#: Rate, its least spread, and whether values below the lower fence fail as well.
RATES = (("word_length", 100, True), ("symbols", 50, False), ("dup_lines", 170, False))


def with_measures(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word).

    Each step is a projection of its own, as lambdas must refer to columns that have been computed.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.withColumn("_text", content).withColumn("_words", F.array_remove(F.split("_text", SPACE_CLASS + "+"), ""))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    step = step.withColumns({"_lines": lines, "_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "n_words": F.size("_words").cast("bigint")})
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.size("_hashes") - WINDOW)).otherwise(F.array().cast("array<int>"))
    step = step.withColumns({
        "word_chars": F.length(F.regexp_replace("_text", SPACE_CLASS + "+", "")).cast("bigint"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_windows": F.transform(starts, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW)))),
    })
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    sorted_windows = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_sorted", F.when(repeats, sorted_windows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter("_sorted", lambda x, k: x.h.eqNullSafe(F.get("_sorted", k - 1).h) | x.h.eqNullSafe(F.get("_sorted", k + 1).h))
    step = step.withColumn("_starts", F.array_sort(F.transform(again, lambda x: x.i)))
    reach = F.transform("_starts", lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - at, F.lit(WINDOW))))
    step = step.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0), lambda total, x: total + x).cast("bigint"))
    return step.drop("_text", "_words", "_lines", "_hashes", "_windows", "_sorted", "_starts")


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Whole numbers: characters per 100 words, symbols per 1000 words, repeated lines per 1000."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {"word_length": F.floor(100 * F.col("word_chars") / words).cast("bigint"),
            "symbols": F.floor(1000 * F.col("n_symbols") / words).cast("bigint"),
            "dup_lines": F.floor(1000 * F.col("n_dup_lines") / lines).cast("bigint")}


def _bin(value: Column) -> Column:
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def fences(measured: DataFrame, lang: str, source: str, min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """(language, source, <rate>_low, <rate>_high): one row per group of ``measured``, which has the rates."""
    long = measured.select(F.col(lang).alias("l"), F.col(source).alias("s"), F.col("failed"), F.explode(F.array(*(
        F.struct(F.lit(name).alias("rate"), F.col(name).alias("value")) for name, _, _ in RATES))).alias("r"))
    sketch = long.groupBy("l", "s", "r.rate", _bin(F.col("r.value")).alias("bin")).agg(F.count_if(~F.col("failed")).alias("n"))
    sketch = stage(sketch, "sketches")
    null = F.lit(None).cast("string")
    levels = (sketch.select(F.lit(0).alias("level"), "l", "s", "rate", "bin", "n")
              .unionAll(sketch.groupBy("l", "rate", "bin").agg(F.sum("n").alias("n")).select(F.lit(1), "l", null, "rate", "bin", "n"))
              .unionAll(sketch.groupBy("rate", "bin").agg(F.sum("n").alias("n")).select(F.lit(2), null, null, "rate", "bin", "n")))
    group = ["level", "l", "s", "rate"]
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))
    of = F.sum("n").over(Window.partitionBy(*group))
    quartiles = levels.where("n > 0").withColumns({"upto": upto, "of": of}).groupBy(*group).agg(
        F.max("of").alias("docs"), F.min(F.when(4 * F.col("upto") >= F.col("of"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("of"), F.col("bin"))).alias("q3"))
    wide = quartiles.groupBy("level", "l", "s").agg(F.max("docs").alias("docs"), *(
        F.max(F.when(F.col("rate") == name, fence)).alias(f"{name}_{end}")
        for name, least, _ in RATES
        for end, fence in (("low", F.col("q1") - reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))),
                           ("high", F.col("q3") + reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))))))
    names = [f"{name}_{end}" for name, _, _ in RATES for end in ("low", "high")]
    own, by_lang, overall = (wide.where(F.col("level") == k).select(
        F.col("l").alias(f"l{k}"), F.col("s").alias(f"s{k}"), F.col("docs").alias(f"docs{k}"),
        *(F.col(c).alias(f"{c}{k}") for c in names)) for k in range(3))
    groups = sketch.select("l", "s").distinct()
    joined = (groups.join(own, F.col("l").eqNullSafe(F.col("l0")) & F.col("s").eqNullSafe(F.col("s0")), "left")
              .join(by_lang, F.col("l").eqNullSafe(F.col("l1")), "left")
              .withColumn("one", F.lit(2)).join(overall.withColumn("two", F.lit(2)), F.col("one") == F.col("two"), "left"))
    return joined.select("l", "s", *(
        F.when(F.col("docs0") >= min_group, F.col(f"{c}0")).when(F.col("docs1") >= min_group, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c)
        for c in names))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                  min_group: int = MIN_GROUP, reach: int = REACH) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Null texts count as empty and fail the base rules.  Null languages and sources are groups of their own.  Repeated
    rows keep a row each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_content"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    measured = with_measures(rows, "_content").withColumn("failed", base_failed()).withColumns(rates()).drop("_content")
    measured = stage(measured, "measures")
    limits = fences(measured, "_lang", "_source", min_group, reach)
    inside = F.lit(True)
    for name, _, both in RATES:
        inside = inside & (F.col(name) <= F.col(f"{name}_high"))
        inside = inside & (F.col(name) >= F.col(f"{name}_low")) if both else inside
    joined = measured.join(limits, F.col("_lang").eqNullSafe(F.col("l")) & F.col("_source").eqNullSafe(F.col("s")), "left")
    return joined.select(
        F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("failed").alias("base_failed"), (~F.col("failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
