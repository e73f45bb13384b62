"""The queries of this package over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftmap.llm import bpe, decontaminate, divergence, htmltext, langid, linededup, mixing, periods, quality, sharding, simhash, tokenfile, tokens
from heftmap.llm.common import table
from heftmap.operators.staging import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.stays AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


ORACLES["op9_quality_rules"] = r"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM parts)
), repeats AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT doc_id, i + k AS at
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows), range(8) AS r(k) WHERE n > 1)
  GROUP BY doc_id
), base AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM parts LEFT JOIN repeats USING (doc_id)
), measured AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed, 100 * word_chars // greatest(n_words, 1) AS word_length,
         1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines
  FROM base
), long AS (
  SELECT lang, source, failed, r.rate, r.least, r.value
  FROM (SELECT lang, source, failed, unnest([
    {rate: 'word_length', least: 100, value: word_length}, {rate: 'symbols', least: 50, value: symbols}, {rate: 'dup_lines', least: 170, value: dup_lines}]) AS r
    FROM measured)
), sketch AS (
  SELECT lang, source, rate, least, (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0) AS bin, count(*) AS n
  FROM long WHERE NOT failed GROUP BY ALL
), levels AS (
  SELECT 0 AS level, lang, source, rate, least, bin, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, rate, least, bin, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rate, least, bin, sum(n) FROM sketch GROUP BY ALL
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS docs FROM levels
), quartiles AS (
  SELECT level, lang, source, rate, least, docs, min(bin) FILTER (WHERE 4 * upto >= docs) AS q1, min(bin) FILTER (WHERE 4 * upto >= 3 * docs) AS q3
  FROM running GROUP BY ALL
), fences AS (
  SELECT level, lang, source, rate, docs, q1 - 3 * greatest(q3 - q1, least) AS low, q3 + 3 * greatest(q3 - q1, least) AS high FROM quartiles
), chosen AS (
  SELECT g.lang, g.source, g.rate, CASE WHEN a.docs >= 50 THEN a.low WHEN b.docs >= 50 THEN b.low ELSE c.low END AS low,
         CASE WHEN a.docs >= 50 THEN a.high WHEN b.docs >= 50 THEN b.high ELSE c.high END AS high
  FROM (SELECT DISTINCT lang, source, rate FROM long) g
  LEFT JOIN fences a ON a.level = 0 AND a.rate = g.rate AND a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source
  LEFT JOIN fences b ON b.level = 1 AND b.rate = g.rate AND b.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN fences c ON c.level = 2 AND c.rate = g.rate
), limits AS (
  SELECT lang, source, max(low) FILTER (WHERE rate = 'word_length') AS length_low, max(high) FILTER (WHERE rate = 'word_length') AS length_high,
         max(high) FILTER (WHERE rate = 'symbols') AS symbols_high, max(high) FILTER (WHERE rate = 'dup_lines') AS dup_high
  FROM chosen GROUP BY ALL
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND coalesce(word_length BETWEEN length_low AND length_high AND symbols <= symbols_high AND dup_lines <= dup_high, FALSE) AS kept
FROM measured m LEFT JOIN limits l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source
"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    tokenfile.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    back = tokenfile.read_ids(spark, path)
    return back.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = htmltext.extract_text(pages, htmltext.fit(pages))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), cells AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS in_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT d.lang, d.source, d.term, d.n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (d.n + 1)) // (d.total + t.v) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (d.in_lang + 1)) // (t.n + t.v) AS BIGINT) AS q
  FROM dense d JOIN totals t ON d.lang = t.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value,
         CAST(row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS INT) AS rank
  FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM all_pairs
UNION ALL SELECT lang, source, 'term', item, value, rank FROM terms WHERE rank <= 200
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    planted = docs.withColumn("_g", F.call_function("div", h, F.lit(10).cast("bigint"))).withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words"))
    a = F.col("_g") % F.col("_n")
    period = 1 + F.call_function("div", F.col("_n") - a, 3 + F.col("_g") % 8)
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % period)
    again = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", at(i).cast("int")))
    found = periods.find_runs(planted.select("doc_id", F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text")))

    def longer(best, run):
        better = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(better, run).otherwise(best)

    best = F.aggregate("runs", F.get("runs", F.lit(-1)), longer)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"), F.call_function("div", F.col("_best.length") * 1000, F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
