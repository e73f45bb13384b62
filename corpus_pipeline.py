"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. ``language_id`` drops documents of no learned language: those without a letter, and those on which the best language's
   model spends ``MAX_BITS`` per byte, half as much again as the bytes themselves.  Texts in a script that was not learned
   take about 20; numbers and junk among learned words take less than 10.
2. ``near_duplicates`` keeps one document of every group of near copies - shingles of five words, Jaccard similarity 0.8 or more,
   compared exactly: the one with the smallest id.
3. ``decontaminate`` drops documents that hold an item of ``benchmark``.
4. ``mix_sources`` takes every source's words by its target weight: a row for every pass over a document, with the words taken in it.
5. ``token_ids`` encodes the mix, writes the Huffman-coded files and returns each document's place in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftmap.llm import decontaminate as leaks
from heftmap.llm import langid, mixing, neardocs, tokenfile
from heftmap.llm.common import table
from heftmap.llm.queries import tokenizer_path
from heftmap.operators.staging import fresh_path, stage

#: SQL cannot score context trees, take XXH64 or tokenize; tests hold the stages against brute force.
ORACLE_SQL = None
MAX_BITS = 12.0


def with_row_id(docs: DataFrame) -> DataFrame:
    """Adds ``_row_id``: rows without an id, and rows that share one, are told apart by all their columns; identical rows are one."""
    return docs.withColumn("_row_id", F.struct(
        F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("row")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    # Other columns travel in a struct, so that their names cannot meet the operator's.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(True).alias("_"), *others).alias("_others"))
    found = langid.identify(rows, model, carry=("text", "_others"))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") < MAX_BITS))
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_others.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical rows one stays as well; rows with an id come before those without."""
    rows = with_row_id(docs)
    groups = neardocs.near_copies(rows.select("_row_id", "text"), "_row_id")
    chosen = groups.where(F.col("_row_id") == F.col("component_id")).select("_row_id")
    return rows.join(chosen, "_row_id", "left_semi").dropDuplicates(["_row_id"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_row_id(docs)
    found = leaks.find_leaks(rows.select("_row_id", "text"), table(spark, sf_dir, "benchmark"), "_row_id")
    return rows.join(found, "_row_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the mix, read back from the files."""
    path = fresh_path(spark, "ids")
    tokenfile.write_ids(docs, path, tokenizer_path("byte_bpe_50k.json"))
    back = tokenfile.read_ids(spark, path)
    return back.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
