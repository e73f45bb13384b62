import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from heftmap.llm import langid, simhash
from heftmap.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_neardocs import components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, function in P.STAGES:
        out.append(P.stage(function(spark, out[-1], SMALL), name))
    return out


def test_language_stage_keeps_clean_documents(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    assert {r.doc_id for r in stages[0].collect()} == kept


def test_other_scripts_go(spark, make):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    strange = [(10**6, "текст на другом языке, которого нет среди выученных"), (10**6 + 1, "Then 4566095658496433 of at +1 (748) 555-8257.")]
    kept = {r.doc_id for r in P.language_id(spark, docs.unionByName(make(strange)), SMALL).collect()}
    assert 10**6 not in kept and 10**6 + 1 in kept and len(kept) == docs.count() + 1


def test_one_of_each_group_stays(stages):
    groups = components({r.doc_id: r.text for r in stages[1].collect()})
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(groups.values()))


def test_leaks_go(spark, stages):
    words = lambda t: " ".join(t.split())
    items = [words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages[2].collect() if any(i in words(r.text) for i in items)}
    assert {r.doc_id for r in stages[2].collect()} - {r.doc_id for r in stages[3].collect()} == held and held


def test_tokens_of_the_mix(stages):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, zlib.crc32(np.array(library.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in stages[4].collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in stages[5].collect()) == want
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_odd_documents(spark, make):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, "en", "b"), (None, text, "en", None), (None, "other words that nobody else has in this small table", None, None), (3, None, None, "a"),
            (4, "", "en", "a"), (5, "123 456", "en", "a")]
    docs = make(rows).withColumn("score", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(7))
    kept = P.language_id(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.count() == 5
    kept = P.near_duplicates(spark, kept, SMALL)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, None]
    mixed = P.mix_sources(spark, P.decontaminate(spark, kept, SMALL), SMALL)
    assert mixed.columns == docs.columns
    empty = make([])
    for name, function in P.STAGES:
        assert function(spark, empty, SMALL).count() == 0, name


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert langid.ORDER == 4 and simhash.SHINGLE == 3 and len(P.STAGES) == 5
