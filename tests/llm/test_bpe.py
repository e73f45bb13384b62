import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from heftmap.llm import bpe
from heftmap.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def encoded(known, texts):
    ids, ends = known.encode(texts)
    return [x.tolist() for x in np.split(ids, ends)[:-1]]


def test_odd_texts_as_the_library(path, library):
    rng = random.Random(7)
    marks = ["<|endoftext|>", "  ", "\n\n", "\r\n", "'s", "'re", "'LL", "’s", "　", "​", "\U0010ffff", "é", "ͅ", "\x1c", "\x85", "\x00"]
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x400), 0x6F22, 0x0E01, 0x1F600, 0xFF13]]
    texts = ["".join(rng.choice(marks if rng.random() < 0.3 else letters) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["", " ", "'", "''s's", " 's", "a" * 3000, "ab" * 999, "\n" * 50 + "x", "<|endoftext|>" * 3, "x<|endoftext|> <|endoftext|>", "\U0010ffff"]
    known = bpe.vocabulary(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(known, texts) == want
    assert [known.decode(ids) for ids in want] == texts


def test_every_code_point_is_cut_as_the_library_cuts_it(path, library):
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}!{chr(c)} x" for c in points]
    assert encoded(bpe.vocabulary(path), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_any_ids_decode_as_the_library(path, library):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50_300) for _ in range(rng.randrange(12))]
        assert bpe.vocabulary(path).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, make, path):
    docs = make([(1, None), (2, ""), (None, "a b"), (3, "x y"), (3, "x y"), (4, "long word " * 20_000)]).withColumnRenamed("n_chars", "ids")
    got = bpe.encode(docs, path)
    assert got.columns == ["doc_id", "ids"]
    back = {(r.doc_id, len(r.ids), r.text[:9]) for r in bpe.decode(got, path).collect()}
    assert back == {(1, 0, ""), (2, 0, ""), (None, 2, "a b"), (3, 2, "x y"), (4, 40_001, "long word")} and got.count() == 6
    assert bpe.decode(bpe.encode(docs.where("false"), path), path).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [64, None, 10**6])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, path).collect()} == {1: "", 2: "a"}


def test_query(spark, library):
    got = {r.doc_id: r for r in QUERIES["op13_bpe_codec"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[doc.doc_id][1:] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
