import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heftmap.llm import bpe, tokenfile, tokens
from heftmap.llm.queries import tokenizer_path
from heftmap.operators.staging import fresh_path

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", "▁", "<s>", "</s>", "<|endoftext|>", "don't", "x1", "ж", "😀", ".", "\xa0", "\x1c", "½", "²", "_", "中文", "the", "'ll"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(10))) for _ in range(n)]


def test_counts_are_the_librarys():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    misses = tokens.Lengths(model)
    for text in random_texts(3000):
        assert tokens.text_tokens(text, {"the": len(model.encode("the"))}, misses) == len(model.encode(text)), repr(text)


def test_count_tokens(spark, make):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*random_texts(50, 2), None, "", "word " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "no id")]
    out = sorted(map(tuple, tokens.count_tokens(make(rows), PIECES).collect()), key=str)
    want = [(i, len((t or "").encode()), n, n > 4096) for i, t in rows for n in [len(model.encode(t or ""))]]
    assert out == sorted(want, key=str)
    assert tokens.count_tokens(make([]), PIECES).count() == 0
    clash = spark.createDataFrame([(1, "a b", 5)], "doc_id int, text string, n_tokens int")
    assert tokens.count_tokens(clash, PIECES).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_ids_are_the_librarys():
    library, known = Tokenizer.from_file(BYTES), bpe.vocabulary(BYTES)
    for text in random_texts(3000, 3):
        assert known.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 2, 3, 60, 3000])
def test_codes(n):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.4, n) * 5).astype(np.int64) % 10**12
    counts[0] = 1
    bits = tokenfile.code_bits(counts, 12)
    used = bits[bits > 0].astype(float)
    assert (bits > 0).tolist() == (counts > 0).tolist() and used.max() <= 12
    if len(used) > 1:
        assert (0.5 ** used).sum() == 1
    code = tokenfile.Code(bits)
    for size in (1, 127, 128, 129, 4000):
        ids = rng.choice(np.flatnonzero(counts), size)
        payload, checkpoints = code.pack(ids)
        assert (code.unpack(payload, checkpoints, size) == ids).all()


def test_code_is_optimal_under_its_limit():
    def best(weights, limit):  # every multiset of lengths with Kraft sum 1, by recursion over the internal nodes of a level
        from itertools import product
        return min(sum(w * b for w, b in zip(sorted(weights, reverse=True), sorted(lengths)))
                   for lengths in product(range(1, limit + 1), repeat=len(weights)) if sum(2.0 ** -b for b in lengths) == 1)

    for weights in ([1, 1, 2, 3, 50], [1, 2, 4, 8, 16, 32], [5, 5, 5, 5, 5]):
        bits = tokenfile.code_bits(np.array(weights), 4)
        assert int((bits * np.array(weights)).sum()) == best(weights, 4)


def round_trip(spark, frame):
    path = fresh_path(spark, "ids")
    tokenfile.write_ids(frame, path, BYTES)
    return [(r.doc_id, r.start, bytes(r.ids)) for r in tokenfile.read_ids(spark, path).collect()]


def test_files(spark, make):
    library = Tokenizer.from_file(BYTES)
    texts = [*random_texts(80, 5), None, "", "long text " * 40_000]
    rows = [(7 * i % 83 - 20, t) for i, t in enumerate(texts)]
    found = sorted(round_trip(spark, make(rows).repartition(5)))
    start, want = 0, []
    for i, text in sorted(rows):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(i, s, zlib.crc32(b)) for i, s, b in found] == want


def test_files_with_ties_and_nothing(spark, make):
    found = round_trip(spark, make([(1, "b"), (1, "b"), (1, "a c"), (None, "x")]))
    assert sorted(s for _, s, _ in found) == np.cumsum([0, *[len(b) // 4 for _, s, b in sorted(found, key=lambda r: r[1])]])[:-1].tolist()
    assert min(found, key=lambda r: r[1])[0] is None
    assert round_trip(spark, make([])) == []
