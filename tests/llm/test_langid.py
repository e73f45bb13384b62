import math

import numpy as np

from heftmap.llm import langid as L


def reference_bits(texts, text, order):
    """Code length by walking the contexts of every byte."""
    counts = {}
    for t in texts:
        data = b"\n" * order + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k:i], {}).setdefault(data[i], 0)
                counts[data[i - k:i]][data[i]] += 1
    bits, data = 0.0, b"\n" * order + text
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k:i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


TRAIN = {"x": [b"abracadabra abra", b"cad abra"], "y": ["ñandú vuela".encode(), b"el tren vuela", b""]}


def test_code_lengths():
    model = L.train(TRAIN, 3)
    texts = [b"abra", "ñandú".encode(), b"zzz", b"", bytes(range(256)), b"vuela abra " * 50]
    got = L.batch_lengths(model, texts)
    for i, text in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert math.isclose(got[i, j], reference_bits(TRAIN[lang], text, 3), rel_tol=1e-4, abs_tol=1e-3)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    model, text = L.train(TRAIN, 3), b"abra vuela cad " * 300
    whole = L.batch_lengths(model, [text])
    monkeypatch.setattr(L, "PIECE", 97)
    assert abs(L.batch_lengths(model, [text, b"x", text])[[0, 2]] - whole).max() < 0.1


def documents():
    english, german = "the cat sat on the mat with the other cat and that was that", "der hund und die katze sind nicht in der kueche oder im garten"
    rows = [(i, f"{(english, german)[i % 2]} {i}", ("en", "de")[i % 2]) for i in range(60)]
    return rows + [(100, None, "en"), (101, "", "de"), (102, "12345 !!", "en"), (103, "the cat", None), (None, "die katze", "de"), (1, rows[1][1], "de")]


def test_identify(spark, make):
    docs = make(documents())
    out = L.identify(docs, L.fit(docs)).collect()
    assert len(out) == docs.count()
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[i].lang_pred == ("en", "de")[i % 2] and by_id[i].score > 0.99 for i in range(60))
    assert [by_id[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn_from(spark, make):
    docs = make([(1, "some words", None), (2, None, "en")])
    assert {r.lang_pred for r in L.identify(docs, L.fit(docs)).collect()} == {"und"}
    empty = make([])
    assert L.identify(empty, L.fit(empty)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = L.identify(docs, L.fit(docs), carry=("lang",)).where(L.held_out("doc_id")).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_a_language_of_one_long_text_is_learned(spark, make):
    """One 3 MB text, copies of one text, empty texts only; and scripts that nobody taught."""
    long = " ".join(f"der hund {i} und die katze sind nicht in der kueche oder im garten" for i in range(42_000))
    rows = [(0, long, "de"), *((i, "the cat sat on the mat with the other cat", "en") for i in range(2, 12)), *((i, "", "xx") for i in range(20, 26))]
    model = L.fit(make([(i + 1000, t, lang) for i, t, lang in rows]), train_bytes=1000)
    assert model.langs == ["de", "en"] and all(g.any() for g in model.escapes)
    asked = make([(1, "die katze und der hund"), (2, "the other cat"), (3, "текст на другом языке")])
    found = {r.doc_id: r for r in L.identify(asked, model).collect()}
    assert found[1].lang_pred == "de" and found[2].lang_pred == "en" and found[3].bits_per_byte > 8


def test_model_is_sent_without_its_tables():
    import pickle

    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 200_000).astype(np.uint64))
    index = L.Index(keys)
    sent = pickle.dumps(index)
    assert len(sent) < 9 * len(keys) and index.keys.nbytes + index.at.nbytes < 60 * len(keys)
    for table in (index, pickle.loads(sent)):
        assert (table.find(keys[::-1]) == np.arange(len(keys))[::-1]).all()
        assert (table.find(keys + np.uint64(1 << 41)) == -1).all()
    assert (L.Index(np.zeros(0, np.uint64)).find(keys[:5]) == -1).all()


def test_batches_are_as_long_as_scoring_needs(spark, make):
    docs = make([(i, "some words of a text " * 50, "en", "a") for i in range(50)])
    found = L.identify(docs, L.fit(docs))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == L.BATCH <= 1 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512 and found.count() == 50
