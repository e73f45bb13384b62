"""Sharding, mixing and quality rules against their definitions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from heftmap.llm import mixing, quality, sharding


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(120))) for _ in range(n)]


def check_shards(rows, found, shards, tolerance):
    assert Counter(r.doc_id for r in found) == Counter(i for i, *_ in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[k] - mean) <= tolerance * mean for k in range(shards))


def test_sharding(spark, make):
    rows = [(i, t) for i, t in enumerate(texts(2000, 1))] + [(None, "x"), (5, "again"), (5, "again"), (9000, None)]
    rows += [(10_000 + i, "the same hot text in a third of all rows") for i in range(1000)] + [(20_000 + i, "") for i in range(1000)]
    found = sharding.shard_documents(make(rows), shards=8).collect()
    check_shards(rows, found, 8, 0.08)
    text = dict(rows)
    for r in found:
        if r.doc_id != 5 and r.doc_id is not None:
            data = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)


def test_copies_stay_together(spark, make):
    rows = [(i, t) for i, t in enumerate(texts(400, 2) * 3)]
    where = defaultdict(set)
    for r in sharding.shard_documents(make(rows), shards=4).collect():
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_equal_rows_are_dealt_out(spark, make):
    """Most rows are the same throughout, id included."""
    rng = random.Random(3)
    rows = [(None, "the same text " * 3)] * 6000 + [(i, "x" * rng.randrange(1, 90)) for i in range(2000)]
    found = sharding.shard_documents(make(rows).repartition(7), 40).collect()
    assert len(found) == len(rows)
    sizes, slots = Counter(), {}
    for r in found:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) < 1.3 * mean and min(sizes.values()) > 0.7 * mean
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_of_little(spark, make):
    assert sharding.shard_documents(make([])).count() == 0
    one = sharding.shard_documents(make([(1, None)]), carry=("lang",)).collect()
    assert [(r.size, r.slot, r.lang) for r in one] == [(16, 0, None)]


def test_range_lookup(spark):
    rng = random.Random(4)
    bounds = sorted({rng.randrange(-2**63, 2**63) for _ in range(300)} | {-2**63, 2**63 - 1, 0, 1, 2})
    keys = [*bounds, *(b + 1 for b in bounds if b < 2**63 - 1), *(b - 1 for b in bounds if b > -2**63)]
    out = spark.createDataFrame([(k,) for k in keys], "k bigint").withColumn("r", sharding.range_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("k"), bounds))
    assert all(r.r == sum(b <= r.k for b in bounds) for r in out.collect())


def test_targets():
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0, 0]
    assert mixing.targets([100]) == [100]
    got = mixing.targets([10, 1000, 1000])
    assert got[0] == 30 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])


def test_draws_and_permutations():
    quotas = np.array([1000, 0, 17, 333])
    counts = mixing.draws(quotas, 100)
    assert counts.sum(axis=0).tolist() == quotas.tolist() and (counts.sum(axis=1)[:-1] == 100).all()
    for n in (1, 2, 3, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 12345).tolist()) == list(range(n))


def mixed_rows():
    return [(i, t, None, ["a", "b", "c", None][i % 4]) for i, t in enumerate(texts(600, 7))] + [(1000, None, None, "a"), (1001, " \n", None, "b"), (3, "x y z", None, "zz"), (None, "no id here", None, "a")]


def test_mixing(spark, make):
    rows = mixed_rows()
    out = mixing.mix_sizes(make(rows), block=16).collect()
    assert len(out) == len(rows)
    again = mixing.mix_sizes(make(rows), block=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    source = {i: s for i, _, _, s in rows if i != 3}
    words = {i: len((t or "").split()) for i, t, _, _ in rows if i != 3}
    names = sorted({s for *_, s in rows if s}) + [None]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    taken = Counter()
    for r in out:
        assert r.taken <= 3 * r.size
        if r.doc_id != 3:
            assert (r.size, r.source_size) == (words[r.doc_id], sizes[source[r.doc_id]])
            assert r.target == pytest.approx(goals[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    for s in ("b", "c", None):
        assert abs(taken[s] - goals[s]) <= 0.05 * goals[s]


def test_sources_of_any_size_come_near_their_targets(spark, make):
    rng = random.Random(12)
    rows, number = [], 0
    for source in range(150):
        left = int(10 ** rng.uniform(0, 4))
        while left:
            size = min(left, rng.randrange(1, 700))
            rows.append((number, "w " * size, None, f"s{source}"))
            number, left = number + 1, left - size
    found = mixing.mix_sizes(make(rows)).collect()
    source_of = {i: s for i, _, _, s in rows}
    taken, targets = Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        taken[source_of[r.doc_id]] += r.taken
        targets[source_of[r.doc_id]] = r.target
    assert len(targets) == 150
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(1, 0.02 * target), (source, taken[source], target)
    hundred = mixing.mix_sizes(make([(i, "w " * 100, None, f"s{i}") for i in range(3)])).collect()
    assert {r.doc_id: r.taken for r in hundred} == {0: 188, 1: 75, 2: 38}


def test_mixed_texts(spark, make):
    rows = mixed_rows()
    wanted = {(r.doc_id, r.size): r.taken for r in mixing.mix_sizes(make(rows), block=16).collect()}
    got, text = Counter(), {i: t for i, t, *_ in rows if i != 3}
    sizes = {i: len((t or "").split()) for i, t, *_ in rows}
    for r in mixing.mix_documents(make(rows), block=16).collect():
        if r.doc_id != 3:
            got[r.doc_id] += len(r.text.split())
            assert set(r.text.split()) <= set(text[r.doc_id].split()) and r.n_chars == len(r.text)
    assert all(got[i] == n for (i, size), n in wanted.items() if i != 3 and size == sizes[i])
    assert mixing.mix_sizes(make([])).count() == 0 and mixing.mix_documents(make([])).count() == 0


def base(text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, make):
    cases = [None, "", "  \n ", "a b c", "é\xa0x # $", "x " * 9, " ".join("abcdefgh") + " z " + " ".join("abcdefgh"), "same line\nsame line\n\n\nsame line ", "q" * 100_000,
             "a b c d e f g h a b c d e f g h a b c", *texts(30, 9)]
    rows = [(i, t, "en", "s") for i, t in enumerate(cases)] + [(0, None, None, None), (None, "no id", "en", None)]
    out = quality.quality_rules(make(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            n, chars, symbols, dups, repeats = want = base(cases[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and not (r.kept and r.base_failed)
    assert quality.quality_rules(make([])).count() == 0


def test_fences_follow_their_group(spark, make):
    rng = random.Random(5)
    short = [" ".join("abc"[: rng.randrange(2, 4)] + str(k) for k in range(30)) for _ in range(80)]
    long = [" ".join("abcdefghijklm" + str(k) for k in range(30)) for _ in range(80)]
    rows = [(i, t, "x", "s") for i, t in enumerate(short)] + [(100 + i, t, "y", "s") for i, t in enumerate(long)]
    rows += [(300, long[0], "x", "s"), (301, "### $$$ " * 3 + short[0], "x", "s"), (302, short[0], "y", "s"), (303, short[1], "x", "few")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(make(rows)).collect()}
    assert all(kept[i] for i in range(80)) and all(kept[100 + i] for i in range(80))
    assert [kept[i] for i in (300, 301, 302, 303)] == [False, False, False, True]
