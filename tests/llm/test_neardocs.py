import random

import numpy as np

import corpus_pipeline as P
from heftmap.llm import neardocs, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def components(texts):
    """texts: {id: text}; smallest id reachable over pairs of Jaccard similarity 0.8 or more, from all pairs."""
    sets, parent = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def corpus(seed):
    """Unrelated texts, copies with 1 to 4 changed words, chains of copies of copies, and a passage that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = [[word() for _ in range(rng.randrange(30, 220))] for _ in range(40)]
    texts += [passage + [word() for _ in range(rng.randrange(5, 60))] for _ in range(60)]
    for _ in range(160):
        copy = list(rng.choice(texts))
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    texts += [["one"], ["ONE"], ["one", "two"], []]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_stage_against_all_pairs(spark, make):
    for seed in (1, 2):
        texts = corpus(seed)
        want = components(texts)
        assert len(set(want.values())) < 0.9 * len(texts)
        kept = P.near_duplicates(spark, make(list(texts.items())), "")
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_texts_around_one_passage_make_few_pairs(spark, make, monkeypatch):
    """No two of these are similar; each shares 56 shingles with all others."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = [(i, " ".join(passage + [word() for _ in range(8 + i % 40)])) for i in range(1200)]
    made = []
    whole = neardocs._overlapping
    monkeypatch.setattr(neardocs, "_overlapping", lambda pairs, distinct: made.append(pairs.count()) or whole(pairs, distinct))
    got = neardocs.near_copies(make(texts), "doc_id").collect()
    want = components({i: t for i, t in texts if i < 120})
    assert {r.doc_id: r.component_id for r in got if r.doc_id < 120} == {i: w for i, w in want.items()}
    assert 0 < sum(made) < 10 * len(texts)


def test_bounds_refuse_no_similar_pair():
    rng = random.Random(9)
    refused = 0
    for _ in range(400):
        n = rng.choice([1, 5, 40, 900])
        a = {rng.randrange(1 << 64) for _ in range(n)}
        b = {x for x in a if rng.random() < rng.choice([0.5, 0.85, 0.95, 1])} | {rng.randrange(1 << 64) for _ in range(rng.randrange(1 + n // 4))} or {1}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        may = neardocs._may_overlap(neardocs._bins(x), neardocs._bins(y), len(x) + len(y))
        assert may or not neardocs.similar(x, y)
        refused += not may
    assert refused > 50 and neardocs._may_overlap(None, b"", 10)
    assert neardocs._bins(np.arange(300, dtype=np.uint64)) is None


def test_tries_of_fingerprints_come_first(spark, make, monkeypatch):
    """Long copies with one changed word differ in few bits: the tries find most pairs, the prefixes the rest, and every pair is compared."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(300)]
    texts = {i: list(passage) for i in range(60)}
    for t in texts.values():
        t[rng.randrange(300)] = word()
    texts |= {100 + i: [word() for _ in range(40)] for i in range(20)}
    texts |= {200 + i: [*t, word()] for i, t in enumerate(list(texts.values())[60:])}  # similar, but far apart in bits
    texts = {i: " ".join(t) for i, t in texts.items()}
    tried, made = [], []
    by_prints, whole = neardocs._by_prints, neardocs._overlapping
    monkeypatch.setattr(neardocs, "_by_prints", lambda distinct: tried.append(by_prints(distinct)) or tried[0])
    monkeypatch.setattr(neardocs, "_overlapping", lambda pairs, distinct: made.append(pairs.count()) or whole(pairs, distinct))
    got = {r.doc_id: r.component_id for r in neardocs.near_copies(make(list(texts.items())), "doc_id").collect()}
    assert got == components(texts)
    pairs = tried[0].collect()
    assert len(pairs) == made[0] >= 30 and sum(made) < 300
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert any((prints[100 + i] ^ prints[200 + i]).bit_count() > 3 for i in range(20))


def test_few_documents_take_few_jobs(spark, make):
    """Plans, threads and code of every query stay in the driver for a while."""
    docs = make(list(corpus(1).items()))
    spark.sparkContext.setJobGroup("near copies", "")
    try:
        P.near_duplicates(spark, docs, "").collect()
    finally:
        spark.sparkContext.setJobGroup("others", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near copies")) <= 160


def test_copies_too_far_apart_make_few_pairs(spark, make, monkeypatch):
    """Copies of one text with more and more changed words: some are one component, the others share most shingles with all and are similar to none."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, spare = [word() for _ in range(150)], [word() for _ in range(40)]
    texts = {0: list(base)}
    for i in range(1, 700):
        texts[i] = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 14)):
            texts[i][at] = rng.choice(spare) if rng.random() < 0.1 else word()
    texts = {i: " ".join(t) for i, t in texts.items()}
    want = components(texts)
    alone = sum(v == i for i, v in want.items())
    assert 250 < alone < 600
    made = []
    whole = neardocs._overlapping
    monkeypatch.setattr(neardocs, "_overlapping", lambda pairs, distinct: made.append(pairs.count()) or whole(pairs, distinct))
    got = {r.doc_id: r.component_id for r in neardocs.near_copies(make(list(texts.items())), "doc_id").collect()}
    assert got == want
    assert 0 < sum(made) < 10 * len(texts)


def test_pairs_that_share_only_changed_or_crowded_words(spark, make, monkeypatch):
    """Families of copies around one text, with every limit of a crowded key: a link may be seen under uncrowded keys, crowded ones or both."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = {}
    for _ in range(60):
        family = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 9)):
            family[at] = word()
        for _ in range(rng.randrange(1, 5)):
            text = [*family, *(word() for _ in range(rng.randrange(12)))][rng.randrange(9):]
            for at in rng.sample(range(len(text)), rng.randrange(3)):
                text[at] = word()
            texts[len(texts)] = " ".join(text)
    want = components(texts)
    assert 10 < len(set(want.values())) < 0.9 * len(texts)
    monkeypatch.setattr(neardocs, "FREQUENT", 2)
    for crowded, rounds in ((0, 0), (4, 0), (32, 2), (1 << 20, 0)):
        monkeypatch.setattr(neardocs, "CROWDED", crowded)
        monkeypatch.setattr(neardocs, "ROUNDS", rounds)
        got = {r.doc_id: r.component_id for r in neardocs.near_copies(make(list(texts.items())), "doc_id").collect()}
        assert got == want
