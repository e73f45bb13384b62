import random

import numpy as np
import xxhash

from heftmap.llm import simhash as S


def reference_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_components(prints):
    """prints: {id: fingerprint}; smallest id reachable over links of at most 3 bits."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


TEXTS = ["", None, "  \n", "one", "ONE", "one two", "a b c", "a b c d", "a\x0bb\tc D", "Éa  b c", "x " * 5000, "a b c a b c a b c"]


def test_fingerprints():
    assert [S.fingerprint(t) for t in TEXTS] == [reference_print(t) for t in TEXTS]


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def values(seed, n):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for v in out[: n // 4]:
        for _ in range(rng.randrange(4)):
            v = near(rng, v, rng.randrange(1, 5))
            out.append(v)
    dense = rng.getrandbits(64)
    return sorted({*out, *(near(rng, dense, rng.randrange(0, 4)) for _ in range(n // 3)), 0, 2**64 - 1, 2**63})


def components_of(spark, found, leaf):
    signed = [(int(np.uint64(v).view(np.int64)),) for v in found]
    edges = S.links(spark.createDataFrame(signed, "print bigint"), leaf=leaf)
    root = dict(S.components(edges).collect())
    groups = {}
    for (v,), i in zip(signed, range(len(signed))):
        groups.setdefault(root.get(v, v), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_trie_join_against_all_pairs(spark):
    for seed, leaf in ((1, S.LEAF), (2, 40), (3, 6)):
        found = values(seed, 160)
        assert components_of(spark, found, leaf) == reference_components(dict(enumerate(found)))


def test_documents(spark, make):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "a b c"), (None, "nobody else says this")]
    out = S.near_duplicates(make(rows)).collect()
    assert len(out) == len(rows)
    prints = {i: reference_print(t) for i, t in enumerate(TEXTS)}
    want = reference_components(prints)
    for doc_id, fingerprint, component in out:
        if doc_id is not None:
            assert (fingerprint, component) == (f"{prints[doc_id]:016x}", want[doc_id])
    assert sorted((r.component_id for r in out if r.doc_id is None), key=str) == [want[6], None]


def test_long_chain_and_empty(spark, make):
    chain = [sum(1 << b for b in range(3 * k)) for k in range(22)]
    assert set(components_of(spark, sorted(chain), S.LEAF).values()) == {0}
    assert S.near_duplicates(make([])).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 7)], "doc_id bigint, text string, fingerprint string, print int")
    assert S.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]


def test_few_edges_take_few_jobs(spark):
    """A driver that plans a hundred small queries for a chain of 300 links keeps their plans, threads and code in memory."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(-i, -rng.randrange(1, i)) for i in range(2, 60)] + [(2**63 - 1, -2**63), (2**63 - 1, 2**62)]
    made = spark.createDataFrame(edges, "a bigint, b bigint")
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        found = dict(S.components(made).collect())
    finally:
        spark.sparkContext.setJobGroup("others", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 10
    assert found == dict(S.components(made, few=0).collect())
    assert found[300] == 0 and found[2**62] == -2**63 and found[-1] == -59
