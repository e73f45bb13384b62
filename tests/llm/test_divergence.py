import random
import re
from collections import Counter, defaultdict

import numpy as np

from heftmap.llm import divergence as D


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(docs, top=200):
    """The whole result from its definition, every term for every source."""
    counts, rows, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        counts[lang, source].update(terms)
        rows[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, n in rows[lang].items() if n >= 3), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        over = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((-sum(over(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-over(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", terms[:top])) for i, (v, item) in enumerate(found)}
    return out


def test_pointers_sort_like_terms():
    rng = random.Random(2)
    words = ["".join(rng.choice("aBé") for _ in range(rng.randrange(1, 40))) for _ in range(400)] + ["a" * n for n in range(1, 30)] * 3
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(60)]
    groups = np.array([rng.randrange(4) for _ in texts])
    terms, term, group, n, docs = D.slice_counts([t.encode() for t in texts], groups)
    names = terms.to_pylist()
    assert names == sorted(set(names), key=str.encode)
    want, rows = Counter(), Counter()
    for text, g in zip(texts, groups.tolist()):
        found = Counter(lower(text).split())
        want.update({(t, g): k for t, k in found.items()})
        rows.update((t, g) for t in found)
    assert {(names[t], g): k for t, g, k in zip(term, group.tolist(), n)} == want
    assert {(names[t], g): k for t, g, k in zip(term, group.tolist(), docs)} == rows


def test_against_the_definition(spark, make):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "été", "a1b", "x" * 17, "x" * 16]
    docs = []
    for i in range(300):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice([None, "s1", "s2", *(f"t{k}" for k in range(70))]) if lang == "en" else rng.choice(["s1", "s2", ""])
        docs.append((i, " ".join(rng.choices(words[:rng.randrange(5, 125)], k=rng.randrange(0, 40))), lang, source))
    docs += [(900, None, "fr", "s1"), (901, "one", "fr", "s2"), (902, None, None, None), (902, None, None, None), (None, "waa wab", "en", "only")]
    docs += [(903, "waa " * 50_000, "de", "s1")]
    got = D.source_divergence(make(docs).withColumnRenamed("n_chars", "rank"))
    assert {tuple(r) for r in got.collect()} == plain(docs)
    assert got.count() == len(plain(docs))
    few = D.source_divergence(make(docs), top=3)
    assert {tuple(r) for r in few.collect()} == plain(docs, 3)


def test_empty(spark, make):
    assert D.source_divergence(make([])).count() == 0
    assert {tuple(r) for r in D.source_divergence(make([(1, None, "en", "a"), (2, "", "en", "b")])).collect()} == {
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
