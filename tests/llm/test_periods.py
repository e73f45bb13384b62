import hashlib
import random
import re
import zlib
from fractions import Fraction

from heftmap.llm.periods import find_runs, text_runs
from heftmap.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, end, period) of every run: each period is walked over all words; the smallest period of a stretch comes first."""
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                out.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    word = lambda k: b"%d" % rng.randrange(k)
    few = rng.choice([1, 2, 3, 5, 50])
    repeated = []
    for _ in range(3):
        repeated += [word(300) for _ in range(rng.randrange(1, 30))] * rng.randrange(2, 12) + [word(300) for _ in range(rng.randrange(5))]
    inner = [word(few) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 9) + [word(few)]
    short, long = [b"a"], [b"a", b"b"]
    for _ in range(rng.randrange(2, 10)):
        short, long = long, long + short
    n = rng.randrange(30, 290)
    a = rng.randrange(n)
    period = 1 + (n - a) // (3 + rng.randrange(8))
    tail = [word(40) for _ in range(n)]
    tail = [tail[i if i < a else a + (i - a) % period] for i in range(n)]
    same = [b"x"] * rng.randrange(200)
    return [[word(few) for _ in range(rng.randrange(260))], repeated, inner * rng.randrange(1, 9), long, same + [b"y"] + same, tail, []]


def test_against_every_period():
    rng = random.Random(5)
    for _ in range(40):
        some = [t for _ in range(rng.randrange(1, 4)) for t in texts(rng)]
        found = text_runs(some)
        for i, words in enumerate(some):
            assert found.get(i, []) == plain_runs(words)


def test_very_periodic_texts_end_soon():
    assert text_runs([[b"a"] * 400_000]) == {0: [(0, 400_000, 1)]}
    assert text_runs([[b"a", b"b", b"c"] * 100_000, []]) == {0: [(0, 300_000, 3)]}
    blocks = text_runs([([b"a"] * 50 + [b"b"]) * 500])[0]
    assert len(blocks) == 501 and blocks[0] == (0, 50, 1) and (0, 25_500, 51) in blocks


def test_rows(spark, make):
    run = "x y z " * 9
    docs = make([(1, None), (2, ""), (3, " \t\n"), (None, run), (4, f"a  b c\n{run}"), (4, "a"), (4, "a")]).withColumnRenamed("lang", "runs")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect())
    assert got == [(0, 27, [(0, 27, 3)], "x y z"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "a"), (4, 1, [], "a"),
                   (4, 29, [(2, 27, 3)], "a b c x y z")]
    assert find_runs(docs.where("false")).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
        s, length, q = (best[0], best[1] - best[0], best[2]) if best else (None, None, None)
        assert got[doc.doc_id][1:] == (
            len(runs), s, length, q, 1000 * length // q if best else None, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))
