import random

from heftmap.plans import mips as M

SCHEMA = "asset_path string, pixel_format string, size_x int, size_y int, num_mips int, mips array<struct<w:int,h:int,bytes:bigint>>"


def saved(levels, cap):
    kept = next((i for i, (w, h, _) in enumerate(levels) if max(w, h) <= cap), len(levels) - 1)
    return sum(b for *_, b in levels[:kept])


def test_every_cap_against_the_plan(spark):
    """Chains that halve, chains that do not fall, single levels, empty levels and edges beyond the largest cap."""
    rng = random.Random(1)
    chains = [[(1 << k, 1 << k, 4 ** k) for k in range(6, -1, -1)], [(40000, 3, 9), (20000, 3, 7), (5, 5, 1)], [(8, 8, 100)], [(1, 1, 5), (1, 1, 5)]]
    chains += [[(rng.randrange(1, 300), rng.randrange(1, 300), rng.choice([0, 7, 500])) for _ in range(rng.randrange(1, 6))] for _ in range(40)]
    rows = [(f"a{i}", "F%d" % (i % 3), 1, 1, len(c), c) for i, c in enumerate(chains)]
    textures = spark.createDataFrame(rows, SCHEMA)
    curve = sorted(tuple(r) for r in M.savings_curve(textures).collect())
    assert curve[0][0] == 1 and curve[-1][1] == M.MAX_CAP and all(a[1] + 1 == b[0] for a, b in zip(curve, curve[1:]))
    for low, high, n, save, original in curve:
        for cap in {low, (low + high) // 2, high}:
            each = [(saved(c, cap), sum(b for *_, b in c)) for c in chains]
            assert (n, save, original) == (sum(s > 0 for s, _ in each), sum(s for s, _ in each), sum(t for s, t in each if s > 0)), cap
    caps = [1, 4, 64, 299, 16384]
    at = {r.cap: r.save_bytes for r in M.savings_at(M.savings_curve(textures), caps).collect()}
    assert at == {c: sum(saved(x, c) for x in chains) for c in caps}
    wishes = [1, 500, 3000, 10**9]
    wanted = spark.createDataFrame([(w,) for w in wishes], "save_at_least bigint")
    got = {r.save_at_least: (r.cap, r.save_bytes) for r in M.mildest_cap(M.savings_curve(textures), wanted).collect()}
    for wish in wishes:
        best = max((high for _, high, _, save, _ in curve if save >= wish), default=None)
        assert got[wish] == (best, None if best is None else sum(saved(x, best) for x in chains))
    by = {(r.pixel_format, r.cap_from): r.save_bytes for r in M.savings_curve(textures, ["pixel_format"]).collect()}
    for (name, cap), save in by.items():
        assert save == sum(saved(c, cap) for i, c in enumerate(chains) if "F%d" % (i % 3) == name)


def test_nothing_to_save(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in M.savings_curve(none).collect()] == [(1, M.MAX_CAP, 0, 0, 0)]
    assert M.savings_curve(none, ["pixel_format"]).count() == 0
