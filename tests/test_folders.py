import random

from heftmap import schemas
from heftmap.operators import folders as FO


def plain(rows):
    """From ancestors: every file counts for every folder above it."""
    out = {}
    for root, path, is_dir, size, *_ in rows:
        inside = path if is_dir else path.rpartition("/")[0]
        parts = inside.split("/") if inside else []
        for depth in range(len(parts) + 1):
            folder = "/".join(parts[:depth])
            held = out.setdefault((root, folder), [depth, 0, 0, 0, 0])
            if not is_dir:
                held[1] += 1
                held[2] += size or 0
                if depth == len(parts):
                    held[3] += 1
                    held[4] += size or 0
    return {k: tuple(v) for k, v in out.items()}


def tree(rng, n):
    names = ["a", "ab", "a-b", "a.b", "a0", "B", "é", "x y", "!"]
    rows = []
    for i in range(n):
        path = "/".join(rng.choice(names) for _ in range(rng.randrange(1, 7))) + f"/f{i}" * (rng.random() < 0.8)
        rows.append((rng.randrange(3), path, rng.random() < 0.2, rng.choice([None, 0, rng.randrange(1000)]), None, None))
    return rows


def test_random_trees(spark):
    rng = random.Random(3)
    for n, ranges in ((1, 1), (40, 3), (600, 1), (600, 16)):
        rows = tree(rng, n)
        got = FO.folder_sizes(spark.createDataFrame(rows, schemas.FILES), ranges)
        assert got.count() == len(plain(rows))
        assert {(r.root_id, r.folder): tuple(r)[2:] for r in got.collect()} == plain(rows)


def test_one_long_chain_and_an_empty_inventory(spark):
    deep = "/".join(f"d{i}" for i in range(200))
    rows = [(1, f"{deep}/f", False, 5, None, None), (1, f"{deep}/empty", True, None, None, None)]
    assert {(r.root_id, r.folder): tuple(r)[2:] for r in FO.folder_sizes(spark.createDataFrame(rows, schemas.FILES)).collect()} == plain(rows)
    assert FO.folder_sizes(spark.createDataFrame([], schemas.FILES)).count() == 0


def test_heaviest(spark):
    rows = [(1, "a/b/f", False, 5, None, None), (1, "a/c/f", False, 7, None, None), (1, "d/f", False, 12, None, None)]
    files = spark.createDataFrame(rows, schemas.FILES)
    assert [(r.folder, r["rank"]) for r in FO.heaviest_folders(files, 3).orderBy("rank").collect()] == [("a", 1), ("d", 2), ("a/c", 3)]
    assert [r.folder for r in FO.heaviest_folders(files, 1, depth=2).collect()] == ["a/c"]
