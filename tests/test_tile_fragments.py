"""Tiles are made of fragments that tasks pack from the pixels they read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heftmap.operators import raster as R
from heftmap.operators import tiles as TI
from heftmap.operators.staging import stage

SIZES = {"a": (130, 70), "b": (64, 129), "c": (1, 1)}


@pytest.fixture(scope="module")
def pixels(spark):
    rng = random.Random(4)
    rows = [(i, x, y, rng.randrange(256), rng.randrange(256), rng.randrange(256)) for i, (w, h) in SIZES.items() for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int").cache()


def values(df):
    return sorted(tuple(r) for r in df.select("image_id", "x", "y", "r", "g", "b").collect())


@pytest.mark.parametrize("pack", [1, 50, 1 << 18])
@pytest.mark.parametrize("parts", [1, 7])
def test_fragments_of_any_length(pixels, monkeypatch, pack, parts):
    monkeypatch.setattr(TI, "PACK", pack)
    monkeypatch.setattr(TI, "GIVEN", 5000)
    dealt = pixels.coalesce(1) if parts == 1 else pixels.repartition(parts, F.rand(1))
    assert values(TI.from_tiles(TI.to_tiles(dealt))) == values(pixels)
    halved = TI.from_tiles(TI.box_downsample(TI.to_tiles(dealt), times=2))
    assert halved.count() == sum((w // 4) * (h // 4) for w, h in SIZES.values())


def test_a_tile_without_any_pixel_is_refused(pixels):
    for hole in ("x >= 64 AND x < 128 AND y < 64", "x = 3 AND y = 3"):
        with pytest.raises(Exception, match="incomplete raster a"):
            TI.to_tiles(pixels.where(f"image_id <> 'a' OR NOT ({hole})")).collect()
    twice = pixels.unionByName(pixels.where("image_id = 'a' AND x = 3 AND y = 3")).where("image_id <> 'a' OR x <> 4 OR y <> 3")
    with pytest.raises(Exception, match="incomplete raster a"):
        TI.to_tiles(twice).collect()


def test_pixels_are_not_shuffled_one_by_one(spark, pixels):
    tiles = TI.to_tiles(pixels.coalesce(1))
    tiles.collect()
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_hash_sends_corners_and_joins_no_tables(pixels):
    areas = stage(TI.summed_area(TI.to_tiles(pixels), "weighted"), "areas")
    hashes = TI.average_hash(areas)
    got = {r.image_id: r.ahash for r in hashes.collect()}
    assert got == {r.image_id: r.ahash for r in R.average_hash(pixels).collect()}
    plan = hashes._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_cells_are_shuffled_compressed(pixels):
    rng = np.random.default_rng(3)
    cells = rng.integers(-300, 300, (3, 500)).astype(np.int16)
    assert (TI._opened(TI._shut(cells), 500, 3) == cells).all()
    flat = np.tile(np.arange(64, dtype=np.int16), (4, 64))
    assert len(TI._shut(flat)) < flat.nbytes / 20
    for made in (TI.to_tiles(pixels), TI.box_downsample(TI.to_tiles(pixels)), TI.bilinear_upsample(TI.to_tiles(pixels), 2)):
        made.collect()
        final = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        exchanges = [line for line in final.splitlines() if "Exchange hashpartitioning(image_id" in line and "tx#" in line]
        assert exchanges and "cells#" in final and "at#" not in final


def test_high_pass_sends_edges_only(spark, monkeypatch):
    rng = random.Random(8)
    sizes = {"a": (130, 70), "b": (65, 129), "c": (2, 200), "d": (66, 66), "e": (64, 64), "f": (1, 1)}
    rows = [(i, x, y, rng.randrange(256), rng.randrange(256), rng.randrange(256)) for i, (w, h) in sizes.items() for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int")
    sent, whole = [], TI._map_tiles
    monkeypatch.setattr(TI, "_map_tiles", lambda *a: sent.append(whole(*a)) or sent[-1])
    got = {r.image_id: r.hp_energy for r in TI.high_pass_energy(TI.to_tiles(pixels)).collect()}
    want = {r.image_id: r.hp_energy for r in R.high_pass_energy(pixels).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    values = sent[0].agg(F.sum(F.size("r"))).first()[0]
    assert 0 < values < len(rows) / 4
    assert sent[0].where("image_id = 'e'").select(F.sum(F.size("r"))).first()[0] == 0


def test_line_sums_are_added_up_over_tiles(pixels, monkeypatch):
    cells = TI.from_tiles(TI.to_tiles(pixels))
    want = cells.groupBy("image_id", "y").agg(F.count(F.lit(1)), *[F.sum(F.col(c) * (F.col("x") + 1)) for c in ("r", "g", "b")])
    sums = TI.line_sums(TI.to_tiles(pixels))
    assert sums.columns == ["image_id", "y", "n", "r", "g", "b"]
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(TI, "PACK", 30)
    assert sorted(map(tuple, TI.line_sums(TI.to_tiles(pixels)).collect())) == sorted(map(tuple, want.collect()))


def test_pixels_of_the_workload_are_not_written(spark, monkeypatch):
    from workload import fixtures

    monkeypatch.setattr(fixtures, "stage", lambda *a: pytest.fail("written"))
    monkeypatch.setattr(fixtures, "_stored", {})
    assert fixtures.view(spark, "/root/testdata/sf0.001", "ras").columns == ["image_id", "x", "y", "r", "g", "b"]
