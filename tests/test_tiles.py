import random

import pytest

from heftmap.operators import raster as R
from heftmap.operators import tiles as TI

SIZES = {1: (1, 1), 2: (3, 2), 3: (64, 64), 4: (65, 130), 5: (150, 70), 6: (1, 129), 7: (128, 1), 8: (200, 3)}


@pytest.fixture(scope="module")
def pixels(spark):
    """Images whose edges are and are not multiples of a tile, smooth and noisy, with three different channels."""
    rng = random.Random(1)
    rows = []
    for i, (w, h) in SIZES.items():
        for y in range(h):
            for x in range(w):
                rows.append((i, x, y, (x * 3 + y) % 256, rng.randrange(256), (x * y) % 251))
    return spark.createDataFrame(rows, "image_id bigint, x int, y int, r int, g int, b int").repartition(8).cache()


@pytest.fixture(scope="module")
def tiles(pixels):
    return TI.to_tiles(pixels).cache()


def rows(df, *names):
    names = names or ("image_id", "x", "y", "r", "g", "b")
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_there_and_back(pixels, tiles):
    assert rows(TI.from_tiles(tiles)) == rows(pixels)
    assert tiles.count() == sum(-(-w // 64) * -(-h // 64) for w, h in SIZES.values())


def test_incomplete_images_are_refused(spark):
    for missing in ([(1, 0, 0, 1, 1, 1), (1, 1, 1, 1, 1, 1)], [(1, 0, 0, 1, 1, 1), (1, 0, 0, 1, 1, 1), (1, 1, 0, 2, 2, 2)]):
        with pytest.raises(Exception, match="incomplete raster 1"):
            TI.to_tiles(spark.createDataFrame(missing, "image_id int, x int, y int, r int, g int, b int")).collect()


def test_energy_as_in_pixel_form(pixels, tiles):
    got, want = ({r.image_id: r.hp_energy for r in df.collect()} for df in (TI.high_pass_energy(tiles), R.high_pass_energy(pixels)))
    assert got == pytest.approx(want) and set(got) == set(SIZES)
    assert got[1] == got[2] == got[6] == got[7] == 0 and got[8] > 0


def test_other_sizes_as_in_pixel_form(pixels, tiles):
    for times in (1, 2):
        assert rows(TI.from_tiles(TI.box_downsample(tiles, times=times))) == rows(R.box_downsample(pixels, times=times))
    for scale in (1, 2, 3):
        assert rows(TI.from_tiles(TI.bilinear_upsample(tiles, scale))) == rows(R.bilinear_upsample(pixels, scale))
    for m in (3, 64):
        assert rows(TI.from_tiles(TI.crop_to_multiple(tiles, m))) == rows(R.crop_to_multiple(pixels, m))


def test_residuals_as_in_pixel_form(pixels, tiles):
    plain = R.residual(pixels, R.bilinear_upsample(R.box_downsample(pixels), 2), 3)
    tiled = TI.residual(TI.crop_to_multiple(tiles, 2), TI.bilinear_upsample(TI.box_downsample(tiles), 2), 3)
    names = ("r", "g", "b", "r_pred", "g_pred", "b_pred", "r_q", "g_q", "b_q")
    assert rows(TI.from_tiles(tiled, names), "image_id", "x", "y", *names) == rows(plain, "image_id", "x", "y", *names)
    assert rows(TI.reconstruct_check(tiled, 3), "image_id", "max_error", "exact") == rows(R.reconstruct_check(plain, 3), "image_id", "max_error", "exact")
    got, want = ({r.image_id: (r.entropy_bits, r.symbol_count) for r in df.collect()} for df in (TI.shannon_entropy(tiled), R.shannon_entropy(R.residual_symbols(plain))))
    assert set(got) == set(want)
    for i in got:
        assert got[i] == pytest.approx(want[i])
    with pytest.raises(Exception, match="different sizes"):
        TI.residual(tiles, TI.bilinear_upsample(TI.box_downsample(tiles), 2)).collect()


def test_summed_areas(pixels, tiles):
    areas = TI.summed_area(tiles)
    plain = {}
    for r in pixels.collect():
        plain.setdefault(r.image_id, {})[r.x, r.y] = (299 * r.r + 587 * r.g + 114 * r.b) // 1000
    got = {(r.image_id, r.x, r.y): r.sums for r in TI.from_tiles(areas.withColumn("sums", areas["sums"]), ("sums",)).collect()}
    for i, (w, h) in SIZES.items():
        column = [0] * w
        for y in range(h):
            line = 0
            for x in range(w):
                column[x] += plain[i][x, y]
                line += column[x]
                assert got[i, x, y] == line
    rng, boxes = random.Random(3), []
    for i, (w, h) in SIZES.items():
        for box in range(20):
            x0, y0 = rng.randrange(w), rng.randrange(h)
            boxes.append((i, box, x0, y0, rng.randrange(x0, w) + 1, rng.randrange(y0, h) + 1))
    asked = pixels.sparkSession.createDataFrame(boxes, "image_id bigint, box int, x0 int, y0 int, x1 int, y1 int")
    sums = {(r.image_id, r.box): r.total for r in TI.box_sums(areas, asked).collect()}
    assert sums == {(i, b): sum(plain[i][x, y] for x in range(x0, x1) for y in range(y0, y1)) for i, b, x0, y0, x1, y1 in boxes}


def test_patches_and_hashes_as_in_pixel_form(pixels, tiles):
    areas = TI.summed_area(tiles)
    got = {(r.image_id, r.patch): r.patch_variance for r in TI.patch_variances(areas, (4, 7, 32)).collect()}
    assert len(got) == 3 * len(SIZES)
    for patch in (4, 7, 32):
        want = {r.image_id: r.patch_variance for r in R.patch_variance(pixels, patch).collect()}
        assert {i: got[i, patch] for i in SIZES} == pytest.approx(want)
    assert rows(TI.average_hash(TI.summed_area(tiles, "weighted")), "image_id", "ahash") == rows(R.average_hash(pixels), "image_id", "ahash")


def test_no_images(tiles):
    none = tiles.where("false")
    for df in (TI.high_pass_energy(none), TI.box_downsample(none), TI.bilinear_upsample(none, 2), TI.summed_area(none), TI.patch_variances(none.withColumn("sums", none["r"].cast("array<bigint>")), (4,))):
        assert df.count() == 0
