import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heftmap.operators import neardup as ND
from heftmap.operators import raster as R

RNG = np.random.default_rng(5)
IMAGES = {
    1: RNG.integers(0, 256, (130, 70, 3)), 2: np.full((16, 16, 3), 128), 3: RNG.integers(0, 256, (2, 5, 3)),
    4: RNG.integers(0, 256, (9, 11, 3)), 5: RNG.integers(0, 256, (1, 1, 3)), 6: RNG.integers(0, 256, (64, 65, 3)),
}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [
        (i, x, y, *map(int, image[y, x])) for i, image in IMAGES.items() for y in range(image.shape[0]) for x in range(image.shape[1])
    ]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int").repartition(6)


def energy(image):
    h, w, _ = image.shape
    if w < 3 or h < 3:
        return 0.0
    mid = image[1:-1, 1:-1]
    around = (image[:-2, 1:-1] + image[2:, 1:-1] + image[1:-1, :-2] + image[1:-1, 2:]) // 4
    return np.abs(mid - around).mean()


def test_high_pass_energy_across_tiles(pixels):
    got = {r["image_id"]: r["hp_energy"] for r in R.high_pass_energy(pixels).collect()}
    assert got == pytest.approx({i: energy(image) for i, image in IMAGES.items()})


def test_patch_variance(pixels):
    def want(image):
        luma = (image[..., 0] * 299 + image[..., 1] * 587 + image[..., 2] * 114) // 1000
        tiles = [luma[y:y + 8, x:x + 8].mean() for y in range(0, image.shape[0] - 7, 8) for x in range(0, image.shape[1] - 7, 8)]
        return np.var(tiles) if tiles else 0.0

    got = {r["image_id"]: r["patch_variance"] for r in R.patch_variance(pixels).collect()}
    assert got == pytest.approx({i: want(image) for i, image in IMAGES.items()})


def test_average_hash(pixels):
    def want(image):
        h, w, _ = image.shape
        luma = image[..., 0] * 299 + image[..., 1] * 587 + image[..., 2] * 114
        cells = []
        for cy in range(8):
            for cx in range(8):
                x0, y0 = cx * w // 8, cy * h // 8
                x1, y1 = min(max((cx + 1) * w // 8, x0 + 1), w), min(max((cy + 1) * h // 8, y0 + 1), h)
                part = luma[y0:y1, x0:x1]
                cells.append(part.sum() / (part.size * 1000))
        mean = sum(cells) / 64
        bits = sum(1 << i for i, c in enumerate(cells) if c >= mean)
        return bits - (1 << 64) if bits >= 1 << 63 else bits

    got = {r["image_id"]: r["ahash"] for r in R.average_hash(pixels).collect()}
    assert got == {i: want(image) for i, image in IMAGES.items()}


def as_image(rows, channels="rgb"):
    w, h = max(r["x"] for r in rows) + 1, max(r["y"] for r in rows) + 1
    out = np.full((h, w, len(channels)), -1)
    for r in rows:
        out[r["y"], r["x"]] = [r[c] for c in channels]
    return out


def images_of(df):
    by_id = {}
    for r in df.collect():
        by_id.setdefault(r["image_id"], []).append(r)
    return {i: as_image(rows) for i, rows in by_id.items()}


def half(image):
    h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
    part = image[:h, :w]
    return (part[::2, ::2] + part[1::2, ::2] + part[::2, 1::2] + part[1::2, 1::2] + 2) // 4


def test_box_downsample(pixels):
    got = images_of(R.box_downsample(pixels))
    assert set(got) == {1, 2, 3, 4, 6}
    for i, image in got.items():
        assert np.array_equal(image, half(IMAGES[i]))
    assert np.array_equal(images_of(R.box_downsample(pixels, times=2))[1], half(half(IMAGES[1])))


def upsample(image, scale):
    f32 = np.float32
    h, w, _ = image.shape
    sx = f32(f32(w) - f32(1)) / max(f32(w * scale) - f32(1), f32(1))
    sy = f32(f32(h) - f32(1)) / max(f32(h * scale) - f32(1), f32(1))
    out = np.zeros((h * scale, w * scale, 3), dtype=int)
    for ty in range(h * scale):
        fy = f32(ty) * sy
        y0 = int(np.floor(fy)); y1 = min(y0 + 1, h - 1); wy = fy - f32(y0)
        for tx in range(w * scale):
            fx = f32(tx) * sx
            x0 = int(np.floor(fx)); x1 = min(x0 + 1, w - 1); wx = fx - f32(x0)
            p = image.astype(f32)
            top = p[y0, x0] * (f32(1) - wx) + p[y0, x1] * wx
            bot = p[y1, x0] * (f32(1) - wx) + p[y1, x1] * wx
            out[ty, tx] = np.clip(np.floor((top * (f32(1) - wy) + bot * wy).astype(float) + 0.5), 0, 255)
    return out


@pytest.mark.parametrize("scale", [2, 3, 4])
def test_bilinear_upsample(pixels, scale):
    small = pixels.where(F.col("image_id").isin(3, 4, 5))
    got = images_of(R.bilinear_upsample(small, scale))
    assert set(got) == {3, 4, 5}
    for i, image in got.items():
        assert np.array_equal(image, upsample(IMAGES[i], scale)), i


def test_crop(pixels):
    sizes = {r["image_id"]: (r["w"], r["h"]) for r in R.crop_to_multiple(pixels, 4).groupBy("image_id").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).collect()}
    assert sizes == {1: (68, 128), 2: (16, 16), 4: (8, 8), 6: (64, 64)}


@pytest.mark.parametrize("step", [1, 2, 5])
def test_residual_round_trip(pixels, step):
    prediction = pixels.select("image_id", "x", "y", *[((F.col(c) + 7) % 256).cast("int").alias(c) for c in "rgb"])
    checked = R.reconstruct_check(R.residual(pixels, prediction, step), step).collect()
    assert all(r["max_error"] <= step // 2 for r in checked)
    if step == 1:
        assert all(r["exact"] for r in checked)


def test_entropy(spark):
    symbols = spark.createDataFrame([(1, 0)] * 8 + [(2, s) for s in range(256)] + [(3, 0), (3, 0), (3, 1), (3, 2)], "image_id long, symbol int")
    got = {r["image_id"]: r["entropy_bits"] for r in R.shannon_entropy(symbols).collect()}
    assert got == pytest.approx({1: 0.0, 2: 8.0, 3: 1.5})
    residuals = spark.createDataFrame([(1, -1), (1, 256)], "image_id long, r_q int")
    assert sorted(r["symbol"] for r in R.residual_symbols(residuals, ["r"]).collect()) == [0, 1, 255, 255]


def brute_pairs(hashes, radius):
    values = sorted(set(hashes))
    found = set()
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            d = bin((a ^ b) & (2**64 - 1)).count("1")
            if d <= radius:
                found.add((a, b, d))
    return found


@pytest.mark.parametrize("crowded, refile_bits", [(10_000, 24), (20, 24), (20, 5)])
def test_near_pairs_match_brute_force(spark, monkeypatch, crowded, refile_bits):
    monkeypatch.setattr(ND, "REFILE_BITS", refile_bits)
    random.seed(3)
    bases = [random.getrandbits(64) for _ in range(40)]
    hashes = []
    for base in bases:
        for _ in range(8):
            value = base
            for bit in random.sample(range(64), random.randint(0, 8)):
                value ^= 1 << bit
            hashes.append(value)
    # A crowd: nearly a third of all values differ in the low bits only.
    hashes += [0xABCDEF0000000000 | i for i in range(150)] + [hashes[0]] * 5
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
    df = spark.createDataFrame([(h,) for h in signed], "ahash long")
    got = ND.near_hash_pairs(df, crowded=crowded).collect()
    assert {(r["hash_a"], r["hash_b"], r["distance"]) for r in got} == brute_pairs(signed, 6)
    assert len(got) == len({(r["hash_a"], r["hash_b"]) for r in got})
    counts = {h: signed.count(h) for h in set(signed)}
    assert all(r["images_a"] == counts[r["hash_a"]] and r["images_b"] == counts[r["hash_b"]] for r in got)


def test_equal_images_are_no_near_pair(spark):
    df = spark.createDataFrame([(7,)] * 1000 + [(6,)] * 500, "ahash long")
    assert [r.asDict() for r in ND.near_duplicates(df).collect()] == [{"distance": 1, "hash_pairs": 1, "image_pairs": 500_000}]
