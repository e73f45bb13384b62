"""What the planner counts too low is not sent through the driver."""

import random

import pytest

from heftmap.operators import neardup
from heftmap.operators import raster as R


def plan_of(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowded", [neardup.CROWDED, 4])
def test_drawers_stay_out_of_the_driver(spark, crowded):
    rng = random.Random(3)
    values = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    values += [v ^ 5 for v in values[:40]] + [7 << 40 | rng.randrange(1 << 9) for _ in range(60)]
    got = neardup.near_hash_pairs(spark.createDataFrame([(v,) for v in values], "ahash bigint"), crowded=crowded)
    assert "BroadcastHashJoin" not in plan_of(got)
    distinct = sorted(set(values))
    want = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= neardup.RADIUS}
    assert {(r.hash_a, r.hash_b) for r in got.collect()} == want


def test_sizes_of_images_stay_out_of_the_driver(spark):
    pixels = spark.range(6400).selectExpr("id div 64 AS image_id", "CAST(id % 8 AS INT) AS x", "CAST(id div 8 % 8 AS INT) AS y", "CAST(id % 251 AS INT) AS r", "1 AS g", "2 AS b")
    assert "BroadcastHashJoin" not in plan_of(R.average_hash(pixels))
