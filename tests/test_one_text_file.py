import os

from pyspark.sql import functions as F

from workload import fixtures


def test_one_file_in_order_sorted_by_many_tasks(spark, monkeypatch):
    sorts = []
    plain = type(spark.range(1)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda df, n: sorts.append(df.count()) or df.repartition(n))
    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", lambda df, *c: sorts.append(df.count()) or plain(df, *c))
    lines = spark.range(50_000).repartition(9).select((F.col("id") * 7919 % 50_000).alias("seq"), F.lit("x").alias("pad")).select(
        "seq", F.concat(F.col("pad"), F.col("seq").cast("string")).alias("line"))
    folder = fixtures.one_text_file(lines, "seq").removeprefix("file://")
    files = [n for n in os.listdir(folder) if not n.startswith((".", "_"))]
    assert len(files) == 1
    with open(f"{folder}/{files[0]}") as f:
        assert f.read().split("\n") == [f"x{i}" for i in range(50_000)] + [""]
    # Only the row that asks for the appending is in one task.
    assert max(sorts, default=1) == 1
