from pyspark.sql import functions as F

from heftmap.operators import incremental as X
from heftmap.schemas import FILES

HASHES = [None, "", "ab", "AB", "aB", "abc", "0" * 64, "zz", "ab\n", "é"]


def test_hashes_of_any_form_stay_apart_and_go_as_bytes(spark):
    rows = [(1, f"p{i}", False, 5, h, None) for i, h in enumerate(HASHES)] + [(2, "same", False, 5, h, None) for h in HASHES]
    before = spark.createDataFrame(rows, FILES)
    after = before.withColumn("content_sha256", F.when(F.col("root_id") == 1, F.upper("content_sha256")).otherwise(F.col("content_sha256")))
    found = X.changes(before, after)
    moved = [(f"p{i}", h) for i, h in enumerate(HASHES) if h is not None and h != h.upper()]
    want = sorted([(p, h, -1) for p, h in moved] + [(p, h.upper(), 1) for p, h in moved])
    assert sorted((r.path, r.content_sha256, r.times) for r in found.collect()) == want
    assert X.changes(spark.createDataFrame([], FILES), before).count() == len(rows)
    assert found.columns == [*FILES.names, "times"] and "_bytes" in found._jdf.queryExecution().executedPlan().toString()
