import json
import os
import re

import pytest
from pyspark.sql import functions as F

from heftmap.sources import inventory_source
from heftmap.sources.readers import scan_inventory


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    sizes = {"a.txt": 3, "x/b.bin": 10, "x/.hidden": 1, "x/_meta/c": 0, "x/y/z/deep.PNG": 2000, "w/1": 5, "w/2": 6}
    for path, size in sizes.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"." * size)
    (root / "empty" / "inner").mkdir(parents=True)
    os.symlink(root / "x", root / "link")
    return str(root)


@pytest.fixture(scope="module")
def inventory(spark, tree):
    inventory_source.register(spark)
    return lambda **options: spark.read.format("inventory").options(roots=json.dumps([[4, tree], [5, f"{tree}/w"]]), **options)


def rows(df):
    return sorted((r.root_id, r.path, r.is_dir, r.size_bytes) for r in df.collect())


def test_as_the_scan_for_any_number_of_partitions(spark, tree, inventory):
    want = rows(scan_inventory(spark, [(4, tree), (5, f"{tree}/w")]))
    assert len(want) == 16 and (4, "empty/inner", True, 0) in want and not any("link" in r[1] for r in want)
    for most in (1, 3, 64):
        got = inventory(partitions=most).load()
        assert rows(got) == want
        assert got.columns == ["root_id", "path", "is_dir", "size_bytes", "content_sha256", "probe_error"]
    assert [r[1:] for r in rows(spark.read.format("inventory").load(f"file://{tree}/w"))] == [("1", False, 5), ("2", False, 6)]


def test_columns_asked_for(inventory):
    assert sorted(tuple(r) for r in inventory().schema("is_dir boolean, path string").load().where("path like 'w%'").collect()) == [(False, "w/1"), (False, "w/2"), (True, "w")]
    assert inventory().schema("path string").load().where(F.col("path").startswith("x/")).count() == 7
    with pytest.raises(Exception, match="no columns"):
        inventory().schema("path string, owner string").load().count()


def test_filters_are_taken_over(inventory):
    all_rows = rows(inventory().load())
    cases = [
        (F.col("path").startswith("x/y") & (F.col("size_bytes") > 10), lambda r: r[1].startswith("x/y") and r[3] > 10),
        (F.col("path").startswith("x/y/z/d"), lambda r: r[1].startswith("x/y/z/d")),
        (F.col("path").startswith("x") & F.col("path").startswith("x/_"), lambda r: r[1].startswith("x/_")),
        (F.col("is_dir") == True, lambda r: r[2]),  # noqa: E712
        (F.col("size_bytes").between(1, 6) & (F.col("root_id") == 4), lambda r: 1 <= r[3] <= 6 and r[0] == 4),
        (F.col("path").isin("a.txt", "1"), lambda r: r[1] in ("a.txt", "1")),
        (F.col("path").endswith(".PNG") | (F.col("size_bytes") == 5), lambda r: r[1].endswith(".PNG") or r[3] == 5),
        (F.col("path").contains("y") & (F.length("path") > 3), lambda r: "y" in r[1] and len(r[1]) > 3),
        (~F.col("path").startswith("x"), lambda r: not r[1].startswith("x")),
    ]
    for condition, test in cases:
        assert rows(inventory().load().where(condition)) == [r for r in all_rows if test(r)], condition
    plan = inventory().load().where(F.col("path").startswith("x/y") & (F.col("size_bytes") > 10))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)


def test_pruned_folders_are_not_entered(tree, monkeypatch):
    from pyspark.sql import datasource as ds

    reader = inventory_source.InventoryReader(inventory_source.schemas.FILES, [(1, tree)], 4)
    assert list(reader.pushFilters([ds.StringStartsWith(("path",), "x/y/z")])) == []
    entered = []
    listing = inventory_source._listing
    monkeypatch.setattr(inventory_source, "_listing", lambda root, folder: entered.append(folder) or listing(root, folder))
    found = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.column(1).to_pylist()]
    assert sorted(found) == ["x/y/z", "x/y/z/deep.PNG"] and set(entered) == {"", "x", "x/y", "x/y/z"}


def test_what_is_not_there(spark, inventory, tmp_path):
    assert spark.read.format("inventory").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="name folders"):
        spark.read.format("inventory").load().count()
