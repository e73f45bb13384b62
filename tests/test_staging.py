import os

import pytest

from heftmap.operators import paired as Q
from heftmap.operators import staging as S


class Unset:
    """A session whose configuration has no shared folder."""

    def __init__(self, master):
        context = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()
        context.getConf = lambda: {}
        self.sparkContext = context
        self.conf = {}


def test_shared_folder_is_asked_for_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            S.shared_dir(Unset(master))
    folder = S.shared_dir(Unset("local[2]"))
    assert os.path.isdir(folder) and S.shared_dir(Unset("local[2]")) == folder


def test_staged_tables_go_when_they_are_discarded(spark):
    first, second = S.stage(spark.range(5), "x"), S.stage(spark.range(6), "y")
    place = lambda df: df.staged_at.removeprefix("file:")
    assert first.count() == 5 and os.path.isdir(place(first))
    S.discard(spark, first)
    assert not os.path.exists(place(first)) and second.count() == 6
    S.discard(spark, second.staged_at)
    assert not os.path.exists(place(second))


def test_benchmarks_without_a_common_label(spark):
    runs = "label string, ratio double, hp_energy double"
    a, b = spark.createDataFrame([("x", 1.0, 2.0)], runs), spark.createDataFrame([("y", 1.0, 2.0)], runs)
    with pytest.raises(ValueError, match="no label in common"):
        Q.require_pairs(Q.pair_benchmarks(a, b))
    assert Q.require_pairs(Q.pair_benchmarks(a, a)).count() == 1
