import pytest

from heftmap import schemas
from heftmap.operators import audit as A
from heftmap.operators import detectors as D
from heftmap.operators import table_functions as TF

ROWS = [(1, "a/x.WAV", False, 10, None, None), (1, "a/y.flac", False, 30, None, None), (1, "b/y.flac", False, 30, None, None), (1, "n.wav", False, None, None, None),
        (1, ".wav", False, 99, None, None), (1, "dir.wav", True, 0, None, None), (2, "z.wav", False, 500, None, None), (3, "z.txt", False, 7, None, None)]
RULE = TF.Rule("raw_audio", TF.ends_in("wav", "flac"), warn_at=100)
WANT = {(1, "raw_audio", 4, 70, 30, "a/y.flac", "info"), (2, "raw_audio", 1, 500, 500, "z.wav", "warning")}


@pytest.fixture
def files(spark):
    return spark.createDataFrame(ROWS, schemas.FILES).repartition(3)


def test_called_from_sql(spark, files):
    TF.register(spark, RULE, TF.Rule("text", TF.ends_in("txt"), warn_at=1))
    files.createOrReplaceTempView("own_files")
    call = "SELECT * FROM audit_rule(TABLE({}) PARTITION BY (root_id), '{}')"
    assert {tuple(r) for r in spark.sql(call.format("own_files", "raw_audio")).collect()} == WANT
    assert {tuple(r) for r in spark.sql(call.format("SELECT * FROM own_files WHERE root_id > 1", "text")).collect()} == {(3, "text", 1, 7, 7, "z.txt", "warning")}
    with pytest.raises(Exception, match="unknown rule nothing"):
        spark.sql(call.format("own_files", "nothing")).collect()


def test_parts_of_a_root_add_up(spark, files):
    TF.register(spark, RULE)
    files.createOrReplaceTempView("own_files")
    parts = spark.sql("SELECT root_id, sum(item_count) AS n, sum(total_bytes) AS b FROM audit_rule(TABLE(own_files), 'raw_audio') GROUP BY root_id")
    assert {tuple(r) for r in parts.collect()} == {(1, 4, 70), (2, 1, 500)}


def test_findings_join_the_roster(spark, files):
    found = TF.rule_findings(files, RULE)
    assert set(found.columns) == set(D.findings(files).columns)
    assert {(r.root_id, r.severity, r.item_count, r.reclaimable_bytes) for r in found.collect()} == {(1, "info", 4, 70), (2, "warning", 1, 500)}
    scored = A.isolated_audit(files, {**dict.fromkeys(D.ROSTER), "raw_audio": lambda f: TF.rule_findings(f, RULE)})
    assert {r.root_id: r.reclaimable_bytes for r in scored.collect()} == {1: 70, 2: 500, 3: 0}
    assert TF.rule_findings(files.where("false"), RULE).count() == 0
