"""A part of the queries against DuckDB on the smallest tables; check.py compares all of them."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from check import canonical
from __spark_entry__ import entry, oracle_sql, queries
from workload.catalog import QUERIES
from workload.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "a9_audit", "c8_languages_ranked", "census_report", "d_evidence", "j5_near_dup_pairs", "j8_patch_to_base", "j9_entries_by_status",
    "p2_plan_strip_containers", "p7_reproject", "p14_snapshot_diff", "b3_replay_restore", "b5_project_savings", "q3_oracle_by_class", "q6_best_threshold",
    "q8_grid_threshold", "r1_high_pass_energy", "r9_bilinear_upsample", "r12_shannon_entropy", "s3_read_bench", "s4_read_manifest",
    "b2_explode_strips", "b4_verify_restore", "e2_search_entries", "j4_threshold_sweep", "j6_route_targets", "p11_eligible_targets", "q7_router_gate", "s6_render_report_markdown",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.splitext(os.path.basename(path))[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    ours = queries()[name](spark, SMALL).toPandas()
    rows = duck.execute(oracle_sql()[name])
    theirs = pd.DataFrame(rows.fetchall(), columns=[c[0] for c in rows.description], dtype=object)
    assert canonical(ours) == canonical(theirs)


def test_entry(spark):
    assert entry(spark).count() == 5


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())
