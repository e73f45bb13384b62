"""Every case is a root of its own, so one run also shows that roots do not leak into each other."""

import pytest
from pyspark.sql import functions as F

from heftmap import schemas
from heftmap.operators import audit as A
from heftmap.operators import detectors as D
from heftmap.operators import inventory as I
from heftmap.schemas import GIB, MIB


def f(path, size, sha=None, error=None, is_dir=False):
    return path, is_dir, size, sha, error


def paks(n, size):
    return [f(f"Video/Paks/{i}/v{i}.pak", size) for i in range(n)]


# name -> (files, {detector: expected columns, or None for "does not fire"})
CASES = {
    "empty dirs only": ([f("a", 0, is_dir=True)], {d: None for d in D.ROSTER}),
    "overlay below the critical ratio": (
        [f("p/pakchunk1-w.pak", 100), f("q/pakchunk1-w_P.pak", 39)],
        {"patch_overlay": dict(severity="warning", item_count=1, total_bytes=39, reclaimable_bytes=19)}),
    "overlay at the critical ratio": (
        [f("p/pakchunk1-w.pak", 100), f("q/pakchunk1-w_P.pak", 40)], {"patch_overlay": dict(severity="critical", reclaimable_bytes=20)}),
    "second base counts as overlay": (
        [f("a/pakchunk1-w.pak", 100), f("b/pakchunk1-w.pak", 60)],
        {"patch_overlay": dict(severity="critical", item_count=1, total_bytes=60, reclaimable_bytes=30)}),
    "patches without base": ([f("a/pakchunk1-w_P.pak", 100), f("b/pakchunk1-x_P.pak", 60)], {"patch_overlay": None}),
    "empty base": ([f("a/pakchunk1-w.pak", 0), f("b/pakchunk1-w_P.pak", 60)], {"patch_overlay": dict(severity="warning", reclaimable_bytes=30)}),
    "versions compare by number": (
        [f("L/3.3.9/a", 70 * MIB), f("L/3.3.11/a", MIB), f("M/1.0/b", 5)],
        {"stale_version_dir": dict(severity="info", item_count=1, total_bytes=70 * MIB, reclaimable_bytes=70 * MIB)}),
    "empty version folder supersedes": (
        [f("L/1.0/a", 100 * MIB), f("L/2.0", 0, is_dir=True), f("L/1.0", 0, is_dir=True)],
        {"stale_version_dir": dict(severity="warning", item_count=1, reclaimable_bytes=100 * MIB)}),
    "nested versions count at both levels": (
        [f("1.0/1.1/a", 10), f("1.0/1.2/b", 20), f("2.0/c", 1)],
        {"stale_version_dir": dict(item_count=2, group_count=2, reclaimable_bytes=30 + 10)}),
    "version file is no folder": ([f("L/1.0", 5), f("L/2.0", 5)], {"stale_version_dir": None}),
    "nineteen shards": (paks(19, 100), {"sharded_videos": None}),
    "twenty shards": (paks(20, 110), {"sharded_videos": dict(severity="warning", item_count=20, total_bytes=2200, reclaimable_bytes=110)}),
    "shards too large on average": (paks(20, 600 * MIB + 1), {"sharded_videos": None}),
    "empty shards do not count": (paks(19, 100) + [f("Video/Paks/x/v.pak", 0)], {"sharded_videos": None}),
    "pak just below two gigabytes": ([f("a.pak", 2 * GIB - 1)], {"large_chunk": None}),
    "pak of two gigabytes": ([f("a.pak", 2 * GIB), f("b.PAK", 20 * GIB)], {"large_chunk": dict(severity="warning", item_count=1, reclaimable_bytes=None)}),
    "pak of ten gigabytes": ([f("a.pak", 10 * GIB)], {"large_chunk": dict(severity="critical")}),
    "all containers readable": ([f("a.pak", 10)], {"encryption": dict(severity="info", detail="clear", reclaimable_bytes=None)}),
    "all containers blocked": (
        [f("a.pak", 10, error="encrypted"), f("b.pak", 10), f("b.sig", 1)], {"encryption": dict(severity="critical", item_count=2, detail="signed")}),
    "store stub wins over signature": (
        [f("a.pak", 10), f("a.utoc", 1), f("a.ucas", 99), f("a.sig", 1), f("c.pak", 1)],
        {"encryption": dict(severity="warning", item_count=2, total_bytes=11, detail="iostore")}),
    "half a store pair is no stub": ([f("a.pak", 10), f("a.utoc", 1)], {"encryption": dict(severity="info")}),
    "leftover below a mebibyte": ([f("x/a.PDB", MIB - 1)], {"editor_leftovers": dict(severity="info", item_count=1)}),
    "leftover at a mebibyte": ([f("build/a.txt", MIB)], {"editor_leftovers": dict(severity="warning", reclaimable_bytes=MIB)}),
    "cache folder without the spelled space": ([f("Game/DerivedDataCache/a", 5)], {"editor_leftovers": None}),
    "two satellites": ([f(f"app/{c}/r.dll", 10) for c in ("de", "fr")], {"launcher_satellite": None}),
    "three satellites": (
        [f(f"app/{c}/r.dll", s) for c, s in (("de", 10), ("fr", 20), ("pt-BR", 30))] + [f("app/ja/x.txt", 99)],
        {"launcher_satellite": dict(severity="info", item_count=3, total_bytes=60, reclaimable_bytes=30)}),
    "satellites warn at ten mebibytes": (
        [f(f"app/{c}/r.dll", 5 * MIB) for c in ("de", "fr", "ja")], {"launcher_satellite": dict(severity="warning", reclaimable_bytes=10 * MIB)}),
    "dll deeper than the language folder": ([f(f"app/{c}/x/r.dll", 10) for c in ("de", "fr", "ja")], {"launcher_satellite": None}),
    "shader families below five mebibytes": (
        [f("ShaderArchive-PCD3D_SM5.x", 5 * MIB - 1), f("ShaderArchive-PCD3D_SM6.x", 50 * MIB)], {"shader_rhi_redundancy": None}),
    "shader families": (
        [f("ShaderArchive-PCD3D_SM5.x", 5 * MIB), f("ShaderArchive-PCD3D_SM6.x", 50 * MIB), f("PCD3D_SM5.x", 99 * MIB)],
        {"shader_rhi_redundancy": dict(severity="info", item_count=2, reclaimable_bytes=5 * MIB)}),
    "installer at the top": ([f("a/vc_redist.exe", 10)], {"redist_installer": dict(severity="info", reclaimable_bytes=10)}),
    "installer deep outside redist": ([f("a/b/vc_redist.exe", 10)], {"redist_installer": None}),
    "installer in a hidden-style folder": ([f("_CommonRedist/x/vcredist.msi", 10 * MIB)], {"redist_installer": dict(severity="warning")}),
    "platforms below fifty mebibytes": (
        [f("E/Binaries/Win64/a", 99 * MIB), f("E/Binaries/Linux/a", 50 * MIB - 1)], {"platform_siblings": None}),
    "platforms": (
        [f("E/Binaries/Win64/a", 99 * MIB), f("E/binaries/LINUX/a", 50 * MIB), f("E/Binaries/LinuxArm64/b", 1)],
        {"platform_siblings": dict(severity="info", item_count=3, reclaimable_bytes=50 * MIB + 1)}),
    "mod leftovers": ([f("m/a.pak.DISABLED", 50 * MIB)], {"mod_manager_artifacts": dict(severity="warning", item_count=1)}),
    "copies below four mebibytes": ([f("a", 4 * MIB - 1, "h"), f("b", 4 * MIB - 1, "h")], {"duplicate_content": None}),
    "copies": (
        [f(n, 4 * MIB, "h") for n in "abc"] + [f("d", 4 * MIB, "other"), f("e", 5 * MIB, "h")],
        {"duplicate_content": dict(severity="info", item_count=2, group_count=1, reclaimable_bytes=8 * MIB)}),
    "copies without a hash": ([f("a", 4 * MIB), f("b", 4 * MIB)], {"duplicate_content": None}),
    "locales below a mebibyte": ([f("cef/de.pak", MIB - 1), f("cef/EN-us.pak", 9 * MIB)], {"cef_locales": None}),
    "locales": (
        [f("x/CEF3/de.PAK", 5 * MIB), f("x/CEF3/EN-us.pak", 9 * MIB)],
        {"cef_locales": dict(severity="warning", item_count=1, total_bytes=14 * MIB, reclaimable_bytes=5 * MIB)}),
}
NAMES = list(CASES)


def inventory(spark, cases=CASES):
    rows = [(i, *row) for i, (rows, _) in enumerate(cases.values()) for row in rows]
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows], schemas.FILES)


@pytest.fixture(scope="module")
def found(spark):
    rows = D.findings(inventory(spark)).collect()
    return {(r["root_id"], r["detector"]): r.asDict() for r in rows}


@pytest.mark.parametrize("case", NAMES)
def test_case(found, case):
    for detector, want in CASES[case][1].items():
        got = found.get((NAMES.index(case), detector))
        if want is None:
            assert got is None, got
        else:
            assert got is not None, detector
            assert {k: got[k] for k in want} == want


def test_single_detectors_agree_with_the_joint_scan(spark, found):
    files = inventory(spark)
    for detector in ("patch_overlay", "stale_version_dir", "duplicate_content", "encryption"):
        alone = {(r["root_id"], r["detector"]): r.asDict() for r in D.findings(files, [detector]).collect()}
        assert alone == {k: v for k, v in found.items() if k[1] == detector}


def test_row_order_and_partitioning_do_not_matter(spark, found):
    shuffled = inventory(spark).orderBy(F.xxhash64("path")).repartition(5)
    again = {(r["root_id"], r["detector"]): r.asDict() for r in D.findings(shuffled).collect()}
    assert again == found


def test_evidence(spark):
    shown = D.evidence(inventory(spark)).collect()
    by = lambda case, d: sorted((r["path"], r["size_bytes"], r["note"]) for r in shown if r["root_id"] == NAMES.index(case) and r["detector"] == d)
    assert by("second base counts as overlay", "patch_overlay") == [("a/pakchunk1-w.pak", 100, "base"), ("b/pakchunk1-w.pak", 60, "overlay")]
    assert by("patches without base", "patch_overlay") == []
    assert by("versions compare by number", "stale_version_dir") == [("L/3.3.9", 70 * MIB, "3.3.9")]
    assert by("copies", "duplicate_content") == [("a", 4 * MIB, "keep"), ("b", 4 * MIB, "duplicate"), ("c", 4 * MIB, "duplicate")]
    assert by("locales", "cef_locales") == [("x/CEF3/EN-us.pak", 9 * MIB, "EN-us (keep)"), ("x/CEF3/de.PAK", 5 * MIB, "de")]
    assert by("locales below a mebibyte", "cef_locales") == []
    assert by("platforms", "platform_siblings")[0] == ("E/Binaries/LinuxArm64", 1, "LinuxArm64")
    assert by("twenty shards", "sharded_videos") == [("Video/Paks", 2200, "20 folders")]
    assert by("store stub wins over signature", "encryption") == [("a.pak", 10, "iostore")]
    assert len(by("three satellites", "launcher_satellite")) == 3


def test_one_huge_group_of_copies(spark):
    n = 20_000
    copies = spark.range(n).select(
        F.lit(1).cast("bigint").alias("root_id"), F.concat(F.lit("d/"), F.col("id")).alias("path"), F.lit(False).alias("is_dir"),
        F.lit(4 * MIB).cast("bigint").alias("size_bytes"), F.lit("same").alias("content_sha256"), F.lit(None).cast("string").alias("probe_error"),
    )
    finding = D.findings(copies, ["duplicate_content"]).first()
    assert (finding["item_count"], finding["reclaimable_bytes"]) == (n - 1, 4 * MIB * (n - 1))
    roles = {r["note"]: r["count"] for r in D.evidence(copies, ["duplicate_content"]).groupBy("note").count().collect()}
    assert roles == {"keep": 1, "duplicate": n - 1}
    assert I.size_collision_prefilter(copies).count() == n


def test_unknown_detector(spark):
    with pytest.raises(ValueError):
        D.findings(inventory(spark), ["nonsense"])


def test_score_components(spark):
    rows = spark.createDataFrame(
        [(0.0, 0, False, 0), (10.9, 0, False, 21), (50.0, 1, False, 70), (200.0, 9, True, 100), (0.0, 0, True, 10), (14.99, 2, True, 59)],
        "pct double, critical long, blocked boolean, want int",
    )
    got = rows.select("want", A.bloat_score(F.col("pct"), F.col("critical"), F.col("blocked")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_audit_keeps_clean_roots_and_reports(spark):
    files = inventory(spark)
    report = A.audit(files)
    clean = report.where(F.col("root_id") == NAMES.index("patches without base")).first()
    assert clean["total_findings"] == 1  # container access is always stated
    texts = {r["root_id"]: r["markdown"] for r in A.report_markdown(A.report_rows(files, evidence_rows=2)).collect()}
    text = texts[NAMES.index("twenty shards")]
    assert "Video/Paks" in text and "warning" in text
    assert "Nothing found" in texts[NAMES.index("version file is no folder")]
    copies = texts[NAMES.index("copies")]
    assert "… and 1 more" in copies
    json = A.report_json(A.report_rows(files)).where(F.col("root_id") == NAMES.index("copies")).first()["json"]
    assert '"reclaimable_bytes":8388608' in json


def test_broken_detector_becomes_a_finding(spark):
    files = inventory(spark).drop("probe_error")
    roster = {"large_chunk": lambda x: D.findings(x.withColumn("probe_error", F.lit(None).cast("string")), ["large_chunk"]),
              "encryption": lambda x: D.findings(x, ["encryption"])}
    got = A.guarded_findings(files, roster).groupBy("detector").count().collect()
    counts = {r["detector"]: r["count"] for r in got}
    assert counts["encryption"] == files.select("root_id").distinct().count() and counts["large_chunk"] >= 2


def test_a_detector_that_fails_in_its_tasks_leaves_the_others_whole(spark):
    rows = [(r, f"Bin/g{i}.pdb", False, 1 << 21, f"h{i % 2}", None) for r in (1, 2) for i in range(6)] + [(1, "Paks/a.pak", False, 3 << 30, None, None)]
    files = spark.createDataFrame(rows, schemas.FILES)
    boom = lambda f: D.findings(f.withColumn("size_bytes", F.when(F.col("path") == "Bin/g3.pdb", F.raise_error(F.lit("boom")).cast("bigint")).otherwise(F.col("size_bytes"))), ["editor_leftovers"])
    missing = lambda f: D.findings(f.drop("content_sha256"), ["duplicate_content"])
    found = A.isolated_findings(files, {**dict.fromkeys(D.ROSTER), "editor_leftovers": boom, "duplicate_content": missing, "own": lambda f: D.findings(f, ["large_chunk"])})
    errors = {(r.root_id, r.detector): r.detail for r in found.where("category = 'chunking_quality'").collect()}
    assert set(errors) == {(r, d) for r in (1, 2) for d in ("editor_leftovers", "duplicate_content")}
    assert all("boom" in errors[r, "editor_leftovers"] and "content_sha256" in errors[r, "duplicate_content"] for r in (1, 2))
    names = [c for c in found.columns if c in D.findings(files).columns]
    others = [d for d in D.ROSTER if d not in ("editor_leftovers", "duplicate_content")]
    got = found.where("category <> 'chunking_quality'").select(*names).collect()
    want = D.findings(files, others).select(*names).collect() + D.findings(files, ["large_chunk"]).select(*names).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert A.isolated_audit(files).count() == 2
