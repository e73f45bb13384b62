"""Census, plans, manifests, entries, readers and writers."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from heftmap import schemas
from heftmap.operators import audit as A
from heftmap.operators import detectors as D
from heftmap.operators import entries as E
from heftmap.operators import inventory as I
from heftmap.operators import manifest as M
from heftmap.plans import mips, strip
from heftmap.sources import readers, writers


def files_df(spark, rows):
    full = [(r, p, False, s, None, e) for r, p, s, e in rows]
    return spark.createDataFrame(full, schemas.FILES)


@pytest.fixture(scope="module")
def files(spark):
    return files_df(spark, [
        (1, "L10N/en-us/a.ogg", 10, None), (1, "L10N/fr/a.ogg", 30, None), (1, "L10N/fr/b.pak", 5, None), (1, "x.pak", 7, "encrypted"),
        (1, "y.pak", 7, None), (1, "y.sig", 1, None), (1, "cef/de.pak", 3, None), (1, "t.PNG", 4, None), (1, "bad.bin", None, None),
        (2, "L10N/fr/a.ogg", 30, None), (2, "z.pak", 100, "unsupported encryption"), (2, "z.PAK", 50, None),
    ])


def test_census(files):
    totals = {r["root_id"]: (r["file_count"], r["total_bytes"]) for r in I.census_totals(files).collect()}
    assert totals == {1: (9, 67), 2: (3, 180)}
    kinds = {(r["root_id"], r["kind"]): (r["file_count"], r["bytes"]) for r in I.census_kinds(files).collect()}
    assert kinds[(1, "pak")] == (3, 19) and kinds[(1, "other")] == (3, 4) and kinds[(2, "pak")] == (2, 150)
    langs = {(r["root_id"], r["lang"]): r["bytes"] for r in I.census_languages(files).collect()}
    assert langs == {(1, "en-US"): 10, (1, "fr"): 35, (2, "fr"): 30}
    saved = {r["root_id"]: r["l10n_savings"] for r in I.l10n_savings(files).collect()}
    assert saved == {1: 10, 2: 0}
    assert {r["root_id"]: r["savings_pct"] for r in I.savings_pct(files).collect()} == {1: 15, 2: 0}
    report = {r["root_id"]: r for r in I.census_report(files).collect()}
    assert report[1]["languages"]["fr"]["size"] == 35 and report[2]["l10n_savings"] == 0


def test_top_files_break_ties_by_path_descending(files):
    top = I.top_files(files, 3).where("root_id = 1").orderBy("rank").collect()
    assert [(r["path"], r["rank"]) for r in top] == [("L10N/fr/a.ogg", 1), ("L10N/en-us/a.ogg", 2), ("y.pak", 3)]


def test_container_inventory(files):
    got = {(r["root_id"], r["path"]): (r["status"], r["reason"]) for r in I.container_status(files).collect()}
    assert got == {
        (1, "L10N/fr/b.pak"): ("readable", None), (1, "x.pak"): ("encrypted", None), (1, "y.pak"): ("signed", None),
        (2, "z.pak"): ("unreadable", "unsupported encryption"), (2, "z.PAK"): ("readable", None),
    }


def test_strip_plans(spark, files):
    loose = strip.plan_strip_loose(files, ["fr"]).collect()
    assert {(r["root_id"], r["path"]) for r in loose} == {(1, "L10N/fr/a.ogg"), (2, "L10N/fr/a.ogg")}
    entries = spark.createDataFrame([
        (1, "L10N/fr/b.pak", "Game\\L10N\\fr\\x", 1), (1, "L10N/fr/b.pak", "Game/L10N/fr/y", 1), (1, "x.pak", "Game/L10N/fr/x", 1),
        (2, "z.PAK", "Game/L10N/fr/x", 1), (2, "z.PAK", "Game/x", 1), (2, "z.PAK", "Game/L10N/de/x", 1), (2, "z.pak", "Game/L10N/fr/x", 1),
    ], "root_id long, container_path string, path string, size_bytes long")
    changes = {r["container_path"]: (r["dropped_entries"], r["kept_entries"], r["becomes_empty"]) for r in strip.plan_strip_containers(entries, files, ["fr"]).collect()}
    assert changes == {"L10N/fr/b.pak": (2, 0, True), "z.PAK": (1, 2, False)}
    assert strip.entries_by_status(entries, files).count() == 5
    skipped = {r["container_path"]: r["status"] for r in strip.plan_strip_skipped(files).collect()}
    assert skipped == {"x.pak": "encrypted", "y.pak": "signed", "z.pak": "unreadable"}
    todo = strip.plan_recompress(files).collect()
    assert [(r["path"], r["encoder"]) for r in todo] == [("t.PNG", "oxipng")]


def test_snapshot_diff(spark, files):
    after = files.where("path <> 't.PNG'").withColumn(
        "size_bytes", F.when(F.col("path") == "x.pak", 3).when(F.col("path") == "y.sig", 9).otherwise(F.col("size_bytes")))
    got = {(r["root_id"], r["path"]): (r["change"], r["saved_bytes"], r["no_improvement"]) for r in strip.snapshot_diff(files, after).collect()}
    assert got[(1, "t.PNG")] == ("deleted", 4, False) and got[(1, "x.pak")] == ("shrunk", 4, False)
    assert got[(1, "y.sig")] == ("grown", -8, True) and got[(2, "z.pak")] == ("unchanged", 0, True)


TEXTURES = [
    ("big", "T_big", "PF_DXT5", None, 4096, 4096, 13), ("small", "T_small_N", "PF_DXT1", None, 64, 64, 7),
    ("stub", "T_stub_lut", "PF_BC7", None, 2048, 2048, 1), ("none", "T_none", "PF_BC7", None, 0, 16, 3), ("nomips", "T_nm", "PF_BC7", None, 16, 16, 0),
]


@pytest.fixture(scope="module")
def textures(spark):
    return spark.createDataFrame(TEXTURES, "asset_path string, export_name string, pixel_format string, compression_settings string, size_x int, size_y int, num_mips int")


def test_mip_plans(textures):
    plan = {r["asset_path"]: r for r in mips.plan_mip_strip(textures, 1024).collect()}
    assert set(plan) == {"big", "small", "stub"}
    assert (plan["big"]["save_bytes"], plan["big"]["drop_mip_count"], plan["big"]["kept_mip_count"], plan["big"]["kept_mip0_dim"]) == (20_971_520, 2, 11, 1024)
    assert plan["small"]["save_bytes"] == 0 and plan["stub"]["save_bytes"] == 0 and plan["stub"]["kept_mip0_dim"] == 2048
    assert [r["asset_path"] for r in mips.reproject(textures, [1024]).collect()] == ["big"]
    sweep = {r["cap"]: r["textures"] for r in mips.reproject_totals(textures, [32, 1024]).collect()}
    assert sweep == {32: 2, 1024: 1}
    status = {r["asset_path"]: (r["status"], r["saved_bytes"]) for r in mips.strip_eligibility(textures, 1024).collect()}
    assert status == {"big": ("strip", 20_971_520), "small": ("already at or below cap", 0), "stub": ("no level small enough", 0)}
    assert [r["asset_path"] for r in mips.eligible_targets(textures, 32).collect()] == ["big"]
    kept = {r["asset_path"] for r in mips.eligible_targets(textures, 32, exempt_backup=False).collect()}
    assert kept == {"big", "small"}
    for cap in (0, 16385):
        with pytest.raises(ValueError):
            mips.plan_mip_strip(textures, cap)


def test_targets_without_a_class_stay(spark, textures):
    plan = mips.plan_mip_strip(textures, 32)
    classes = spark.createDataFrame([("small", "no_strip")], "asset_path string, restore_class string")
    assert {r["asset_path"] for r in mips.route_targets(plan, classes).collect()} == {"big", "stub"}


def entry(path, op, sha, size, payload, strips=None):
    return {"path": path, "op": op, "original_sha256": sha, "original_size": size, "payload": payload, **({"texture_strips": strips} if strips is not None else {})}


STRIP = {"asset_path": "A", "export_name": "T", "original_top_dim": 1024, "pixel_format": "PF_DXT1", "saved_bytes": 5}
ENTRIES = [
    entry("a", "replace", "h1", 100, "p1", [STRIP, {**STRIP, "compression_settings": "TC_Masks", "pixel_format": "PF_X"}]),
    entry("a", "replace", "h2", 90, "p2"), entry("b", "create", "", 0, ""), entry("b", "delete", "h3", 7, "p3"),
    entry("c", "replace", "h4", 5, "gone"), entry("c", "replace", "h5", 4, "p5"), entry("../d", "delete", "h6", 3, "p6"), entry("e", "replace", "h7", 2, "p7"),
]


@pytest.fixture(scope="module")
def manifest_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("manifests")
    for name in ("r1", "r2"):
        doc = {"version": 1, "created_at": 0, "root": name, "mode": "strip", "entries": ENTRIES if name == "r1" else ENTRIES[:1]}
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=1))
    return folder


def test_manifests(spark, manifest_dir):
    manifests = readers.read_manifest(spark, str(manifest_dir))
    ids = [r["manifest_id"] for r in manifests.collect()]
    assert sorted(i.split("/")[-1] for i in ids) == ["r1.json#r1#0", "r2.json#r2#0"]
    manifests = manifests.withColumn("manifest_id", F.col("root"))
    status = {r["manifest_id"]: (r["entry_count"], r["created_text"]) for r in M.manifest_status(manifests).collect()}
    assert status == {"r1": (8, "1970-01-01T00:00:00Z"), "r2": (1, "1970-01-01T00:00:00Z")}
    entries = M.explode_entries(manifests)
    assert {r["seq"]: len(r["texture_strips"]) for r in entries.where("manifest_id = 'r1'").collect()}[1] == 0
    payloads = spark.createDataFrame(
        [("r1", f"p{i}", f"h{i}") for i in (1, 2, 3, 5, 6)] + [("r1", "p7", "rotten"), ("r2", "p1", "h1")],
        "manifest_id string, payload string, payload_sha256 string")
    verified = M.verify_restore(entries, payloads)
    r1 = [r["status"] for r in verified.where("manifest_id = 'r1'").orderBy("seq").collect()]
    assert r1 == ["ok", "ok", "ok", "ok", "missing_payload", "ok", "escapes_root", "hash_mismatch"]
    replay = {(r["manifest_id"], r["path"]): (r["outcome"], r["sha256"], r["size_bytes"]) for r in M.replay_restore(verified).collect()}
    assert replay == {
        ("r1", "a"): ("restored", "h1", 100), ("r1", "b"): ("absent", None, None), ("r1", "c"): ("restored", "h5", 4),
        ("r1", "../d"): ("unchanged", None, None), ("r1", "e"): ("unchanged", None, None), ("r2", "a"): ("restored", "h1", 100),
    }
    strips = M.explode_strips(entries)
    classes = {r["compression_settings"]: (r["texture_count"], r["baseline_bytes"], r["projected_bytes"]) for r in M.project_classes(strips.where("manifest_id = 'r1'")).collect()}
    assert classes == {"none": (1, 524288, 104857), "TC_Masks": (1, 1048576, 104857)}
    saved = M.project_savings(entries, strips).where("manifest_id = 'r2'").first()
    assert (saved["current_bytes"], saved["projected_bytes"], saved["savings_bytes"]) == (100, 209714, 0)


def test_manifest_of_another_version_is_refused(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 2, "root": "x", "entries": []}))
    with pytest.raises(PySparkException):
        readers.read_manifest(spark, str(tmp_path)).collect()


def test_entries(spark):
    rows = spark.createDataFrame([
        (1, "p", "a/X.uasset", 5, False, False), (1, "p", "a/y.wav", 9, False, False), (1, "p", "b/z.png", 7, False, False),
        (1, "q", "b/k.uexp", 1, False, True), (2, "p", "b/o.dat", 2, True, False),
    ], schemas.ENTRIES)
    counts = {(r["root_id"], r["entry_class"]): r["entry_count"] for r in E.entry_class_counts(rows).collect()}
    assert counts == {(1, "package"): 1, (1, "audio"): 1, (1, "texture"): 1, (1, "payload"): 1, (1, "all"): 4, (2, "package"): 1, (2, "all"): 1}
    assert [r["path"] for r in E.search_entries(rows, "A/", top=1).collect()] == ["a/y.wav"]
    listed = readers.read_entries(rows, 2).collect()
    assert {(r["root_id"], r["container_path"]): r["truncated"] for r in listed} == {(1, "p"): True, (1, "q"): False, (2, "p"): False}
    assert sorted(r["path"] for r in listed if r["root_id"] == 1 and r["container_path"] == "p") == ["a/X.uasset", "a/y.wav"]


def test_scan_sees_hidden_names_and_empty_folders(spark, tmp_path):
    for name, size in (("_CommonRedist/vc.exe", 3), (".h/deep/er/x.bin", 5), ("top.txt", 1), ("a/b/c/d/e.pak", 7)):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    os.makedirs(tmp_path / "L/1.0")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    got = {(r["path"], r["is_dir"], r["size_bytes"]) for r in readers.scan_inventory(spark, [(4, str(tmp_path))]).collect()}
    assert {g for g in got if not g[1]} == {("_CommonRedist/vc.exe", False, 3), (".h/deep/er/x.bin", False, 5), ("top.txt", False, 1), ("a/b/c/d/e.pak", False, 7)}
    assert {g[0] for g in got if g[1]} == {"_CommonRedist", ".h", ".h/deep", ".h/deep/er", "a", "a/b", "a/b/c", "a/b/c/d", "L", "L/1.0"}


def test_hashing_candidates(spark, tmp_path):
    for name, text in (("a", b"same"), ("b", b"same"), ("c", b"diff"), ("d", b"longer")):
        (tmp_path / name).write_bytes(text)
    scanned = readers.scan_inventory(spark, [(1, str(tmp_path))])
    roots = spark.createDataFrame([(1, str(tmp_path))], "root_id long, root string")
    hashed = {r["path"]: r["content_sha256"] for r in readers.hash_files(I.size_collision_prefilter(scanned), roots).collect()}
    assert set(hashed) == {"a", "b", "c"} and hashed["a"] == hashed["b"] != hashed["c"]


def test_bench_round_trip(spark, tmp_path):
    row = ('c/"q",x.png', "L_Color", 8, 8, "rgba8", 1, 256, 100, 16, 116, 0.453125, True, 3.14159, "pixel")
    runs = spark.createDataFrame([row], schemas.BENCH)
    path = str(tmp_path / "bench")
    writers.write_bench_csv(runs, path)
    text = [line for name in os.listdir(path) if name.endswith(".csv") for line in open(os.path.join(path, name)).read().splitlines()]
    # Every part file starts with the header.
    assert sorted(set(text), reverse=True) == [",".join(schemas.BENCH.names), '"c/""q"",x.png",L_Color,8,8,rgba8,1,256,100,16,116,0.453125,true,3.1416,pixel']


def test_last_row_of_a_label_wins(spark, tmp_path):
    head = ",".join(schemas.BENCH.names)
    lines = [f'"p",{label},8,8,rgba8,1,256,{n},16,{n},0.5,true,1.0,pixel' for n, label in enumerate(["a", "b", "a", "c", "a", "b"])]
    (tmp_path / "bench.csv").write_text("\n".join([head, *lines]) + "\n")
    got = {r["label"]: r["residual_bytes"] for r in readers.read_bench(spark, str(tmp_path / "bench.csv")).collect()}
    assert got == {"a": 4, "b": 5, "c": 3}


def test_reports_are_written(spark, files, tmp_path):
    report = A.report_rows(files)
    writers.write_report_json(report, str(tmp_path / "json"))
    writers.render_report_markdown(report, str(tmp_path / "md"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert sorted(n for n in os.listdir(tmp_path / "md") if n.startswith("root_id")) == ["root_id=1", "root_id=2"]


def test_live_audit_finds_equal_files(spark, tmp_path):
    deep = tmp_path.joinpath(*[f"d{i}" for i in range(6)])
    deep.mkdir(parents=True)
    (deep / "one.bin").write_bytes(b"x" * (4 << 20))
    (tmp_path / "two.bin").write_bytes(b"x" * (4 << 20))
    (tmp_path / "three.bin").write_bytes(b"y" * (4 << 20))
    (tmp_path / "sealed.pak").write_bytes(b"z")
    found = {r["detector"]: r for r in D.findings(readers.hashed_inventory(spark, [(7, str(tmp_path))])).collect()}
    assert found["duplicate_content"]["reclaimable_bytes"] == 4 << 20
    scored = readers.audit_roots(spark, [(7, str(tmp_path))]).collect()
    assert [(r["root_id"], r["reclaimable_bytes"], r["access_blocked"]) for r in scored] == [(7, 4 << 20, False)]
    probes = spark.createDataFrame([(7, "sealed.pak", "pak is encrypted but no key was provided")], "root_id long, path string, probe_error string")
    assert readers.audit_roots(spark, [(7, str(tmp_path))], probes=probes).collect()[0]["access_blocked"]


def test_every_folder_is_a_work_item(spark, tmp_path):
    for i in range(20):
        (tmp_path / "top" / f"sub{i}").mkdir(parents=True)
        (tmp_path / "top" / f"sub{i}" / "f").write_text("a")
    scanned = readers.scan_inventory(spark, [(1, str(tmp_path))])
    assert scanned.count() == 41
    assert scanned.where("path LIKE 'top/sub%/f'").select(F.input_file_name()).distinct().count() > 1


def test_assets_take_their_strictest_class(spark):
    plan = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "asset_path string, save_bytes long")
    classes = spark.createDataFrame([("a", "ai_upscale"), ("a", "no_strip"), ("b", "exact_backup"), ("b", "ai_upscale"), ("c", "ai_upscale")],
                                    "asset_path string, restore_class string")
    assert [r["asset_path"] for r in mips.route_targets(plan, classes).collect()] == ["c"]
    assert {r["asset_path"] for r in mips.route_targets(plan, classes, exempt_backup=False).collect()} == {"b", "c"}


def test_two_manifests_of_one_root_stay_apart(spark, tmp_path):
    for name in ("x", "y"):
        doc = {"version": 1, "created_at": 5, "root": "r", "mode": "strip", "entries": [entry("a", "replace", f"h-{name}", 1, "p")]}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert M.explode_entries(readers.read_manifest(spark, str(tmp_path))).select("manifest_id").distinct().count() == 2


def test_strip_records_keep_their_fields(spark, tmp_path):
    strip_record = {"asset_path": "A", "export_name": "T", "original_top_dim": 4096, "stripped_top_dim": 1024, "drop_mip_count": 2, "kept_mip_count": 9,
                    "pixel_format": "PF_DXT5", "compression_settings": "TC_Masks", "saved_bytes": 77}
    doc = {"version": 1, "created_at": 5, "root": "r", "mode": "strip", "entries": [entry("a", "replace", "h", 1, "p", [strip_record])]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    row = M.explode_strips(M.explode_entries(readers.read_manifest(spark, str(tmp_path)))).first().asDict()
    assert {k: row[k] for k in strip_record} == strip_record


def test_search_is_capped_per_container(spark):
    rows = spark.createDataFrame([(1, c, f"{c}/L10N/fr/{i}.wav", i, False, False) for c in ("p", "q") for i in range(5)], schemas.ENTRIES)
    shown = E.search_entries(rows, "l10n", top=2).collect()
    assert sorted((r["container_path"], r["size_bytes"]) for r in shown) == [("p", 3), ("p", 4), ("q", 3), ("q", 4)]


def test_every_blocked_container_is_shown(spark):
    rows = [(1, f"p{i}.pak", False, 10, None, "pak is encrypted but no key was provided" if i % 2 else "unsupported pak version 99") for i in range(18)]
    files = spark.createDataFrame(rows, schemas.FILES)
    shown = D.evidence(files, ["encryption"]).collect()
    assert len(shown) == 18 and {r["note"] for r in shown} == {"encrypted", "unreadable"}
    ranked = A.rank_evidence(D.evidence(files, ["encryption"]), 3).collect()
    assert {r["more"] for r in ranked} == {15}


def test_access_of_empty_containers(spark):
    files = spark.createDataFrame([(1, "p.pak", False, 0, None, "pak is encrypted but no key was provided")], schemas.FILES)
    assert D.findings(files, ["encryption"]).first()["detail"] == "unreadable"
