"""One query per operator over the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heftmap import schemas
from heftmap.functions import numbers as N
from heftmap.functions import paths as P
from heftmap.functions import textures as T
from heftmap.operators import audit as A
from heftmap.operators import detectors as D
from heftmap.operators import entries as E
from heftmap.operators import folders as FO
from heftmap.operators import incremental as X
from heftmap.operators import inventory as I
from heftmap.operators import manifest as M
from heftmap.operators import neardup
from heftmap.operators import paired as Q
from heftmap.operators import raster as R
from heftmap.operators import table_functions as TF
from heftmap.operators import tiles as TI
from heftmap.operators.staging import fresh_path
from heftmap.plans import mips, strip
from heftmap.sources import inventory_source, manifest_split, manifest_versions, readers, writers
from workload import fixtures
from workload.fixtures import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DROP = ("fr", "de")
CAP = 512
CAPS = (256, 512, 1024, 2048)


def query(over: str | None = None):
    """Register a query under its function name; ``over`` names the view it reads."""

    def keep(build):
        if over is None:
            QUERIES[build.__name__] = build
        else:
            QUERIES[build.__name__] = lambda spark, sf_dir: build(view(spark, sf_dir, over))
        return build

    return keep


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# -- scalar expressions --------------------------------------------------------------


@query("files")
def f1_norm_path(files):
    return files.select("root_id", "path", P.norm_path(F.replace("path", F.lit("/"), F.lit("\\"))).alias("norm"))


@query("files")
def f2_ext(files):
    return files.select("root_id", "path", P.ext(F.col("path")).alias("ext"))


@query("files")
def f3_file_kind(files):
    return files.select("root_id", "path", P.file_kind(F.col("path")).alias("kind"))


@query("files")
def f4_detect_language(files):
    return files.select("root_id", "path", P.detect_language(F.col("path")).alias("lang"))


def _segments(files):
    return files.select(F.explode(F.split("path", "/")).alias("segment"))


@query("files")
def f5_is_language_code(files):
    code = P.is_language_code(F.col("segment"))
    return _segments(files).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).withColumn("is_code", code)


@query("files")
def f5b_is_satellite_code(files):
    code = P.is_satellite_code(F.col("segment"))
    return _segments(files).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).withColumn("is_code", code)


@query("files")
def f6_normalize_lang(files):
    code = F.regexp_extract("path", P.LANGUAGE_PATTERN, 1)
    return (
        files.select(code.alias("code")).where("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("lang", P.normalize_lang(F.col("code")))
    )


@query("files")
def f7_parse_version(files):
    version = P.parse_version(F.col("segment"))
    counted = _segments(files).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("segment", "n", F.array_join(version, ",").alias("version"))


@query("files")
def f8_parse_chunk(files):
    name = P.file_name(F.col("path"))
    return files.select("root_id", "path", P.chunk_id(name).alias("chunk_id"), P.is_patch_chunk(name).alias("is_patch"))


@query("files")
def f9_rule_match(files):
    path = F.col("path")
    ready = files.select(
        "root_id", "path", P.rooted(path).alias("rooted"), P.ext(path).alias("ext"), P.file_name(path).alias("name")
    ).withColumn("low_name", F.lower("name"))
    rooted, low_name = F.col("rooted"), F.col("low_name")
    return ready.select(
        "root_id", "path", D.leftover_reason(F.col("ext"), rooted).alias("leftover"),
        D.shader_family(F.col("name")).alias("family"), D.installer_reason(low_name, rooted).alias("installer"),
        D.binary_platform(rooted).alias("platform"), D.mod_suffix(low_name).alias("suffix"),
    )


@query("files")
def f10_container_status(files):
    return I.container_status(files)


@query("files")
def f11_format_bytes(files):
    return files.select("root_id", "path", N.format_bytes(F.col("size_bytes")).alias("text"))


@query("orders")
def f12_score_label(orders):
    score = F.pmod(F.col("o_orderkey"), F.lit(101))
    return orders.select("o_orderkey", score.alias("score"), N.score_label(score).alias("label"))


@query("tex")
def f13_bytes_for_mip(tex):
    size = T.bytes_for_mip(F.col("pixel_format"), F.col("size_x"), F.col("size_y"))
    return tex.select("tex_id", size.alias("top_bytes"))


@query("tex")
def f14_mip_chain(tex):
    chain = T.mip_chain(F.col("pixel_format"), F.col("size_x"), F.col("size_y"), F.col("num_mips"))
    return tex.select("tex_id", F.posexplode(chain).alias("level", "mip")).select("tex_id", "level", "mip.*")


@query("tex")
def f15_first_kept(tex):
    return mips.with_mips(tex).select("tex_id", T.first_kept(F.col("mips"), F.lit(CAP)).alias("level"))


@query("strips")
def f16_top_mip_bytes(strips):
    size = T.top_mip_bytes(F.col("original_top_dim"), F.col("pixel_format"))
    return strips.select("seq", size.alias("top_bytes"))


@query("tex")
def f17_restore_class(tex):
    facts = [F.col(c) for c in ("export_name", "compression_settings", "pixel_format")]
    return tex.select("tex_id", *[T.restore_class(*facts, policy).alias(policy) for policy in T.POLICIES])


@query("tex")
def f18_projection_ratio(tex):
    settings = F.col("compression_settings")
    return tex.select("tex_id", T.projection_ratio(settings).alias("ratio"), T.projection_basis(settings).alias("basis"))


@query("ben")
def f19_content_class(ben):
    return ben.select("label", "predictor", T.content_class(F.col("label")).alias("content_class"))


@query("ben")
def f20_split_name(ben):
    name = F.concat("label", F.lit(".png"))
    return ben.select("label", "predictor", T.label_suffix(name).alias("suffix"), T.split_name(name).alias("s")).select(
        "label", "predictor", "suffix", "s.material", "s.map_class"
    )


@query("files")
def f21_recompress_kind(files):
    kind = P.recompress_kind(F.col("path"))
    return files.select("root_id", "path", kind.alias("kind"), P.encoder_for(kind).alias("encoder"))


@query("ent")
def f22_entry_filter_class(ent):
    return E.classified(ent).select("root_id", "container_path", "path", "entry_class")


@query("pix")
def f23_quantize(pix):
    r = F.col("v") - 128
    return pix.select(
        "image_id", "x", "y", N.quantize(r, 1).alias("q1"), N.quantize(r, 4).alias("q4"),
        N.dequantize(N.quantize(r, 4), 4).alias("d4"), N.quantize(r, 5).alias("q5"),
    )


def _climbing(man):
    kind = F.pmod(F.col("seq"), F.lit(5))
    path = (
        F.when(kind == 0, F.concat(F.lit("../"), "path")).when(kind == 1, F.concat(F.lit("a/../"), "path"))
        .when(kind == 2, F.concat(F.lit("a/../../"), "path")).when(kind == 3, F.concat(F.lit("./a//../"), "path"))
        .otherwise(F.col("path"))
    )
    return man.select("seq", path.alias("path"))


@query("man")
def f24_path_escapes_root(man):
    return _climbing(man).withColumn("escapes", P.path_escapes_root(F.col("path")))


@query("documents")
def f25_has_magic(documents):
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    head = F.when(kind == 0, F.unhex(F.lit(P.SIGNATURES["png"]))).when(kind == 1, F.unhex(F.lit(P.SIGNATURES["ogg"])))
    content = F.concat(F.coalesce(head, F.unhex(F.lit(""))), F.encode("text", "UTF-8"))
    return documents.select(
        "doc_id", P.has_magic(content, "png").alias("is_png"), P.has_magic(content, "ogg").alias("is_ogg")
    )


@query("documents")
def f26_sha256_hex(documents):
    return documents.select("doc_id", P.sha256_hex(F.col("text")).alias("sha256"))


@query("events")
def f27_rfc3339(events):
    epoch = F.col("event_id") * 7919 + 1600000000
    return events.select("event_id", N.rfc3339(epoch).alias("text"))


@query("files")
def f28_cef_locale(files):
    name = P.file_name(F.col("path"))
    return files.where(P.is_embedded_browser(F.col("path"))).select(
        "root_id", "path", P.cef_locale(name).alias("locale"), P.is_keeper_locale(name).alias("keeper")
    )


@query("ben")
def f29_codec_space(ben):
    return ben.select("label", "predictor", T.codec_space(F.col("hp_energy")).alias("space"))


@query("files")
def f30_rel_posix(files):
    root = F.format_string("D:\\games\\root%d", F.col("root_id"))
    full = F.concat(root, F.lit("\\"), F.replace("path", F.lit("/"), F.lit("\\")))
    return files.select("root_id", full.alias("full_path"), P.rel_posix(full, root).alias("rel"))


# -- joins ---------------------------------------------------------------------------


@query("files")
def j1_with_siblings(files):
    return I.with_siblings(files).select("root_id", "path", "size_bytes", "has_sig", "has_utoc", "has_ucas")


@query("files")
def j2_satellite_dirs(files):
    return I.satellite_dirs(files)


def _sides(ben):
    return ben.where("predictor = 'bilinear'"), ben.where("predictor = 'learned'")


def _pairs(ben):
    return Q.oracle_rows(Q.require_pairs(Q.pair_benchmarks(*_sides(ben))))


@query("ben")
def j3_pair_benchmarks(ben):
    return Q.pair_benchmarks(*_sides(ben)).select("label", "content_class", "a_ratio", "b_ratio", "hp_energy")


def _per_predictor(ben, report):
    """A report over each predictor's runs, with its name beside."""
    names = ("bilinear", "learned")
    parts = [report(side).withColumn("predictor", F.lit(name)) for name, side in zip(names, _sides(ben))]
    return parts[0].unionByName(parts[1])


@query("ben")
def j4_threshold_sweep(ben):
    grid = _per_predictor(ben, lambda side: Q.grid_counts(side, "hp_energy", F.col("ratio") >= 1.0))
    return _rounded(grid.select("predictor", "step", "threshold", "correct"), "threshold")


@query("near_pixels")
def j5_near_dup_pairs(near_pixels):
    return neardup.near_hash_pairs(R.average_hash(near_pixels))


@query("tex")
def j6_route_targets(tex):
    plan = mips.plan_mip_strip(tex, CAP).select("tex_id", "asset_path", "save_bytes")
    # Every seventh asset has no class, as when routing ran over a part of the plan.
    classes = mips.plan_restore(tex.where("tex_id % 7 <> 0"))
    return mips.route_targets(plan, classes).select("tex_id", "asset_path", "save_bytes", "restore_class")


@query("files")
def j7_size_collision_prefilter(files):
    return I.size_collision_prefilter(files, D.MIN_DUPLICATE_SIZE).select("root_id", "path", "size_bytes")


@query("files")
def j8_patch_to_base(files):
    return I.patch_to_base(files)


@query()
def j9_entries_by_status(spark, sf_dir):
    readable = strip.entries_by_status(view(spark, sf_dir, "ent"), view(spark, sf_dir, "files"))
    return readable.select("root_id", "container_path", "path", "size_bytes")


def _payload():
    """Created files have none."""
    return F.when(F.col("op") == "create", "").otherwise(F.concat(F.lit("p"), "seq"))


def _manifest_tables(spark, sf_dir):
    man = view(spark, sf_dir, "man").withColumns({"manifest_id": F.lit("m"), "payload": _payload()})
    # Payload files of every 89th entry are gone.
    payloads = man.where("seq % 89 <> 0 AND op <> 'create'").select("manifest_id", "payload", "payload_sha256")
    # Every 83rd entry names a path outside its root.
    path = F.when(F.pmod("seq", F.lit(83)) == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    entries = man.drop("payload_sha256").withColumn("path", path)
    return entries, payloads


@query()
def j10_verify_manifest(spark, sf_dir):
    return M.verify_manifest(*_manifest_tables(spark, sf_dir)).drop("manifest_id")


# -- census --------------------------------------------------------------------------


@query("files")
def c1_census_totals(files):
    return I.census_totals(files)


@query("files")
def c2_census_kinds(files):
    return I.census_kinds(files)


@query("files")
def c3_census_languages(files):
    return I.census_languages(files)


@query("files")
def c4_l10n_savings(files):
    return I.l10n_savings(files)


@query("files")
def c5_top_files(files):
    return I.top_files(files)


@query("files")
def c6_container_inventory(files):
    return I.container_inventory(files)


@query("files")
def c7_savings_pct(files):
    return I.savings_pct(files)


@query("files")
def c8_languages_ranked(files):
    return I.languages_ranked(files)


@query("files")
def census_report(files):
    flat = ["pak_files", "texture_files", "audio_files"]
    return I.census_report(files).select(
        "root_id", "file_count", "total_bytes",
        *[F.col(f"{k}.count").alias(f"{k}_count") for k in flat], *[F.col(f"{k}.size").alias(f"{k}_bytes") for k in flat],
        F.size("languages").alias("languages"), "l10n_savings",
    )


@query("files")
def census_full(files):
    report = I.full_census(files)
    listed = report.select("root_id", "l10n_savings", "containers", F.explode("top_files").alias("f"))
    status = lambda s: F.coalesce(F.try_element_at("containers", F.lit(s))["container_count"], F.lit(0)).alias(s)
    return listed.select("root_id", "l10n_savings", "f.*", *map(status, ("readable", "encrypted", "iostore", "signed", "unreadable")))


@query("tree")
def folder_sizes(tree):
    return FO.folder_sizes(tree)


@query("tree")
def heaviest_folders(tree):
    return FO.heaviest_folders(tree, 10)


# -- audit ---------------------------------------------------------------------------

FINDING = ("root_id", "detector", "severity", "item_count", "group_count", "total_bytes", "reclaimable_bytes", "detail")


def _detector_query(number: int, name: str) -> None:
    def run(spark, sf_dir):
        return D.findings(view(spark, sf_dir, "files"), [name]).select(*FINDING)

    QUERIES[f"d{number}_{name}"] = run


for _number, _name in enumerate(D.ROSTER, start=1):
    _detector_query(_number, _name)


@query("files")
def d_evidence(files):
    return D.evidence(files)


@query("files")
def d5_pak_access(files):
    return D.pak_access(files)


def _findings(files):
    return D.findings(files)


@query("files")
def a1_union_findings(files):
    flat = [d for d in D.ROSTER if d not in D.FILE_LISTING]
    return A.union_findings([D.findings(files, flat), D.findings(files, D.FILE_LISTING)]).select(*FINDING)


@query("files")
def a2_findings_by_severity(files):
    return A.findings_by_severity(_findings(files))


@query("files")
def a3_reclaimable_by_category(files):
    return A.reclaimable_by_category(_findings(files))


@query("files")
def a4_reclaimable_total_pct(files):
    audit = A.audit(files).select("root_id", "total_bytes", "reclaimable_bytes", "reclaimable_pct")
    return _rounded(audit, "reclaimable_pct")


@query("files")
def a5_bloat_score(files):
    return A.audit(files).select("root_id", "score", "score_label")


@query("files")
def a6_rank_evidence(files):
    return A.rank_evidence(D.evidence(files), A.MARKDOWN_EVIDENCE)


@query("files")
def a7_category_table(files):
    return A.category_table(_findings(files))


@query("files")
def a8_detector_error_finding(files):
    roster = {
        "large_chunk": lambda f: D.findings(f, ["large_chunk"]),
        "duplicate_content": lambda f: D.findings(f.drop("content_sha256"), ["duplicate_content"]),
        "cef_locales": lambda f: D.findings(f, ["cef_locales"]),
    }
    return A.guarded_findings(files, roster).select("root_id", "detector", "category", "severity", "item_count")


@query("files")
def a8_isolated_findings(files):
    """Content hashes of some rows cannot be read: their detector fails in its tasks, the other twelve do not."""
    spoilt = F.when(F.col("size_bytes") == 4194304 + 7 * 1048576, F.raise_error(F.lit("no hash"))).otherwise(F.col("content_sha256"))
    roster = {**dict.fromkeys(D.ROSTER), "duplicate_content": lambda f: D.findings(f.withColumn("content_sha256", spoilt), ["duplicate_content"])}
    return A.isolated_findings(files, roster).select("root_id", "detector", "category", "severity", "item_count", "reclaimable_bytes")


@query("tree")
def d_rule_from_sql(tree):
    """A detector of one's own, called from SQL."""
    spark = tree.sparkSession
    TF.register(spark, TF.Rule("raw_audio", TF.ends_in("wav", "flac", "obj"), warn_at=schemas.MIB))
    tree.createOrReplaceTempView("tree_files")
    return spark.sql("SELECT * FROM audit_rule(TABLE(tree_files) PARTITION BY (root_id), 'raw_audio')")


@query("tree")
def d2_stale_version_dir_empty(tree):
    """Version folders that hold no file count through their own rows."""
    return D.findings(tree, ["stale_version_dir"]).select(*FINDING)


@query("files")
def a9_audit(files):
    return _rounded(A.audit(files), "reclaimable_pct")


def _updated(spark, sf_dir):
    """Audit state of the inventory, brought forward by two sets of changes."""
    files, after, moved = (view(spark, sf_dir, n) for n in ("files", "after_files", "moved_files"))
    return X.update(X.update(X.start(files), X.changes(files, after)), X.changes(after, moved))


@query()
def a9_incremental_audit(spark, sf_dir):
    return _rounded(_updated(spark, sf_dir).audit(), "reclaimable_pct")


@query()
def a1_incremental_findings(spark, sf_dir):
    return _updated(spark, sf_dir).findings.select(*FINDING)


# -- plans ---------------------------------------------------------------------------


@query("files")
def p1_plan_strip_loose(files):
    return strip.plan_strip_loose(files, DROP)


@query("files")
def p1_plan_strip_totals(files):
    return strip.plan_strip_totals(files, DROP)


@query()
def p2_plan_strip_containers(spark, sf_dir):
    return strip.plan_strip_containers(view(spark, sf_dir, "ent"), view(spark, sf_dir, "files"), DROP)


@query("files")
def p3_plan_strip_skipped(files):
    return strip.plan_strip_skipped(files)


@query("files")
def p4_plan_recompress(files):
    return strip.recompress_totals(files)


PLAN = ("tex_id", "asset_path", "current_mip0_dim", "kept_mip0_dim", "drop_mip_count", "kept_mip_count",
        "save_bytes", "original_bytes")


@query("tex")
def p5_plan_mip_strip(tex):
    return mips.plan_mip_strip(tex, CAP).select(*PLAN)


@query("tex")
def p6_mip_strip_totals(tex):
    return mips.mip_strip_totals(mips.plan_mip_strip(tex, CAP))


@query("tex")
def p7_reproject(tex):
    return mips.reproject(tex, CAPS).select("cap", *PLAN)


@query("tex")
def p7_reproject_totals(tex):
    return mips.reproject_totals(tex, CAPS)


@query("tex")
def p7_savings_curve(tex):
    return mips.savings_curve(tex)


@query("tex")
def p7_savings_curve_by_format(tex):
    return mips.savings_curve(tex, ["pixel_format"])


@query("tex")
def p7_savings_at(tex):
    """The curve at the caps of p7_reproject_totals."""
    return mips.savings_at(mips.savings_curve(tex), CAPS)


@query("tex")
def p7_mildest_cap(tex):
    """The largest cap of every format that frees a tenth, a half and nine tenths of its bytes, and one byte more than there are."""
    curve = mips.savings_curve(tex, ["pixel_format"])
    total = mips.with_mips(tex).groupBy("pixel_format").agg(F.sum(T.total_mip_bytes(F.col("mips"))).alias("total"))
    shares = F.array(*[F.call_function("div", F.col("total") * k, F.lit(10).cast("bigint")) for k in (1, 5, 9)], F.col("total") + 1)
    wanted = total.select("pixel_format", F.explode(shares).alias("save_at_least"))
    return mips.mildest_cap(curve, wanted, ["pixel_format"])


@query("tex")
def p8_format_breakdown(tex):
    return mips.format_breakdown(mips.plan_mip_strip(tex, CAP))


@query("tex")
def p9_class_histogram(tex):
    # Settings stand in for export classes, which the tables do not have.
    named = tex.withColumn("class_name", F.coalesce("compression_settings", F.lit("none")))
    return mips.class_histogram(named)


@query("tex")
def p10_plan_restore(tex):
    return mips.restore_counts(mips.plan_restore(tex))


@query("tex")
def p11_eligible_targets(tex):
    return mips.eligible_targets(tex, CAP).select("tex_id", "asset_path", "restore_class", "save_bytes", "kept_mip0_dim")


@query("tex")
def p12_strip_eligibility(tex):
    # Two caps, so that both reasons to skip occur.
    parts = [mips.strip_eligibility(tex, cap).withColumn("cap", F.lit(cap)) for cap in (32, 128)]
    return parts[0].unionByName(parts[1]).select("cap", "tex_id", "status", "saved_bytes")


@query("tex")
def p13_skip_histogram(tex):
    return mips.skip_histogram(mips.strip_eligibility(tex, 32).unionByName(mips.strip_eligibility(tex, 128)))


@query()
def p14_snapshot_diff(spark, sf_dir):
    return strip.snapshot_diff(view(spark, sf_dir, "files"), view(spark, sf_dir, "after_files"))


@query()
def p14_snapshot_diff_totals(spark, sf_dir):
    return strip.snapshot_diff_totals(view(spark, sf_dir, "files"), view(spark, sf_dir, "after_files"))


# -- change manifests ----------------------------------------------------------------


STRIP_FIELDS = schemas.STRIP_RECORD.names


def _manifest_entries(spark, sf_dir):
    strips = view(spark, sf_dir, "strips").groupBy("seq").agg(F.collect_list(F.struct(*STRIP_FIELDS)).alias("texture_strips"))
    man = view(spark, sf_dir, "man").join(strips, "seq", "left")
    return man.select("seq", "path", F.struct("path", "op", "original_sha256", "original_size", _payload().alias("payload"), "texture_strips").alias("entry"))


def _manifest_documents(spark, sf_dir):
    """Manifests of at most 1000 entries each, several of them per root, as JSON documents."""
    cut = _manifest_entries(spark, sf_dir).withColumns({"root": F.col("path"), "part": F.floor(F.col("seq") / 1000)})
    docs = cut.groupBy("root", "part").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("entry").alias("e")))).alias("entries"), F.min("seq").alias("created_at"))
    return docs.select(
        F.lit(1).alias("version"), (F.col("created_at") + 1600000000).alias("created_at"), "root",
        F.lit("full").alias("mode"), F.transform("entries", lambda e: e["e"]).alias("entries"),
    )


def _read_manifests(spark, sf_dir):
    path = fresh_path(spark, "manifests")
    _manifest_documents(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return readers.read_manifest(spark, path, one_per_line=True)


def _known_by(manifest_rows):
    """The part of a manifest's id that does not depend on where the query wrote it: root and creation time."""
    parts = F.split("manifest_id", "#")
    return manifest_rows.withColumn("manifest_id", F.concat_ws("#", F.element_at(parts, -2), F.element_at(parts, -1)))


@query()
def b1_manifest_status(spark, sf_dir):
    return _known_by(M.manifest_status(_read_manifests(spark, sf_dir))).drop("created_at")


@query()
def b2_explode_strips(spark, sf_dir):
    strips = M.explode_strips(M.explode_entries(_read_manifests(spark, sf_dir)))
    return _known_by(strips).select("manifest_id", "seq", "path", "original_size", "strip_seq", *STRIP_FIELDS)


@query()
def b3_replay_restore(spark, sf_dir):
    return M.replay_restore(M.verify_restore(*_manifest_tables(spark, sf_dir))).drop("manifest_id")


@query()
def b4_verify_restore(spark, sf_dir):
    return M.verify_restore(*_manifest_tables(spark, sf_dir)).select("seq", "path", "op", "status")


def _strips(spark, sf_dir):
    return view(spark, sf_dir, "strips").withColumn("manifest_id", F.lit("m"))


@query()
def b5_project_savings(spark, sf_dir):
    entries, _ = _manifest_tables(spark, sf_dir)
    return _rounded(M.project_savings(entries, _strips(spark, sf_dir)).drop("manifest_id"), "ratio")


@query()
def b5_project_classes(spark, sf_dir):
    return M.project_classes(_strips(spark, sf_dir)).drop("manifest_id", "basis")


# -- paired benchmarks ---------------------------------------------------------------


@query("ben")
def q1_oracle_rows(ben):
    return _pairs(ben).select("label", "oracle_ratio", "winner")


MEDIANS = ("a_median", "b_median", "oracle_median")


@query("ben")
def q2_oracle_summary(ben):
    return _rounded(Q.oracle_summary(_pairs(ben)), *MEDIANS)


@query("ben")
def q3_oracle_by_class(ben):
    return _rounded(Q.oracle_by_class(_pairs(ben)), *MEDIANS)


@query("ben")
def q4_oracle_lift(ben):
    return _rounded(Q.oracle_lift(Q.oracle_summary(_pairs(ben))), "best_forced_median", "oracle_median", "lift_abs", "lift_pct")


@query("ben")
def q5_feature_range_by_winner(ben):
    return _rounded(Q.feature_range_by_winner(_pairs(ben)), "feature_median")


@query("ben")
def q6_best_threshold(ben):
    best = Q.best_threshold(_pairs(ben), "hp_energy", F.col("winner") == "learned")
    return _rounded(best, "threshold", "accuracy", "majority")


@query("ben")
def q7_router_gate(ben):
    return _rounded(_per_predictor(ben, Q.router_gate), "always_codec", "perfect", "headroom", "value_vs_backup")


@query("ben")
def q8_grid_threshold(ben):
    best = _per_predictor(ben, lambda side: Q.grid_threshold(side, "hp_energy", F.col("ratio") >= 1.0))
    return _rounded(best, "threshold", "accuracy", "majority")


@query("ben")
def q9_mean_cost_by_class(ben):
    return _rounded(_per_predictor(ben, Q.mean_cost_by_class), "mean_cost")


def _residual_runs(ben):
    return ben.select(
        "label", F.col("baseline_bytes").alias("top_bytes"),
        F.floor(F.col("ratio") * F.col("baseline_bytes")).alias("residual_bytes"), F.col("lossless").alias("byte_exact"),
    )


@query("ben")
def q10_residual_accounting(ben):
    return _rounded(Q.residual_accounting(_residual_runs(ben)), "mean_sidecar")


@query("ben")
def q10_residual_accounting_by_class(ben):
    return _rounded(Q.residual_accounting_by_class(_residual_runs(ben)), "mean_sidecar")


def _stepped_runs(ben):
    step = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.pmod(F.length("label"), F.lit(3)) + 1).cast("int"))
    return ben.select(F.col("label").alias("sample"), "predictor", step.alias("quant_step"), "ratio", F.col("lossless").alias("byte_exact"))


@query("ben")
def q11_best_lossless(ben):
    return _rounded(Q.best_lossless(_stepped_runs(ben)), "best_ratio")


@query("ben")
def q12_lossless_rate(ben):
    return _rounded(Q.lossless_rate(_stepped_runs(ben)), "rate")


# -- rasters -------------------------------------------------------------------------


@query("pixels")
def r1_high_pass_energy(pixels):
    return _rounded(R.high_pass_energy(pixels), "hp_energy")


@query("pixels")
def r2_patch_variance(pixels):
    # Twelve places hold these variances exactly, so no rounding tie can fall either way.
    return R.patch_variance(pixels, patch=4).withColumn("patch_variance", F.round("patch_variance", 12))


@query("pixels")
def r3_codec_space_route(pixels):
    return _rounded(R.codec_space_route(pixels), "hp_energy")


@query("near_pixels")
def r4_average_hash(near_pixels):
    return R.average_hash(near_pixels)


@query("documents")
def r5_exact_duplicates(documents):
    return R.exact_duplicates(documents, "text")


@query("near_pixels")
def r6_near_duplicates(near_pixels):
    return neardup.near_duplicates(R.average_hash(near_pixels))


@query("ben")
def r7_multimap_groups(ben):
    # Materials by kind of surface, so that groups have several maps.
    kind = F.concat_ws("_", F.regexp_extract("label", "^[A-Za-z]+", 0), T.label_suffix(F.col("label")))
    return R.multimap_groups(ben.select(kind.alias("label")))


@query("pixels")
def r8_box_downsample(pixels):
    return R.box_downsample(pixels)


@query("pixels")
def r8_box_downsample_4x(pixels):
    return R.box_downsample(pixels, times=2)


@query("pixels")
def r9_bilinear_upsample(pixels):
    return R.bilinear_upsample(pixels, 2)


def _prediction(pixels):
    return R.bilinear_upsample(R.box_downsample(pixels), 2)


@query("pixels")
def r10_residual(pixels):
    return R.residual(pixels, _prediction(pixels), 2).select("image_id", "x", "y", "r_pred", "r_q")


@query("pixels")
def r11_reconstruct_check(pixels):
    return R.reconstruct_check(R.residual(pixels, _prediction(pixels), 4), 4)


@query("pixels")
def r12_shannon_entropy(pixels):
    symbols = R.residual_symbols(R.residual(pixels, _prediction(pixels)))
    return _rounded(R.shannon_entropy(symbols), "entropy_bits")


@query("pixels")
def r13_crop_to_multiple(pixels):
    return R.crop_to_multiple(pixels, 3).select("image_id", "x", "y", "r")


@query("tex")
def r14_mip_table(tex):
    return mips.mip_table(tex).select("asset_path", "mip_count", "total_bytes", "mip_index", "w", "h", "bytes")


# -- rasters as tiles: images of many sizes, three different channels ------------------


def _lines(tiles, channels=("r", "g", "b")):
    """Every line of every image as sums that depend on where each value stands."""
    return TI.line_sums(tiles, channels)


def _tile_prediction(tiles):
    return TI.bilinear_upsample(TI.box_downsample(tiles), 2)


@query("ras")
def r1_tiles_high_pass_energy(ras):
    return _rounded(TI.high_pass_energy(TI.to_tiles(ras)), "hp_energy")


@query("ras")
def r2_tiles_patch_variance(ras):
    """Four patch sizes from one table of summed areas."""
    return TI.patch_variances(TI.summed_area(TI.to_tiles(ras)), (4, 8, 16, 32))


@query("ras")
def r4_tiles_average_hash(ras):
    return TI.average_hash(TI.summed_area(TI.to_tiles(ras), "weighted"))


@query("ras")
def r8_tiles_box_downsample(ras):
    return _lines(TI.box_downsample(TI.to_tiles(ras)))


@query("ras")
def r8_tiles_box_downsample_4x(ras):
    return _lines(TI.box_downsample(TI.to_tiles(ras), times=2))


@query("ras")
def r9_tiles_bilinear_upsample(ras):
    return _lines(_tile_prediction(TI.to_tiles(ras)))


@query("ras")
def r10_tiles_residual(ras):
    tiles = TI.to_tiles(ras)
    return _lines(TI.residual(TI.crop_to_multiple(tiles, 2), _tile_prediction(tiles), 2), ("r_pred", "r_q", "g_q", "b_q"))


@query("ras")
def r11_tiles_reconstruct_check(ras):
    tiles = TI.to_tiles(ras)
    return TI.reconstruct_check(TI.residual(TI.crop_to_multiple(tiles, 2), _tile_prediction(tiles), 4), 4)


@query("ras")
def r12_tiles_shannon_entropy(ras):
    tiles = TI.to_tiles(ras)
    return _rounded(TI.shannon_entropy(TI.residual(TI.crop_to_multiple(tiles, 2), _tile_prediction(tiles))), "entropy_bits")


@query("ras")
def r13_tiles_crop_to_multiple(ras):
    return _lines(TI.crop_to_multiple(TI.to_tiles(ras), 5))


# -- entry browser -------------------------------------------------------------------


@query("ent")
def e1_entry_class_counts(ent):
    return E.entry_class_counts(ent)


@query("ent")
def e2_search_entries(ent):
    # A small limit, so that many containers have more hits than are shown.
    found = E.search_entries(ent, " L10n/FR ", top=2)
    return found.select("root_id", "container_path", "path", "size_bytes", "entry_class", "position")


# -- sources and sinks ---------------------------------------------------------------


@query()
def s1_scan_inventory(spark, sf_dir):
    path = fresh_path(spark, "inventory")
    view(spark, sf_dir, "files").write.option("header", True).csv(path)
    return readers.read_inventory(spark, path, "csv").select("root_id", "path", "size_bytes", "content_sha256", "probe_error")


@query()
def s1_inventory_source(spark, sf_dir):
    """Trees of sparse files, written by tasks and read by the data source, filters included."""
    base = fixtures.folder_tree(view(spark, sf_dir, "tex"))
    inventory_source.register(spark)
    files = spark.read.format("inventory").schema("path string, root_id long, is_dir boolean, size_bytes long").option(
        "roots", json.dumps([[i, f"{base}/{i}"] for i in range(3)])).load()
    return files.where(F.col("path").startswith("Game/Content/") & (F.col("root_id") < 2) & (F.col("is_dir") | (F.col("size_bytes") >= 1000)))


@query("ent")
def s2_read_entries(ent):
    return readers.read_entries(ent, 3).select("root_id", "container_path", "path", "position", "truncated")


def _bench_runs(ben):
    ratio = F.col("ratio")
    # Runs of one label lie in one file, the learned run last, so that reading keeps it.
    return ben.repartition("label").sortWithinPartitions("label", "predictor").select(
        F.concat(F.lit("corpus/"), "label", F.lit(".png")).alias("path"), "label", F.lit(512).alias("w"),
        F.lit(512).alias("h"), F.lit("rgba8").alias("format"), F.lit(1).alias("quant_step"), "baseline_bytes",
        F.floor(ratio * F.col("baseline_bytes")).alias("residual_bytes"), F.lit(65536).cast("bigint").alias("low_mip_bytes"),
        F.floor(ratio * F.col("baseline_bytes") + 65536).alias("total_codec_bytes"), ratio.alias("ratio_vs_baseline"),
        F.col("lossless").alias("lossless_pass"), "hp_energy", T.codec_space(F.col("hp_energy")).alias("recommended_space"),
    )


def _written_bench(ben):
    path = fresh_path(ben.sparkSession, "bench")
    writers.write_bench_csv(_bench_runs(ben), path)
    return path


@query("ben")
def s3_read_bench(ben):
    return readers.read_bench(ben.sparkSession, _written_bench(ben))


@query()
def s4_read_manifest(spark, sf_dir):
    entries = M.explode_entries(_read_manifests(spark, sf_dir))
    return _known_by(entries).select(
        "manifest_id", "seq", "path", "op", "original_sha256", "original_size", "payload",
        F.size("texture_strips").alias("strips"),
    )


def _mixed_documents(spark, sf_dir):
    """The manifests, every third of a later version with a field of its own, and one text per manifest that is none."""
    path = fresh_path(spark, "mixed-manifests")
    docs = _manifest_documents(spark, sf_dir)
    later = F.pmod("created_at", F.lit(3)) == 0
    texts = docs.select(F.when(later, F.to_json(F.struct(F.lit(3).alias("version"), *docs.columns[1:], F.lit("new").alias("tool")))).otherwise(F.to_json(F.struct("*"))).alias("value"))
    broken = docs.select(F.concat(F.lit('{"version": 1, "root": "'), "root", F.lit('", "created_at": '), "created_at", F.lit(', "entries": [{"op": 1}]}')).alias("value"))
    texts.unionByName(broken).write.text(path)
    return manifest_versions.read_documents(spark, path, one_per_line=True)


@query()
def s4_mixed_versions(spark, sf_dir):
    good = manifest_versions.good_manifests(_mixed_documents(spark, sf_dir))
    tool = F.variant_get("document", "$.tool", "string").alias("tool")
    return _known_by(good).select("manifest_id", "version", "mode", tool, F.size("entries").alias("entry_count"))


@query()
def s4_refused_documents(spark, sf_dir):
    return manifest_versions.refused_documents(_mixed_documents(spark, sf_dir)).groupBy("version", "reason").agg(F.count(F.lit(1)).alias("documents"))


@query()
def s4_read_manifest_split(spark, sf_dir):
    """All entries as one document in one file, read in ranges of 128 KiB."""
    entries = _manifest_entries(spark, sf_dir)
    lines = entries.select("seq", F.concat(F.when(F.col("seq") == F.lit(entries.agg(F.min("seq")).first()[0]), "").otherwise(","), F.to_json(F.struct("entry.*"))).alias("line"))
    ends = spark.createDataFrame([(-1, '{"version": 1, "created_at": 7, "root": "r", "notes": [{"a": "]}"}], "mode": "full", "entries": ['), (1 << 60, "]}")], "seq long, line string")
    path = fixtures.one_text_file(lines.unionByName(ends), "seq")
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 10))
    try:
        rows = manifest_split.read_manifest_entries(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    return rows.select("root", "created_at", "seq", "path", "op", "original_sha256", "original_size", "payload", F.size("texture_strips").alias("strips"))


@query("files")
def s5_write_report_json(files):
    path = fresh_path(files.sparkSession, "report-json")
    writers.write_report_json(A.report_rows(files), path)
    finding = "struct<detector:string,severity:string,recommendation:string,more:long,evidence:array<struct<rank:int,path:string,size_bytes:long,note:string>>>"
    back = files.sparkSession.read.schema(
        f"root_id long, total_bytes long, reclaimable_bytes long, score int, schema_version int, detectors array<string>, findings array<{finding}>"
    ).json(path)
    found = back.select("root_id", "total_bytes", "reclaimable_bytes", "score", "schema_version", F.size("detectors").alias("roster"), F.explode("findings").alias("f"))
    return found.select(
        *found.columns[:-1], "f.detector", "f.severity", (F.length("f.recommendation") > 0).alias("advised"), "f.more",
        F.explode_outer("f.evidence").alias("e")).select("*", "e.*").drop("e")


@query("files")
def s6_render_report_markdown(files):
    """The documents' lines that carry results, without sizes and texts of our own; "more" lines with their finding."""
    documents = A.report_markdown(A.report_rows(files))
    blocks = documents.select("root_id", F.explode(F.split("markdown", "\n\n")).alias("block"))
    detector = F.regexp_extract("block", r"Detector: `(\w+)`", 1)
    lines = blocks.select("root_id", detector.alias("detector"), F.explode(F.split("block", "\n")).alias("line"))
    kinds = {
        "score": (r"^Score: .*$", F.col("line")),
        "finding": (r"^### \[", F.regexp_extract("line", r"^(### \[\w+\])", 1)),
        "category": (r"^\| \w+ \| [\d.]+ \w+ \|$", F.regexp_extract("line", r"^(\| \w+ \|)", 1)),
        "evidence": (r"^- `", F.regexp_replace("line", r"`: [\d.]+ \w+ _", "` _")),
        "more": (r"^- … and ", F.concat("line", F.lit(" of "), "detector")),
    }
    parts = [lines.where(F.col("line").rlike(pattern)).select("root_id", F.lit(kind).alias("kind"), shown.alias("line")) for kind, (pattern, shown) in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("ben")
def s7_write_bench_csv(ben):
    return ben.sparkSession.read.text(_written_bench(ben)).where("value NOT LIKE 'path,label,%'")
