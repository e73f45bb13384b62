"""DuckDB SQL giving the same rows as every query, written independently of the operators."""

from __future__ import annotations

import re

from workload.fixtures import duck_views

ORACLES: dict[str, str] = {}

NAME = "regexp_extract(path, '[^/]*$')"
RAW_EXT = f"regexp_extract({NAME}, '^.+[.]([^.]*)$', 1)"
EXT = f"lower({RAW_EXT})"
PARENT = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
STEM = "regexp_replace(path, '([^/])[.][^./]*$', '\\1')"
LOW = "('/' || lower(path))"
CEF = f"(contains({LOW}, '/cef3/') OR contains({LOW}, '/cef/'))"
KIND = f"""CASE WHEN {EXT} IN ('pak','utoc','ucas') AND NOT {CEF} THEN 'pak'
  WHEN {EXT} IN ('dds','png','tga','bmp','jpg','jpeg') THEN 'texture'
  WHEN {EXT} IN ('wav','ogg','opus','mp3','flac') THEN 'audio' ELSE 'other' END"""
CODE_PATTERN = "(?i:(?:^|/)(?:l10n|localization))/(?:[^/]+/)*?([a-z]{2,3}(?:-[A-Za-z]{2,4})?)(?:/|$)"
RAW_CODE = f"regexp_extract(path, '{CODE_PATTERN}', 1)"


def _lang(code: str) -> str:
    tail = f"split_part({code}, '-', 2)"
    return f"""CASE WHEN {code} = '' THEN NULL WHEN NOT contains({code}, '-') THEN {code}
      WHEN length({tail}) = 4 THEN split_part({code}, '-', 1) || '-' || upper({tail}[1]) || lower({tail}[2:])
      ELSE split_part({code}, '-', 1) || '-' || upper({tail}) END"""


LANG = _lang(RAW_CODE)


def _status(has_sig: str) -> str:
    return f"""CASE WHEN {has_sig} THEN 'signed' WHEN probe_error IS NULL THEN 'readable'
      WHEN contains(lower(probe_error), 'unsupported') THEN 'unreadable'
      WHEN contains(lower(probe_error), 'encrypt') OR contains(lower(probe_error), 'aes') THEN 'encrypted'
      ELSE 'unreadable' END"""


def _text(n: str) -> str:
    return f"""CASE WHEN {n} >= 1099511627776 THEN printf('%.2f TB', {n} / 1099511627776.0::DOUBLE)
      WHEN {n} >= 1073741824 THEN printf('%.2f GB', {n} / 1073741824.0::DOUBLE)
      WHEN {n} >= 1048576 THEN printf('%.2f MB', {n} / 1048576.0::DOUBLE)
      WHEN {n} >= 1024 THEN printf('%.2f KB', {n} / 1024.0::DOUBLE) ELSE printf('%d B', {n}) END"""


def oracle(name: str, sql: str, *views: str) -> None:
    prefix = duck_views(*views) if views else ""
    sql = sql.strip()
    if prefix and sql.upper().startswith("WITH "):
        sql = ", " + sql[5:]
    ORACLES[name] = f"{prefix}\n{sql}" if prefix else sql


# -- scalar expressions --------------------------------------------------------------

oracle("f1_norm_path", "SELECT root_id, path, lower(path) AS norm FROM files", "files")
oracle("f2_ext", f"SELECT root_id, path, {EXT} AS ext FROM files", "files")
oracle("f3_file_kind", f"SELECT root_id, path, {KIND} AS kind FROM files", "files")
oracle("f4_detect_language", f"SELECT root_id, path, {LANG} AS lang FROM files", "files")
_SEGMENTS = "seg AS (SELECT segment, count(*) AS n FROM (SELECT unnest(string_split(path, '/')) AS segment FROM files) GROUP BY segment)"
oracle("f5_is_language_code", f"""WITH {_SEGMENTS}
SELECT segment, n, regexp_full_match(segment, '[a-z]{{2,3}}(-[A-Za-z]{{2,4}})?') AS is_code FROM seg""", "files")
oracle("f5b_is_satellite_code", f"""WITH {_SEGMENTS}
SELECT segment, n, regexp_full_match(segment, '[a-z]{{2,3}}(-[A-Za-z0-9]{{2,4}})?') AND length(segment) <= 8 AS is_code FROM seg""", "files")
oracle("f6_normalize_lang", f"""WITH c AS (SELECT {RAW_CODE} AS code FROM files)
SELECT code, count(*) AS n, any_value({_lang('code')}) AS lang FROM c WHERE code <> '' GROUP BY code""", "files")
oracle("f7_parse_version", f"""WITH {_SEGMENTS}
SELECT segment, n, CASE WHEN regexp_full_match(segment, '[+]?[0-9]+([.][+]?[0-9]+){{0,3}}') THEN
  CASE WHEN list_max(list_transform(string_split(segment, '.'), lambda x: CAST(x AS BIGINT))) <= 4294967295 THEN
    array_to_string(list_transform(string_split(segment, '.'), lambda x: CAST(x AS BIGINT)), ',') END END AS version FROM seg""", "files")
oracle("f8_parse_chunk", f"""SELECT root_id, path, nullif(regexp_extract({NAME}, '^pakchunk([^-]+)-(.*)[.]pak$', 1), '') AS chunk_id,
  regexp_full_match({NAME}, 'pakchunk[^-]+-.*_P[.]pak') AS is_patch FROM files""", "files")

LEFT_EXT = ("pdb", "ilk", "exp", "tps", "uproject", "uplugin", "bak", "orig")
LEFT_PART = ("/intermediate/", "/derivedatacache/", "/derived data cache/", "/source/", "/build/", "/engine/editor/", "/game/editor/")
LEFTOVER = f"CASE WHEN {EXT} IN {LEFT_EXT} THEN {EXT} " + " ".join(f"WHEN contains({LOW}, '{p}') THEN '{p}'" for p in LEFT_PART) + " END"
HINTS = ("ShaderCache", "ShaderArchive", "GlobalShaderCache", "upipelinecache", "ushaderbytecode")
FAMS = ("PCD3D_SM6", "PCD3D_SM5", "VulkanSM6", "VulkanSM5", "OpenGLES31", "OpenGLES", "MetalSM5", "MetalSM6", "D3D11")
FAMILY = "CASE WHEN (" + " OR ".join(f"contains({NAME}, '{h}')" for h in HINTS) + ") THEN CASE " + " ".join(
    f"WHEN contains({NAME}, '{f}') THEN '{f}'" for f in FAMS) + " END END"
INST = ("ue4prereqsetup", "ueprereqsetup", "ue5prereqsetup", "vc_redist", "vcredist", "dxsetup.exe", "dxwebsetup.exe", "dotnetfx", "ndp48", "ndp472")
INST_PART = ("/extras/redist/", "/redist/", "/_commonredist/", "/commonredist/", "/prereqs/")
INSTALLER = "CASE WHEN (" + " OR ".join(f"contains({LOW}, '{p}')" for p in INST_PART) + \
    f" OR (ends_with(lower({NAME}), '.exe') AND len(string_split(path, '/')) <= 2)) THEN CASE " + " ".join(
    f"WHEN contains(lower({NAME}), '{i}') THEN '{i}'" for i in INST) + " END END"
PLATS = ("Win64", "Win32", "WinGDK", "Linux", "LinuxArm64", "LinuxAArch64", "Mac", "IOS", "TVOS", "Android", "Switch", "PS4", "PS5", "XSX", "XB1")
PLATFORM = "CASE " + " ".join(f"WHEN contains({LOW}, '/binaries/{p.lower()}/') THEN '{p}'" for p in PLATS) + " END"
MODS = (".disabled", ".modtemp", ".nxm_backup", ".vortex_backup", ".mohidden", ".original")
MOD = "CASE " + " ".join(f"WHEN ends_with(lower({NAME}), '{m}') THEN '{m}'" for m in MODS) + " END"
oracle("f9_rule_match", f"""SELECT root_id, path, {LEFTOVER} AS leftover, {FAMILY} AS family, {INSTALLER} AS installer,
  {PLATFORM} AS platform, {MOD} AS suffix FROM files""", "files")


def _exists(suffix: str) -> str:
    return f"EXISTS (SELECT 1 FROM files s WHERE s.root_id = p.root_id AND s.path = {STEM.replace('path', 'p.path')} || '.{suffix}')"


PAKS = f"""paks AS (SELECT p.root_id, p.path, p.size_bytes, p.probe_error, {_exists('sig')} AS has_sig,
  {_exists('utoc')} AS has_utoc, {_exists('ucas')} AS has_ucas FROM files p WHERE {EXT.replace('path', 'p.path')} = 'pak')"""
STATUS = _status("has_sig")
oracle("f10_container_status", f"""WITH {PAKS}, s AS (SELECT *, {STATUS} AS status FROM paks WHERE NOT {CEF})
SELECT root_id, path, size_bytes, status, CASE WHEN status = 'unreadable' THEN probe_error END AS reason FROM s""", "files")
oracle("f11_format_bytes", f"SELECT root_id, path, {_text('size_bytes')} AS text FROM files", "files")
oracle("f12_score_label", """SELECT o_orderkey, o_orderkey % 101 AS score, CASE WHEN o_orderkey % 101 < 20 THEN 'clean'
  WHEN o_orderkey % 101 < 50 THEN 'mild' WHEN o_orderkey % 101 < 80 THEN 'structural bloat' ELSE 'severe' END AS label FROM orders""")


def _mip(fmt: str, w: str, h: str) -> str:
    block = lambda e: f"((({w}) + {e - 1}) // {e}) * ((({h}) + {e - 1}) // {e})"
    return f"""CAST(CASE WHEN {fmt} = 'PF_DXT1' THEN {block(4)} * 8 WHEN {fmt} IN ('PF_DXT5','PF_BC5','PF_BC7') THEN {block(4)} * 16
      WHEN {fmt} = 'PF_ASTC_6x6' THEN {block(6)} * 16 ELSE ({w})::BIGINT * ({h}) * 4 END AS BIGINT)"""


MIPS = f"""lv AS (SELECT tex_id, asset_path, export_name, pixel_format, compression_settings, size_x, size_y, num_mips, CAST(i AS INT) AS level,
   greatest(1, size_x >> CAST(i AS INT)) AS w, greatest(1, size_y >> CAST(i AS INT)) AS h FROM tex, LATERAL (SELECT unnest(range(0, num_mips)) AS i)),
 mip AS (SELECT *, {_mip('pixel_format', 'w', 'h')} AS bytes FROM lv)"""
oracle("f13_bytes_for_mip", f"SELECT tex_id, {_mip('pixel_format', 'size_x', 'size_y')} AS top_bytes FROM tex", "tex")
oracle("f14_mip_chain", f"WITH {MIPS} SELECT tex_id, level, w, h, bytes FROM mip", "tex")


def _kept(cap: str) -> str:
    return f"coalesce(min(level) FILTER (greatest(w, h) <= {cap}), max(level))"


oracle("f15_first_kept", f"WITH {MIPS} SELECT tex_id, {_kept('512')} AS level FROM mip GROUP BY tex_id", "tex")
TOP = "CAST(((original_top_dim + 3) // 4) * ((original_top_dim + 3) // 4) * CASE WHEN pixel_format IN ('PF_DXT1','PF_BC1') THEN 8 ELSE 16 END AS BIGINT)"
oracle("f16_top_mip_bytes", f"SELECT seq, {TOP} AS top_bytes FROM strips", "strips")
LOOKUP_NAME = "(starts_with(lower(export_name), 'lut_') OR ends_with(lower(export_name), '_lut') OR contains(lower(export_name), '_lookup') OR contains(lower(export_name), 'colorgrade'))"
SMART = f"""CASE lower(trim(compression_settings)) WHEN 'tc_normalmap' THEN 'exact_backup' WHEN 'tc_lookuptable' THEN 'no_strip'
  WHEN 'tc_default' THEN 'ai_upscale' WHEN 'tc_masks' THEN 'ai_upscale' ELSE
  CASE WHEN regexp_matches(lower(export_name), '^n_|_n$|_normal$|_norm$|_nm$|_normalmap') THEN 'exact_backup'
       WHEN {LOOKUP_NAME} THEN 'no_strip' WHEN pixel_format = 'PF_BC5' THEN 'exact_backup' ELSE 'ai_upscale' END END"""
oracle("f17_restore_class", f"""SELECT tex_id, 'no_strip' AS never_strip, 'exact_backup' AS conservative,
  CASE WHEN {LOOKUP_NAME} OR compression_settings = 'TC_LookupTable' THEN 'no_strip' ELSE 'ai_upscale' END AS aggressive,
  {SMART} AS smart FROM tex""", "tex")
RATIO = "CASE compression_settings WHEN 'TC_LookupTable' THEN 1.0::DOUBLE WHEN 'TC_Masks' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END"
oracle("f18_projection_ratio", f"""SELECT tex_id, {RATIO} AS ratio, CASE compression_settings WHEN 'TC_LookupTable' THEN 'untouched'
  WHEN 'TC_Masks' THEN 'pixel-smooth' WHEN 'TC_Normalmap' THEN 'block' ELSE 'pixel-textured' END AS basis FROM tex""", "tex")
CLASS = """CASE WHEN lower(label) LIKE '%color%' THEN 'color' WHEN lower(label) LIKE '%normal%' THEN 'normal'
  WHEN lower(label) LIKE '%roughness%' THEN 'roughness' WHEN lower(label) LIKE '%metalness%' THEN 'metalness' ELSE 'other' END"""
oracle("f19_content_class", f"SELECT label, predictor, {CLASS} AS content_class FROM ben", "ben")
SUFFIX = "regexp_extract(label, '[^_]*$')"
oracle("f20_split_name", f"""SELECT label, predictor, {SUFFIX} AS suffix, regexp_extract(label, '^(.*)_[^_]*$', 1) AS material,
  {SUFFIX} AS map_class FROM ben""", "ben")
RECOMP = f"CASE {EXT} WHEN 'png' THEN 'png' WHEN 'wav' THEN 'wav' WHEN 'flac' THEN 'flac' END"
ENCODER = f"CASE {EXT} WHEN 'png' THEN 'oxipng' WHEN 'wav' THEN 'opusenc' WHEN 'flac' THEN 'opusenc' END"
oracle("f21_recompress_kind", f"SELECT root_id, path, {RECOMP} AS kind, {ENCODER} AS encoder FROM files", "files")
ENTRY = f"""CASE WHEN is_payload THEN 'payload' WHEN is_package OR {EXT} IN ('uasset','uexp','umap','ubulk') THEN 'package'
  WHEN {EXT} IN ('wav','flac','ogg','opus','bnk','bin') THEN 'audio' WHEN {EXT} IN ('png','jpg','jpeg','tga','dds') THEN 'texture' ELSE 'other' END"""
oracle("f22_entry_filter_class", f"SELECT root_id, container_path, path, {ENTRY} AS entry_class FROM ent", "ent")


def _quant(r: str, step: int) -> str:
    return f"CAST(sign({r}) * ((abs({r}) + {step // 2}) // {step}) AS INT)"


oracle("f23_quantize", f"""SELECT image_id, x, y, v - 128 AS q1, {_quant('(v - 128)', 4)} AS q4, {_quant('(v - 128)', 4)} * 4 AS d4,
  {_quant('(v - 128)', 5)} AS q5 FROM pix""", "pix")
oracle("f24_path_escapes_root", """SELECT seq, CASE seq % 5 WHEN 0 THEN '../' || path WHEN 1 THEN 'a/../' || path WHEN 2 THEN 'a/../../' || path
  WHEN 3 THEN './a//../' || path ELSE path END AS path, seq % 5 IN (0, 2) AS escapes FROM man""", "man")
oracle("f25_has_magic", "SELECT doc_id, doc_id % 3 = 0 AS is_png, doc_id % 3 = 1 AS is_ogg FROM documents")
oracle("f26_sha256_hex", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
oracle("f27_rfc3339", """SELECT event_id, strftime(make_timestamp((event_id * 7919 + 1600000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS text FROM events""")
LOCALE = f"regexp_replace({NAME}, '[.][^.]*$', '')"
oracle("f28_cef_locale", f"SELECT root_id, path, {LOCALE} AS locale, lower({LOCALE}) IN ('en','en-us','en-gb') AS keeper FROM files WHERE {CEF}", "files")
oracle("f29_codec_space", "SELECT label, predictor, CASE WHEN hp_energy < 25 THEN 'pixel' ELSE 'bc3_byte' END AS space FROM ben", "ben")
oracle("f30_rel_posix", "SELECT root_id, 'D:\\games\\root' || root_id || '\\' || replace(path, '/', '\\') AS full_path, path AS rel FROM files", "files")

# -- joins ---------------------------------------------------------------------------

oracle("j1_with_siblings", f"WITH {PAKS} SELECT root_id, path, size_bytes, has_sig, has_utoc, has_ucas FROM paks", "files")
SAT_NAME = "regexp_full_match({0}, '[a-z]{{2,3}}(-[A-Za-z0-9]{{2,4}})?') AND length({0}) <= 8"
oracle("j2_satellite_dirs", f"""SELECT DISTINCT root_id, dir FROM (SELECT root_id, {PARENT} AS dir FROM files WHERE {RAW_EXT} = 'dll')
WHERE {SAT_NAME.format("regexp_extract(dir, '[^/]*$')")}""", "files")
PAIRS = f"""pairs AS (SELECT a.label, {CLASS.replace('label', 'a.label')} AS content_class, a.ratio AS a_ratio, b.ratio AS b_ratio, a.hp_energy,
  least(a.ratio, b.ratio) AS oracle_ratio, CASE WHEN a.ratio <= b.ratio THEN 'bilinear' ELSE 'learned' END AS winner
  FROM ben a JOIN ben b ON a.label = b.label WHERE a.predictor = 'bilinear' AND b.predictor = 'learned')"""
oracle("j3_pair_benchmarks", f"WITH {PAIRS} SELECT label, content_class, a_ratio, b_ratio, hp_energy FROM pairs", "ben")
GRID = """b AS (SELECT predictor, min(hp_energy) AS lo, max(hp_energy) AS hi FROM ben GROUP BY predictor),
 g AS (SELECT predictor, CAST(i AS INT) AS step, lo + (hi - lo) * (i / 200.0::DOUBLE) AS threshold FROM b, range(0, 201) r(i)),
 grid AS (SELECT predictor, step, threshold, count(*) FILTER ((hp_energy >= threshold) = (ratio >= 1.0)) AS correct, count(*) AS total,
   count(*) FILTER (ratio >= 1.0) AS pos_total FROM g JOIN ben USING (predictor) GROUP BY predictor, step, threshold)"""
oracle("j4_threshold_sweep", f"WITH {GRID} SELECT predictor, step, round(threshold, 6) AS threshold, correct FROM grid", "ben")
HASH = """ah0 AS (SELECT image_id, sum(CASE WHEN r >= m THEN (1::HUGEINT << CAST(y * 8 + x AS INT)) ELSE 0 END)::HUGEINT AS s FROM
   (SELECT *, avg(r) OVER (PARTITION BY image_id) AS m FROM near_pixels) GROUP BY image_id),
 ah AS (SELECT image_id, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS ahash FROM ah0),
 hv AS (SELECT ahash, count(*) AS images FROM ah GROUP BY ahash),
 np AS (SELECT a.ahash AS hash_a, b.ahash AS hash_b, CAST(bit_count(xor(a.ahash, b.ahash)) AS INT) AS distance, a.images AS images_a, b.images AS images_b
   FROM hv a JOIN hv b ON a.ahash < b.ahash WHERE bit_count(xor(a.ahash, b.ahash)) <= 6)"""
oracle("j5_near_dup_pairs", f"WITH {HASH} SELECT * FROM np", "near_pixels")
PLAN_SQL = f"""k AS (SELECT tex_id, {_kept('512')} AS kept FROM mip GROUP BY tex_id),
 plan AS (SELECT m.tex_id, m.asset_path, any_value(pixel_format) AS pixel_format, any_value(compression_settings) AS compression_settings,
   any_value(export_name) AS export_name, max(CASE WHEN level = 0 THEN greatest(w, h) END) AS current_mip0_dim,
   max(CASE WHEN level = kept THEN greatest(w, h) END) AS kept_mip0_dim, any_value(kept) AS drop_mip_count,
   CAST(count(*) - any_value(kept) AS INT) AS kept_mip_count, CAST(coalesce(sum(bytes) FILTER (level < kept), 0) AS BIGINT) AS save_bytes,
   CAST(sum(bytes) AS BIGINT) AS original_bytes FROM mip m JOIN k USING (tex_id) GROUP BY m.tex_id, m.asset_path)"""
oracle("j6_route_targets", f"""WITH {MIPS}, {PLAN_SQL}, routed AS (SELECT tex_id, asset_path, save_bytes,
  min(CASE WHEN tex_id % 7 <> 0 THEN CASE {SMART} WHEN 'no_strip' THEN '0no_strip' WHEN 'exact_backup' THEN '1exact_backup' ELSE '2ai_upscale' END END)
    OVER (PARTITION BY asset_path) AS strictest FROM plan)
SELECT tex_id, asset_path, save_bytes, strictest[2:] AS restore_class FROM routed WHERE strictest IS NULL OR strictest = '2ai_upscale'""", "tex")
oracle("j7_size_collision_prefilter", """SELECT root_id, path, size_bytes FROM files WHERE size_bytes >= 4194304
QUALIFY count(*) OVER (PARTITION BY root_id, size_bytes) >= 2""", "files")
CHUNK = f"""ch AS (SELECT root_id, path, size_bytes, regexp_extract({NAME}, '^pakchunk([^-]+)-(.*)[.]pak$', 1) AS chunk_id,
   ends_with({NAME}, '_P.pak') AS is_patch FROM files WHERE regexp_full_match({NAME}, 'pakchunk[^-]+-.*[.]pak')),
 cb AS (SELECT root_id, chunk_id, min(path) AS base_path FROM ch WHERE NOT is_patch GROUP BY ALL),
 cm AS (SELECT ch.*, base_path FROM ch JOIN cb USING (root_id, chunk_id) QUALIFY count(*) OVER (PARTITION BY ch.root_id, ch.chunk_id) >= 2)"""
oracle("j8_patch_to_base", f"""WITH {CHUNK} SELECT o.root_id, o.chunk_id, b.path AS base_path, b.size_bytes AS base_size, o.path AS patch_path,
  o.size_bytes AS patch_size FROM cm o JOIN cm b ON o.root_id = b.root_id AND o.base_path = b.path WHERE o.path <> o.base_path""", "files")
oracle("j9_entries_by_status", f"""WITH {PAKS} SELECT e.root_id, e.container_path, e.path, e.size_bytes FROM ent e JOIN paks p
  ON p.root_id = e.root_id AND p.path = e.container_path WHERE p.probe_error IS NULL AND NOT p.has_sig""", "files", "ent")
MSTAT = """mst AS (SELECT *, CASE WHEN seq % 83 = 0 THEN 'escapes_root' WHEN op = 'create' THEN 'ok' WHEN seq % 89 = 0 THEN 'missing_payload'
   WHEN payload_sha256 <> original_sha256 THEN 'hash_mismatch' ELSE 'ok' END AS status,
   CASE WHEN seq % 83 = 0 THEN '../' || path ELSE path END AS full_path FROM man)"""
oracle("j10_verify_manifest", f"WITH {MSTAT} SELECT status, count(*) AS entry_count FROM mst GROUP BY status", "man")

# -- census --------------------------------------------------------------------------

BIG = lambda e: f"CAST({e} AS BIGINT)"
SUM = lambda e: BIG(f"sum({e})")
oracle("c1_census_totals", f"SELECT root_id, count(*) AS file_count, {SUM('size_bytes')} AS total_bytes FROM files GROUP BY root_id", "files")
oracle("c2_census_kinds", f"""SELECT root_id, {KIND} AS kind, count(*) AS file_count, {SUM('size_bytes')} AS bytes FROM files GROUP BY ALL""", "files")
LANGS = f"lg AS (SELECT root_id, {LANG} AS lang, count(*) AS file_count, {SUM('size_bytes')} AS bytes FROM files WHERE {RAW_CODE} <> '' GROUP BY ALL)"
oracle("c3_census_languages", f"WITH {LANGS} SELECT * FROM lg", "files")
SAVE = "ls AS (SELECT root_id, count(*) AS languages, CAST(CASE WHEN count(*) >= 2 THEN sum(bytes) - max(bytes) ELSE 0 END AS BIGINT) AS l10n_savings FROM lg GROUP BY root_id)"
oracle("c4_l10n_savings", f"""WITH {LANGS}, {SAVE} SELECT r.root_id, coalesce(languages, 0) AS languages, coalesce(l10n_savings, 0) AS l10n_savings
  FROM (SELECT DISTINCT root_id FROM files) r LEFT JOIN ls USING (root_id)""", "files")
oracle("c5_top_files", f"""SELECT root_id, path, size_bytes, CAST(rank AS INT) AS rank, {KIND} AS kind FROM (SELECT *, row_number() OVER
  (PARTITION BY root_id ORDER BY size_bytes DESC, path DESC) AS rank FROM files) WHERE rank <= 50""", "files")
oracle("c6_container_inventory", f"""WITH {PAKS} SELECT root_id, {STATUS} AS status, count(*) AS container_count, {SUM('size_bytes')} AS bytes
  FROM paks WHERE NOT {CEF} GROUP BY ALL""", "files")
oracle("c7_savings_pct", f"""WITH {LANGS}, {SAVE} SELECT root_id, CAST(round(100.0::DOUBLE * coalesce(any_value(l10n_savings), 0) / sum(size_bytes)) AS INT) AS savings_pct
  FROM files LEFT JOIN ls USING (root_id) GROUP BY root_id""", "files")
oracle("c8_languages_ranked", f"""WITH {LANGS}, rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY root_id ORDER BY bytes DESC, lang) AS INT) AS rank FROM lg)
SELECT *, rank = 1 AS is_largest FROM rk""", "files")
_KINDCOLS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_files_count, CAST(coalesce(sum(size_bytes) FILTER (kind = '{k}'), 0) AS BIGINT) AS {k}_files_bytes" for k in ("pak", "texture", "audio"))
oracle("census_report", f"""WITH {LANGS}, {SAVE}, ks AS (SELECT root_id, count(*) AS file_count, {SUM('size_bytes')} AS total_bytes, {_KINDCOLS}
  FROM (SELECT *, {KIND} AS kind FROM files) GROUP BY root_id)
SELECT ks.*, coalesce(languages, 0) AS languages, coalesce(l10n_savings, 0) AS l10n_savings FROM ks LEFT JOIN ls USING (root_id)""", "files")

oracle("census_full", f"""WITH {LANGS}, {SAVE}, {PAKS}, st AS (SELECT root_id, {STATUS} AS status FROM paks WHERE NOT {CEF}),
 ca AS (SELECT root_id, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('readable', 'encrypted', 'iostore', 'signed', 'unreadable'))} FROM st GROUP BY root_id),
 tf AS (SELECT root_id, path, size_bytes, {KIND} AS kind, CAST(row_number() OVER (PARTITION BY root_id ORDER BY size_bytes DESC, path DESC) AS INT) AS rank FROM files)
SELECT tf.*, coalesce(l10n_savings, 0) AS l10n_savings, coalesce(readable, 0) AS readable, coalesce(encrypted, 0) AS encrypted, coalesce(iostore, 0) AS iostore,
  coalesce(signed, 0) AS signed, coalesce(unreadable, 0) AS unreadable FROM tf LEFT JOIN ls USING (root_id) LEFT JOIN ca USING (root_id) WHERE rank <= 50""", "files")

# -- detectors -----------------------------------------------------------------------

MIB = 1048576
DIRS = """anc AS (SELECT root_id, size_bytes, path, array_to_string(parts[1:i], '/') AS dir FROM (SELECT *, string_split(path, '/') AS parts FROM files),
   LATERAL (SELECT unnest(range(1, len(parts))) AS i)),
 ds AS (SELECT root_id, dir, regexp_extract(dir, '[^/]*$') AS name, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent, sum(size_bytes) AS bytes,
   count(*) FILTER (regexp_extract(path, '^(.*)/[^/]*$', 1) = dir AND ends_with(path, '.dll')) AS dlls FROM anc GROUP BY ALL)"""


def _row(detector: str, severity: str, items: str, groups: str, total: str, saved: str, source: str, detail: str = "NULL", having: str = "") -> str:
    return f"""SELECT root_id, '{detector}' AS detector, {severity} AS severity, {BIG(items)} AS item_count, {BIG(groups)} AS group_count,
  {BIG(total)} AS total_bytes, {BIG(saved)} AS reclaimable_bytes, CAST({detail} AS VARCHAR) AS detail FROM {source} GROUP BY root_id {having}"""


def _warn(amount: str, bar: int) -> str:
    return f"CASE WHEN {amount} >= {bar} THEN 'warning' ELSE 'info' END"


def _listing(detector: str, label: str, bar: int) -> tuple[str, str]:
    view = f"{detector}_v AS (SELECT *, {label} AS label FROM files WHERE {label} IS NOT NULL)"
    return view, _row(detector, _warn("sum(size_bytes)", bar), "count(*)", "1", "sum(size_bytes)", "sum(size_bytes)", f"{detector}_v")


def _largest_kept(detector: str, label: str, low: int, bar: int) -> tuple[str, str]:
    view = f"""{detector}_v AS (SELECT root_id, {label} AS label, sum(size_bytes) AS bytes, min(path) AS first_path FROM files WHERE {label} IS NOT NULL GROUP BY ALL)"""
    spare = "sum(bytes) - max(bytes)"
    return view, _row(detector, _warn(spare, bar), "count(*)", "count(*)", "sum(bytes)", spare, f"{detector}_v",
                      having=f"HAVING count(*) >= 2 AND {spare} >= {low}")


_ACCESS = f"""acc AS (SELECT root_id, path, size_bytes, CASE WHEN has_utoc AND has_ucas THEN 'iostore' ELSE {STATUS} END AS status
   FROM paks WHERE {RAW_EXT} = 'pak'),
 accs AS (SELECT root_id, status, count(*) AS n, sum(size_bytes) AS bytes FROM acc GROUP BY ALL),
 dom AS (SELECT root_id, status FROM accs WHERE status <> 'readable' QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY bytes DESC,
   CASE status WHEN 'unreadable' THEN 0 WHEN 'signed' THEN 1 WHEN 'iostore' THEN 2 ELSE 3 END) = 1)"""
_BLOCKED = "coalesce(sum(n) FILTER (status <> 'readable'), 0)"
# detector -> (list of WITH parts, select)
FIND: dict[str, tuple[list[str], str]] = {
    "patch_overlay": ([CHUNK, """cs AS (SELECT root_id, chunk_id, count(*) - 1 AS n, sum(size_bytes) FILTER (path <> base_path) AS over_bytes,
   max(size_bytes) FILTER (path = base_path) AS base_bytes FROM cm GROUP BY ALL)"""],
        _row("patch_overlay", "CASE WHEN max(CASE WHEN base_bytes > 0 THEN over_bytes / base_bytes::DOUBLE ELSE 0 END) >= 0.4 THEN 'critical' ELSE 'warning' END",
             "sum(n)", "count(*)", "sum(over_bytes)", "sum(over_bytes) // 2", "cs")),
    "stale_version_dir": ([DIRS, """vd AS (SELECT *, row_number() OVER (PARTITION BY root_id, parent ORDER BY list_transform(string_split(name, '.'), lambda x: CAST(x AS BIGINT)) DESC, dir DESC) AS age
   FROM ds WHERE regexp_full_match(name, '[+]?[0-9]+([.][+]?[0-9]+){0,3}'))"""],
        _row("stale_version_dir", _warn("sum(bytes)", 100 * MIB), "count(*)", "count(DISTINCT parent)", "sum(bytes)", "sum(bytes)", "vd WHERE age > 1")),
    "sharded_videos": ([f"""pd AS (SELECT root_id, {PARENT} AS dir, sum(size_bytes) AS bytes FROM files WHERE {RAW_EXT} = 'pak' AND contains(path, '/') GROUP BY ALL HAVING sum(size_bytes) > 0),
 sh AS (SELECT root_id, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS parent, count(*) AS n, sum(bytes) AS bytes FROM pd GROUP BY ALL HAVING count(*) >= 20 AND sum(bytes) // count(*) <= {600 * MIB})"""],
        _row("sharded_videos", "'warning'", "sum(n)", "count(*)", "sum(bytes)", "floor(sum(bytes)::DOUBLE * 0.05)", "sh")),
    "large_chunk": ([f"lc AS (SELECT * FROM files WHERE {RAW_EXT} = 'pak' AND size_bytes >= 2147483648)"],
        _row("large_chunk", "CASE WHEN max(size_bytes) >= 10737418240 THEN 'critical' ELSE 'warning' END", "count(*)", "1", "sum(size_bytes)", "NULL", "lc")),
    "encryption": ([PAKS, _ACCESS],
        f"SELECT * REPLACE (CASE WHEN severity = 'info' THEN 'clear' ELSE dom.status END AS detail) FROM ("
        + _row("encryption", f"CASE WHEN {_BLOCKED} = 0 THEN 'info' WHEN {_BLOCKED} = sum(n) THEN 'critical' ELSE 'warning' END",
               "sum(n)", "count(*)", "sum(bytes)", "NULL", "accs") + ") LEFT JOIN dom USING (root_id)"),
    "editor_leftovers": ([], ""), "redist_installer": ([], ""), "mod_manager_artifacts": ([], ""),
    "launcher_satellite": ([DIRS, f"""st AS (SELECT root_id, parent, count(*) AS n, sum(bytes) AS bytes, max(bytes) AS largest FROM ds
   WHERE dlls > 0 AND {SAT_NAME.format('name')} GROUP BY ALL HAVING count(*) >= 3)"""],
        _row("launcher_satellite", _warn("sum(bytes - largest)", 10 * MIB), "sum(n)", "count(*)", "sum(bytes)", "sum(bytes - largest)", "st")),
    "shader_rhi_redundancy": ([], ""), "platform_siblings": ([], ""),
    "duplicate_content": ([f"""dg AS (SELECT root_id, size_bytes, content_sha256, count(*) AS n, min(path) AS keep_path FROM files WHERE size_bytes >= {4 * MIB}
   AND content_sha256 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"""],
        _row("duplicate_content", _warn("sum(size_bytes * (n - 1))", 100 * MIB), "sum(n - 1)", "count(*)", "sum(size_bytes * (n - 1))", "sum(size_bytes * (n - 1))", "dg")),
    "cef_locales": ([f"cl AS (SELECT *, {LOCALE} AS locale, lower({LOCALE}) IN ('en','en-us','en-gb') AS kept FROM files WHERE {CEF} AND ends_with(lower(path), '.pak'))"],
        _row("cef_locales", _warn("sum(size_bytes) FILTER (NOT kept)", 5 * MIB), "count(*) FILTER (NOT kept)", "1", "sum(size_bytes)",
             "sum(size_bytes) FILTER (NOT kept)", "cl", having=f"HAVING sum(size_bytes) FILTER (NOT kept) >= {MIB}")),
}
for _name, _label, _bar in (("editor_leftovers", LEFTOVER, MIB), ("redist_installer", INSTALLER, 10 * MIB), ("mod_manager_artifacts", MOD, 50 * MIB)):
    _view, _select = _listing(_name, _label, _bar)
    FIND[_name] = ([_view], _select)
for _name, _label, _low, _bar in (("shader_rhi_redundancy", FAMILY, 5 * MIB, 200 * MIB), ("platform_siblings", PLATFORM, 50 * MIB, 500 * MIB)):
    _view, _select = _largest_kept(_name, _label, _low, _bar)
    FIND[_name] = ([_view], _select)

_ORDER = ("patch_overlay", "stale_version_dir", "sharded_videos", "large_chunk", "encryption", "editor_leftovers", "launcher_satellite",
          "shader_rhi_redundancy", "redist_installer", "platform_siblings", "mod_manager_artifacts", "duplicate_content", "cef_locales")
_FCOLS = "root_id, detector, severity, item_count, group_count, total_bytes, reclaimable_bytes, detail"
for _number, _name in enumerate(_ORDER, start=1):
    _parts, _select = FIND[_name]
    oracle(f"d{_number}_{_name}", f"WITH {', '.join(_parts)} SELECT {_FCOLS} FROM ({_select})", "files")
oracle("d5_pak_access", f"WITH {PAKS}, {_ACCESS} SELECT root_id, status, n AS container_count, {BIG('bytes')} AS bytes FROM accs", "files")

_ALL_PARTS = list(dict.fromkeys(part for name in _ORDER for part in FIND[name][0]))
FOUND = ", ".join(_ALL_PARTS) + ", fnd AS (" + " UNION ALL ".join(f"SELECT {_FCOLS} FROM ({FIND[n][1]})" for n in _ORDER) + ")"

EVID = f"""sf AS (SELECT root_id FROM fnd WHERE detector = 'shader_rhi_redundancy'), pf AS (SELECT root_id FROM fnd WHERE detector = 'platform_siblings'),
 cf AS (SELECT root_id FROM fnd WHERE detector = 'cef_locales'),
 ev AS (
  SELECT root_id, 'patch_overlay' AS detector, path, size_bytes, CASE WHEN path = base_path THEN 'base' ELSE 'overlay' END AS note FROM cm
  UNION ALL SELECT root_id, 'stale_version_dir', dir, {BIG('bytes')}, name FROM vd WHERE age > 1
  UNION ALL SELECT root_id, 'sharded_videos', parent, {BIG('bytes')}, n || ' folders' FROM sh
  UNION ALL SELECT root_id, 'large_chunk', path, size_bytes, CASE WHEN size_bytes >= 10737418240 THEN 'critical' ELSE 'oversized' END FROM lc
  UNION ALL SELECT root_id, 'encryption', path, size_bytes, status FROM acc WHERE status <> 'readable'
  UNION ALL SELECT root_id, 'editor_leftovers', path, size_bytes, label FROM editor_leftovers_v
  UNION ALL SELECT root_id, 'launcher_satellite', dir, {BIG('ds.bytes')}, name FROM ds JOIN st USING (root_id, parent) WHERE dlls > 0 AND {SAT_NAME.format('name')}
  UNION ALL SELECT root_id, 'shader_rhi_redundancy', path, size_bytes, {FAMILY} FROM files JOIN sf USING (root_id) WHERE {FAMILY} IS NOT NULL
  UNION ALL SELECT root_id, 'redist_installer', path, size_bytes, label FROM redist_installer_v
  UNION ALL SELECT root_id, 'platform_siblings', regexp_extract(first_path, '^(.*/Binaries/' || label || ')/', 1), {BIG('bytes')}, label FROM platform_siblings_v JOIN pf USING (root_id)
  UNION ALL SELECT root_id, 'mod_manager_artifacts', path, size_bytes, label FROM mod_manager_artifacts_v
  UNION ALL SELECT root_id, 'duplicate_content', f.path, f.size_bytes, CASE WHEN f.path = keep_path THEN 'keep' ELSE 'duplicate' END FROM files f JOIN dg USING (root_id, size_bytes, content_sha256)
  UNION ALL SELECT root_id, 'cef_locales', path, size_bytes, CASE WHEN kept THEN locale || ' (keep)' ELSE locale END FROM cl JOIN cf USING (root_id))"""
oracle("d_evidence", f"WITH {FOUND}, {EVID} SELECT root_id, detector, path, size_bytes, note FROM ev", "files")

# -- audit assembly ------------------------------------------------------------------

oracle("a1_union_findings", f"WITH {FOUND} SELECT {_FCOLS} FROM fnd", "files")
oracle("a2_findings_by_severity", f"WITH {FOUND} SELECT root_id, severity, count(*) AS findings FROM fnd GROUP BY ALL", "files")
_CATS = f"cat AS (SELECT root_id, detector AS category, {SUM('reclaimable_bytes')} AS bytes FROM fnd WHERE reclaimable_bytes IS NOT NULL GROUP BY ALL)"
oracle("a3_reclaimable_by_category", f"WITH {FOUND}, {_CATS} SELECT * FROM cat", "files")
_AUD = f"""tot AS (SELECT root_id, count(*) AS file_count, {SUM('size_bytes')} AS total_bytes FROM files GROUP BY root_id),
 ag AS (SELECT root_id, count(*) AS total_findings, count(*) FILTER (severity = 'info') AS info_findings, count(*) FILTER (severity = 'warning') AS warning_findings,
   count(*) FILTER (severity = 'critical') AS critical_findings, CAST(coalesce(sum(reclaimable_bytes), 0) AS BIGINT) AS reclaimable_bytes,
   coalesce(bool_or(detector = 'encryption' AND severity <> 'info'), false) AS access_blocked FROM fnd GROUP BY root_id),
 aud AS (SELECT *, reclaimable_bytes / total_bytes::DOUBLE * 100 AS reclaimable_pct FROM (SELECT root_id, file_count, total_bytes, coalesce(total_findings, 0) AS total_findings,
   coalesce(info_findings, 0) AS info_findings, coalesce(warning_findings, 0) AS warning_findings, coalesce(critical_findings, 0) AS critical_findings,
   coalesce(reclaimable_bytes, 0) AS reclaimable_bytes, coalesce(access_blocked, false) AS access_blocked FROM tot LEFT JOIN ag USING (root_id))),
 sc AS (SELECT *, CAST(floor(greatest(0, least(100, least(reclaimable_pct * 2, 60) + least(critical_findings * 10, 30) + CASE WHEN access_blocked THEN 10 ELSE 0 END))) AS INT) AS score FROM aud),
 rep AS (SELECT * REPLACE (round(reclaimable_pct, 6) AS reclaimable_pct), CASE WHEN score < 20 THEN 'clean' WHEN score < 50 THEN 'mild' WHEN score < 80 THEN 'structural bloat' ELSE 'severe' END AS score_label FROM sc)"""
oracle("a4_reclaimable_total_pct", f"WITH {FOUND}, {_AUD} SELECT root_id, total_bytes, reclaimable_bytes, reclaimable_pct FROM rep", "files")
oracle("a5_bloat_score", f"WITH {FOUND}, {_AUD} SELECT root_id, score, score_label FROM rep", "files")
oracle("a6_rank_evidence", f"""WITH {FOUND}, {EVID}, re AS (SELECT *, CAST(row_number() OVER (PARTITION BY root_id, detector ORDER BY size_bytes DESC, path) AS INT) AS rank,
  greatest(count(*) OVER (PARTITION BY root_id, detector) - 5, 0) AS more FROM ev)
SELECT root_id, detector, path, size_bytes, note, rank, more FROM re WHERE rank <= 5""", "files")
oracle("a7_category_table", f"WITH {FOUND}, {_CATS} SELECT *, CAST(row_number() OVER (PARTITION BY root_id ORDER BY bytes DESC, category) AS INT) AS rank FROM cat WHERE bytes > 0", "files")
oracle("a8_detector_error_finding", f"""WITH {FOUND} SELECT root_id, detector, detector AS category, severity, item_count FROM fnd WHERE detector IN ('large_chunk', 'cef_locales')
UNION ALL SELECT DISTINCT root_id, 'duplicate_content', 'chunking_quality', 'warning', CAST(0 AS BIGINT) FROM files""", "files")
oracle("a8_isolated_findings", f"""WITH {FOUND} SELECT root_id, detector, detector AS category, severity, item_count, reclaimable_bytes FROM fnd WHERE detector <> 'duplicate_content'
UNION ALL SELECT DISTINCT root_id, 'duplicate_content', 'chunking_quality', 'warning', CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM files""", "files")
oracle("a9_audit", f"WITH {FOUND}, {_AUD} SELECT * FROM rep", "files")

_DIRS_TREE = DIRS.replace("FROM files", "FROM tree").replace("range(1, len(parts))", "range(1, len(parts) + CASE WHEN is_dir THEN 1 ELSE 0 END)").replace(
    "SELECT root_id, size_bytes, path, array", "SELECT root_id, coalesce(size_bytes, 0) AS size_bytes, path, array")
oracle("d_rule_from_sql", f"""SELECT root_id, 'raw_audio' AS detector, count(*) AS item_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes, max(coalesce(size_bytes, 0)) AS largest_bytes,
  min_by(path, (-coalesce(size_bytes, 0), path)) AS largest_path, CASE WHEN coalesce(sum(size_bytes), 0) >= {MIB} THEN 'warning' ELSE 'info' END AS severity
FROM tree WHERE NOT is_dir AND regexp_matches(lower(path), '[^/][.](wav|flac|obj)$') GROUP BY root_id""", "tree")
oracle("d2_stale_version_dir_empty", f"WITH {_DIRS_TREE}, {FIND['stale_version_dir'][0][1]} SELECT {_FCOLS} FROM ({FIND['stale_version_dir'][1]})", "tree")
_FOLDERS = """up AS (SELECT root_id, is_dir, size_bytes, folder AS own, unnest(list_concat([''], list_transform(range(1, CASE WHEN folder = '' THEN 1 ELSE len(parts) + 1 END), lambda i: array_to_string(parts[1:i], '/')))) AS folder
  FROM (SELECT *, string_split(folder, '/') AS parts FROM (SELECT *, CASE WHEN is_dir THEN path ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS folder FROM tree))),
 fs AS (SELECT root_id, folder, CAST(CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS INT) AS depth, count(*) FILTER (NOT is_dir) AS file_count,
  CAST(coalesce(sum(size_bytes) FILTER (NOT is_dir), 0) AS BIGINT) AS total_bytes, count(*) FILTER (NOT is_dir AND own = folder) AS own_files,
  CAST(coalesce(sum(size_bytes) FILTER (NOT is_dir AND own = folder), 0) AS BIGINT) AS own_bytes FROM up GROUP BY root_id, folder)"""
oracle("folder_sizes", f"WITH {_FOLDERS} SELECT * FROM fs", "tree")
oracle("heaviest_folders", f"""WITH {_FOLDERS} SELECT *, CAST(row_number() OVER (PARTITION BY root_id ORDER BY total_bytes DESC, folder) AS INT) AS rank FROM fs WHERE depth > 0
  QUALIFY rank <= 10""", "tree")
_OF_MOVED = lambda text: re.sub(r"\bfiles\b", "moved_files", text)
oracle("a9_incremental_audit", f"WITH {_OF_MOVED(FOUND)}, {_OF_MOVED(_AUD)} SELECT * FROM rep", "moved_files")
oracle("a1_incremental_findings", f"WITH {_OF_MOVED(FOUND)} SELECT {_FCOLS} FROM fnd", "moved_files")

# -- plans ---------------------------------------------------------------------------

_LOOSE = f"loose AS (SELECT root_id, path, size_bytes, {LANG} AS lang FROM files WHERE {EXT} <> 'pak' AND {RAW_CODE} IN ('fr', 'de'))"
oracle("p1_plan_strip_loose", f"WITH {_LOOSE} SELECT * FROM loose", "files")
oracle("p1_plan_strip_totals", f"WITH {_LOOSE} SELECT root_id, count(*) AS loose_files, {SUM('size_bytes')} AS loose_bytes, 'de,fr' AS drop_languages FROM loose GROUP BY root_id", "files")
oracle("p2_plan_strip_containers", f"""WITH {PAKS}, en AS (SELECT root_id, container_path, {RAW_CODE} IN ('fr', 'de') AS dropped FROM ent)
SELECT e.root_id, e.container_path, count(*) FILTER (dropped) AS dropped_entries, count(*) FILTER (NOT dropped) AS kept_entries, count(*) FILTER (NOT dropped) = 0 AS becomes_empty
FROM en e JOIN paks p ON p.root_id = e.root_id AND p.path = e.container_path WHERE p.probe_error IS NULL AND NOT p.has_sig GROUP BY ALL HAVING count(*) FILTER (dropped) > 0""", "files", "ent")
oracle("p3_plan_strip_skipped", f"""WITH {PAKS}, s AS (SELECT root_id, path AS container_path, size_bytes, {STATUS} AS status, probe_error FROM paks)
SELECT root_id, container_path, size_bytes, status, CASE WHEN status = 'unreadable' THEN probe_error END AS reason FROM s WHERE status <> 'readable'""", "files")
oracle("p4_plan_recompress", f"""SELECT root_id, {RECOMP} AS kind, {ENCODER} AS encoder, count(*) AS file_count, {SUM('size_bytes')} AS bytes FROM files
WHERE {RECOMP} IS NOT NULL GROUP BY ALL""", "files")
_PCOLS = "tex_id, asset_path, current_mip0_dim, kept_mip0_dim, drop_mip_count, kept_mip_count, save_bytes, original_bytes"
oracle("p5_plan_mip_strip", f"WITH {MIPS}, {PLAN_SQL} SELECT {_PCOLS} FROM plan", "tex")
oracle("p6_mip_strip_totals", f"WITH {MIPS}, {PLAN_SQL} SELECT count(*) AS textures, {SUM('save_bytes')} AS save_bytes, {SUM('original_bytes')} AS original_bytes FROM plan", "tex")
_SWEEP = f"""ck AS (SELECT tex_id, cap, {_kept('cap')} AS kept FROM mip, (SELECT unnest([256, 512, 1024, 2048]) AS cap) GROUP BY ALL),
 sw AS (SELECT cap, m.tex_id, m.asset_path, max(CASE WHEN level = 0 THEN greatest(w, h) END) AS current_mip0_dim, max(CASE WHEN level = kept THEN greatest(w, h) END) AS kept_mip0_dim,
   any_value(kept) AS drop_mip_count, CAST(count(*) - any_value(kept) AS INT) AS kept_mip_count, CAST(coalesce(sum(bytes) FILTER (level < kept), 0) AS BIGINT) AS save_bytes,
   CAST(sum(bytes) AS BIGINT) AS original_bytes FROM mip m JOIN ck USING (tex_id) GROUP BY cap, m.tex_id, m.asset_path)"""
oracle("p7_reproject", f"WITH {MIPS}, {_SWEEP} SELECT cap, {_PCOLS} FROM sw WHERE save_bytes > 0", "tex")
oracle("p7_reproject_totals", f"""WITH {MIPS}, {_SWEEP} SELECT cap, count(*) AS textures, {SUM('save_bytes')} AS save_bytes, {SUM('original_bytes')} AS original_bytes
FROM sw WHERE save_bytes > 0 GROUP BY cap""", "tex")
def _curve(by: str) -> str:
    """Every cap at which something changes, and what it saves by the definition of the kept level."""
    k, kk, on = (f"{by}, ", f"b.{by}, ", f"AND m.{by} = b.{by}") if by else ("", "", "")
    return f"""ed AS (SELECT DISTINCT {k}greatest(w, h) AS cap FROM mip m WHERE level < num_mips - 1 AND greatest(w, h) > 1 UNION SELECT DISTINCT {k}1 FROM mip),
 kp AS (SELECT {kk}b.cap, m.tex_id, {_kept('b.cap')} AS kept FROM ed b JOIN mip m ON true {on} GROUP BY ALL),
 sv AS (SELECT kp.*, (SELECT coalesce(sum(bytes), 0) FROM mip m WHERE m.tex_id = kp.tex_id AND m.level < kp.kept) AS save, (SELECT sum(bytes) FROM mip m WHERE m.tex_id = kp.tex_id) AS all_bytes FROM kp),
 cu AS (SELECT {k}CAST(cap AS INT) AS cap_from, CAST(coalesce(lead(cap) OVER ({"PARTITION BY " + by if by else ""} ORDER BY cap), 16385) - 1 AS INT) AS cap_to,
  count(*) FILTER (save > 0) AS textures, CAST(sum(save) AS BIGINT) AS save_bytes, CAST(coalesce(sum(all_bytes) FILTER (save > 0), 0) AS BIGINT) AS original_bytes FROM sv GROUP BY {k}cap)"""


oracle("p7_savings_curve", f"WITH {MIPS}, {_curve('')} SELECT * FROM cu", "tex")
oracle("p7_savings_curve_by_format", f"WITH {MIPS}, {_curve('pixel_format')} SELECT * FROM cu", "tex")
oracle("p7_savings_at", f"""WITH {MIPS}, {_SWEEP} SELECT cap, count(*) FILTER (save_bytes > 0) AS textures, {SUM('save_bytes')} AS save_bytes,
  CAST(coalesce(sum(original_bytes) FILTER (save_bytes > 0), 0) AS BIGINT) AS original_bytes FROM sw GROUP BY cap""", "tex")
oracle("p7_mildest_cap", f"""WITH {MIPS}, {_curve('pixel_format')}, t AS (SELECT pixel_format, sum(bytes) AS total FROM mip GROUP BY pixel_format),
 wa AS (SELECT pixel_format, CAST(unnest([total // 10, total * 5 // 10, total * 9 // 10, total + 1]) AS BIGINT) AS save_at_least FROM t)
SELECT wa.pixel_format, save_at_least, max(cap_to) AS cap, arg_max(save_bytes, cap_to) AS save_bytes FROM wa LEFT JOIN cu ON cu.pixel_format = wa.pixel_format AND save_bytes >= save_at_least GROUP BY ALL""", "tex")
oracle("p8_format_breakdown", f"WITH {MIPS}, {PLAN_SQL} SELECT pixel_format, count(*) AS textures, {SUM('save_bytes')} AS save_bytes FROM plan GROUP BY pixel_format", "tex")
oracle("p9_class_histogram", """SELECT coalesce(compression_settings, 'none') AS class_name, count(*) AS textures FROM tex GROUP BY ALL
ORDER BY textures DESC, class_name LIMIT 20""", "tex")
oracle("p10_plan_restore", f"""WITH c AS (SELECT {SMART} AS rc FROM tex) SELECT count(*) FILTER (rc = 'ai_upscale') AS ai_upscale,
  count(*) FILTER (rc = 'exact_backup') AS exact_backup, count(*) FILTER (rc = 'no_strip') AS no_strip FROM c""", "tex")
oracle("p11_eligible_targets", f"""WITH {MIPS}, {PLAN_SQL} SELECT tex_id, asset_path, {SMART} AS restore_class, save_bytes, kept_mip0_dim FROM plan
WHERE save_bytes > 0 AND {SMART} = 'ai_upscale'""", "tex")
_ELIG = """fl AS (SELECT tex_id, cap, min(level) FILTER (greatest(w, h) <= cap) AS fit FROM mip, (SELECT unnest([32, 128]) AS cap) GROUP BY tex_id, cap),
 el AS (SELECT tex_id, cap, CASE WHEN any_value(fit) IS NULL THEN 'no level small enough' WHEN any_value(fit) = 0 THEN 'already at or below cap' ELSE 'strip' END AS status,
   CAST(coalesce(sum(bytes) FILTER (level < fit), 0) AS BIGINT) AS saved_bytes FROM mip JOIN fl USING (tex_id) GROUP BY tex_id, cap)"""
oracle("p12_strip_eligibility", f"WITH {MIPS}, {_ELIG} SELECT * FROM el", "tex")
oracle("p13_skip_histogram", f"WITH {MIPS}, {_ELIG} SELECT status AS reason, count(*) AS textures FROM el WHERE status <> 'strip' GROUP BY status", "tex")
_DIFF = """df AS (SELECT coalesce(b.root_id, a.root_id) AS root_id, coalesce(b.path, a.path) AS path, b.size_bytes AS before_bytes, a.size_bytes AS after_bytes,
   CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.size_bytes < b.size_bytes THEN 'shrunk' WHEN a.size_bytes > b.size_bytes THEN 'grown' ELSE 'unchanged' END AS change,
   coalesce(b.size_bytes, 0) - coalesce(a.size_bytes, 0) AS saved_bytes, coalesce(a.size_bytes >= b.size_bytes, false) AS no_improvement
   FROM files b FULL JOIN after_files a ON a.root_id = b.root_id AND a.path = b.path)"""
oracle("p14_snapshot_diff", f"WITH {_DIFF} SELECT * FROM df", "files", "after_files")
oracle("p14_snapshot_diff_totals", f"WITH {_DIFF} SELECT root_id, change, count(*) AS file_count, {SUM('saved_bytes')} AS saved_bytes FROM df GROUP BY ALL", "files", "after_files")

# -- change manifests ----------------------------------------------------------------

DOCS = """docs AS (SELECT *, path || '#' || (min(seq) OVER (PARTITION BY path, seq // 1000) + 1600000000) AS manifest_id,
  row_number() OVER (PARTITION BY path, seq // 1000 ORDER BY seq) - 1 AS place FROM man)"""
oracle("b1_manifest_status", f"""WITH {DOCS} SELECT manifest_id, 1 AS version,
  strftime(make_timestamp((min(seq) + 1600000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_text, 'full' AS mode, CAST(count(*) AS INT) AS entry_count
FROM docs GROUP BY manifest_id""", "man")
oracle("b2_explode_strips", f"""WITH {DOCS} SELECT manifest_id, place AS seq, d.path, d.original_size, 0 AS strip_seq, asset_path, export_name, original_top_dim, stripped_top_dim,
  drop_mip_count, kept_mip_count, pixel_format, compression_settings, saved_bytes FROM docs d JOIN strips s ON s.seq = d.seq""", "man", "strips")
oracle("b3_replay_restore", f"""WITH {MSTAT}, ok AS (SELECT * FROM mst WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY full_path ORDER BY seq) = 1)
SELECT p.path, CASE WHEN ok.op IS NULL THEN 'unchanged' WHEN ok.op = 'create' THEN 'absent' ELSE 'restored' END AS outcome,
  CASE WHEN ok.op <> 'create' THEN ok.original_sha256 END AS sha256, CASE WHEN ok.op <> 'create' THEN ok.original_size END AS size_bytes
FROM (SELECT DISTINCT full_path AS path FROM mst) p LEFT JOIN ok ON ok.full_path = p.path""", "man")
oracle("b4_verify_restore", f"WITH {MSTAT} SELECT seq, full_path AS path, op, status FROM mst", "man")
_PROJ = f"""am AS (SELECT coalesce(compression_settings, 'none') AS compression_settings, {RATIO} AS ratio, {TOP} AS baseline, CAST(floor({TOP} * {RATIO}) AS BIGINT) AS projected FROM strips)"""
oracle("b5_project_savings", f"""WITH {_PROJ}, t AS (SELECT (SELECT {SUM('original_size')} FROM man) AS current_bytes, count(*) AS texture_count, {SUM('baseline')} AS baseline,
  {SUM('projected')} AS projected FROM am), u AS (SELECT *, projected + greatest(current_bytes - baseline, 0) AS projected_bytes FROM t)
SELECT texture_count, current_bytes, projected_bytes, greatest(current_bytes - projected_bytes, 0) AS savings_bytes, round(projected_bytes / current_bytes::DOUBLE, 6) AS ratio FROM u""", "man", "strips")
oracle("b5_project_classes", f"""WITH {_PROJ} SELECT compression_settings, ratio, count(*) AS texture_count, {SUM('baseline')} AS baseline_bytes, {SUM('projected')} AS projected_bytes
FROM am GROUP BY ALL""", "strips")

# -- paired benchmarks ---------------------------------------------------------------

oracle("q1_oracle_rows", f"WITH {PAIRS} SELECT label, oracle_ratio, winner FROM pairs", "ben")
_MED = """count(*) AS n, count(*) FILTER (winner = 'bilinear') AS a_wins, count(*) FILTER (winner = 'learned') AS b_wins, round(median(a_ratio), 6) AS a_median,
  round(median(b_ratio), 6) AS b_median, round(median(oracle_ratio), 6) AS oracle_median"""
oracle("q2_oracle_summary", f"WITH {PAIRS} SELECT {_MED} FROM pairs", "ben")
oracle("q3_oracle_by_class", f"WITH {PAIRS} SELECT content_class, {_MED} FROM pairs GROUP BY content_class", "ben")
oracle("q4_oracle_lift", f"""WITH {PAIRS}, s AS (SELECT count(*) AS n, least(median(a_ratio), median(b_ratio)) AS best, median(oracle_ratio) AS orc FROM pairs)
SELECT n, round(best, 6) AS best_forced_median, round(orc, 6) AS oracle_median, round(best - orc, 6) AS lift_abs, round((best - orc) / best * 100, 6) AS lift_pct,
  (best - orc) / best * 100 > 5 AS worthwhile FROM s""", "ben")
oracle("q5_feature_range_by_winner", f"""WITH {PAIRS} SELECT winner, count(*) AS n, min(hp_energy) AS feature_min, max(hp_energy) AS feature_max,
  round(median(hp_energy), 6) AS feature_median FROM pairs GROUP BY winner""", "ben")
oracle("q6_best_threshold", f"""WITH {PAIRS}, xs AS (SELECT DISTINCT hp_energy AS x FROM pairs), md AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS t FROM xs),
 acc AS (SELECT t, count(*) FILTER ((hp_energy >= t) = (winner = 'learned')) / count(*)::DOUBLE AS accuracy,
   greatest(count(*) FILTER (winner = 'learned'), count(*) FILTER (winner <> 'learned')) / count(*)::DOUBLE AS majority FROM md, pairs WHERE t IS NOT NULL GROUP BY t)
SELECT round(t, 6) AS threshold, round(accuracy, 6) AS accuracy, round(majority, 6) AS majority FROM acc ORDER BY acc.accuracy DESC, t LIMIT 1""", "ben")
oracle("q7_router_gate", """WITH c AS (SELECT predictor, count(*) FILTER (ratio < 1) AS codec_wins, count(*) FILTER (ratio >= 1) AS backup_wins, avg(ratio) AS always_codec, avg(least(ratio, 1.0)) AS perfect
  FROM ben GROUP BY predictor)
SELECT predictor, codec_wins, backup_wins, round(always_codec, 6) AS always_codec, round(perfect, 6) AS perfect, round(always_codec - perfect, 6) AS headroom, round(1 - perfect, 6) AS value_vs_backup,
  always_codec - perfect > 0.005 AS headroom_is_real FROM c""", "ben")
oracle("q8_grid_threshold", f"""WITH {GRID}, best AS (SELECT *, correct / total::DOUBLE AS a, greatest(pos_total, total - pos_total) / total::DOUBLE AS m FROM grid
  QUALIFY row_number() OVER (PARTITION BY predictor ORDER BY correct DESC, step) = 1)
SELECT predictor, round(threshold, 6) AS threshold, round(a, 6) AS accuracy, round(m, 6) AS majority, CASE WHEN pos_total = 0 THEN 'no_decision' WHEN a > m + 0.02 THEN 'pass' ELSE 'fail' END AS verdict FROM best""", "ben")
oracle("q9_mean_cost_by_class", f"SELECT predictor, {SUFFIX} AS label_class, count(*) AS n, round(avg(ratio), 6) AS mean_cost FROM ben GROUP BY ALL", "ben")
_RUNS = f"rr AS (SELECT {SUFFIX} AS label_class, baseline_bytes AS top, CAST(floor(ratio * baseline_bytes) AS BIGINT) AS res, lossless FROM ben)"
_ACCOUNT = f"""count(*) AS n, {SUM('top')} AS top_bytes, {SUM('res')} AS residual_bytes, {SUM('top - res')} AS net_bytes, count(*) FILTER (res < top) AS wins,
  round(avg(res / greatest(top, 1)::DOUBLE), 6) AS mean_sidecar, count(*) FILTER (lossless) AS byte_exact"""
oracle("q10_residual_accounting", f"WITH {_RUNS} SELECT {_ACCOUNT} FROM rr", "ben")
oracle("q10_residual_accounting_by_class", f"WITH {_RUNS} SELECT label_class, {_ACCOUNT} FROM rr GROUP BY label_class", "ben")
_STEP = "st AS (SELECT *, [1, 2, 4][CAST(length(label) % 3 AS INT) + 1] AS quant_step FROM ben)"
oracle("q11_best_lossless", f"""WITH {_STEP} SELECT round(coalesce(min(ratio) FILTER (quant_step = 1 AND lossless), 0), 6) AS best_ratio,
  count(*) FILTER (quant_step = 1 AND lossless) AS lossless_runs, count(*) AS total_runs FROM st""", "ben")
oracle("q12_lossless_rate", f"""WITH {_STEP} SELECT count(*) FILTER (lossless) AS passed, count(*) AS total, round(count(*) FILTER (lossless) / count(*)::DOUBLE, 6) AS rate
FROM st WHERE quant_step = 1""", "ben")

# -- rasters -------------------------------------------------------------------------

ENERGY = """nb AS (SELECT image_id, r, lag(r) OVER xw AS le, lead(r) OVER xw AS ri, lag(r) OVER yw AS up, lead(r) OVER yw AS dn FROM pixels
   WINDOW xw AS (PARTITION BY image_id, y ORDER BY x), yw AS (PARTITION BY image_id, x ORDER BY y)),
 en AS (SELECT image_id, coalesce(avg(abs(r - (up + dn + le + ri) // 4)), 0) AS e FROM nb GROUP BY image_id)"""
oracle("r1_high_pass_energy", f"WITH {ENERGY} SELECT image_id, round(e, 6) AS hp_energy FROM en", "pixels")
oracle("r2_patch_variance", """WITH t AS (SELECT image_id, y // 4 AS ty, x // 4 AS tx, avg(r) AS m FROM pixels GROUP BY ALL)
SELECT image_id, round(var_pop(m), 12) AS patch_variance FROM t GROUP BY image_id""", "pixels")
oracle("r3_codec_space_route", f"WITH {ENERGY} SELECT image_id, round(e, 6) AS hp_energy, CASE WHEN e < 25 THEN 'pixel' ELSE 'bc3_byte' END AS codec_space FROM en", "pixels")
oracle("r4_average_hash", f"WITH {HASH} SELECT image_id, ahash FROM ah", "near_pixels")
oracle("r5_exact_duplicates", "SELECT sha256(text) AS content_sha256, count(*) AS copies, count(*) - 1 AS redundant FROM documents GROUP BY 1 HAVING count(*) > 1")
oracle("r6_near_duplicates", f"WITH {HASH} SELECT distance, count(*) AS hash_pairs, {SUM('images_a * images_b')} AS image_pairs FROM np GROUP BY distance", "near_pixels")
oracle("r7_multimap_groups", """SELECT regexp_extract(label, '^[A-Za-z]+') AS material, count(*) AS maps FROM ben GROUP BY 1 HAVING count(*) >= 2""", "ben")


def _half(source: str) -> str:
    return f"(SELECT image_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST((sum(r) + 2) // 4 AS INT) AS r FROM {source} GROUP BY image_id, x // 2, y // 2 HAVING count(*) = 4)"


_RGB = "SELECT image_id, x, y, r, r AS g, r AS b FROM"
oracle("r8_box_downsample", f"{_RGB} {_half('pixels')}", "pixels")
oracle("r8_box_downsample_4x", f"{_RGB} {_half(_half('pixels'))}", "pixels")


def _up(name: str, source: str, edge: int) -> str:
    wide = edge * 2
    scale = f"(CAST({edge - 1} AS FLOAT) / CAST({wide - 1} AS FLOAT))"
    one = "CAST(1 AS FLOAT)"
    at = lambda x, y: f"CAST(px[{y} * {edge} + {x} + 1] AS FLOAT)"
    return f"""{name}_lo AS (SELECT image_id, list(r ORDER BY y, x) AS px FROM {source} GROUP BY image_id),
 {name}_t AS (SELECT CAST(t AS INT) AS t, CAST(t AS FLOAT) * {scale} AS f FROM range(0, {wide}) r(t)),
 {name}_a AS (SELECT t, f, CAST(floor(f) AS INT) AS p0, least(CAST(floor(f) AS INT) + 1, {edge - 1}) AS p1, f - CAST(floor(f) AS FLOAT) AS wgt FROM {name}_t),
 {name}_s AS (SELECT image_id, xx.t AS x, yy.t AS y, {at('xx.p0', 'yy.p0')} * ({one} - xx.wgt) + {at('xx.p1', 'yy.p0')} * xx.wgt AS top,
   {at('xx.p0', 'yy.p1')} * ({one} - xx.wgt) + {at('xx.p1', 'yy.p1')} * xx.wgt AS bot, yy.wgt AS wy
   FROM {name}_lo CROSS JOIN {name}_a xx CROSS JOIN {name}_a yy),
 {name} AS (SELECT image_id, x, y, CAST(greatest(0, least(255, floor(CAST(top * ({one} - wy) + bot * wy AS DOUBLE) + 0.5))) AS INT) AS r FROM {name}_s)"""


oracle("r9_bilinear_upsample", f"WITH {_up('up', 'pixels', 8)} {_RGB} up", "pixels")
_PRED = _up("pred", _half("pixels"), 4)
oracle("r10_residual", f"""WITH {_PRED} SELECT image_id, x, y, q.r AS r_pred, {_quant('(p.r - q.r)', 2)} AS r_q FROM pixels p JOIN pred q USING (image_id, x, y)""", "pixels")
oracle("r11_reconstruct_check", f"""WITH {_PRED}, e AS (SELECT image_id, p.r, greatest(0, least(255, q.r + {_quant('(p.r - q.r)', 4)} * 4)) AS back FROM pixels p JOIN pred q USING (image_id, x, y))
SELECT image_id, CAST(max(abs(back - r)) AS INT) AS max_error, max(abs(back - r)) = 0 AS exact FROM e GROUP BY image_id""", "pixels")
oracle("r12_shannon_entropy", f"""WITH {_PRED}, d AS (SELECT image_id, p.r - q.r + 65536 AS u FROM pixels p JOIN pred q USING (image_id, x, y)),
 sy AS (SELECT image_id, unnest([u % 256, (u // 256) % 256]) AS s FROM d, range(0, 3) r(i)), ct AS (SELECT image_id, s, count(*) AS n FROM sy GROUP BY ALL),
 pr AS (SELECT image_id, n, n / (sum(n) OVER (PARTITION BY image_id))::DOUBLE AS p FROM ct)
SELECT image_id, round(abs(sum(p * log2(p))), 6) AS entropy_bits, {SUM('n')} AS symbol_count FROM pr GROUP BY image_id""", "pixels")
oracle("r13_crop_to_multiple", "SELECT image_id, x, y, r FROM pixels WHERE x < 6 AND y < 6", "pixels")
_ALL = ("r", "g", "b")


def _half_rgb(source: str) -> str:
    means = ", ".join(f"CAST((sum({c}) + 2) // 4 AS INT) AS {c}" for c in _ALL)
    return f"(SELECT image_id, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, {means} FROM {source} GROUP BY image_id, x // 2, y // 2 HAVING count(*) = 4)"


def _up_rgb(name: str, source: str) -> str:
    """Twice the size of images of any size."""
    def value(c: str) -> str:
        one, f = "CAST(1 AS FLOAT)", lambda t: f"CAST({t}.{c} AS FLOAT)"
        top = f"({f('p')} * ({one} - xx.wgt) + {f('q')} * xx.wgt)"
        low = f"({f('s')} * ({one} - xx.wgt) + {f('u')} * xx.wgt)"
        return f"CAST(greatest(0, least(255, floor(CAST({top} * ({one} - yy.wgt) + {low} * yy.wgt AS DOUBLE) + 0.5))) AS INT) AS {c}"

    return f"""{name}_lo AS (SELECT * FROM {source}),
 {name}_z AS (SELECT image_id, CAST(max(x) + 1 AS INT) AS w, CAST(max(y) + 1 AS INT) AS h FROM {name}_lo GROUP BY image_id),
 {name}_n AS (SELECT w AS n FROM {name}_z UNION SELECT h FROM {name}_z),
 {name}_f AS (SELECT n, CAST(t AS INT) AS t, CAST(t AS FLOAT) * CAST(CAST(CAST(n AS FLOAT) - CAST(1 AS FLOAT) AS DOUBLE) / CAST(greatest(n * 2 - 1, 1) AS DOUBLE) AS FLOAT) AS f
   FROM (SELECT n, unnest(range(0, n * 2)) AS t FROM {name}_n)),
 {name}_a AS (SELECT n, t, CAST(floor(f) AS INT) AS p0, least(CAST(floor(f) AS INT) + 1, n - 1) AS p1, f - CAST(floor(f) AS FLOAT) AS wgt FROM {name}_f),
 {name} AS (SELECT z.image_id, xx.t AS x, yy.t AS y, {", ".join(map(value, _ALL))}
   FROM {name}_z z JOIN {name}_a xx ON xx.n = z.w JOIN {name}_a yy ON yy.n = z.h
   JOIN {name}_lo p ON p.image_id = z.image_id AND p.x = xx.p0 AND p.y = yy.p0 JOIN {name}_lo q ON q.image_id = z.image_id AND q.x = xx.p1 AND q.y = yy.p0
   JOIN {name}_lo s ON s.image_id = z.image_id AND s.x = xx.p0 AND s.y = yy.p1 JOIN {name}_lo u ON u.image_id = z.image_id AND u.x = xx.p1 AND u.y = yy.p1)"""


def _lines(source: str, channels=_ALL) -> str:
    sums = ", ".join(f"CAST(sum({c} * (x + 1)) AS BIGINT) AS {c}" for c in channels)
    return f"SELECT image_id, y, count(*) AS n, {sums} FROM {source} GROUP BY image_id, y"


_NEXT = ", ".join(f"{f}({c}) OVER {w} AS {c}_{n}" for c in _ALL for n, f, w in (("le", "lag", "xw"), ("ri", "lead", "xw"), ("up", "lag", "yw"), ("dn", "lead", "yw")))
_GAPS = " + ".join(f"abs({c} - ({c}_up + {c}_dn + {c}_le + {c}_ri) // 4)" for c in _ALL)
oracle("r1_tiles_high_pass_energy", f"""WITH nb AS (SELECT image_id, r, g, b, {_NEXT} FROM ras
   WINDOW xw AS (PARTITION BY image_id, y ORDER BY x), yw AS (PARTITION BY image_id, x ORDER BY y))
SELECT image_id, round(coalesce(avg({_GAPS}) / 3, 0), 6) AS hp_energy FROM nb GROUP BY image_id""", "ras")
oracle("r2_tiles_patch_variance", """WITH p AS (SELECT CAST(unnest([4, 8, 16, 32]) AS INT) AS patch),
 t AS (SELECT image_id, patch, y // patch AS ty, x // patch AS tx, sum((299 * r + 587 * g + 114 * b) // 1000) AS m FROM ras, p GROUP BY image_id, patch, y // patch, x // patch HAVING count(*) = patch * patch),
 v AS (SELECT image_id, patch, CAST(count(*) * sum(m * m) - sum(m) * sum(m) AS DOUBLE) / CAST(count(*) * count(*) * patch * patch * patch * patch AS DOUBLE) AS v FROM t GROUP BY image_id, patch)
SELECT i.image_id, p.patch, coalesce(v, 0) AS patch_variance FROM (SELECT DISTINCT image_id FROM ras) i CROSS JOIN p
 LEFT JOIN v ON v.image_id = i.image_id AND v.patch = p.patch""", "ras")
oracle("r4_tiles_average_hash", """WITH z AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM ras GROUP BY image_id), n AS (SELECT w AS n FROM z UNION SELECT h FROM z),
 c AS (SELECT n, i, i * n // 8 AS lo, least(greatest((i + 1) * n // 8, i * n // 8 + 1), n) AS hi FROM n, range(0, 8) q(i)),
 m AS (SELECT ras.image_id, cy.i * 8 + cx.i AS cell, sum(299 * r + 587 * g + 114 * b) / (count(*) * 1000) AS m FROM ras JOIN z ON z.image_id = ras.image_id
   JOIN c cx ON cx.n = z.w AND x >= cx.lo AND x < cx.hi JOIN c cy ON cy.n = z.h AND y >= cy.lo AND y < cy.hi GROUP BY ALL),
 o AS (SELECT image_id, list_reduce(list(m ORDER BY cell), lambda a, b: a + b) / 64 AS o FROM m GROUP BY image_id),
 s AS (SELECT m.image_id, sum(CASE WHEN m >= o THEN (1::HUGEINT << CAST(cell AS INT)) ELSE 0 END)::HUGEINT AS s FROM m JOIN o ON o.image_id = m.image_id GROUP BY m.image_id)
SELECT image_id, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS ahash FROM s""", "ras")
oracle("r8_tiles_box_downsample", _lines(_half_rgb("ras")), "ras")
oracle("r8_tiles_box_downsample_4x", _lines(_half_rgb(_half_rgb("ras"))), "ras")
_PRED_RGB = _up_rgb("pred", _half_rgb("ras"))
oracle("r9_tiles_bilinear_upsample", f"WITH {_PRED_RGB} {_lines('pred')}", "ras")
_MINUS = ", ".join(f"p.{c} AS {c}, q.{c} AS {c}_pred, {{{c}}} AS {c}_q" for c in _ALL)
_DIFF = lambda step: f"d AS (SELECT p.image_id, p.x, p.y, {_MINUS.format(**{c: _quant(f'(p.{c} - q.{c})', step) for c in _ALL})} FROM ras p JOIN pred q USING (image_id, x, y))"
oracle("r10_tiles_residual", f"WITH {_PRED_RGB}, {_DIFF(2)} {_lines('d', ('r_pred', 'r_q', 'g_q', 'b_q'))}", "ras")
_ERR = ", ".join(f"abs(greatest(0, least(255, {c}_pred + {c}_q * 4)) - {c})" for c in _ALL)
oracle("r11_tiles_reconstruct_check", f"""WITH {_PRED_RGB}, {_DIFF(4)}, e AS (SELECT image_id, max(greatest({_ERR})) AS e FROM d GROUP BY image_id)
SELECT image_id, CAST(e AS INT) AS max_error, e = 0 AS exact FROM e""", "ras")
oracle("r12_tiles_shannon_entropy", f"""WITH {_PRED_RGB}, {_DIFF(1)}, u AS (SELECT image_id, unnest([r_q, g_q, b_q]) + 65536 AS u FROM d),
 sy AS (SELECT image_id, unnest([u % 256, (u // 256) % 256]) AS s FROM u), ct AS (SELECT image_id, s, count(*) AS n FROM sy GROUP BY ALL),
 pr AS (SELECT image_id, n, n / (sum(n) OVER (PARTITION BY image_id))::DOUBLE AS p FROM ct)
SELECT image_id, round(abs(sum(p * log2(p))), 6) AS entropy_bits, {SUM('n')} AS symbol_count FROM pr GROUP BY image_id""", "ras")
_SIZES = "z AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM ras GROUP BY image_id)"
oracle("r13_tiles_crop_to_multiple", f"WITH {_SIZES} " + _lines("(SELECT ras.* FROM ras JOIN z USING (image_id) WHERE x < w - w % 5 AND y < h - h % 5)"), "ras")
oracle("r14_mip_table", f"""WITH {MIPS} SELECT asset_path, CAST(num_mips AS INT) AS mip_count, CAST(sum(bytes) OVER (PARTITION BY tex_id) AS BIGINT) AS total_bytes, level AS mip_index, w, h, bytes FROM mip""", "tex")

# -- entry browser -------------------------------------------------------------------

oracle("e1_entry_class_counts", f"""SELECT root_id, {ENTRY} AS entry_class, count(*) AS entry_count FROM ent GROUP BY ALL
UNION ALL SELECT root_id, 'all', count(*) FROM ent GROUP BY root_id""", "ent")
oracle("e2_search_entries", f"""SELECT root_id, container_path, path, size_bytes, {ENTRY} AS entry_class,
  CAST(row_number() OVER (PARTITION BY root_id, container_path ORDER BY size_bytes DESC, path) AS INT) AS position
FROM ent WHERE contains(lower(path), 'l10n/fr') QUALIFY position <= 2""", "ent")

# -- sources and sinks ---------------------------------------------------------------

oracle("s1_scan_inventory", "SELECT root_id, path, size_bytes, content_sha256, probe_error FROM files", "files")
oracle("s1_inventory_source", """WITH f AS (SELECT tex_id % 3 AS root_id, asset_path || CASE WHEN tex_id % 7 = 0 THEN '/.cache' ELSE '' END AS folder,
  CASE WHEN tex_id % 5 = 0 THEN '_' ELSE '' END || export_name || '.bin' AS name, CAST(size_x * num_mips AS BIGINT) AS size_bytes FROM tex),
 a AS (SELECT root_id, false AS is_dir, folder || '/' || name AS path, size_bytes FROM f
  UNION SELECT root_id, true, array_to_string(parts[1:i], '/'), 0 FROM (SELECT root_id, string_split(folder, '/') AS parts FROM f), range(1, 9) r(i) WHERE i <= len(parts))
SELECT CAST(root_id AS BIGINT) AS root_id, path, is_dir, size_bytes FROM a WHERE path LIKE 'Game/Content/%' AND root_id < 2 AND (is_dir OR size_bytes >= 1000)""", "tex")
oracle("s2_read_entries", """SELECT root_id, container_path, path, CAST(position AS INT) AS position, n > 3 AS truncated FROM (SELECT *, row_number() OVER
  (PARTITION BY root_id, container_path ORDER BY path) AS position, count(*) OVER (PARTITION BY root_id, container_path) AS n FROM ent) WHERE position <= 3""", "ent")
_BENCH = """bench AS (SELECT 'corpus/' || label || '.png' AS path, label, 512 AS w, 512 AS h, 'rgba8' AS format, 1 AS quant_step, baseline_bytes,
  CAST(floor(ratio * baseline_bytes) AS BIGINT) AS residual_bytes, CAST(65536 AS BIGINT) AS low_mip_bytes, CAST(floor(ratio * baseline_bytes + 65536) AS BIGINT) AS total_codec_bytes,
  ratio AS ratio_vs_baseline, lossless AS lossless_pass, hp_energy, CASE WHEN hp_energy < 25 THEN 'pixel' ELSE 'bc3_byte' END AS recommended_space, predictor FROM ben)"""
oracle("s3_read_bench", f"WITH {_BENCH} SELECT * EXCLUDE (predictor) FROM bench QUALIFY row_number() OVER (PARTITION BY label ORDER BY predictor DESC) = 1", "ben")
oracle("s4_read_manifest", f"""WITH {DOCS} SELECT manifest_id, place AS seq, d.path, op, original_sha256, d.original_size, CASE WHEN op = 'create' THEN '' ELSE 'p' || d.seq END AS payload,
  CAST(s.seq IS NOT NULL AS INT) AS strips FROM docs d LEFT JOIN (SELECT DISTINCT seq FROM strips) s ON s.seq = d.seq""", "man", "strips")
oracle("s4_mixed_versions", f"""WITH {DOCS}, d AS (SELECT manifest_id, min(seq) + 1600000000 AS created_at, count(*) AS n FROM docs GROUP BY manifest_id)
SELECT manifest_id, CASE WHEN created_at % 3 = 0 THEN 3 ELSE 1 END AS version, 'full' AS mode, CASE WHEN created_at % 3 = 0 THEN 'new' END AS tool, CAST(n AS INT) AS entry_count FROM d""", "man")
oracle("s4_refused_documents", f"WITH {DOCS} SELECT 1 AS version, 'entry 0 cannot be read' AS reason, count(DISTINCT manifest_id) AS documents FROM docs", "man")
oracle("s4_read_manifest_split", """SELECT 'r' AS root, CAST(7 AS BIGINT) AS created_at, row_number() OVER (ORDER BY m.seq) - 1 AS seq, path, op, original_sha256, original_size,
  CASE WHEN op = 'create' THEN '' ELSE 'p' || m.seq END AS payload, CAST(s.seq IS NOT NULL AS INT) AS strips FROM man m LEFT JOIN (SELECT DISTINCT seq FROM strips) s ON s.seq = m.seq""", "man", "strips")
oracle("s5_write_report_json", f"""WITH {FOUND}, {EVID}, {_AUD}, re AS (SELECT *, CAST(row_number() OVER (PARTITION BY root_id, detector ORDER BY size_bytes DESC, path) AS INT) AS rank,
  greatest(count(*) OVER (PARTITION BY root_id, detector) - 5, 0) AS more FROM ev)
SELECT rep.root_id, rep.total_bytes, rep.reclaimable_bytes, score, 1 AS schema_version, 13 AS roster, fnd.detector, fnd.severity, true AS advised, coalesce(more, 0) AS more,
  rank, path, size_bytes, note FROM rep JOIN fnd USING (root_id) LEFT JOIN re ON re.root_id = rep.root_id AND re.detector = fnd.detector AND rank <= 5""", "files")
oracle("s6_render_report_markdown", f"""WITH {FOUND}, {EVID}, {_AUD}, re AS (SELECT *, row_number() OVER (PARTITION BY root_id, detector ORDER BY size_bytes DESC, path) AS rank,
  count(*) OVER (PARTITION BY root_id, detector) AS n FROM ev)
SELECT root_id, 'score' AS kind, 'Score: ' || score || '/100 (' || score_label || ')' AS line FROM rep
UNION ALL SELECT root_id, 'finding', '### [' || severity || ']' FROM fnd
UNION ALL SELECT root_id, 'category', '| ' || detector || ' |' FROM fnd WHERE reclaimable_bytes IS NOT NULL
UNION ALL SELECT root_id, 'evidence', '- `' || path || '` _' || note || '_' FROM re WHERE rank <= 5
UNION ALL SELECT DISTINCT root_id, 'more', '- … and ' || (n - 5) || ' more of ' || detector FROM re WHERE n > 5""", "files")
oracle("s7_write_bench_csv", f"""WITH {_BENCH} SELECT concat_ws(',', '"' || path || '"', label, w, h, format, quant_step, baseline_bytes, residual_bytes, low_mip_bytes, total_codec_bytes,
  printf('%.6f', ratio_vs_baseline), CAST(lossless_pass AS VARCHAR), printf('%.4f', hp_energy), recommended_space) AS value FROM bench""", "ben")
