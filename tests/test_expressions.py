import pytest
from pyspark.sql import functions as F

from heftmap.functions import numbers as N
from heftmap.functions import paths as P
from heftmap.functions import textures as T


def apply(spark, build, cases):
    """Evaluate build(column) over the inputs of cases, an input -> expected mapping."""
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v string").select("i", build(F.col("v")).alias("r"))
    got = {r["i"]: r["r"] for r in rows.collect()}
    return {v: got[i] for i, v in enumerate(cases)}


@pytest.mark.parametrize("build, cases", [
    (P.norm_path, {"Game\\Art/X.PNG": "game/art/x.png"}),
    (P.ext, {"a/.bak": "", "x.tar.GZ": "gz", "a.b/c": "", "x.": "", "a/b.Pak": "pak", ".a.b": "b"}),
    (P.stem, {"a/x.pak": "a/x", "a.b/c": "a.b/c", "a/.bak": "a/.bak", "x.tar.gz": "x.tar"}),
    (P.file_kind, {"a/x.PAK": "pak", "a/CEF3/x.pak": "other", "cef/de.pak": "other", "x.dds": "texture", "x.opus": "audio", "x.bin": "other"}),
    (P.detect_language, {
        "Game/L10N/en-us/x.ogg": "en-US", "Game/Localization/Game/zh-hans/x": "zh-Hans", "Game/L10N/UI/x.ogg": None,
        "fr/L10N/x.ogg": None, "Game/l10n/VR/fr/x": "fr", "L10N/de": "de", "Game/L10Nx/de/f": None,
        "Game\\L10N\\pt-BR\\x": "pt-BR", "Game/L10N/en-u1/x.ogg": None,
    }),
    (P.is_language_code, {"en": True, "En": False, "zho": True, "en-US": True, "en-U1": False, "english": False}),
    (P.is_satellite_code, {"en-U1": True, "pt-BR": True, "zho-Hant": True, "e": False, "en-": False, "bin": True}),
    (lambda c: F.array_join(P.parse_version(c), "."), {
        "3.3.11": "3.3.11", "3.x": None, "1.2.3.4.5": None, "4294967296": None, "4294967295": "4294967295", "1..2": None, "+1.2": "1.2",
    }),
    (P.chunk_id, {"pakchunk70-Win.pak": "70", "pakchunk0optional-Win.pak": "0optional", "pakchunk-Win.pak": None, "Pakchunk1-x.pak": None, "pakchunk1-x.PAK": None}),
    (P.is_patch_chunk, {"pakchunk7-Win_P.pak": True, "pakchunk7-Win.pak": False, "x_P.pak": False}),
    (P.path_escapes_root, {"../a": True, "a/../b": False, "a/../../b": True, "./a": False, "a//../..": True, "/a": False}),
    (P.is_keeper_locale, {"EN-us.pak": True, "en.pak": True, "de.pak": False}),
    (lambda c: T.label_suffix(c), {"Wood_01_Color.png": "Color", "plain": "plain"}),
    (lambda c: T.split_name(c)["map_class"], {"Wood_Color.png": "Color", "plain.png": "?"}),
    (T.content_class, {"WoodColor_Normal": "color", "x_NormalGL": "normal", "x_Roughness": "roughness", "x": "other"}),
])
def test_text_expressions(spark, build, cases):
    assert apply(spark, build, cases) == cases


def test_language_order_by_segment_not_text(spark):
    versions = spark.createDataFrame([("3.3.9",), ("3.3.11",), ("3.3",)], "v string")
    ordered = versions.orderBy(P.parse_version(F.col("v"))).collect()
    assert [r["v"] for r in ordered] == ["3.3", "3.3.9", "3.3.11"]


def test_container_status(spark):
    rows = spark.createDataFrame(
        [(None, True, "signed"), (None, False, "readable"), ("unsupported or encrypted", False, "unreadable"),
         ("AES key missing", False, "encrypted"), ("is Encrypted", False, "encrypted"), ("bad header", False, "unreadable"),
         ("is encrypted", True, "signed")],
        "e string, s boolean, want string",
    )
    got = rows.select("want", P.container_status(F.col("e"), F.col("s")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


@pytest.mark.parametrize("n, text", [
    (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1024**2 - 1, "1024.00 KB"), (1024**3, "1.00 GB"),
    (2 * 1024**4, "2.00 TB"), (131072 + 1024 * 1024, "1.12 MB"), (3 * 131072 + 1024 * 1024, "1.38 MB"), (5000 * 1024**4, "5000.00 TB"),
])
def test_format_bytes(spark, n, text):
    assert spark.range(1).select(N.format_bytes(F.lit(n).cast("bigint"))).first()[0] == text


def test_score_labels_and_epoch(spark):
    labels = spark.range(1).select(*[N.score_label(F.lit(s)) for s in (0, 19, 20, 49, 50, 79, 80, 100)]).first()
    assert list(labels) == ["clean", "clean", "mild", "mild", "structural bloat", "structural bloat", "severe", "severe"]
    assert spark.range(1).select(N.rfc3339(F.lit(0).cast("bigint"))).first()[0] == "1970-01-01T00:00:00Z"
    assert spark.range(1).select(N.rfc3339(F.lit(951782400).cast("bigint"))).first()[0] == "2000-02-29T00:00:00Z"


def test_quantize_rounds_half_away_and_rejects_zero(spark):
    values = spark.range(-5, 6).select(N.quantize(F.col("id").cast("int"), 2).alias("q")).collect()
    assert [r["q"] for r in values] == [-3, -2, -2, -1, -1, 0, 1, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        N.quantize(F.lit(1), 0)


@pytest.mark.parametrize("fmt, w, h, size", [
    ("PF_DXT1", 4, 4, 8), ("PF_BC4", 1, 1, 8), ("PF_DXT5", 5, 4, 32), ("PF_ASTC_4x4", 10, 10, 100), ("PF_ASTC_6x6", 7, 6, 32),
    ("PF_ASTC_8x8_HDR", 9, 9, 64), ("PF_G8", 3, 3, 9), ("PF_R16F", 3, 3, 18), ("PF_A2B10G10R10", 2, 2, 16), ("PF_FloatRGBA", 2, 2, 32),
    ("PF_A32B32G32R32F", 2, 2, 64), ("PF_Whatever", 8, 8, 64),
])
def test_bytes_for_mip(spark, fmt, w, h, size):
    assert spark.range(1).select(T.bytes_for_mip(F.lit(fmt), F.lit(w), F.lit(h))).first()[0] == size


@pytest.mark.parametrize("name, setting, fmt, policy, want", [
    ("T_x_N", None, "PF_DXT5", "smart", "exact_backup"), ("T_x_lut", None, "PF_DXT5", "smart", "no_strip"),
    ("T_x", None, "pf_bc5", "smart", "exact_backup"), ("T_x", None, "PF_DXT5", "smart", "ai_upscale"),
    ("T_x_N", "TC_Default", "PF_BC5", "smart", "ai_upscale"), ("T_x_N", "TC_Unheard", "PF_DXT1", "smart", "exact_backup"),
    ("T_x", " tc_hdr ", "PF_DXT1", "smart", "exact_backup"), ("T_x", "TC_EditorIcon", "PF_DXT1", "smart", "no_strip"),
    ("T_x_N", "TC_Normalmap", "PF_BC5", "aggressive", "ai_upscale"), ("T_x", "TC_LookupTable", "PF_DXT1", "aggressive", "no_strip"),
    ("ColorGrade_a", None, "PF_DXT1", "aggressive", "no_strip"), ("T_lut", None, "PF_DXT1", "conservative", "exact_backup"),
    ("T_x", None, "PF_DXT1", "never_strip", "no_strip"),
])
def test_restore_class(spark, name, setting, fmt, policy, want):
    column = T.restore_class(F.lit(name), F.lit(setting).cast("string"), F.lit(fmt), policy)
    assert spark.range(1).select(column).first()[0] == want


def test_unknown_policy_is_rejected(spark):
    with pytest.raises(ValueError):
        T.restore_class(F.lit("x"), F.lit("y"), F.lit("z"), "reckless")


def test_rel_posix_and_magic(spark):
    row = spark.range(1).select(
        P.rel_posix(F.lit("D:\\g\\r1\\a\\b"), F.lit("D:\\g\\r1")), P.rel_posix(F.lit("/g/r10/a"), F.lit("/g/r1")),
        P.has_magic(F.lit(b"OggSxx"), "ogg"), P.has_magic(F.lit(b"\x89PNG\r\n\x1a\n"), "png"), P.has_magic(F.lit(b"PNG"), "png"),
    ).first()
    assert list(row) == ["a/b", "/g/r10/a", True, True, False]
