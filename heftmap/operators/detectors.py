"""The thirteen waste detectors.

Each detector turns a file into signals (detector, parent, unit, mark).  All chosen
detectors share one scan: signals are rolled up to units, units to parents, parents
to one finding per root.  The first rollup keeps fixed-width numbers only, so it is a
hash aggregation with map-side partial sums: a root, folder or group of copies may be
arbitrarily large.

    signals -> units (root, detector, parent, unit)
            -> places (root, detector, parent)
            -> findings (root, detector)

What parent / unit / mark mean per detector:

    patch_overlay          base candidate    chunk id            overlay file
    stale_version_dir      parent folder     version folder      -
    sharded_videos         parent folder     folder with paks    -
    large_chunk            -                 -                   at or above critical size
    encryption             access status     container stem      the container itself
    editor_leftovers       -                 -                   -
    launcher_satellite     parent folder     language folder     dll directly inside
    shader_rhi_redundancy  -                 shader family       -
    redist_installer       -                 -                   -
    platform_siblings      -                 platform            -
    mod_manager_artifacts  -                 -                   -
    duplicate_content      -                 size and hash       -
    cef_locales            -                 -                   kept locale
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftmap.functions import paths as P
from heftmap.functions.numbers import format_bytes, int_div
from heftmap.functions.rules import any_of, contains, ends_with, equals, first_match, rule_match
from heftmap.operators import spread
from heftmap.operators.inventory import chunk_members
from heftmap.operators.staging import stage
from heftmap.schemas import GIB, MIB

# The order of the roster is the order of the report.
ROSTER = (
    "patch_overlay", "stale_version_dir", "sharded_videos", "large_chunk", "encryption",
    "editor_leftovers", "launcher_satellite", "shader_rhi_redundancy", "redist_installer",
    "platform_siblings", "mod_manager_artifacts", "duplicate_content", "cef_locales",
)

# Severities in rising order.
SEVERITIES = ("info", "warning", "critical")

# Rule lists.  "/derivedatacache/" is spelled as the rule has it.
LEFTOVER_EXTENSIONS = ("pdb", "ilk", "exp", "tps", "uproject", "uplugin", "bak", "orig")
LEFTOVER_PARTS = (
    "/intermediate/", "/derivedatacache/", "/derived data cache/", "/source/", "/build/",
    "/engine/editor/", "/game/editor/",
)
SHADER_HINTS = ("ShaderCache", "ShaderArchive", "GlobalShaderCache", "upipelinecache", "ushaderbytecode")
SHADER_FAMILIES = (
    "PCD3D_SM6", "PCD3D_SM5", "VulkanSM6", "VulkanSM5", "OpenGLES31", "OpenGLES", "MetalSM5",
    "MetalSM6", "D3D11",
)
INSTALLER_NAMES = (
    "ue4prereqsetup", "ueprereqsetup", "ue5prereqsetup", "vc_redist", "vcredist", "dxsetup.exe",
    "dxwebsetup.exe", "dotnetfx", "ndp48", "ndp472",
)
INSTALLER_PARTS = ("/extras/redist/", "/redist/", "/_commonredist/", "/commonredist/", "/prereqs/")
PLATFORMS = (
    "Win64", "Win32", "WinGDK", "Linux", "LinuxArm64", "LinuxAArch64", "Mac", "IOS", "TVOS",
    "Android", "Switch", "PS4", "PS5", "XSX", "XB1",
)
MOD_SUFFIXES = (".disabled", ".modtemp", ".nxm_backup", ".vortex_backup", ".mohidden", ".original")

# Thresholds.
CRITICAL_OVERLAY_RATIO = 0.4
MIN_VERSION_SIBLINGS = 2
MIN_SHARDS = 20
MAX_MEAN_SHARD = 600 * MIB
SHARD_OVERHEAD = 0.05
LARGE_CHUNK, CRITICAL_CHUNK = 2 * GIB, 10 * GIB
MIN_SATELLITES = 3
MIN_SHADER_RECLAIM = 5 * MIB
MIN_PLATFORM_RECLAIM = 50 * MIB
MIN_DUPLICATE_SIZE = 4 * MIB
MIN_LOCALE_RECLAIM = MIB
MAX_INSTALLER_DEPTH = 2
WARN_AT = {
    "stale_version_dir": 100 * MIB, "editor_leftovers": MIB, "launcher_satellite": 10 * MIB,
    "shader_rhi_redundancy": 200 * MIB, "redist_installer": 10 * MIB, "platform_siblings": 500 * MIB,
    "mod_manager_artifacts": 50 * MIB, "duplicate_content": 100 * MIB, "cef_locales": 5 * MIB,
}

# Bits gathered per container stem: side files, and what opening the container gave.
SIG, UTOC, UCAS, OPENED, LOCKED = 1, 2, 4, 8, 16

# Detectors whose groups are units; for the others they are places.
UNIT_GROUPS = ("shader_rhi_redundancy", "platform_siblings", "duplicate_content")
# Detectors that list every file they match.
FILE_LISTING = ("large_chunk", "editor_leftovers", "redist_installer", "mod_manager_artifacts")


def _check(detectors: Sequence[str]) -> list[str]:
    unknown = set(detectors) - set(ROSTER)
    if unknown:
        raise ValueError(f"unknown detectors {sorted(unknown)}; choose from {ROSTER}")
    return [d for d in ROSTER if d in detectors]


# -- signals -------------------------------------------------------------------------


# These take columns that are already lower-cased, so that one conversion per file serves
# all rules: ``rooted`` is paths.rooted(path), ``low_name`` the lower-case file name.


def leftover_reason(extension: Column, rooted: Column) -> Column:
    return F.coalesce(rule_match(extension, LEFTOVER_EXTENSIONS, equals), rule_match(rooted, LEFTOVER_PARTS, contains))


def shader_family(name: Column) -> Column:
    return F.when(any_of(name, SHADER_HINTS, contains), rule_match(name, SHADER_FAMILIES, contains))


def installer_reason(low_name: Column, rooted: Column) -> Column:
    # A rooted path has one separator per level.
    levels = F.length(rooted) - F.length(F.replace(rooted, F.lit("/"), F.lit("")))
    placed = any_of(rooted, INSTALLER_PARTS, contains) | (low_name.endswith(".exe") & (levels <= MAX_INSTALLER_DEPTH))
    named = rule_match(low_name, INSTALLER_NAMES, contains)
    return F.when(named.isNotNull() & placed, named)


def binary_platform(rooted: Column) -> Column:
    folders = [(f"/binaries/{name.lower()}/", name) for name in PLATFORMS]
    return F.when(rooted.contains("/binaries/"), rule_match(rooted, folders, contains))


def mod_suffix(low_name: Column) -> Column:
    return rule_match(low_name, MOD_SUFFIXES, ends_with)


def _signal(detector: str, parent: Column | str = "", unit: Column | str = "", mark: Column | bool = False,
            bits: Column | int = 0, note: Column | str | None = None) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(detector).alias("detector"),
        as_column(parent).alias("parent"),
        as_column(unit).alias("unit"),
        as_column(mark).alias("mark"),
        as_column(bits).cast("int").alias("bits"),
        as_column(note).cast("string").alias("note"),
    )


def _one(condition: Column, signal: Column) -> Column:
    return F.when(condition, F.array(signal))


def _folders(last: Column, name_test, detector: str, mark) -> Column:
    """Signals for the folders on a path, up to segment ``last``, whose name passes the test."""
    segments = F.col("segments")
    chosen = F.filter(
        F.sequence(F.lit(1), F.size(segments)),
        lambda i: (i <= last) & name_test(F.element_at(segments, i)),
    )
    upto = lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/")
    return F.transform(
        chosen,
        lambda i: _signal(detector, upto(i - 1), upto(i), mark(i), note=F.element_at(segments, i)),
    )


# Cheap tests that keep the segment arrays from being built for most files.
_MAY_HOLD_VERSION = r"(^|/)[+]?[0-9]+([.][+]?[0-9]+){0,3}(/|$)"
_MAY_HOLD_LOCALE = r"(^|/)[a-z]{2,3}(-[A-Za-z0-9]{2,4})?/"


def _prepared(files: DataFrame, chosen: list[str]) -> DataFrame:
    path = F.col("path")
    named = files.select(
        "root_id", "path", "is_dir", F.coalesce(F.col("size_bytes"), F.lit(0)).alias("size_bytes"),
        "content_sha256", "probe_error", P.file_name(path).alias("name"), P.rooted(path).alias("rooted"),
    )
    version = path.rlike(_MAY_HOLD_VERSION) if "stale_version_dir" in chosen else F.lit(False)
    locale = path.rlike(_MAY_HOLD_LOCALE) if "launcher_satellite" in chosen else F.lit(False)
    tested = named.select(
        "*", P.name_ext(F.col("name")).alias("raw_ext"), F.lower("name").alias("low_name"),
        version.alias("may_hold_version"), locale.alias("may_hold_locale"),
    )
    return tested.withColumn("segments", F.when(F.col("may_hold_version") | F.col("may_hold_locale"), F.split("path", "/")))


def _emitters(chosen: list[str]) -> list[Column]:
    """One nullable ARRAY<signal> column per chosen detector, over the prepared columns."""
    path, name, size = F.col("path"), F.col("name"), F.col("size_bytes")
    low_name, rooted = F.col("low_name"), F.col("rooted")
    extension, is_file = F.col("raw_ext"), ~F.col("is_dir")
    is_pak = is_file & (extension == "pak")
    folder = P.parent_dir(path)
    chunk = P.chunk_id(name)
    opened = P.container_status(F.col("probe_error"), F.lit(False))
    stem_bits = first_match(
        [
            (extension == "sig", SIG), (extension == "utoc", UTOC), (extension == "ucas", UCAS),
            (opened == "readable", OPENED), (opened == "encrypted", LOCKED),
        ],
        0,
    )
    level_above = F.size("segments") - 1
    is_version = lambda n: F.when(n.rlike(P.VERSION_NAME), P.parse_version(n).isNotNull()).otherwise(False)

    def optional(label: Column, detector: str, as_unit: bool = False) -> Column:
        return _one(is_file & label.isNotNull(), _signal(detector, unit=label if as_unit else "", note=label))

    emit = {
        "patch_overlay": lambda: _one(
            is_file & name.startswith("pakchunk") & chunk.isNotNull(),
            _signal("patch_overlay", F.when(P.is_patch_chunk(name), "").otherwise(path), chunk,
                    P.is_patch_chunk(name)),
        ),
        "stale_version_dir": lambda: F.when(
            F.col("may_hold_version"),
            _folders(F.when(F.col("is_dir"), F.size("segments")).otherwise(level_above), is_version,
                     "stale_version_dir", lambda i: F.lit(False)),
        ),
        "sharded_videos": lambda: _one(
            is_pak & path.contains("/"), _signal("sharded_videos", P.parent_dir(folder), folder)
        ),
        "large_chunk": lambda: _one(
            is_pak & (size >= LARGE_CHUNK),
            _signal("large_chunk", mark=size >= CRITICAL_CHUNK,
                    note=F.when(size >= CRITICAL_CHUNK, "critical").otherwise("oversized")),
        ),
        "encryption": lambda: _one(
            is_file & extension.isin("pak", "sig", "utoc", "ucas"),
            _signal("encryption", unit=P.stem(path), mark=extension == "pak", bits=stem_bits),
        ),
        "editor_leftovers": lambda: optional(leftover_reason(F.lower(extension), rooted), "editor_leftovers"),
        "launcher_satellite": lambda: F.when(
            is_file & F.col("may_hold_locale"),
            _folders(level_above, P.is_satellite_code, "launcher_satellite",
                     lambda i: (i == level_above) & (extension == "dll")),
        ),
        "shader_rhi_redundancy": lambda: optional(shader_family(name), "shader_rhi_redundancy", True),
        "redist_installer": lambda: optional(installer_reason(low_name, rooted), "redist_installer"),
        "platform_siblings": lambda: optional(binary_platform(rooted), "platform_siblings", True),
        "mod_manager_artifacts": lambda: optional(mod_suffix(low_name), "mod_manager_artifacts"),
        "duplicate_content": lambda: _one(
            is_file & (size >= MIN_DUPLICATE_SIZE) & F.col("content_sha256").isNotNull(),
            _signal("duplicate_content", unit=F.concat_ws(":", size, F.col("content_sha256"))),
        ),
        "cef_locales": lambda: _one(
            is_file & low_name.endswith(".pak") & any_of(rooted, P.EMBEDDED_BROWSER_PARTS, contains),
            _signal("cef_locales", mark=P.is_keeper_locale(name), note=P.cef_locale(name)),
        ),
    }
    return [emit[d]() for d in chosen]


def _could_match(chosen: list[str]) -> Column | None:
    """A cheap condition no matching file can fail, for the scan; None where there is none."""
    path, size = F.col("path"), F.col("size_bytes")
    coarse = {
        "patch_overlay": path.contains("pakchunk"),
        "sharded_videos": path.endswith(".pak"),
        "large_chunk": size >= LARGE_CHUNK,
        "encryption": path.endswith(".pak") | path.endswith(".sig") | path.endswith(".utoc") | path.endswith(".ucas"),
        "duplicate_content": size >= MIN_DUPLICATE_SIZE,
    }
    if any(d not in coarse for d in chosen):
        return None
    return reduce(lambda a, b: a | b, [coarse[d] for d in chosen])


def signals(files: DataFrame, detectors: Sequence[str] = ROSTER) -> DataFrame:
    """Matches of the chosen detectors: (detector, parent, unit, mark, bits, note) per file."""
    chosen = _check(detectors)
    coarse = _could_match(chosen)
    if coarse is not None:
        files = files.where(coarse)
    empty = F.array().cast(
        "array<struct<detector:string,parent:string,unit:string,mark:boolean,bits:int,note:string>>"
    )
    emitted = F.concat(*[F.coalesce(e, empty) for e in _emitters(chosen)])
    # The array gets a projection of its own: compiled there, interpreted inside a generator.
    # From a plain inline the optimizer would infer a filter on the array's size and push it,
    # with every rule written out again, down to the scan; inline_outer keeps one evaluation.
    arrays = _prepared(files, chosen).select("root_id", "path", "size_bytes", emitted.alias("emitted"))
    rows = arrays.select("root_id", "path", "size_bytes", F.inline_outer("emitted"))
    return rows.where(F.col("detector").isNotNull())


# -- rollups -------------------------------------------------------------------------


def _is(*detectors: str) -> Column:
    return F.col("detector").isin(*detectors)


UNIT_KEYS = ("root_id", "detector", "parent", "unit")


def units(found: DataFrame) -> DataFrame:
    """Signals per unit, with what the unit puts at stake."""
    return units_from(unit_sums(found))


def unit_sums(found: DataFrame) -> DataFrame:
    """Signals per unit; fixed-width sums only, so a hash aggregation."""
    marked = F.col("mark")
    return found.groupBy(*UNIT_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size_bytes").alias("bytes"),
        F.count_if(marked).alias("marked_n"),
        F.coalesce(F.sum(F.when(marked, F.col("size_bytes"))), F.lit(0)).alias("marked_bytes"),
        F.max("size_bytes").alias("largest_file"),
        F.bit_or("bits").alias("bits"),
        spread.salt_mask("path"),
    )


def units_from(grouped: DataFrame) -> DataFrame:
    """What every unit puts at stake; units that count for nothing go."""
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit)) != 0
    status = first_match(
        [
            (has(UTOC) & has(UCAS), "iostore"), (has(SIG), "signed"), (has(OPENED), "readable"),
            (has(LOCKED), "encrypted"),
        ],
        "unreadable",
    )
    n, total = F.col("n"), F.col("bytes")
    marked_n, marked_bytes = F.col("marked_n"), F.col("marked_bytes")
    hit = first_match(
        [
            (_is("sharded_videos"), total > 0),
            (_is("encryption", "launcher_satellite"), marked_n > 0),
            (_is("duplicate_content"), n >= 2),
        ],
        True,
    )
    amount = first_match(
        [
            (_is("encryption"), marked_bytes),
            (_is("cef_locales"), total - marked_bytes),
            (_is("duplicate_content"), F.col("largest_file") * (n - 1)),
        ],
        total,
    )
    items = first_match(
        [
            (_is("duplicate_content"), n - 1),
            (_is("encryption"), marked_n),
            (_is("cef_locales"), n - marked_n),
            (_is("patch_overlay", *FILE_LISTING), n),
        ],
        F.lit(1).cast("bigint"),
    )
    place = F.when(_is("encryption"), status).when(_is("patch_overlay"), F.col("unit")).otherwise(F.col("parent"))
    return grouped.where(hit).select(
        "root_id", "detector", place.alias("place"), "parent", "unit", "n", "bytes", "largest_file",
        spread.MASK, amount.alias("amount"), items.alias("items"),
    )


def places(rolled: DataFrame) -> DataFrame:
    """Units per place; keeps only places that count towards a finding."""
    version = F.when(_is("stale_version_dir"), P.parse_version(P.file_name(F.col("unit"))))
    is_base = _is("patch_overlay") & (F.col("parent") != "")
    grouped = rolled.groupBy("root_id", "detector", "place").agg(
        F.count(F.lit(1)).alias("unit_count"),
        F.sum("items").alias("items"),
        F.sum("amount").alias("total"),
        F.max("amount").alias("largest"),
        F.sum("bytes").alias("bytes"),
        F.max(F.when(version.isNotNull(), F.struct(version.alias("version"), F.col("unit"), F.col("amount")))).alias("newest"),
        F.min(F.when(is_base, F.struct("parent", "amount"))).alias("base"),
        F.max("largest_file").alias("largest_file"),
        spread.salt_mask("unit"),
    )
    count, total, largest = F.col("unit_count"), F.col("total"), F.col("largest")
    kept_aside = first_match(
        [
            (_is("patch_overlay"), F.col("base.amount")),
            (_is("stale_version_dir"), F.col("newest.amount")),
            (_is("launcher_satellite", "shader_rhi_redundancy", "platform_siblings"), largest),
        ],
        F.lit(0).cast("bigint"),
    )
    spare = total - kept_aside
    counts = first_match(
        [
            (_is("patch_overlay"), F.col("base").isNotNull() & (F.col("items") >= 2)),
            (_is("stale_version_dir"), count >= MIN_VERSION_SIBLINGS),
            (_is("sharded_videos"), (count >= MIN_SHARDS) & (int_div(total, count) <= MAX_MEAN_SHARD)),
            (_is("launcher_satellite"), count >= MIN_SATELLITES),
            (_is("shader_rhi_redundancy"), (count >= 2) & (spare >= MIN_SHADER_RECLAIM)),
            (_is("platform_siblings"), (count >= 2) & (spare >= MIN_PLATFORM_RECLAIM)),
            (_is("cef_locales"), total >= MIN_LOCALE_RECLAIM),
        ],
        True,
    )
    one_less = _is("patch_overlay", "stale_version_dir")
    base = F.col("base.amount")
    overlay = F.when(_is("patch_overlay"), F.when(base > 0, spare / base).otherwise(F.lit(0.0)))
    return grouped.where(counts).select(
        "root_id", "detector", "place", "unit_count",
        F.when(one_less, F.col("items") - 1).otherwise(F.col("items")).alias("items"),
        "bytes", "largest_file", F.when(one_less, spare).otherwise(total).alias("total"), spare.alias("spare"),
        F.col("newest.unit").alias("newest_unit"), overlay.alias("overlay_ratio"), spread.MASK,
    )


def _title() -> Column:
    """Short report line per detector, made from the finding's own numbers."""
    size, saved = F.col("total_text"), F.col("saved_text")
    items, groups = F.col("item_count"), F.col("group_count")
    lines = {
        "patch_overlay": F.format_string("%s in %d overlay paks on %d chunks", size, items, groups),
        "stale_version_dir": F.format_string("%s in %d superseded version folders", saved, items),
        "sharded_videos": F.format_string("%s of paks spread over %d folders", size, items),
        "large_chunk": F.format_string("%d paks of 2 GB or more, %s together", items, size),
        "encryption": F.format_string("%d paks, access %s", items, F.col("detail")),
        "editor_leftovers": F.format_string("%d development files, %s", items, size),
        "launcher_satellite": F.format_string("%d language folders, %s spare", items, saved),
        "shader_rhi_redundancy": F.format_string("%d shader families, %s spare", items, saved),
        "redist_installer": F.format_string("%d bundled installers, %s", items, size),
        "platform_siblings": F.format_string("%d platforms of binaries, %s spare", items, saved),
        "mod_manager_artifacts": F.format_string("%d mod-tool leftovers, %s", items, size),
        "duplicate_content": F.format_string("%d extra copies in %d groups, %s", items, groups, saved),
        "cef_locales": F.format_string("%d unused browser locales, %s", items, saved),
    }
    return first_match((_is(d), line) for d, line in lines.items())


def findings_from(at_places: DataFrame) -> DataFrame:
    blocked = _is("encryption") & (F.col("place") != "readable")
    # Most blocked bytes win; equal bytes fall to the earlier of these statuses, and no bytes at all to the first.
    tie_order = first_match(
        (F.col("place") == s, -i) for i, s in enumerate(("unreadable", "signed", "iostore", "encrypted"))
    )
    grouped = at_places.groupBy("root_id", "detector").agg(
        F.sum("items").alias("item_count"),
        F.sum(F.when(_is(*UNIT_GROUPS), F.col("unit_count")).otherwise(F.lit(1))).alias("group_count"),
        F.sum("total").alias("total"),
        F.sum("spare").alias("spare"),
        F.sum("bytes").alias("bytes"),
        F.max("overlay_ratio").alias("overlay_ratio"),
        F.max("largest_file").alias("largest_file"),
        F.coalesce(F.sum(F.when(blocked, F.col("items"))), F.lit(0)).alias("blocked_n"),
        F.max(F.when(blocked, F.struct(F.col("total"), tie_order.alias("o"), F.col("place")))).alias("dominant"),
    )
    total, spare = F.col("total"), F.col("spare")
    reclaimable = first_match(
        [
            (_is("large_chunk", "encryption"), F.lit(None).cast("bigint")),
            (_is("patch_overlay"), int_div(total, 2)),
            (_is("sharded_videos"), F.floor(total * F.lit(SHARD_OVERHEAD))),
        ],
        spare,
    )
    warn_bar = first_match((_is(d), F.lit(bar).cast("bigint")) for d, bar in WARN_AT.items())
    severity = first_match(
        [
            (_is("patch_overlay"), F.when(F.col("overlay_ratio") >= CRITICAL_OVERLAY_RATIO, "critical").otherwise("warning")),
            (_is("sharded_videos"), "warning"),
            (_is("large_chunk"), F.when(F.col("largest_file") >= CRITICAL_CHUNK, "critical").otherwise("warning")),
            (_is("encryption"), F.when(F.col("blocked_n") == 0, "info")
             .when(F.col("blocked_n") == F.col("item_count"), "critical").otherwise("warning")),
            (spare >= warn_bar, "warning"),
        ],
        "info",
    )
    detail = F.when(_is("encryption"), F.when(F.col("blocked_n") == 0, "clear").when(F.col("dominant.total") > 0, F.col("dominant.place")).otherwise("unreadable"))
    shaped = grouped.select(
        "root_id", "detector", F.col("detector").alias("category"), severity.alias("severity"),
        "item_count", "group_count",
        F.when(_is("cef_locales"), F.col("bytes")).otherwise(total).alias("total_bytes"),
        reclaimable.alias("reclaimable_bytes"), detail.alias("detail"),
    )
    texts = shaped.withColumns({
        "total_text": format_bytes(F.col("total_bytes")),
        "saved_text": format_bytes(F.coalesce(F.col("reclaimable_bytes"), F.lit(0))),
    })
    return texts.withColumns({
        "detector_rank": first_match((_is(d), i) for i, d in enumerate(ROSTER)),
        "severity_rank": first_match((F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)),
        "title": _title(),
    }).drop("total_text", "saved_text")


def findings(files: DataFrame, detectors: Sequence[str] = ROSTER) -> DataFrame:
    """At most one finding per root and detector."""
    return findings_from(places(units(signals(files, detectors))))


# -- evidence ------------------------------------------------------------------------

EVIDENCE = ("root_id", "detector", "path", "size_bytes", "note")


def _chunk_evidence(found: DataFrame) -> DataFrame:
    chunks = found.select(
        "root_id", "path", "size_bytes", F.col("unit").alias("chunk_id"), F.col("mark").alias("is_patch")
    )
    role = F.when(F.col("path") == F.col("base_path"), "base").otherwise("overlay")
    return chunk_members(chunks).select(
        "root_id", F.lit("patch_overlay").alias("detector"), "path", "size_bytes", role.alias("note")
    )


def _member_evidence(found: DataFrame, held: DataFrame) -> DataFrame:
    """Files of the groups that count, whatever the size of a group."""
    groups = held.select("root_id", "detector", "unit", "first_path", spread.MASK)
    member = spread.attach(found, groups, ["root_id", "detector", "unit"], ["path"])
    note = first_match(
        [
            (_is("duplicate_content"), F.when(F.col("path") == F.col("first_path"), "keep").otherwise("duplicate")),
            (_is("cef_locales") & F.col("mark"), F.concat(F.col("note"), F.lit(" (keep)"))),
        ],
        F.col("note"),
    )
    return member.withColumn("note", note).select(*EVIDENCE)


def _folder_evidence(held: DataFrame) -> DataFrame:
    # A platform is shown by the folder of that name above its smallest path.
    above = F.filter(
        P.ancestors(F.col("first_path")), lambda d: F.lower(P.file_name(d)) == F.lower(F.col("unit"))
    )
    path = F.when(_is("platform_siblings"), F.element_at(above, -1)).otherwise(F.col("unit"))
    note = F.when(_is("platform_siblings"), F.col("unit")).otherwise(P.file_name(F.col("unit")))
    stale_only = ~_is("stale_version_dir") | (F.col("unit") != F.col("newest_unit"))
    return held.where(stale_only).select(
        "root_id", "detector", path.alias("path"), F.col("amount").alias("size_bytes"), note.alias("note")
    )


def _container_evidence(held: DataFrame) -> DataFrame:
    """Every container that cannot be read, with its status."""
    return held.where(F.col("place") != "readable").select(
        "root_id", "detector", F.concat("unit", F.lit(".pak")).alias("path"), F.col("amount").alias("size_bytes"),
        F.col("place").alias("note"),
    )


def staged_signals(files: DataFrame, detectors: Sequence[str] = ROSTER) -> DataFrame:
    """The signals, written once: findings and evidence can both be made from them."""
    return stage(signals(files, detectors), "signals")


WITH_MEMBERS = ("shader_rhi_redundancy", "cef_locales", "duplicate_content")
WITH_FOLDERS = ("stale_version_dir", "launcher_satellite", "platform_siblings")
FIRST_PATHS = ("duplicate_content", "platform_siblings")


def evidence(files: DataFrame, detectors: Sequence[str] = ROSTER) -> DataFrame:
    """Every file or folder behind the findings of the chosen detectors.

    Runs jobs while it is called: the signals and their rollup are written once and read from there.
    """
    chosen = _check(detectors)
    return evidence_from(staged_signals(files, chosen), chosen)


def evidence_from(found: DataFrame, detectors: Sequence[str] = ROSTER) -> DataFrame:
    """``evidence`` of signals that have been written.

    All detectors share one rollup to units and places; the units of the places that count are
    written, and members and folders are read from there.
    """
    chosen = _check(detectors)
    of = lambda names: found.where(_is(*names))
    pick = lambda *names: [d for d in chosen if d in names]
    parts = []
    if listed := pick(*FILE_LISTING):
        parts.append(of(listed).select(*EVIDENCE))
    if "patch_overlay" in chosen:
        parts.append(_chunk_evidence(of(["patch_overlay"])))
    if grouped := pick(*WITH_MEMBERS, *WITH_FOLDERS, "encryption", "sharded_videos"):
        rolled = stage(units(of(grouped)), "units")
        at_places = places(rolled)
        keep = at_places.select("root_id", "detector", "place", "newest_unit", spread.MASK)
        held = spread.attach(
            rolled.withColumnRenamed(spread.MASK, "file_mask"), keep, ["root_id", "detector", "place"], ["unit"]
        ).withColumnRenamed("file_mask", spread.MASK)
        if shown := pick(*FIRST_PATHS):
            above = F.coalesce("parent", F.lit("")).alias("above")
            first = of(shown).groupBy("root_id", "detector", above, "unit").agg(F.min("path").alias("first_path"))
            held = held.withColumn("above", above).join(first, ["root_id", "detector", "above", "unit"], "left").drop("above")
        else:
            held = held.withColumn("first_path", F.lit(None).cast("string"))
        held = stage(held, "held")
        if members := pick(*WITH_MEMBERS):
            parts.append(_member_evidence(of(members), held.where(_is(*members))))
        if folders := pick(*WITH_FOLDERS):
            parts.append(_folder_evidence(held.where(_is(*folders))))
        if "encryption" in chosen:
            parts.append(_container_evidence(held.where(_is("encryption"))))
        if "sharded_videos" in chosen:
            parts.append(at_places.where(_is("sharded_videos")).select(
                "root_id", "detector", F.col("place").alias("path"), F.col("total").alias("size_bytes"),
                F.format_string("%d folders", F.col("unit_count")).alias("note"),
            ))
    return reduce(DataFrame.unionByName, parts)


def pak_access(files: DataFrame) -> DataFrame:
    """Container counts and bytes by access status, including side-by-side store stubs."""
    held = units(signals(files, ["encryption"]))
    return held.groupBy("root_id", F.col("place").alias("status")).agg(
        F.sum("items").alias("container_count"), F.sum("amount").alias("bytes")
    )
