"""Texture size, mip-chain and routing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heftmap.functions.numbers import int_div
from heftmap.functions.rules import first_match

# Bytes per mip level by pixel format.
BLOCK8_FORMATS = ("PF_DXT1", "PF_BC1", "PF_BC4")
BLOCK16_FORMATS = ("PF_DXT3", "PF_DXT5", "PF_BC2", "PF_BC3", "PF_BC5", "PF_BC6H", "PF_BC7")
ASTC_BLOCK_EDGE = {"PF_ASTC_6x6": 6, "PF_ASTC_6x6_HDR": 6, "PF_ASTC_8x8": 8, "PF_ASTC_8x8_HDR": 8}
BYTES_PER_PIXEL = {
    1: ("PF_ASTC_4x4", "PF_ASTC_4x4_HDR", "PF_A8", "PF_G8", "PF_L8", "PF_R8"),
    2: ("PF_G16", "PF_R16F", "PF_R16_UINT", "PF_R16_SINT"),
    4: (
        "PF_B8G8R8A8", "PF_R8G8B8A8", "PF_R8G8B8A8_UINT", "PF_R8G8B8A8_SNORM",
        "PF_A2B10G10R10", "PF_A2R10G10B10",
    ),
    8: ("PF_FloatRGB", "PF_FloatRGBA", "PF_R32_FLOAT", "PF_R16G16_FLOAT"),
    16: ("PF_A32B32G32R32F",),
}

# Compression settings by how a stripped texture can be brought back.
BACKUP_SETTINGS = (
    "tc_normalmap", "tc_vectordisplacementmap", "tc_displacementmap", "tc_hdr",
    "tc_hdr_compressed", "tc_hdrcompressed", "tc_alpha",
)
KEEP_SETTINGS = ("tc_editoricon", "tc_lookuptable")
UPSCALE_SETTINGS = (
    "tc_default", "tc_basecolor", "tc_diffuse", "tc_grayscale", "tc_masks", "tc_roughness",
    "tc_metallic", "tc_ambientocclusion", "tc_specular",
)
SMOOTH_SETTINGS = (
    "tc_grayscale", "tc_masks", "tc_roughness", "tc_metallic", "tc_ambientocclusion", "tc_specular",
)
POLICIES = ("never_strip", "conservative", "aggressive", "smart")
CONTENT_CLASSES = ("color", "normal", "roughness", "metalness")


def _ceil_div(value: Column, edge: int) -> Column:
    return int_div(value + F.lit(edge - 1), edge)


def bytes_for_mip(pixel_format: Column, w: Column, h: Column) -> Column:
    """Bytes of one level; unknown formats count 16 bytes per 4x4 block."""
    w, h = w.cast("bigint"), h.cast("bigint")
    blocks = F.greatest(F.lit(1), _ceil_div(w, 4)) * F.greatest(F.lit(1), _ceil_div(h, 4))
    rules = [(pixel_format.isin(*BLOCK8_FORMATS), blocks * 8)]
    rules += [(pixel_format.isin(*BLOCK16_FORMATS), blocks * 16)]
    rules += [
        (pixel_format == name, _ceil_div(w, edge) * _ceil_div(h, edge) * 16)
        for name, edge in ASTC_BLOCK_EDGE.items()
    ]
    rules += [(pixel_format.isin(*names), w * h * size) for size, names in BYTES_PER_PIXEL.items()]
    return first_match(rules, blocks * 16)


def mip_chain(pixel_format: Column, size_x: Column, size_y: Column, num_mips: Column) -> Column:
    """ARRAY<STRUCT<w,h,bytes>> of ``num_mips`` levels, halving down to 1."""

    def level(i: Column) -> Column:
        w = F.greatest(F.lit(1), F.call_function("shiftright", size_x, i))
        h = F.greatest(F.lit(1), F.call_function("shiftright", size_y, i))
        return F.struct(w.alias("w"), h.alias("h"), bytes_for_mip(pixel_format, w, h).alias("bytes"))

    return F.when(num_mips > 0, F.transform(F.sequence(F.lit(0), num_mips - 1), level))


def fitting_level(mips: Column, cap: Column) -> Column:
    """Index of the first level with both edges within ``cap``, NULL if none fits."""
    fits = F.transform(mips, lambda m: F.greatest(m["w"], m["h"]) <= cap)
    position = F.array_position(fits, F.lit(True))
    return F.when(position > 0, (position - 1).cast("int"))


def first_kept(mips: Column, cap: Column) -> Column:
    """``fitting_level``, or the last level if none fits."""
    return F.coalesce(fitting_level(mips, cap), F.size(mips) - 1)


def bytes_before(mips: Column, level: Column) -> Column:
    """Bytes of the levels in front of ``level``."""
    return F.aggregate(
        F.slice(mips, F.lit(1), level), F.lit(0).cast("bigint"), lambda acc, m: acc + m["bytes"]
    )


def total_mip_bytes(mips: Column) -> Column:
    return F.aggregate(mips, F.lit(0).cast("bigint"), lambda acc, m: acc + m["bytes"])


def top_mip_bytes(dim: Column, pixel_format: Column) -> Column:
    """Block size of a square top level; formats outside the 8-byte pair count 16."""
    edge = _ceil_div(dim.cast("bigint"), 4)
    return edge * edge * F.when(pixel_format.isin("PF_DXT1", "PF_BC1"), 8).otherwise(16)


def _names_a_normal(name: Column) -> Column:
    return (
        name.startswith("n_") | name.endswith("_n") | name.endswith("_normal")
        | name.endswith("_norm") | name.endswith("_nm") | name.contains("_normalmap")
    )


def _names_a_lookup(name: Column) -> Column:
    return (
        name.startswith("lut_") | name.endswith("_lut") | name.contains("_lookup")
        | name.contains("colorgrade")
    )


def restore_class(name: Column, settings: Column, pixel_format: Column, policy: str = "smart") -> Column:
    """``ai_upscale``, ``exact_backup`` or ``no_strip`` for one texture under a policy."""
    if policy not in POLICIES:
        raise ValueError(f"unknown restore policy {policy!r}; one of {POLICIES}")
    if policy == "never_strip":
        return F.lit("no_strip")
    if policy == "conservative":
        return F.lit("exact_backup")
    low_name = F.lower(name)
    if policy == "aggressive":
        keep = _names_a_lookup(low_name) | F.coalesce(F.lower(settings).isin(*KEEP_SETTINGS), F.lit(False))
        return F.when(keep, "no_strip").otherwise("ai_upscale")
    setting = F.lower(F.trim(settings))
    return first_match(
        [
            (setting.isin(*BACKUP_SETTINGS), "exact_backup"),
            (setting.isin(*KEEP_SETTINGS), "no_strip"),
            (setting.isin(*UPSCALE_SETTINGS), "ai_upscale"),
            (_names_a_normal(low_name), "exact_backup"),
            (_names_a_lookup(low_name), "no_strip"),
            (F.upper(pixel_format) == "PF_BC5", "exact_backup"),
        ],
        "ai_upscale",
    )


def projection_ratio(settings: Column) -> Column:
    setting = F.lower(settings)
    return first_match(
        [
            (setting.isin(*BACKUP_SETTINGS), 0.20),
            (setting.isin(*KEEP_SETTINGS), 1.0),
            (setting.isin(*SMOOTH_SETTINGS), 0.10),
        ],
        0.20,
    )


def projection_basis(settings: Column) -> Column:
    setting = F.lower(settings)
    return first_match(
        [
            (setting.isin(*BACKUP_SETTINGS), "block"),
            (setting.isin(*KEEP_SETTINGS), "untouched"),
            (setting.isin(*SMOOTH_SETTINGS), "pixel-smooth"),
        ],
        "pixel-textured",
    )


def content_class(label: Column) -> Column:
    low = F.lower(label)
    return first_match(((low.contains(word), word) for word in CONTENT_CLASSES), "other")


def label_suffix(name: Column) -> Column:
    """Text after the last ``_`` once ``.png`` is dropped."""
    return F.substring_index(F.regexp_replace(name, r"[.]png$", ""), "_", -1)


def split_name(name: Column) -> Column:
    """STRUCT<material, map_class>; class ``?`` when the name has no ``_``."""
    bare = F.regexp_replace(name, r"[.]png$", "")
    material = F.regexp_extract(bare, r"^(.*)_[^_]*$", 1)
    has_class = bare.contains("_")
    return F.struct(
        F.when(has_class, material).otherwise(bare).alias("material"),
        F.when(has_class, F.substring_index(bare, "_", -1)).otherwise("?").alias("map_class"),
    )


CODEC_SPACE_LIMIT = 25.0


def codec_space(energy: Column) -> Column:
    return F.when(energy < CODEC_SPACE_LIMIT, "pixel").otherwise("bc3_byte")
