"""Path, file-name, language and version expressions.

Paths are relative to their root and use ``/``.  Substring rules run on
``rooted(path)`` so that a rule such as ``/build/`` also sees a first segment and
never sees the folders above the root.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heftmap.functions.rules import any_of, contains, first_match

# Which extensions count as which kind of file.
CONTAINER_EXTENSIONS = ("pak", "utoc", "ucas")
TEXTURE_EXTENSIONS = ("dds", "png", "tga", "bmp", "jpg", "jpeg")
AUDIO_EXTENSIONS = ("wav", "ogg", "opus", "mp3", "flac")
EMBEDDED_BROWSER_PARTS = ("/cef3/", "/cef/")
EMBEDDED_BROWSER_KEEP = ("en", "en-us", "en-gb")
REENCODABLE = {"png": "png", "wav": "wav", "flac": "flac"}
ENCODERS = {"png": "oxipng", "wav": "opusenc", "flac": "opusenc"}
ENTRY_PACKAGE_EXTENSIONS = (".uasset", ".uexp", ".umap", ".ubulk")
ENTRY_AUDIO_EXTENSIONS = (".wav", ".flac", ".ogg", ".opus", ".bnk", ".bin")
ENTRY_TEXTURE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tga", ".dds")

# Fixed pattern: first well-formed code in a segment after a localisation marker.
LANGUAGE_PATTERN = (
    r"(?i:(?:^|/)(?:l10n|localization))/(?:[^/]+/)*?([a-z]{2,3}(?:-[A-Za-z]{2,4})?)(?:/|$)"
)
LANGUAGE_CODE = r"^[a-z]{2,3}(-[A-Za-z]{2,4})?$"
SATELLITE_CODE = r"^[a-z]{2,3}(-[A-Za-z0-9]{2,4})?$"
VERSION_NAME = r"^[+]?[0-9]+([.][+]?[0-9]+){0,3}$"
CHUNK_NAME = r"^pakchunk([^-]+)-(.*)[.]pak$"
U32_MAX = 4294967295

SIGNATURES = {"png": "89504E470D0A1A0A", "ogg": "4F676753"}


def norm_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), norm_path(path))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Folder part of the path; empty for a top-level name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name_ext(name: Column) -> Column:
    """Extension of a file name as written; empty when there is none (``.bak`` has none)."""
    tail = F.substring_index(name, ".", -1)
    return F.when(F.length(tail) < F.length(name) - 1, tail).otherwise(F.lit(""))


def raw_ext(path: Column) -> Column:
    return name_ext(file_name(path))


def ext(path: Column) -> Column:
    return F.lower(raw_ext(path))


def stem(path: Column) -> Column:
    """Path without its extension; containers and their side files share it."""
    return F.regexp_replace(path, r"(?<=[^/])[.][^./]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """Every folder above the path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def rel_posix(path: Column, root: Column) -> Column:
    """Path below ``root`` with ``/`` separators; unchanged when not below it."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    below = F.startswith(clean, F.concat(base, F.lit("/")))
    return F.when(below, F.substr(clean, F.length(base) + 2)).otherwise(clean)


def is_embedded_browser(path: Column) -> Column:
    return any_of(rooted(path), EMBEDDED_BROWSER_PARTS, contains)


def file_kind(path: Column) -> Column:
    extension = ext(path)
    return first_match(
        [
            (extension.isin(*CONTAINER_EXTENSIONS) & ~is_embedded_browser(path), "pak"),
            (extension.isin(*TEXTURE_EXTENSIONS), "texture"),
            (extension.isin(*AUDIO_EXTENSIONS), "audio"),
        ],
        "other",
    )


def is_language_code(text: Column) -> Column:
    return text.rlike(LANGUAGE_CODE)


def is_satellite_code(text: Column) -> Column:
    return text.rlike(SATELLITE_CODE) & (F.length(text) <= 8)


def normalize_lang(code: Column) -> Column:
    """``en-us`` -> ``en-US``, ``zh-hans`` -> ``zh-Hans``; other shapes stay as they are."""
    parts = F.split(code, "-")
    tail = F.get(parts, F.lit(1))
    cased = F.when(F.length(tail) == 4, F.initcap(tail)).otherwise(F.upper(tail))
    return F.when(F.size(parts) == 2, F.concat_ws("-", F.get(parts, F.lit(0)), cased)).otherwise(code)


def detect_language(path: Column) -> Column:
    """Normalised language of a localised path, NULL when there is none."""
    code = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), LANGUAGE_PATTERN, 1)
    return F.when(code != "", normalize_lang(code))


def parse_version(text: Column) -> Column:
    """1-4 unsigned 32-bit segments as ARRAY<BIGINT>, else NULL; arrays order segment-wise."""
    segments = F.transform(F.split(text, "[.]"), lambda s: s.try_cast("bigint"))
    fits = F.forall(segments, lambda v: v.isNotNull() & (v <= F.lit(U32_MAX)))
    return F.when(text.rlike(VERSION_NAME), F.when(fits, segments))


def chunk_id(name: Column) -> Column:
    found = F.regexp_extract(name, CHUNK_NAME, 1)
    return F.when(found != "", found)


def is_patch_chunk(name: Column) -> Column:
    return chunk_id(name).isNotNull() & F.regexp_extract(name, CHUNK_NAME, 2).endswith("_P")


def container_status(probe_error: Column, has_sig: Column) -> Column:
    """signed > readable > unreadable (unsupported) > encrypted > unreadable."""
    text = F.lower(probe_error)
    return first_match(
        [
            (has_sig, "signed"),
            (probe_error.isNull(), "readable"),
            (text.contains("unsupported"), "unreadable"),
            (text.contains("encrypt") | text.contains("aes"), "encrypted"),
        ],
        "unreadable",
    )


def cef_locale(name: Column) -> Column:
    return F.regexp_replace(name, r"[.][^.]*$", "")


def is_keeper_locale(name: Column) -> Column:
    return F.lower(cef_locale(name)).isin(*EMBEDDED_BROWSER_KEEP)


def recompress_kind(path: Column) -> Column:
    extension = ext(path)
    return first_match((extension == e, kind) for e, kind in REENCODABLE.items())


def encoder_for(kind: Column) -> Column:
    return first_match((kind == k, encoder) for k, encoder in ENCODERS.items())


def entry_filter_class(path: Column, is_package: Column, is_payload: Column) -> Column:
    dotted = F.concat(F.lit("."), ext(path))
    return first_match(
        [
            (is_payload, "payload"),
            (is_package | dotted.isin(*ENTRY_PACKAGE_EXTENSIONS), "package"),
            (dotted.isin(*ENTRY_AUDIO_EXTENSIONS), "audio"),
            (dotted.isin(*ENTRY_TEXTURE_EXTENSIONS), "texture"),
        ],
        "other",
    )


def path_escapes_root(path: Column) -> Column:
    """True when ``..`` segments ever climb above the start of the path."""
    step = lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("level"), F.lit(False).alias("out"))
    walk = F.aggregate(
        F.split(path, "/"),
        start,
        lambda acc, s: F.struct(
            (acc["level"] + step(s)).alias("level"),
            (acc["out"] | (acc["level"] + step(s) < 0)).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return walk


def has_magic(content: Column, kind: str) -> Column:
    mark = bytes.fromhex(SIGNATURES[kind])
    return F.substring(content, 1, len(mark)) == F.lit(mark)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)
