"""Change manifests of mixed and later versions: unknown fields are kept, and a bad document is listed instead of ending the job.

A document is read as a VARIANT.  The fields this library knows are taken out by name, with defaults where older versions lack them;
the whole document and every entry stay at hand as VARIANT columns, so that fields of later versions can be asked for by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heftmap import schemas
from heftmap.operators import manifest as M

_FIELDS = [f for f in schemas.MANIFEST_ENTRY.fields if f.name != "texture_strips"]
_STRIPS = schemas.MANIFEST_ENTRY["texture_strips"].dataType


def _take(of: Column, name: str, kind: T.DataType | str) -> Column:
    return F.try_variant_get(of, f"$.{name}", kind if isinstance(kind, str) else kind.simpleString())


def _given(of: Column, name: str) -> Column:
    """Whether the field is there and not null."""
    field = F.try_variant_get(of, f"$.{name}", "variant")
    return field.isNotNull() & ~F.coalesce(F.is_variant_null(field), F.lit(True))


def _wrong(of: Column, name: str, kind: T.DataType | str) -> Column:
    """There, but not of its kind.  Most fields can be taken, which settles it in one look."""
    return _take(of, name, kind).isNull() & _given(of, name)


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.  A filter on a plain column moves below it, and there every mention is computed again."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*columns))))


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(file, manifest_id, version, created_at, root, mode, entries, document, reason): one row per document, ``reason`` NULL for good ones.

    Refused are texts that are no JSON object, versions below 1 or not whole numbers, known fields of another kind, and entries without
    a path.  Later versions are read like the known one.  ``entries`` holds the known fields and, in ``fields``, the whole entry.
    """
    texts = spark.read.text(path, wholetext=not one_per_line).select(F.col("_metadata.file_path").alias("file"), "value")
    raw = _once(texts, F.try_parse_json(F.col("value")).alias("document")).drop("value")
    doc = F.col("document")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))
    listed = _take(doc, "entries", "array<variant>")
    entry = lambda e: F.struct(
        *[_take(e, f.name, f.dataType).alias(f.name) for f in _FIELDS], F.coalesce(_take(e, "texture_strips", _STRIPS), F.array().cast(_STRIPS)).alias("texture_strips"), e.alias("fields"))
    bad = lambda e: _take(e, "path", "string").isNull() | _wrong(e, "texture_strips", _STRIPS)
    for f in _FIELDS:
        bad = (lambda before, f: lambda e: before(e) | _wrong(e, f.name, f.dataType))(bad, f)
    entries = F.coalesce(listed, F.array().cast("array<variant>"))
    first_bad = F.array_position(F.transform(entries, lambda e: F.coalesce(bad(e), F.lit(True))), F.lit(True))
    version = _take(doc, "version", "int")
    reason = (
        F.when(~is_object, "not a JSON object").when(~_given(doc, "version"), "no version").when(version.isNull() | (version < M.VERSION), "unknown version")
        .when(_wrong(doc, "created_at", "bigint") | _wrong(doc, "root", "string") | _wrong(doc, "mode", "string"), "a field is of another kind")
        .when(_wrong(doc, "entries", "array<variant>"), "entries are no list")
        .when(first_bad > 0, F.concat(F.lit("entry "), (first_bad - 1).cast("string"), F.lit(" cannot be read"))))
    known = _once(raw, reason.alias("reason")).select(
        "file", version.alias("version"), _take(doc, "created_at", "bigint").alias("created_at"), _take(doc, "root", "string").alias("root"),
        F.coalesce(_take(doc, "mode", "string"), F.lit("full")).alias("mode"), F.transform(entries, entry).alias("entries"), doc.alias("document"), "reason")
    return known.withColumn("manifest_id", F.concat_ws("#", "file", "root", "created_at"))


def good_manifests(documents: DataFrame) -> DataFrame:
    """As ``read_manifest`` gives them, with ``document``; entries carry ``fields``."""
    return documents.where(F.col("reason").isNull()).select("manifest_id", "version", "created_at", "root", "mode", "entries", "document")


def refused_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("reason").isNotNull()).select("file", "version", "reason")
