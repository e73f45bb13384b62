"""Replay, verification and projection over change manifests.

Entries carry ``seq``, their position in the manifest.  ``manifest_id`` names the
manifest; every operator works on any number of manifests at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.functions import paths as P
from heftmap.functions import textures as T
from heftmap.functions.numbers import rfc3339

VERSION = 1


def manifest_status(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        "manifest_id", "version", "created_at", rfc3339(F.col("created_at")).alias("created_text"), "mode",
        F.coalesce(F.size("entries"), F.lit(0)).alias("entry_count"),
    )


def explode_entries(manifests: DataFrame) -> DataFrame:
    """One row per entry with its position; absent strip lists become empty."""
    rows = manifests.select("manifest_id", F.posexplode("entries").alias("seq", "entry")).select(
        "manifest_id", F.col("seq").cast("bigint").alias("seq"), "entry.*"
    )
    strips = rows.schema["texture_strips"].dataType
    return rows.withColumn("texture_strips", F.coalesce("texture_strips", F.array().cast(strips)))


def explode_strips(entries: DataFrame) -> DataFrame:
    return entries.select(
        "manifest_id", "seq", "path", "original_size", F.posexplode("texture_strips").alias("strip_seq", "strip")
    ).select("manifest_id", "seq", "path", "original_size", "strip_seq", "strip.*")


def verify_restore(entries: DataFrame, payloads: DataFrame) -> DataFrame:
    """Status of every entry: ok, escapes root, missing payload or hash mismatch.

    ``payloads`` holds (manifest_id, payload, payload_sha256), one row per payload.  Created
    files have no payload, so they and escaping paths need no look-up; sharing one empty
    key, they would also meet in one task.
    """
    settled = F.when(P.path_escapes_root(F.col("path")), "escapes_root").when(F.col("op") == "create", "ok")
    marked = entries.withColumn("status", settled)
    known = marked.where(F.col("status").isNotNull()).withColumn("payload_sha256", F.lit(None).cast("string"))
    looked_up = marked.where(F.col("status").isNull()).drop("status").join(payloads, ["manifest_id", "payload"], "left")
    status = (
        F.when(F.col("payload_sha256").isNull(), "missing_payload")
        .when(F.col("payload_sha256") != F.col("original_sha256"), "hash_mismatch")
        .otherwise("ok")
    )
    return known.unionByName(looked_up.withColumn("status", status))


def verify_manifest(entries: DataFrame, payloads: DataFrame) -> DataFrame:
    return verify_restore(entries, payloads).groupBy("manifest_id", "status").agg(
        F.count(F.lit(1)).alias("entry_count")
    )


def replay_restore(verified: DataFrame) -> DataFrame:
    """State of every path after undoing the manifest from its end to its start.

    The earliest entry that passes verification is undone last, so it decides.
    """
    passed = F.when(
        F.col("status") == "ok",
        F.struct("seq", F.col("op"), F.col("original_sha256").alias("sha"), F.col("original_size").alias("size")),
    )
    decided = verified.groupBy("manifest_id", "path").agg(F.min(passed).alias("last"))
    op = F.col("last.op")
    return decided.select(
        "manifest_id", "path",
        F.when(op.isNull(), "unchanged").when(op == "create", "absent").otherwise("restored").alias("outcome"),
        F.when(op != "create", F.col("last.sha")).alias("sha256"),
        F.when(op != "create", F.col("last.size")).alias("size_bytes"),
    )


def _strip_amounts(strips: DataFrame) -> DataFrame:
    settings = F.col("compression_settings")
    baseline = T.top_mip_bytes(F.col("original_top_dim"), F.col("pixel_format"))
    ratio = T.projection_ratio(settings)
    return strips.select(
        "manifest_id", F.coalesce(settings, F.lit("none")).alias("compression_settings"),
        baseline.alias("baseline_bytes"), ratio.alias("ratio"), T.projection_basis(settings).alias("basis"),
        F.floor(baseline * ratio).alias("projected_bytes"),
    )


def project_classes(strips: DataFrame) -> DataFrame:
    """Per compression setting: textures, baseline and projected bytes."""
    return _strip_amounts(strips).groupBy("manifest_id", "compression_settings", "ratio", "basis").agg(
        F.count(F.lit(1)).alias("texture_count"), F.sum("baseline_bytes").alias("baseline_bytes"),
        F.sum("projected_bytes").alias("projected_bytes"),
    )


def project_savings(entries: DataFrame, strips: DataFrame) -> DataFrame:
    """Backup bytes now and after re-coding the strips; other bytes stay as they are."""
    now = entries.groupBy("manifest_id").agg(F.coalesce(F.sum("original_size"), F.lit(0)).alias("current_bytes"))
    recoded = _strip_amounts(strips).groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("texture_count"), F.sum("baseline_bytes").alias("baseline"),
        F.sum("projected_bytes").alias("projected"),
    )
    zero = F.lit(0).cast("bigint")
    joined = now.join(recoded, "manifest_id", "left").fillna(0, ["texture_count", "baseline", "projected"])
    other = F.greatest(F.col("current_bytes") - F.col("baseline"), zero)
    after = joined.withColumn("projected_bytes", F.col("projected") + other)
    return after.select(
        "manifest_id", "texture_count", "current_bytes", "projected_bytes",
        F.greatest(F.col("current_bytes") - F.col("projected_bytes"), zero).alias("savings_bytes"),
        F.when(F.col("current_bytes") == 0, F.lit(0.0))
        .otherwise(F.col("projected_bytes") / F.col("current_bytes")).alias("ratio"),
    )
