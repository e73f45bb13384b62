"""Table shapes the operators expect.  All sizes are bytes."""

from pyspark.sql import types as T

MIB = 1024 * 1024
GIB = 1024 * MIB


def _fields(*specs: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in specs])


FILES = _fields(
    ("root_id", T.LongType(), False),
    ("path", T.StringType(), False),
    ("is_dir", T.BooleanType(), False),
    ("size_bytes", T.LongType(), True),
    ("content_sha256", T.StringType(), True),
    ("probe_error", T.StringType(), True),
)

ENTRIES = _fields(
    ("root_id", T.LongType(), False),
    ("container_path", T.StringType(), False),
    ("path", T.StringType(), False),
    ("size_bytes", T.LongType(), True),
    ("is_package", T.BooleanType(), True),
    ("is_payload", T.BooleanType(), True),
)

MIP = _fields(("w", T.IntegerType(), True), ("h", T.IntegerType(), True), ("bytes", T.LongType(), True))

# Field names of strip records and entries are part of the manifest's file format.
STRIP_RECORD = _fields(
    ("asset_path", T.StringType(), True),
    ("export_name", T.StringType(), True),
    ("original_top_dim", T.IntegerType(), True),
    ("stripped_top_dim", T.IntegerType(), True),
    ("drop_mip_count", T.IntegerType(), True),
    ("kept_mip_count", T.IntegerType(), True),
    ("pixel_format", T.StringType(), True),
    ("compression_settings", T.StringType(), True),
    ("saved_bytes", T.LongType(), True),
)

MANIFEST_ENTRY = _fields(
    ("path", T.StringType(), True),
    ("op", T.StringType(), True),
    ("original_sha256", T.StringType(), True),
    ("original_size", T.LongType(), True),
    ("new_sha256", T.StringType(), True),
    ("new_size", T.LongType(), True),
    ("payload", T.StringType(), True),
    ("texture_strips", T.ArrayType(STRIP_RECORD), True),
)

MANIFEST = _fields(
    ("version", T.IntegerType(), True),
    ("created_at", T.LongType(), True),
    ("root", T.StringType(), True),
    ("mode", T.StringType(), True),
    ("entries", T.ArrayType(MANIFEST_ENTRY), True),
)

# Column names and order of a benchmark CSV are part of its file format.
BENCH = _fields(
    ("path", T.StringType(), True),
    ("label", T.StringType(), True),
    ("w", T.IntegerType(), True),
    ("h", T.IntegerType(), True),
    ("format", T.StringType(), True),
    ("quant_step", T.IntegerType(), True),
    ("baseline_bytes", T.LongType(), True),
    ("residual_bytes", T.LongType(), True),
    ("low_mip_bytes", T.LongType(), True),
    ("total_codec_bytes", T.LongType(), True),
    ("ratio_vs_baseline", T.DoubleType(), True),
    ("lossless_pass", T.BooleanType(), True),
    ("hp_energy", T.DoubleType(), True),
    ("recommended_space", T.StringType(), True),
)
