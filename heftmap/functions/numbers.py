"""Number formatting, scoring labels and residual quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heftmap.functions.rules import first_match


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division truncating towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def format_bytes(n: Column) -> Column:
    """Two decimals above bytes; halves go to the even digit, as ``format_number`` rounds."""
    units = ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))
    unit = first_match(((n >= F.lit(1024**p), float(1024**p)) for p, _ in units), 1.0)
    name = first_match((n >= F.lit(1024**p), label) for p, label in units)
    scaled = F.replace(F.format_number(n / unit, 2), F.lit(","), F.lit(""))
    return F.when(name.isNull(), F.format_string("%d B", n)).otherwise(F.concat_ws(" ", scaled, name))


def score_label(score: Column) -> Column:
    return first_match(
        [(score < 20, "clean"), (score < 50, "mild"), (score < 80, "structural bloat")], "severe"
    )


def rfc3339(epoch: Column) -> Column:
    """UTC second-resolution text, whatever the session time zone is."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(epoch), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def quantize(value: Column, step: int) -> Column:
    """Nearest multiple index, halves away from zero."""
    if step < 1:
        raise ValueError("quantisation step must be at least 1")
    if step == 1:
        return value
    half = step // 2
    return F.when(value >= 0, int_div(value + half, step)).otherwise(int_div(value - half, step)).cast("int")


def dequantize(index: Column, step: int) -> Column:
    if step < 1:
        raise ValueError("quantisation step must be at least 1")
    return index if step == 1 else index * F.lit(step)
