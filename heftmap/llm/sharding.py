"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by (hash of the text, hash of the id), so equal texts lie together.  A size-weighted
sample of about ``OVERSAMPLE`` keys per unit - the driver gets these and a row per range, one for a million rows or fewer - gives quantile
boundaries; records are range-partitioned into units of about 1/``units`` of a shard's bytes.  A range over
``OVERFULL`` units by bytes or rows (a hot text, or many short ones) is subdivided by a hash of the
id and, for rows that are equal throughout, of their place.  Consecutive units form shards by their cumulative bytes, and slots run on from unit to
unit, so that no task ever orders more than a unit.  Column functions only.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heftmap.operators.staging import stage

SHARDS = 40
OVERHEAD = 16
UNITS = 64
OVERSAMPLE = 8
OVERFULL = 8
UNIT_ROWS = 1_000_000
CELL_BITS = 12


def _numbers(values: list[int]) -> Column:
    """A constant array, folded once when the plan is optimized."""
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")


def _fraction(hashed: Column) -> Column:
    """A hash as a number from 0 to below 1."""
    return F.call_function("shiftrightunsigned", hashed, F.lit(11)).cast("double") / F.lit(float(1 << 53))


def splitters(records: DataFrame, total: int, units: int) -> list[int]:
    """Quantile boundaries of the key ``h`` by size, from a size-weighted sample; ascending and distinct."""
    expected = units * OVERSAMPLE
    share = F.col("size").cast("double") * F.lit(expected / total)
    sample = records.where(_fraction(F.col("d")) < share).select("h", F.greatest(share, F.lit(1.0)).alias("w"))
    drawn = sorted((r.h, r.w) for r in sample.collect())  # about ``expected`` rows
    weight, done, bounds = sum(w for _, w in drawn), 0.0, []
    for key, w in drawn:
        if int(done * units / weight) != int((done + w) * units / weight) and (not bounds or bounds[-1] != key):
            bounds.append(key)
        done += w
    return bounds


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of boundaries that are not above ``key``: a lookup of the key's cell, then of the few boundaries in it."""
    width = 1 << (64 - CELL_BITS)
    starts = [bisect_left(bounds, -(1 << 63) + cell * width) for cell in range((1 << CELL_BITS) + 1)]
    cell = (F.call_function("shiftright", key, F.lit(64 - CELL_BITS)) + F.lit(1 << (CELL_BITS - 1))).cast("int")
    table = _numbers(starts)
    low, high = F.get(table, cell), F.get(table, cell + 1)
    inside = F.slice(_numbers(bounds), (low + 1).cast("int"), (high - low).cast("int"))
    return (low + F.size(F.filter(inside, lambda b: b <= key))).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text",
                    carry: tuple[str, ...] = (), units: int = UNITS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, with the columns ``carry`` of the input.

    Law ``bytes``: sizes (UTF-8 bytes plus 16) of shards are near equal.  Equal texts share a shard while they fill no more than
    ``OVERFULL / units`` of one; a larger group goes to neighbouring shards.  ``slot`` is gapless from 0 in each shard;
    ``grown_shard`` is null, as it belongs to another law.  Null and empty texts have 16 bytes.  Repeated rows and null
    ids get slots of their own, an empty table no rows.  Carried names must not be among the result's; other columns are not read.
    """
    content = F.col(text).cast("string")
    records = stage(docs.select(
        F.col(id_column), *carry, (F.coalesce(F.octet_length(content), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(content).alias("h"),
        F.xxhash64(F.col(id_column), content, F.lit(0)).alias("d")), "records")
    # Equal rows are told apart by their place in the staged table, which is the same whenever the input comes in the same tasks.
    task = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1)
    records = records.withColumn("d", F.xxhash64("d", task, "_metadata.row_index"))
    rows, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    goal = max(shards * units, -(-rows // UNIT_ROWS))
    bounds = splitters(records, max(total, 1), goal)
    placed = records.withColumn("range", range_of(F.col("h"), bounds))
    unit_size, unit_rows = max(1.0, total / goal), max(1.0, rows / goal)
    filled = placed.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    overfull = {r.range: max(r.s / unit_size, r.n / unit_rows) for r in filled.collect()}  # a row per range
    parts = [1] * (len(bounds) + 1)
    for number, fill in overfull.items():
        parts[number] = -(-int(fill) // 1) if fill > OVERFULL else 1
    part = F.floor(_fraction(F.col("d")) * F.get(_numbers(parts), F.col("range"))).cast("int")
    placed = placed.withColumn("part", part)
    order = Window.orderBy("range", "part")  # over the units, whose number is bounded
    before = F.sum("bytes").over(order) - F.col("bytes") / 2
    table = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        "range", "part", "n", F.least(F.lit(shards - 1), F.floor(before * shards / F.lit(max(total, 1)))).cast("int").alias("shard"))
    table = stage(table.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part")) - F.col("n")).drop("n"), "units")
    inside = F.row_number().over(Window.partitionBy("range", "part").orderBy("h", "d", id_column)) - 1
    return placed.withColumn("inside", inside).join(table, ["range", "part"]).select(
        id_column, *carry, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(assigned: DataFrame, path: str, rows_per_file: int = UNIT_ROWS) -> None:
    """One folder per shard, its files cut by slot."""
    files = assigned.withColumn("_file", F.floor(F.col("slot") / rows_per_file))
    files.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
