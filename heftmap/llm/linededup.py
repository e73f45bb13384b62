"""Line dedup with two Bloom filters and exact confirmation of suspected repeats.

Every task keeps a filter of keys seen once and one of keys seen twice; its bits go out in
compressed segments.  Merging two tasks' filters keeps every repeat:
``twice = twice_a | twice_b | (once_a & once_b)``.  The merged twice-filter has a fixed size
(``bits``, a documented bound of ``bits / 8`` bytes) and is broadcast; a key outside it is in one
document only.  Only keys inside it are shuffled, as whole keys, and counted exactly.  Filters only
save work: a fuller filter sends more lines to the exact count and loses none.  ``bits`` should be
about eight times the number of distinct keys, up to what an executor can hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.llm.common import map_rows
from heftmap.operators.staging import stage

FILTER_BITS = 1 << 27
SEGMENTS = 256
MIN_CHARS = 20
MIN_DOCS = 3
STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Key of a UTF-8 line, None where it has too few code points.  ``bytes.lower`` changes A-Z only."""
    if len(line) < min_chars:
        return None
    key = line.strip(STRIPPED).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key


def text_keys(text: str | None, min_chars: int) -> set[bytes]:
    keys = {line_key(line, min_chars) for line in (text or "").encode().split(b"\n")}
    keys.discard(None)
    return keys


class Bits:
    """A Bloom filter of two bits a key over ``size`` bits, a power of two."""

    def __init__(self, size: int, data: np.ndarray | None = None):
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.data = np.zeros(size // 8, np.uint8) if data is None else data

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes >> self.shift, (hashes * MIX) >> self.shift

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            found &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def repeat_filter(rows: DataFrame, bits: int, hashes_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Bits of the merged twice-filter over what ``hashes_of`` finds in the batches of all rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bits(bits), Bits(bits)
        for batch in batches:
            values, counts = np.unique(hashes_of(batch), return_counts=True)
            twice.add(values[(counts > 1) | once.has(values)])
            once.add(values)
        yield from segments(once.data, twice.data)

    def segments(once: np.ndarray, twice: np.ndarray, numbers: list[int] | None = None) -> Iterator[pa.RecordBatch]:
        once, twice = once.reshape(-1, bits // 8 // SEGMENTS), twice.reshape(-1, bits // 8 // SEGMENTS)
        numbers = numbers or list(range(SEGMENTS))
        used = [i for i in range(len(numbers)) if once[i].any()]
        for i in used:
            yield pa.RecordBatch.from_arrays([
                pa.array([numbers[i]], pa.int32()), pa.array([pa.compress(once[i].tobytes(), "zstd", asbytes=True)], pa.binary()),
                pa.array([pa.compress(twice[i].tobytes(), "zstd", asbytes=True)], pa.binary())], names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = bits // 8 // SEGMENTS
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for number, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = (np.frombuffer(pa.decompress(p, size, "zstd", asbytes=True), np.uint8) for p in packed)
                if number in held:
                    once_held, twice_held = held[number]
                    twice_held |= twice | (once_held & once)
                    once_held |= once
                else:
                    held[number] = once.copy(), twice.copy()
        for number, (once, twice) in held.items():
            yield from segments(once, twice, [number])

    schema = "segment int, once binary, twice binary"
    parts = map_rows(rows, build, schema)
    tasks = min(SEGMENTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = map_rows(parts.repartition(tasks, "segment"), merge, schema).select("segment", "twice").collect()  # bits / 8 bytes at most
    size = bits // 8 // SEGMENTS
    data = np.zeros(bits // 8, np.uint8)
    for row in merged:
        data[row.segment * size:(row.segment + 1) * size] = np.frombuffer(pa.decompress(bytes(row.twice), size, "zstd", asbytes=True), np.uint8)
    return data


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS, bits: int = FILTER_BITS) -> DataFrame:
    """(id, kept_text, n_lines, n_dropped) of every row.

    A key (line stripped of ``[\\x20\\x09-\\x0D]``, A-Z lower-cased) of at least ``min_chars`` code points in at least
    ``min_docs`` documents loses its lines everywhere but in the largest id that holds it.  Null and empty
    texts are one empty line.  Rows of one id are one document for the count and keep a row each; rows
    without an id count as one document that is never the largest.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias("_text"))
    id_type = rows.schema[0].dataType.simpleString()

    def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(key) for text in batch.column(1).to_pylist() for key in text_keys(text, min_chars)], np.uint64)

    repeats = rows.sparkSession.sparkContext.broadcast(repeat_filter(rows, bits, hashes_of))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Bits(bits, repeats.value)
        for batch in batches:
            keys, owners = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = text_keys(value, min_chars)
                keys += found
                owners += [i] * len(found)
            chosen = np.flatnonzero(twice.has(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.array(owners, np.int64)[chosen])), pa.array([keys[i] for i in chosen], pa.binary())], names=["id", "key"])

    held = stage(map_rows(rows, suspects, f"id {id_type}, key binary"), "lines")
    repeated = (held.groupBy("key").agg(F.count_distinct(F.struct("id")).alias("n"), F.max("id").alias("stays"))
                .where(F.col("n") >= min_docs).drop("n"))
    lost = (held.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("stays")))
            .groupBy("id").agg(F.collect_set("key").alias("keys")).withColumnRenamed("id", "_id"))
    joined = rows.join(lost, F.col(id_column).eqNullSafe(F.col("_id")), "left").drop("_id")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            for value, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (value or "").encode().split(b"\n")
                kept = lines
                if keys:
                    keys = set(keys)
                    kept = [line for line in lines if line_key(line, min_chars) not in keys]
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
                names=[id_column, "kept_text", "n_lines", "n_dropped"])

    return map_rows(joined, rewrite, f"`{id_column}` {id_type}, kept_text string, n_lines bigint, n_dropped bigint")
