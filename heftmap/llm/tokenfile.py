"""Token ids in Huffman-coded files, and reading them back.

Documents are range-partitioned by id, sorted, encoded once and staged in that order with their places.  Ids are
counted over all of them (a row per id and task, summed) and get canonical codes of at most ``MAX_BITS`` bits by
package-merge.  Runs of staged documents then go into blocks of about ``BLOCK_TOKENS`` ids, always whole documents.  A block is
decoded alone, with a table of one entry per bit pattern, from all of its checkpoints (bit offsets, one every ``STRIDE`` ids) at once.

Files of a folder, as Parquet tables so that any file system Spark writes to will do:
``codes`` (id, bits), ``files`` (file, start: ids of all parts of the order before it), ``blocks`` (file,
first: ids before it in its part of the order, tokens, doc_ids, doc_tokens, checkpoints, payload).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heftmap.llm.bpe import in_groups, vocabulary
from heftmap.llm.common import map_rows
from heftmap.operators.staging import discard, fresh_path

END_ID = 0
MAX_BITS = 16
BLOCK_TOKENS = 1 << 18
STRIDE = 128


def id_type(path: str) -> np.dtype:
    """Ids are kept in two bytes where the vocabulary allows it."""
    known = vocabulary(path)
    return np.dtype("<u4" if max(known.bytes_of, default=0) >= 1 << 16 else "<u2")


def code_bits(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of every symbol, 0 for those that do not occur, by package-merge; optimal among codes of at most ``limit`` bits."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        bits[used] = 1
        return bits
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(weights))
        merged = merged[rank]
        packages = merged[0:len(merged) // 2 * 2:2] + merged[1::2]
    take = 2 * len(weights) - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        bits[order[:own]] += 1
        take = 2 * (take - own)
    return bits


class Code:
    """Canonical code: by length, then by id."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.limit = int(bits.max(initial=1))
        order = np.flatnonzero(bits)
        order = order[np.argsort(bits[order], kind="stable")]
        spans = np.uint64(1) << (np.uint64(self.limit) - bits[order].astype(np.uint64))
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(bits), np.uint64)
        self.codes[order] = starts >> (np.uint64(self.limit) - bits[order].astype(np.uint64))
        self.symbols = np.zeros(1 << self.limit, np.uint32)
        self.lengths = np.ones(1 << self.limit, np.int64)
        filled = int(spans.sum())
        self.symbols[:filled] = np.repeat(order, spans.astype(np.int64))
        self.lengths[:filled] = np.repeat(bits[order], spans.astype(np.int64))

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids' code bits, and the bit offset of every ``STRIDE``-th id."""
        size = self.bits[ids].astype(np.uint64)
        ends = np.cumsum(size)
        starts = ends - size
        top = self.codes[ids] << (np.uint64(64) - size)
        word, inside = starts >> np.uint64(6), starts & np.uint64(63)
        words = np.zeros(int(ends[-1] >> np.uint64(6)) + 2, np.uint64)
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        words[word[first].astype(np.int64)] = np.bitwise_or.reduceat(top >> inside, first)
        over = np.flatnonzero(inside + size > 64)
        words[word[over].astype(np.int64) + 1] |= top[over] << (np.uint64(64) - inside[over])
        return words.astype(">u8").tobytes()[:(int(ends[-1]) + 7) // 8], starts[::STRIDE]

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        data = np.frombuffer(payload + bytes(8 + STRIDE * self.limit // 8), np.uint8).astype(np.uint64)
        window = (data[:-3] << np.uint64(24)) | (data[1:-2] << np.uint64(16)) | (data[2:-1] << np.uint64(8)) | data[3:]
        window, at = window.astype(np.int64), checkpoints.astype(np.int64)
        out = np.empty((STRIDE, len(at)), np.uint32)
        mask = (1 << self.limit) - 1
        for step in range(STRIDE):
            pattern = (window[at >> 3] >> (32 - self.limit - (at & 7))) & mask
            out[step] = self.symbols[pattern]
            at = at + self.lengths[pattern]
        return out.T.ravel()[:n]


def ordered_ids(rows: DataFrame, path: str, end_id: int) -> DataFrame:
    """(file, place, first, tokens, id, ids) of the rows (id, text) in id order: a part of the order per task, running numbers and ids inside it."""

    width = id_type(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, file, place, first = vocabulary(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_groups(texts):
                ids, ends = known.encode(texts[a:b])
                ids = np.insert(ids.astype(width), ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                sizes = np.diff(ends, prepend=0)
                offsets = np.concatenate([[0], ends * width.itemsize]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends), file, np.int32)), pa.array(np.arange(place, place + len(ends))), pa.array(first + ends - sizes), pa.array(sizes),
                    batch.column(0).slice(a, b - a), packed], names=["file", "place", "first", "tokens", "id", "ids"])
                place, first = place + len(ends), first + int(ends[-1])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64("_text")
    ordered = rows.repartitionByRange(tasks, "_id", hashed).sortWithinPartitions("_id", hashed)
    return map_rows(ordered, encode, f"file int, place bigint, first bigint, tokens bigint, id {rows.schema[0].dataType.simpleString()}, ids binary")


def token_counts(staged: DataFrame, width: str) -> np.ndarray:
    """How often every id occurs in ``staged`` (ids)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            values = batch.column(0)
            found = np.bincount(np.frombuffer(b"".join(values.to_pylist()), width))
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[:len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    totals = map_rows(staged.select("ids"), count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    ids = totals["id"].to_numpy()
    counts = np.zeros(ids.max(initial=0) + 1, np.int64)
    counts[ids] = totals["n"].to_numpy()
    return counts


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", end_id: int = END_ID,
              max_bits: int = MAX_BITS) -> None:
    """Encodes every text, appends ``end_id`` to each document and writes the files, documents in ascending id order.

    Null texts count as empty: the end id alone.  Rows of one id keep a document each, ordered by a hash of their texts; null
    ids come first.  An empty table gives files without a block; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).cast("string").alias("_text"))
    width = id_type(tokenizer_path).str
    place = fresh_path(spark, "ordered-ids")
    ordered_ids(rows, tokenizer_path, end_id).write.option("compression", "zstd").parquet(place)
    staged = spark.read.parquet(place)
    code = Code(code_bits(token_counts(staged, width), max_bits))
    shared = spark.sparkContext.broadcast(code)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows that follow on each other; a task may read several parts, or a piece of one."""
        code, names, ids, start, before, held = shared.value, [], [], (0, 0), None, 0

        def flush() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(ids), width)
            payload, checkpoints = code.pack(tokens)
            return pa.RecordBatch.from_arrays([
                pa.array([start[0]], pa.int32()), pa.array([start[1]], pa.int64()), pa.array([len(tokens)], pa.int64()),
                pa.array([names], pa.list_(kind)), pa.array([[len(x) // np.dtype(width).itemsize for x in ids]], pa.list_(pa.int64())),
                pa.array([checkpoints.astype("<u8").tobytes()], pa.binary()), pa.array([payload], pa.binary())],
                names=["file", "first", "tokens", "doc_ids", "doc_tokens", "checkpoints", "payload"])

        for batch in batches:
            kind = batch.schema.field(4).type
            for file, at, first, tokens, name, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (held >= BLOCK_TOKENS or (file, at - 1) != before):
                    yield flush()
                    names, ids, held = [], [], 0
                if not ids:
                    start = file, first
                names.append(name)
                ids.append(packed)
                held += tokens
                before = file, at
        if ids:
            yield flush()

    schema = (f"file int, first bigint, tokens bigint, doc_ids array<{rows.schema[0].dataType.simpleString()}>, doc_tokens array<bigint>, "
              "checkpoints binary, payload binary")
    map_rows(staged, pack, schema).write.parquet(f"{path}/blocks")
    sums = staged.groupBy("file").agg(F.sum("tokens").alias("n"))  # a row per task that encoded
    sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start")).write.parquet(f"{path}/files")
    discard(spark, place)
    listed = ",".join(f"{i}:{code.bits[i]}" for i in np.flatnonzero(code.bits))
    entries = spark.range(1).select(F.explode(F.split(F.lit(listed), ",")).alias("entry"))
    entries.select(F.split("entry", ":").alias("p")).where("size(p) = 2").select(
        F.col("p")[0].cast("int").alias("id"), F.col("p")[1].cast("int").alias("bits")).write.parquet(f"{path}/codes")


def read_ids(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, start, ids) of every document: ids of all documents before it, and its own as little-endian 32-bit integers."""
    listed = spark.read.parquet(f"{path}/codes").toArrow()  # at most the vocabulary
    ids = listed["id"].to_numpy()
    bits = np.zeros(ids.max(initial=0) + 1, np.uint8)
    bits[ids] = listed["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(Code(bits))
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/files"), "file")
    blocks = blocks.select((F.col("start") + F.col("first")).alias("start"), "tokens", "doc_ids", "doc_tokens", "checkpoints", "payload")
    id_type = blocks.schema["doc_ids"].dataType.elementType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in batches:
            names = batch.column(2)
            for i in range(batch.num_rows):
                start, tokens, sizes, checkpoints, payload = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5))
                ids = code.unpack(payload, np.frombuffer(checkpoints, "<u8"), tokens).astype("<u4")
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    names[i].values, pa.array(start + ends - sizes, pa.int64()),
                    pa.array([ids[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], names=[id_column, "start", "ids"])

    return map_rows(blocks, decode, f"`{id_column}` {id_type.simpleString()}, start bigint, ids binary")
