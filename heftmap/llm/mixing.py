"""Mixing sources to target weights over fixed-length blocks of words.

Each source's words, documents in the order of a hash, form one stream that is packed into blocks of
``block`` words.  A source's slots come from multinomial draws per output shard under fixed totals,
and run through pseudorandom permutations of the source's block indexes, a new one for every
pass: slots are then joined with blocks by index, so a block is taken as often as its source's mean rounded up or
down.  Positions in a stream are sums over hash buckets of a source, so no task orders a whole source.
Only the list of sources (at most ``MAX_SOURCES``, else an error) and the draws pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heftmap.llm.common import SPACE_CLASS, WORD_CLASS, map_rows
from heftmap.operators.staging import stage

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BLOCK = 128
SHARD_SLOTS = 1 << 16
BUCKETS = 1024
MAX_SOURCES = 1_000_000
SEED = 20261


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Shares of all sizes by repeating weights; a target stops at ``cap`` sizes and the rest is shared anew."""
    out, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i % len(weights)] for i in open_)
        share = {i: rest * weights[i % len(weights)] / weight for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            rest -= out[i]
        rest = max(rest, 0.0)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def draws(quotas: np.ndarray, shard_slots: int, seed: int = SEED) -> np.ndarray:
    """Source counts per output shard: multinomial draws from what is left, never more than is left; columns add up to the quotas."""
    rng, left, out = np.random.default_rng(seed), quotas.astype(np.int64).copy(), []
    while left.sum():
        slots = min(shard_slots, int(left.sum()))
        counts = np.minimum(rng.multinomial(slots, left / left.sum()), left)
        while counts.sum() < slots:
            room = left - counts
            counts += np.minimum(rng.multinomial(slots - counts.sum(), room / room.sum()), room)
        out.append(counts)
        left -= counts
    return np.array(out, np.int64).reshape(len(out), len(quotas))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0 .. n-1: four Feistel rounds on the next even power of two, walked until inside."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            mixed = (right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS + "+"), "")).cast("bigint")


class Mix:
    """A mix of ``docs``: staged rows with stream positions, the table of sources and how often each block is taken."""

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (),
                 weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        spark = docs.sparkSession
        rows = docs.select(F.col(id_column).alias("_id"), F.struct(*carry).alias("_carried") if carry else F.lit(True).alias("_carried"),
                           _key(F.col(source)).alias("_source"), word_count(F.col(text)).alias("_size"),
                           F.xxhash64(F.col(id_column), F.col(text).cast("string"), F.lit(seed)).alias("_hash"))
        self.rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
        listed = self.rows.groupBy("_source").agg(F.sum("_size").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(listed) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        listed = sorted((not r[0], r[0], r[1]) for r in listed)
        keys, sizes = [r[1] for r in listed], [r[2] for r in listed]
        goals = targets(sizes, weights, cap)
        # A hundredth of what a source has or gives, so that whole blocks come near any target.
        words = [min(block, max(1, int(min(s, g)) // 100)) for s, g in zip(sizes, goals)]
        blocks = [-(-s // w) for s, w in zip(sizes, words)]
        quotas = np.array([min(round(g * b / s), int(cap * b)) if s else 0 for g, b, s in zip(goals, blocks, sizes)], np.int64)
        frame = pd.DataFrame({"_source": keys, "source_size": np.array(sizes, np.int64), "target": np.array(goals, float), "_length": np.array(words, np.int64)})
        lengths = stage(spark.createDataFrame(frame, "_source string, source_size bigint, target double, _length bigint"), "sources")
        self.sources = lengths.drop("_length")
        self.slots = self._slots(spark, keys, blocks, draws(quotas, shard_slots, seed), seed)
        self.times = self.slots.groupBy("_source", "_block").agg(F.count("*").alias("_times"))
        self.pieces = self._pieces(lengths.select("_source", "_length"))

    def _slots(self, spark, keys: list[str], blocks: list[int], counts: np.ndarray, seed: int) -> DataFrame:
        """(shard, _source, _block) of every slot."""
        first = np.cumsum(counts, axis=0) - counts
        runs = [(i, keys[k], int(first[i, k]), int(counts[i, k]), blocks[k], k) for i, k in zip(*np.nonzero(counts))]
        frame = pd.DataFrame(runs, columns=["shard", "_source", "first", "n", "blocks", "number"])
        table = spark.createDataFrame(frame, "shard bigint, _source string, first bigint, n bigint, blocks bigint, number bigint")

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, key, at, n, of, number in zip(*(c.to_pylist() for c in batch.columns)):
                    slots = np.arange(at, at + n)
                    taken = np.empty(n, np.int64)
                    for turn in np.unique(slots // of):
                        now = slots // of == turn
                        taken[now] = permuted(slots[now] % of, of, (seed * 1_000_003 + number) * 1_009 + int(turn))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array([key] * n, pa.string()), pa.array(taken)],
                                                     names=["shard", "_source", "_block"])

        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return map_rows(table.repartition(tasks), fill, "shard bigint, _source string, _block bigint")

    def _pieces(self, lengths: DataFrame) -> DataFrame:
        """Rows cut at block borders: (_row, _id, _source, _size, _block, _from, _words); rows without words have one piece without a block."""
        bucket = Window.partitionBy("_source", "_bucket")
        placed = self.rows.drop("_carried").withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)))
        whole = placed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("all"))
        whole = whole.withColumn("_before", F.sum("all").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("all")).drop("all").join(lengths, "_source")
        inside = F.sum("_size").over(bucket.orderBy("_hash", "_row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
        placed = placed.withColumn("_inside", inside).join(whole, ["_source", "_bucket"])
        start = F.col("_before") + F.col("_inside")
        placed = placed.select("_row", "_id", "_source", "_size", "_length", start.alias("_start"))
        block = F.col("_length")
        cut = F.when(F.col("_size") > 0, F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_size") - 1) / block)))
        cut = placed.withColumn("_block", F.explode_outer(cut))
        low = F.greatest(F.col("_block") * block, F.col("_start"))
        high = F.least((F.col("_block") + 1) * block, F.col("_start") + F.col("_size"))
        return cut.select("_row", "_id", "_source", "_size", "_block", (low - F.col("_start")).alias("_from"), (high - low).alias("_words"))

    def taken(self) -> DataFrame:
        """(_row, _id, _source, _size, _taken, _spans): _spans lists (from, words, times) of the pieces that are taken."""
        # Both sides grow with the input, so neither is ever broadcast.
        met = self.pieces.join(self.times.hint("merge"), ["_source", "_block"], "left")
        span = F.when(F.col("_times") > 0, F.struct(F.col("_from").alias("at"), F.col("_words").alias("words"), F.col("_times").alias("times")))
        return met.groupBy("_row").agg(
            F.any_value("_id").alias("_id"), F.any_value("_source").alias("_source"), F.any_value("_size").alias("_size"),
            F.coalesce(F.sum(F.col("_words") * F.col("_times")), F.lit(0)).alias("_taken"), F.array_sort(F.collect_list(span)).alias("_spans"))


def mix_sizes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: its words, its source's words and target, and the words taken, repeats counted.

    Sources rank by code point, null last, and weigh 5, 2, 1, repeating.  Null texts and texts without a word have size 0 and are not taken.
    Repeated rows and null ids are mixed like others; an empty table gives no rows; other columns are not read.
    """
    mix = Mix(docs, id_column, text, source, **options)
    out = mix.taken().select("_id", "_source", "_size", "_taken").join(mix.sources, "_source")
    return out.select(F.col("_id").alias(id_column), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows of the input's columns: one row for every pass over a document, with the words taken in that pass.

    Passes that take a whole text keep it as it is; parts of a text keep the white space inside them and are
    joined by a line feed.  Documents of which nothing is taken, so also those without a word, have no row.
    A column ``n_chars`` of whole numbers is brought up to date.
    """
    mix = Mix(docs, id_column, text, source, carry=tuple(docs.columns), **options)
    spans = mix.taken().select("_row", "_size", "_spans").where(F.size("_spans") > 0)
    joined = mix.rows.select("_row", "_carried", F.col(f"_carried.{text}").cast("string").alias("_text")).join(spans, "_row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD_CLASS)
        for batch in batches:
            rows, texts = [], []
            for i, (value, size, pieces) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                bounds = None
                for turn in range(max(p["times"] for p in pieces)):
                    runs: list[list[int]] = []
                    for p in pieces:
                        if p["times"] > turn:
                            if runs and runs[-1][1] == p["at"]:
                                runs[-1][1] += p["words"]
                            else:
                                runs.append([p["at"], p["at"] + p["words"]])
                    if runs == [[0, size]]:
                        texts.append(value)
                    else:
                        bounds = bounds or [m.span() for m in word.finditer(value)]
                        texts.append("\n".join(value[bounds[a][0]:bounds[b - 1][1]] for a, b in runs))
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["_carried", "_mixed"])

    fields = next(f for f in mix.rows.schema if f.name == "_carried").dataType
    out = map_rows(joined.select("_carried", "_text", "_size", "_spans"), cut, f"_carried {fields.simpleString()}, _mixed string")
    columns = [F.col("_mixed").alias(c) if c == text else F.length("_mixed").cast(fields[c].dataType).alias(c)
               if c == "n_chars" and fields[c].dataType.typeName() in ("integer", "long") else F.col(f"_carried.{c}") for c in docs.columns]
    return out.select(*columns)
