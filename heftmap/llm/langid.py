"""Language identification by prediction by partial matching.

Every language has a context tree of its training bytes, up to ``ORDER`` bytes deep.  A byte costs
``-log2(n(c, b) / (n(c) + d(c)))`` bits in the longest context ``c`` that has seen it, and each longer known context adds its
escape, ``-log2(d(c) / (n(c) + d(c)))`` with ``d`` distinct successors; below order 0 a byte costs 8 bits.  The
statistics are frozen after training, so the code length of a text is an exact sum, and the language with the shortest one wins.

All languages' costs for a (context, byte) that any of them has seen are kept as one row of a hash table per order, so scoring is a
few array lookups per byte.  Training reads a sample of about ``TRAIN_BYTES`` per language (a parameter), chosen by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.llm.common import map_rows

ORDER = 4
TRAIN_BYTES = 1 << 20
PIECE = 1 << 19
#: Of a batch of texts: scoring takes pieces, so longer batches only hold memory.
BATCH = 2 * PIECE
UNKNOWN = "und"
START = b"\n" * ORDER
MIX = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(2**64 - 1)


class Index:
    """Hash table from distinct 64-bit keys to their positions, with linear probing; -1 for other keys.  Slots hold positions, and only the keys are sent to tasks."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, NONE)  # the last one is what position -1 finds
        self._fill()

    def __getstate__(self) -> np.ndarray:
        return self.keys

    def __setstate__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self._fill()

    def _fill(self) -> None:
        keys = self.keys[:-1]
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.at = np.full(1 << bits, -1, np.int32)
        left, place = np.arange(len(keys)), (keys * MIX) >> self.shift
        while len(left):
            free = np.flatnonzero(self.at[place] < 0)
            slots, first = np.unique(place[free], return_index=True)
            chosen = free[first]
            self.at[slots] = left[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, place = left[rest], (place[rest] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = (keys * MIX) >> self.shift
        at = self.at[place]
        seen = self.keys[at]
        out = np.where(seen == keys, at, -1)
        todo = np.flatnonzero((seen != keys) & (seen != NONE))
        place = place[todo]
        while len(todo):
            place = (place + np.uint64(1)) & self.mask
            at, wanted = self.at[place], keys[todo]
            seen = self.keys[at]
            hit = seen == wanted
            out[todo[hit]] = at[hit]
            more = ~hit & (seen != NONE)
            todo, place = todo[more], place[more]
        return out


@dataclass
class Model:
    """Per order k: an index of the (k context bytes, byte) seen and their costs, and of the contexts and their escapes, a column per language."""

    langs: list[str]
    grams: list[Index] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    contexts: list[Index] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)


def packed(data: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before and each byte itself as one number, for every byte after the first ``order``."""
    n = len(data) - order
    out = np.zeros(n, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | data[k:k + n]
    return out


def train(texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
    model = Model(sorted(name for name, parts in texts.items() if any(parts)))  # an empty tree would take 8 bits for any byte
    if not model.langs:
        return model
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    for lang in model.langs:
        streams = [np.frombuffer(START[:order] + t, np.uint8) for t in texts[lang] if t]
        full = np.concatenate([packed(s, order) for s in streams]) if streams else np.zeros(0, np.uint64)
        for k in range(order + 1):
            counts[k].append(np.unique(full & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True))
    shorter = np.full((256, len(model.langs)), 8.0)
    shorter_keys = np.arange(256, dtype=np.uint64)
    for k in range(order + 1):
        keys = np.unique(np.concatenate([c[0] for c in counts[k]]))
        heads = np.unique(keys >> np.uint64(8))
        below = keys & np.uint64((1 << 8 * max(k, 1)) - 1)
        cost = shorter[np.searchsorted(shorter_keys, below)].copy()
        escape = np.zeros((len(heads), len(model.langs)))
        for j, (grams, n) in enumerate(counts[k]):
            context = np.searchsorted(heads, grams >> np.uint64(8))
            total, distinct = np.bincount(context, n, len(heads)), np.bincount(context, minlength=len(heads))
            known = distinct > 0
            escape[known, j] = -np.log2(distinct[known] / (total[known] + distinct[known]))
            cost[:, j] += escape[np.searchsorted(heads, keys >> np.uint64(8)), j]
            cost[np.searchsorted(keys, grams), j] = -np.log2(n / (total[context] + distinct[context]))
        model.grams.append(Index(keys))
        model.contexts.append(Index(heads))
        model.costs.append(cost.astype(np.float32))
        model.escapes.append(escape.astype(np.float32))
        shorter, shorter_keys = cost, keys
    return model


def code_lengths(model: Model, data: np.ndarray) -> np.ndarray:
    """Bits of every byte after the first ``order`` under every language."""
    order = len(model.grams) - 1
    full = packed(data, order)
    out = np.zeros((len(full), len(model.langs)), np.float32)
    todo = np.arange(len(full))
    for k in range(order, -1, -1):
        grams = full[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
        at = model.grams[k].find(grams)
        hit = at >= 0
        out[todo[hit]] += model.costs[k][at[hit]]
        todo, grams = todo[~hit], grams[~hit]
        if not len(todo):
            return out
        context = model.contexts[k].find(grams >> np.uint64(8))
        known = context >= 0
        out[todo[known]] += model.escapes[k][context[known]]
    out[todo] += 8
    return out


def batch_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Code length of every text under every language, whole texts, in pieces of bounded size."""
    order = len(model.grams) - 1
    lead = START[:order]
    out = np.zeros((len(texts), len(model.langs)))
    held: list[tuple[int, bytes]] = []

    def score() -> None:
        data = np.frombuffer(b"".join(part for _, part in held), np.uint8)
        ends = np.cumsum([len(part) for _, part in held])
        bits = np.concatenate([np.zeros((order, len(model.langs)), np.float32), code_lengths(model, data)])
        for (i, part), end in zip(held, ends):
            out[i] += bits[end - len(part) + order:end].sum(axis=0, dtype=np.float64)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            part = (lead if at == 0 else text[at - order:at]) + text[at:at + PIECE]
            held.append((i, part))
            size += len(part)
            if size >= PIECE:
                score()
                size = 0
    if held:
        score()
    return out


def held_out(id_column: str):
    """crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", train_bytes: int = TRAIN_BYTES, order: int = ORDER) -> Model:
    """Learns from non-null texts and languages of rows that are not held out: per language the distinct texts of the lowest hashes, until ``train_bytes`` are filled."""
    usable = docs.select(F.col(id_column).alias("_id"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    usable = usable.where((F.octet_length("_text") > 0) & F.col("_lang").isNotNull() & ~held_out("_id")).select(
        "_text", "_lang", F.xxhash64("_text").alias("_hash"))
    # Copies share a hash; each text counts once, so that a large group of them cannot fill the sample.
    zeros = (64 - F.length(F.bin("_hash"))).alias("zeros")
    once = usable.groupBy("_lang", "_hash").agg(F.any_value(F.octet_length("_text").cast("bigint")).alias("n"))
    sizes: dict[str, dict[int, int]] = {}
    for name, k, n in once.groupBy("_lang", zeros).agg(F.sum("n")).collect():  # at most 64 rows per language
        sizes.setdefault(name, {})[k] = n
    texts: dict[str, list[bytes]] = {name: [] for name in sizes}
    if not sizes:
        return train(texts, order)
    least = F.lit(64)
    for name, by_zeros in sizes.items():
        filled = [k for k in by_zeros if sum(n for z, n in by_zeros.items() if z >= k) >= train_bytes]
        least = F.when(F.col("_lang") == name, max(filled, default=0)).otherwise(least)
    drawn = usable.where(64 - F.length(F.bin("_hash")) >= least)
    for row in drawn.dropDuplicates(["_lang", "_hash"]).orderBy("_lang", F.col("_hash") < 0, "_hash").toLocalIterator():
        held = sum(map(len, texts[row._lang]))
        if held < train_bytes:
            texts[row._lang].append(row._text.encode()[:2 * train_bytes - held])
    return train(texts, order)


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) of every row, with the columns ``carry``.

    ``score`` is the winner's posterior under equal priors.  Texts that are null or have no letter, and all texts under a model of no
    language, are ``und`` with score 0; ties go to the first language by name.  Repeated rows and null ids give a row each, an empty table none.
    """
    spark = docs.sparkSession
    others = [c for c in carry if c != text]  # the text itself is passed once
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).cast("string").alias("_text"), *others)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            scored = [i for i, t in enumerate(values) if t and model.langs and any(map(str.isalpha, t))]
            texts = [values[i].encode() for i in scored]
            lengths = batch_lengths(model, texts)
            names, scores, rates = [UNKNOWN] * len(values), [0.0] * len(values), [None] * len(values)
            for i, data, bits in zip(scored, texts, lengths):
                best = int(bits.argmin())
                names[i] = model.langs[best]
                scores[i] = float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())
                rates[i] = float(bits[best] / len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()),
                 *([batch.column(1)] if text in carry else []), *batch.columns[2:]],
                names=[id_column, "lang_pred", "score", "bits_per_byte", *([text] if text in carry else []), *others])

    id_type = rows.schema[0].dataType.simpleString()
    carried = f", `{text}` string" * (text in carry) + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    return map_rows(rows, predict, batch_bytes=BATCH, schema=f"`{id_column}` {id_type}, lang_pred string, score double, bits_per_byte double{carried}")
