"""Benchmark decontamination by template windows.

Texts become templates: numbers, units after a number and names (capitalised words inside a sentence) turn into typed
placeholders, other words lose outer punctuation and case.  Short windows of every item, of its words and - where enough of them are
literal - of its template, are seeds: a bitmap of their hashes, of fixed size, is broadcast and keeps all but a few of the documents'
windows from the shuffle; the rest is hash-joined with the seeds.  Each document and item so met is aligned word by word.  A window of
``WINDOW`` words counts when its words are the item's, or when its template is, at least half literal, and its new slot values do
not contradict what most of the alignment says; a name that becomes several others, none more often, leaves only the item's own words.
An item is in a document when at least ``SHARE`` of its windows are, or all its words but ``changes_allowed``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.llm.common import map_rows
from heftmap.operators.staging import stage

WINDOW = 8
LEAST = 4
LITERALS = 0.5
SHARE = 1 / 3
FILTER_BITS = 1 << 26
CACHED = 400_000
NUMBER, UNIT, NAME = (np.uint64(xxhash.xxh64_intdigest(s)) for s in ("<number>", "<unit>", "<name>"))
START = np.uint64(0x2545F4914F6CDD1D)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
QUANTITY = regex.compile(r"[$€£]?[+-]?\d[\d.,:/]*(%|[a-z]{1,3})?")
# Stripped from words; signs of an amount stay.
OPENING, CLOSING = "!\"#%&'()*,./:;<=>?@[\\]^_`{|}~«»“”‘’„¿¡…–—", "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„¿¡…–—"
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms ton tons oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers centimeter centimeters "
    "mph kmh hz w kw v volt volts watt watts joule joules byte bytes kb mb gb tb".split())
IS_TITLE, ENDS, IS_NUMBER, IS_UNIT = 1, 2, 4, 8


class Words(dict):
    """Word (UTF-8) -> position in ``hashes`` and ``flags``; starts anew when it is full and a text begins."""

    def __init__(self):
        super().__init__()
        self.hashes, self.flags = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes, self.flags = np.concatenate([self.hashes, np.zeros(at, np.uint64)]), np.concatenate([self.flags, np.zeros(at, np.uint8)])
        text = word.decode(errors="replace")
        core = text.lstrip(OPENING).rstrip(CLOSING) or text
        lower = core.lower()
        self.hashes[at] = xxhash.xxh64_intdigest(lower)
        title = core[0].isupper() and not core[1:].isupper()
        self.flags[at] = (IS_TITLE * title + ENDS * (text.rstrip("\"')]»”’")[-1:] in ".!?:;") + IS_NUMBER * (not core.isalpha() and bool(QUANTITY.fullmatch(lower))) + IS_UNIT * (lower in UNITS))
        self[word] = at
        return at


def template(text: str | None, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of a text, the hashes of its words, and which of them are slots."""
    parts = (text or "").encode().split()
    if len(words) > CACHED:
        words.clear()
    at = np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))
    flags = words.flags[at]
    number = flags & IS_NUMBER > 0
    ended, counted = np.ones(len(parts), bool), np.zeros(len(parts), bool)
    ended[1:], counted[1:] = flags[:-1] & ENDS > 0, number[:-1]
    unit = (flags & IS_UNIT > 0) & counted & ~number
    name = (flags & IS_TITLE > 0) & ~ended & ~number & ~unit
    exact = words.hashes[at]
    tokens = exact.copy()
    tokens[number], tokens[unit], tokens[name] = NUMBER, UNIT, NAME
    return tokens, exact, number | unit | name


def all_window_hashes(tokens: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of all windows) for ascending widths, in one pass."""
    out = np.full(len(tokens), START, np.uint64)
    for k in range(min(max(widths, default=0), len(tokens))):
        out = (out[:len(tokens) - k] ^ tokens[k:]) * STEP
        out ^= out >> np.uint64(29)
        if k + 1 in widths:
            yield k + 1, out * MIX + np.uint64(k + 1)


def changes_allowed(n: int) -> int:
    """Words of an item of ``n`` that may differ in a near copy."""
    return max(min(3, n // 5), n // 10)


def seed_width(n: int) -> int:
    """So many words in a row stay in every near copy, and in every matching window."""
    allowed = changes_allowed(n)
    return min(WINDOW, -(-(n - allowed) // (allowed + 1)))


#: Literal words that the template of a seed needs: a window with half its words literal has a seed with so many, of every width.
SEED_LITERALS = (0, 1, 1, 2, 2, 2, 2, 3, 4)


def benchmark_seeds(texts: DataFrame) -> DataFrame:
    """(item, hash, width) of every item's windows: of the words themselves, and of the template where enough of it is literal."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = set()
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, exact, slots = template(value, words)
                if not len(tokens):
                    continue
                width = seed_width(len(tokens))
                literal = np.concatenate([[0], np.cumsum(~slots)])
                solid = literal[width:] - literal[:-width] >= SEED_LITERALS[width]
                for hashes in (next(all_window_hashes(exact, [width]))[1], *([next(all_window_hashes(tokens, [width]))[1][solid]] if len(tokens) >= LEAST else [])):
                    rows.update((name, h, width) for h in hashes.view(np.int64).tolist())
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], names=["item", "hash", "width"])

    return map_rows(texts, cut, "item bigint, hash bigint, width int")


def seed_hits(item: np.ndarray, doc: np.ndarray, width: int) -> set[int]:
    """Shifts at which a window of the item meets one of the document."""
    (_, mine), (_, theirs) = (next(all_window_hashes(x, [width])) for x in (item, doc))
    places: dict[int, list[int]] = {}
    for at, h in enumerate(mine.tolist()):
        places.setdefault(h, []).append(at)
    return {int(k) - at for k in np.flatnonzero(np.isin(theirs, mine)) for at in places[int(theirs[k])]}


def aligned(item: tuple, doc: tuple, shift: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which words of the item are met as they are, which under consistent new slot values, and the number of changed values."""
    (tokens, exact, slots), (tokens_d, exact_d, slots_d) = item, doc
    low, high = max(0, -shift), min(len(tokens), len(tokens_d) - shift)
    here, there = slice(low, high), slice(low + shift, high + shift)
    same, changed = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
    same[here] = exact[here] == exact_d[there]
    changed[here] = ~same[here] & slots[here] & slots_d[there] & (tokens[here] == tokens_d[there])
    maps: dict[tuple, Counter] = {}
    for i in np.flatnonzero(changed).tolist():
        maps.setdefault((tokens[i], exact[i]), Counter())[exact_d[i + shift]] += 1
    if not maps:
        return same, changed, 0
    for i in np.flatnonzero(same & slots).tolist():
        if (tokens[i], exact[i]) in maps:
            maps[tokens[i], exact[i]][exact[i]] += 1
    chosen, mixed = {}, False
    for (kind, value), met in maps.items():
        most = max(met.values())
        best = [v for v, n in met.items() if n == most]
        chosen[kind, value] = value if value in best else best[0]
        # Equal numbers may be so by chance, equal names are one.
        mixed |= kind == NAME and value not in best and len(best) > 1
    for i in np.flatnonzero(changed).tolist():
        changed[i] = not mixed and chosen[tokens[i], exact[i]] == exact_d[i + shift]
    return same, changed, sum(k[1] != v for k, v in chosen.items()) if changed.any() else 0


def runs_of(met: np.ndarray, width: int) -> np.ndarray:
    """The members of runs of at least ``width``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], met.astype(np.int8), [0]])))
    out = np.zeros(len(met), bool)
    for low, high in zip(edge[::2], edge[1::2]):
        out[low:high] = high - low >= width
    return out


def compare(item: tuple, doc: tuple, share: float) -> tuple[int, int, int] | None:
    """(matched windows, windows, changed slot values) of an item that the document holds, else None."""
    tokens, exact, slots = item
    n = len(tokens)
    if not n or not len(doc[0]):
        return None
    width, window = seed_width(n), min(WINDOW, n)
    if len(doc[0]) < width:
        return None
    literal = np.concatenate([[0], np.cumsum(~slots)])
    solid = literal[window:] - literal[:-window] >= LITERALS * window
    shifts = seed_hits(exact, doc[1], width) | (seed_hits(tokens, doc[0], width) if n >= LEAST else set())
    matched, met_at, least, near = np.zeros(len(solid), bool), {}, None, None
    for shift in shifts:
        same, changed, n_changed = aligned(item, doc, shift)
        if n < LEAST:
            changed[:] = False
        all_of = lambda x: np.lib.stride_tricks.sliding_window_view(x, window).all(axis=1)
        windows = all_of(same) | all_of(same | changed) & solid
        if windows.any():
            matched |= windows
            least = n_changed if least is None else min(least, n_changed)
        met_at[shift] = same, changed, n_changed
    # Words put in or left out move the rest of a copy by a few places.
    for shift, (same, changed, n_changed) in met_at.items():
        met = same | changed
        for move in (-3, -2, -1, 1, 2, 3):
            if shift + move in met_at:
                met = met | runs_of(met_at[shift + move][0], width)
        # A template needs as many literal words as its windows do.
        enough = not changed.any() or (met & ~slots).sum() >= LITERALS * met.sum()
        if enough and n - met.sum() <= changes_allowed(n):
            near = n_changed if near is None else min(near, n_changed)
    by_windows = matched.sum() >= share * len(matched) or solid.any() and (matched & solid).sum() >= share * solid.sum()
    if not by_windows and near is None:
        return None
    return int(matched.sum()), len(matched), min(x for x in (least if by_windows else None, near) if x is not None)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               share: float = SHARE) -> DataFrame:
    """(id, item, matched_windows, item_windows, n_changed): one row per document and benchmark item found in it.

    ``n_changed`` counts slots with another value than the item's, 0 for literal copies.  Items with equal words come as the smallest of their ids.
    Null and empty texts hold nothing; items with fewer than ``LEAST`` words are found as they are only.
    Rows of one id are one document, and rows without an id another; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = benchmark.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("_item")).where("_item is not null")
    texts = stage(texts.groupBy("_item").agg(F.min("item").alias("item")).select("item", "_item"), "items")
    seeds = stage(benchmark_seeds(texts), "seeds")
    place = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64 - (FILTER_BITS.bit_length() - 1)))
    bits = seeds.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("page")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    known = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bits.collect():  # at most FILTER_BITS / 8 bytes
        known[row.page * 4096:(row.page + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    widths = sorted(r.width for r in seeds.select("width").distinct().collect())  # 1 .. WINDOW
    shared = spark.sparkContext.broadcast(known)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    id_type = rows.schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), shared.value
        shift = np.uint64(64 - (FILTER_BITS.bit_length() - 1))
        for batch in batches:
            owners, found = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                tokens, exact, slots = template(value, words)
                hits = []
                for stream in (tokens, exact) if slots.any() else (tokens,):
                    for _, hashes in all_window_hashes(stream, widths):
                        at = hashes >> shift
                        hits.append(hashes[((known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)])
                hits = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.uint64)
                owners.append(np.full(len(hits), i))
                found.append(hits.view(np.int64))
            owners, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), pa.array(found, pa.int64())], names=["id", "hash"])

    candidates = map_rows(rows, scan, f"id {id_type}, hash bigint").join(seeds.select("hash", "item"), "hash").select("id", "item").distinct()
    wanted = stage(candidates.select(F.col("id").alias("_id"), "item").join(texts, "item"), "candidates")
    met = rows.join(wanted, F.col("id").eqNullSafe(F.col("_id"))).select("id", "item", "_text", "_item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        read = lru_cache(256)(lambda value: template(value, words))
        for batch in batches:
            held = [compare(read(y), read(x), share) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kept = [i for i, h in enumerate(held) if h]
            columns = list(zip(*(held[i] for i in kept))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(kept, pa.int64())) for k in (0, 1)), *(pa.array(c, pa.int32()) for c in columns)],
                                             names=["id", "item", "matched_windows", "item_windows", "n_changed"])

    found = map_rows(met, verify, f"id {id_type}, item bigint, matched_windows int, item_windows int, n_changed int")
    return found.groupBy("id", "item").agg(F.max("matched_windows").alias("matched_windows"), F.max("item_windows").alias("item_windows"), F.min("n_changed").alias("n_changed")).select(
        F.col("id").alias(id_column), F.col("item").alias(item), "matched_windows", "item_windows", "n_changed")
