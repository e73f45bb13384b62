"""Rasters as tiles: one row per ``TILE`` x ``TILE`` piece of an image, with an array per channel.

A tile holds image_id, the image's w and h, its own place ty and tx (in tiles), and its pixels row by row in one SMALLINT array per
channel; the last tiles of a row or column are smaller.  A texture of 4096 x 4096 is 4,096 rows here and 16.7 million in pixel form.
What a tile needs of its neighbours - border rows and columns, or the pieces a larger or smaller image is made of - is
sent to it by one shuffle on (image_id, ty, tx); no task ever holds an image.  Kernels are numpy over one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heftmap.functions.numbers import dequantize, int_div, quantize
from heftmap.functions.textures import codec_space
from heftmap.operators import raster
from heftmap.operators.raster import COLOUR, HASH_EDGE, TILE
from heftmap.operators.staging import stage
from heftmap.operators.tasks import map_batches

PLACE = ("image_id", "w", "h", "ty", "tx")
#: Pixels that a task packs at once, and values of a channel in a batch that it gives out.
PACK, GIVEN = 1 << 18, 1 << 18
#: Values a summed-area table can be taken of, from r, g and b.
MEASURES = {
    "luma": lambda r, g, b: (299 * r + 587 * g + 114 * b) // 1000,
    "weighted": lambda r, g, b: 299 * r + 587 * g + 114 * b,
}


def edge_of(extent: Column, at: Column) -> Column:
    """Rows or columns of the tile at this place."""
    return F.least(F.lit(TILE), extent - at * TILE)


def to_tiles(pixels: DataFrame, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Tiles of a pixel table whose images are complete; an image with a pixel missing or twice is an error.

    A task packs the pixels it reads into fragments of tiles, ``PACK`` pixels at a time, so that compressed bytes are shuffled and not rows of pixels.
    A row with the image's size comes before each tile's fragments.
    """
    given = {"w", "h"} <= set(pixels.columns)
    w, h = (F.max("w"), F.max("h")) if given else (F.max("x") + 1, F.max("y") + 1)
    one_size = (F.min("w") == F.max("w")) & (F.min("h") == F.max("h")) if given else F.lit(True)
    sizes = pixels.where(F.col("image_id").isNotNull()).groupBy("image_id").agg(
        w.cast("int").alias("w"), h.cast("int").alias("h"), F.count(F.lit(1)).alias("n"), one_size.alias("one_size"))
    whole = (F.col("n") == F.col("w").cast("bigint") * F.col("h")) & F.col("one_size")
    complaint = F.raise_error(F.concat(F.lit("incomplete raster "), F.col("image_id").cast("string"))).cast("array<int>")
    places = lambda extent: F.sequence(F.lit(0), int_div(F.col(extent) - 1, TILE).cast("int"))
    heads = sizes.select("image_id", "w", "h", F.explode(F.when(whole, places("h")).otherwise(complaint)).alias("ty")).select(
        "image_id", "ty", F.explode(places("w")).alias("tx"), "w", "h", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("cells"))

    placed = pixels.where(F.col("image_id").isNotNull()).select(
        "image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.col(c).cast("smallint").alias(c) for c in channels])
    id_type = placed.schema["image_id"].dataType.simpleString()

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        if any(table.column(k).null_count for k in range(1, table.num_columns)):
            raise ValueError("incomplete raster: a pixel without a value")
        ids = table.column(0).combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).dictionary_encode()
        image = ids.indices.to_numpy()
        x, y = (table.column(k).to_numpy() for k in (1, 2))
        ty, tx = y // TILE, x // TILE
        order = np.lexsort((x, y, tx, ty, image))
        image, ty, tx = image[order], ty[order], tx[order]
        starts = np.concatenate([[0], np.flatnonzero((np.diff(image) != 0) | (np.diff(ty) != 0) | (np.diff(tx) != 0)) + 1])
        ends = np.append(starts[1:], len(order))
        cells = np.stack([y % TILE * TILE + x % TILE, *(table.column(3 + k).to_numpy() for k in range(len(channels)))]).astype(np.int16)[:, order]
        cells[0, 1:] = np.diff(cells[0])  # places in order are mostly 1 apart
        cells[0, starts] = (y % TILE * TILE + x % TILE)[order][starts]
        nothing = pa.nulls(len(starts), pa.int32())
        return pa.RecordBatch.from_arrays(
            [ids.dictionary.take(pa.array(image[starts])), pa.array(ty[starts].astype(np.int32)), pa.array(tx[starts].astype(np.int32)), nothing, nothing,
             pa.array((ends - starts).astype(np.int32)), pa.array([_shut(cells[:, a:b]) for a, b in zip(starts, ends)], pa.binary())],
            names=["image_id", "ty", "tx", "w", "h", "n", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACK:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    arrays = ", ".join(f"`{c}` array<smallint>" for c in channels)
    fragments = map_batches(placed, pack, f"image_id {id_type}, ty int, tx int, w int, h int, n int, cells binary")
    met = heads.unionByName(fragments).repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx", F.asc_nulls_last("w"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, w, h, wide, tile, seen, n = None, 0, 0, 0, [], np.zeros(0, bool), 0
        made = _Tiles(channels)

        def finish() -> Iterator[pa.RecordBatch]:
            if key is not None:
                if n != len(seen) or not seen.all():
                    raise ValueError(f"incomplete raster {key[0]}")
                yield from made.add((key[0], w, h, *key[1:]), tile)

        for batch in batches:
            made.id_type = batch.schema.field(0).type
            for place, width, height, many, cells in zip(zip(*(batch.column(k).to_pylist() for k in range(3))), *(batch.column(k).to_pylist() for k in range(3, 7))):
                if width is not None:
                    yield from finish()
                    key, w, h, n = place, width, height, 0
                    wide, high = min(TILE, w - key[2] * TILE), min(TILE, h - key[1] * TILE)
                    tile, seen = [np.zeros(wide * high, np.int16) for _ in channels], np.zeros(wide * high, bool)
                    continue
                at, *held = _opened(cells, many, 1 + len(channels))
                ys, xs = np.divmod(np.cumsum(at, dtype=np.int64), TILE)
                if place != key or xs.max() >= wide or ys.max() * wide >= len(seen):
                    raise ValueError(f"incomplete raster {place[0]}")
                to = ys * wide + xs
                seen[to] = True
                n += len(to)
                for c, values in enumerate(held):
                    tile[c][to] = values
        yield from finish()
        yield from made.rest()

    return map_batches(met, join, f"image_id {id_type}, w int, h int, ty int, tx int, {arrays}")


def from_tiles(tiles: DataFrame, channels: Sequence[str] = COLOUR) -> DataFrame:
    """The pixel table of tiles, with w and h."""
    cells = F.posexplode(F.arrays_zip(*channels)).alias("at", "p")
    wide = edge_of(F.col("w"), F.col("tx"))
    return tiles.select(*PLACE, cells).select(
        "image_id", "w", "h", (F.col("tx") * TILE + F.pmod(F.col("at"), wide)).alias("x"), (F.col("ty") * TILE + int_div(F.col("at"), wide)).cast("int").alias("y"),
        *[F.col(f"p.{c}").cast("int").alias(c) for c in channels])


def _shut(cells: np.ndarray, kind: type = np.int16) -> bytes:
    """Rows of integers, compressed, the low bytes before the high bytes."""
    stored = np.ascontiguousarray(cells, kind)
    return pa.compress(np.ascontiguousarray(stored.view(np.uint8).reshape(*stored.shape, stored.itemsize).transpose(2, 0, 1)).tobytes(), "zstd", asbytes=True)


def _opened(shut: bytes, n: int, rows: int, kind: type = np.int16) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(shut, size * rows * n, "zstd", asbytes=True), np.uint8).reshape(size, rows, n)
    return np.ascontiguousarray(planes.transpose(1, 2, 0)).view(kind)[..., 0]


def _arrays(column: pa.Array) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


class _Tiles:
    """Collects finished tiles and gives them out as batches of about ``GIVEN`` values a channel."""

    def __init__(self, channels: Sequence[str], keys: Sequence[str] = PLACE):
        self.channels, self.keys, self.id_type, self.values = channels, keys, None, 0
        self.places: list[tuple] = []
        self.tiles: list[Sequence[np.ndarray]] = []

    def add(self, place: tuple, tile: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.places.append(place)
        self.tiles.append(tile)
        self.values += len(tile[0])
        if self.values >= GIVEN:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.places:
            ids, *numbers = zip(*self.places)
            columns = [pa.array(ids, self.id_type), *(pa.array(v, pa.int32()) for v in numbers), *(_lists(list(v), pa.int16()) for v in zip(*self.tiles))]
            self.places, self.tiles, self.values = [], [], 0
            yield pa.RecordBatch.from_arrays(columns, names=[*self.keys, *self.channels])


def _map_tiles(tiles: DataFrame, kernel: Callable, channels: Sequence[str], out: dict[str, str]) -> DataFrame:
    """``kernel(place, {channel: rows x columns})`` yields the values of ``out`` for any number of rows."""
    names = [*PLACE, *channels]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<smallint>": pa.list_(pa.int16()), "array<bigint>": pa.list_(pa.int64())}
    id_type = tiles.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.column(k).to_pylist() for k in range(len(PLACE))]
            held = [_arrays(batch.column(len(PLACE) + k)) for k in range(len(channels))]
            ids, rows = [], []
            for i, place in enumerate(zip(*places)):
                _, w, h, ty, tx = place
                shape = min(TILE, h - ty * TILE), min(TILE, w - tx * TILE)
                for row in kernel(place, {c: held[k][i].reshape(shape).astype(np.int64) for k, c in enumerate(channels)}):
                    ids.append(i)
                    rows.append(row)
            columns = [batch.column(0).take(pa.array(ids, pa.int32()))]
            for (_, kind), values in zip(out.items(), zip(*rows) if rows else [()] * len(out)):
                columns.append(_lists(list(values), arrow[kind].value_type) if kind.startswith("array") else pa.array(values, arrow[kind]))
            yield pa.RecordBatch.from_arrays(columns, names=["image_id", *out])

    schema = ", ".join(f"`{n}` {k}" for n, k in {"image_id": id_type, **out}.items())
    return map_batches(tiles.select(*names), run, schema)


def line_sums(tiles: DataFrame, channels: Sequence[str] = COLOUR) -> DataFrame:
    """(image_id, y, n, one sum per channel) of every line of every image: its pixels, and the sum of each value times its place in the line, from 1.

    A tile sends the sums of its lines as one compressed row; the tiles beside each other add theirs up.
    """
    id_type = tiles.schema["image_id"].dataType.simpleString()

    def send(place, held):
        _, _, _, ty, tx = place
        rows, cols = next(iter(held.values())).shape
        at = tx * TILE + 1 + np.arange(cols)
        yield ty, rows, _shut(np.stack([np.full(rows, cols), *(held[c] @ at for c in channels)]), np.int64)

    sent = _map_tiles(tiles, send, channels, {"ty": "int", "rows": "int", "sums": "binary"})
    met = sent.repartition("image_id", "ty").sortWithinPartitions("image_id", "ty")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, kind, ids, lines, n = None, None, None, [], [], 0

        def given() -> pa.RecordBatch:
            many = [v.shape[1] for v in lines]
            sums = np.concatenate(lines, axis=1)
            y = np.concatenate([ty * TILE + np.arange(k) for (_, ty), k in zip(ids, many)])
            image = pa.array([i for i, _ in ids], kind).take(pa.array(np.repeat(np.arange(len(ids)), many)))
            return pa.RecordBatch.from_arrays([image, pa.array(y.astype(np.int32)), *map(pa.array, sums)], names=["image_id", "y", "n", *channels])

        for batch in batches:
            kind = batch.schema.field(0).type
            for image, ty, rows, shut in zip(*(c.to_pylist() for c in batch.columns)):
                own = _opened(shut, rows, 1 + len(channels), np.int64)
                if (image, ty) == key:
                    total += own
                    continue
                if key is not None:
                    ids.append(key)
                    lines.append(total)
                    n += total.shape[1]
                key, total = (image, ty), own
                if n >= PACK:
                    yield given()
                    ids, lines, n = [], [], 0
        if key is not None:
            ids.append(key)
            lines.append(total)
            yield given()

    return map_batches(met, add, f"image_id {id_type}, y int, n bigint, " + ", ".join(f"`{c}` bigint" for c in channels))


# -- neighbours ------------------------------------------------------------------------


def with_borders(tiles: DataFrame, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Every tile with the border rows and columns of the tiles beside it: arrays ``<c>_up``, ``_below``, ``_left`` and ``_right``, NULL at
    the image's edge.  A tile sends itself to its own place and four strips to its neighbours'."""
    wide, high = edge_of(F.col("w"), F.col("tx")), edge_of(F.col("h"), F.col("ty"))
    column = lambda c, at: F.transform(F.sequence(F.lit(0), high - 1), lambda i: F.get(c, (i * wide + at).cast("int")))
    strips = {
        "own": (0, 0, lambda c: F.col(c)), "up": (1, 0, lambda c: F.slice(c, (high - 1) * wide + 1, wide)), "below": (-1, 0, lambda c: F.slice(c, F.lit(1), wide)),
        "left": (0, 1, lambda c: column(c, wide - 1)), "right": (0, -1, lambda c: column(c, F.lit(0)))}
    sent = [F.struct((F.col("ty") + dy).alias("ty"), (F.col("tx") + dx).alias("tx"), F.lit(name).alias("side"), *[cut(c).alias(c) for c in channels])
            for name, (dy, dx, cut) in strips.items()]
    to = tiles.select("image_id", "w", "h", F.inline(F.array(*sent))).where(
        (F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * TILE < F.col("h")) & (F.col("tx") * TILE < F.col("w")))
    # At most five rows meet: the tile and its strips.
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.struct(c)))[c]
    return to.groupBy(*PLACE).agg(
        *[pick("own", c).alias(c) for c in channels], *[pick(s, c).alias(f"{c}_{s}") for s in ("up", "below", "left", "right") for c in channels])


def high_pass_energy(tiles: DataFrame, channels: Sequence[str] = COLOUR) -> DataFrame:
    """As ``raster.high_pass_energy``: mean absolute difference between a pixel and its four neighbours, 0 for images below 3 x 3."""
    id_type = tiles.schema["image_id"].dataType.simpleString()
    empty = np.zeros((len(channels), 0), np.int16)

    def facing(w: int, h: int, ty: int, tx: int) -> dict[str, bool]:
        return {"up": ty > 0, "below": (ty + 1) * TILE < h, "left": tx > 0, "right": (tx + 1) * TILE < w}

    def gaps(around: np.ndarray, chosen: np.ndarray) -> int:
        """Sum over the chosen of the tile's pixels; ``around`` has a border of one."""
        mean = (around[:, :-2, 1:-1] + around[:, 2:, 1:-1] + around[:, 1:-1, :-2] + around[:, 1:-1, 2:]) // 4
        return int(np.abs(around[:, 1:-1, 1:-1] - mean)[:, chosen].sum())

    def within(w: int, h: int, ty: int, tx: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner pixels of the image in a tile, and which of them have a neighbour in another tile."""
        ys, xs = np.arange(ty * TILE, min(h, (ty + 1) * TILE)), np.arange(tx * TILE, min(w, (tx + 1) * TILE))
        inner = ((ys > 0) & (ys < h - 1))[:, None] & ((xs > 0) & (xs < w - 1))
        edge = np.zeros_like(inner)
        for side, at in (("up", np.s_[0]), ("below", np.s_[-1]), ("left", np.s_[:, 0]), ("right", np.s_[:, -1])):
            edge[at] |= facing(w, h, ty, tx)[side]
        return inner, inner & edge

    def send(place, held):
        """The sum over pixels whose neighbours are in the tile, with the two outer lines of every side that faces a tile; and a line to each of those tiles."""
        _, w, h, ty, tx = place
        cells = np.stack([held[c] for c in channels])
        inner, edge = within(*place[1:])
        total = gaps(np.pad(cells, ((0, 0), (1, 1), (1, 1))), inner & ~edge)
        faces = facing(*place[1:])
        lines = {"up": cells[:, :2], "below": cells[:, -2:], "left": cells[:, :, :2], "right": cells[:, :, -2:]}
        own = np.concatenate([empty, *(v.reshape(len(channels), -1) for side, v in lines.items() if faces[side])], axis=1)
        yield (w, h, ty, tx, 0, total, int(inner.sum()), *own)
        for number, side, to_y, to_x, line in ((1, "below", 1, 0, cells[:, -1]), (2, "up", -1, 0, cells[:, 0]), (3, "right", 0, 1, cells[:, :, -1]), (4, "left", 0, -1, cells[:, :, 0])):
            if faces[side]:
                yield (w, h, ty + to_y, tx + to_x, number, 0, 0, *line)

    sent = _map_tiles(tiles, send, channels, {**{k: "int" for k in PLACE[1:]}, "part": "int", "total": "bigint", "n": "bigint", **{c: "array<smallint>" for c in channels}})
    met = sent.repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile's own row comes first, then the lines of the tiles above, below, left and right."""
        key, shape, around, total, n = None, (), None, 0, 0
        ids, totals, numbers = [], [], []

        def finish() -> None:
            if key is not None:
                ids.append(key[0])
                totals.append(total + (gaps(around, within(*shape)[1]) if around is not None else 0))
                numbers.append(n)

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(totals, pa.int64()), pa.array(numbers, pa.int64())], names=["image_id", "total", "n"])
            for v in (ids, totals, numbers):
                v.clear()
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            held = [_arrays(batch.column(8 + k)) for k in range(len(channels))]
            for i, (image, w, h, ty, tx, part, own, many) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(8)))):
                cells = np.stack([v[i] for v in held])
                if part:
                    if (image, ty, tx) != key:
                        raise ValueError(f"incomplete raster {image}")
                    around[:, *{1: np.s_[0, 1:-1], 2: np.s_[-1, 1:-1], 3: np.s_[1:-1, 0], 4: np.s_[1:-1, -1]}[part]] = cells
                    continue
                finish()
                key, shape, total, n, around = (image, ty, tx), (w, h, ty, tx), own, many, None
                if cells.size:
                    high, wide = min(TILE, h - ty * TILE), min(TILE, w - tx * TILE)
                    around = np.zeros((len(channels), high + 2, wide + 2), np.int64)
                    tile, faces, at = around[:, 1:-1, 1:-1], facing(*shape), 0
                    for side, target in (("up", tile[:, :2]), ("below", tile[:, -2:]), ("left", tile[:, :, :2]), ("right", tile[:, :, -2:])):
                        if faces[side]:
                            size = target[0].size
                            target[...] = cells[:, at:at + size].reshape(target.shape)
                            at += size
            if ids:
                yield given()
        finish()
        if ids:
            yield given()

    parts = map_batches(met.select(*PLACE, "part", "total", "n", *channels), run, f"image_id {id_type}, total bigint, n bigint")
    sums = parts.groupBy("image_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    energy = F.when(F.col("n") > 0, F.col("total") / (F.col("n") * len(channels))).otherwise(F.lit(0.0))
    return sums.select("image_id", energy.alias("hp_energy"))


def codec_space_route(tiles: DataFrame) -> DataFrame:
    return high_pass_energy(tiles).withColumn("codec_space", codec_space(F.col("hp_energy")))


# -- other sizes -----------------------------------------------------------------------


def _assembled(pieces: DataFrame, channels: Sequence[str], kernel: Callable, keys: Sequence[str] = PLACE) -> DataFrame:
    """Tiles made of the few pieces sent to their place: ``kernel(place, [(y, x, rows, columns, {channel: values})])`` gives the channels."""
    gathered = pieces.select(*keys, "y", "x", "rows", "cols", "cells").repartition(*keys).sortWithinPartitions(*keys)
    id_type = pieces.schema["image_id"].dataType.simpleString()
    count = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, parts, made = None, [], _Tiles(channels, keys)

        def finish() -> Iterator[pa.RecordBatch]:
            if parts:
                tile = kernel(place, parts)
                yield from made.add(place, [tile[c].ravel() for c in channels])

        for batch in batches:
            made.id_type = batch.schema.field(0).type
            at = [batch.column(count + k).to_pylist() for k in range(4)]
            held = batch.column(count + 4).to_pylist()
            for i, own in enumerate(zip(*(batch.column(k).to_pylist() for k in range(count)))):
                if own != place:
                    yield from finish()
                    place, parts = own, []
                parts.append((*(a[i] for a in at), dict(zip(channels, _opened(held[i], at[2][i] * at[3][i], len(channels))))))
        yield from finish()
        yield from made.rest()

    schema = ", ".join([f"image_id {id_type}", *(f"`{k}` int" for k in keys[1:]), *(f"`{c}` array<smallint>" for c in channels)])
    return map_batches(gathered, run, schema)


#: What a kernel yields of a piece; its values are compressed, as they are shuffled.
PIECE = {**{k: "int" for k in ("w", "h", "ty", "tx", "y", "x", "rows", "cols")}, "cells": "binary"}


def box_downsample(tiles: DataFrame, channels: Sequence[str] = COLOUR, times: int = 1) -> DataFrame:
    """As ``raster.box_downsample``: both edges halved by 2 x 2 means, odd last rows and columns fall away.

    A tile's edge is even, so a tile shrinks on its own; four shrunken tiles make a new one.
    """

    def halve(place, held):
        _, w, h, ty, tx = place
        rows, cols = (n // 2 for n in next(iter(held.values())).shape)
        if rows and cols:
            small = {c: (v[:2 * rows:2, :2 * cols:2] + v[1:2 * rows:2, :2 * cols:2] + v[:2 * rows:2, 1:2 * cols:2] + v[1:2 * rows:2, 1:2 * cols:2] + 2) // 4
                     for c, v in held.items()}
            half = TILE // 2
            yield (w // 2, h // 2, ty // 2, tx // 2, ty % 2 * half, tx % 2 * half, rows, cols, _shut(np.stack([small[c].ravel() for c in channels])))

    def put(place, parts):
        _, w, h, ty, tx = place
        out = {c: np.zeros((min(TILE, h - ty * TILE), min(TILE, w - tx * TILE)), np.int16) for c in channels}
        for y, x, rows, cols, values in parts:
            for c in channels:
                out[c][y:y + rows, x:x + cols] = values[c].reshape(rows, cols)
        return out

    for _ in range(times):
        tiles = _assembled(_map_tiles(tiles, halve, channels, PIECE), channels, put)
    return tiles


def _samples(first: int, past: int, extent: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of target positions first..past-1: the source positions before and after each, and the weight of the second, in single precision."""
    one = np.float32(1)
    ratio = np.float32(np.float64(np.float32(extent) - one) / np.float64(max(np.float32(wide) - one, one)))
    at = np.arange(first, past).astype(np.float32) * ratio
    low = np.minimum(np.floor(at).astype(np.int64), extent - 1)
    return low, np.minimum(low + 1, extent - 1), at - low.astype(np.float32)


def bilinear_upsample(tiles: DataFrame, scale: int, channels: Sequence[str] = COLOUR) -> DataFrame:
    """As ``raster.bilinear_upsample``: aligned corners, single precision, rounded half up.

    Every tile cuts out what each target tile needs of it, mostly one piece a target; a target tile meets its up to four pieces and samples them.
    """

    def spans(at: int, size: int, extent: int) -> Iterator[tuple[int, int, int]]:
        """Target tiles along one axis that need rows at*TILE .. +size: (target, first, past) of what they need."""
        wide = extent * scale
        per_tile = TILE * max(extent - 1, 0) / max(wide - 1, 1)
        guess = int((at * TILE - 1) / per_tile) - 1 if per_tile else 0
        t = max(guess, 0)
        while t * TILE < wide:
            low, high, _ = _samples(t * TILE, min(wide, (t + 1) * TILE), extent, wide)
            first, past = max(int(low[0]), at * TILE), min(int(high[-1]) + 1, at * TILE + size)
            if first < past:
                yield t, first, past
            elif int(low[0]) >= at * TILE + size:
                return
            t += 1

    def cut(place, held):
        _, w, h, ty, tx = place
        rows, cols = next(iter(held.values())).shape
        across = list(spans(tx, cols, w))
        for to_y, y0, y1 in spans(ty, rows, h):
            for to_x, x0, x1 in across:
                part = np.s_[y0 - ty * TILE:y1 - ty * TILE, x0 - tx * TILE:x1 - tx * TILE]
                yield (w * scale, h * scale, to_y, to_x, y0, x0, y1 - y0, x1 - x0, _shut(np.stack([held[c][part].ravel() for c in channels])))

    def sample(place, parts):
        _, w, h, ty, tx = place
        y_low, y_high, y_weight = _samples(ty * TILE, min(h, (ty + 1) * TILE), h // scale, h)
        x_low, x_high, x_weight = _samples(tx * TILE, min(w, (tx + 1) * TILE), w // scale, w)
        top, left = int(y_low[0]), int(x_low[0])
        source = {c: np.zeros((int(y_high[-1]) - top + 1, int(x_high[-1]) - left + 1), np.float32) for c in channels}
        for y, x, rows, cols, values in parts:
            for c in channels:
                source[c][y - top:y - top + rows, x - left:x - left + cols] = values[c].reshape(rows, cols)
        wy, wx, one = y_weight[:, None], x_weight[None, :], np.float32(1)
        out = {}
        for c, v in source.items():
            corner = lambda ys, xs: v[np.ix_(ys - top, xs - left)]  # noqa: E731, B023
            above = corner(y_low, x_low) * (one - wx) + corner(y_low, x_high) * wx
            below = corner(y_high, x_low) * (one - wx) + corner(y_high, x_high) * wx
            value = above * (one - wy) + below * wy
            out[c] = np.clip(np.floor(value.astype(np.float64) + 0.5), 0, 255).astype(np.int16)
        return out

    return _assembled(_map_tiles(tiles, cut, channels, PIECE), channels, sample)


def crop_to_multiple(tiles: DataFrame, m: int, channels: Sequence[str] = COLOUR) -> DataFrame:
    """As ``raster.crop_to_multiple``: trailing rows and columns go until both edges are multiples of m; each tile is cut on its own."""

    def cut(place, held):
        _, w, h, ty, tx = place
        w, h = w - w % m, h - h % m
        rows, cols = min(TILE, h - ty * TILE), min(TILE, w - tx * TILE)
        if rows > 0 and cols > 0:
            yield (w, h, ty, tx, *(held[c][:rows, :cols].ravel() for c in channels))

    return _map_tiles(tiles, cut, channels, {**{k: "int" for k in PLACE[1:]}, **{c: "array<smallint>" for c in channels}})


# -- residuals -------------------------------------------------------------------------


def residual(top: DataFrame, predicted: DataFrame, step: int = 1, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Quantised differences of two rasters, tile by tile: arrays c, c_pred and c_q."""
    other = predicted.select("image_id", "ty", "tx", *[F.col(c).alias(f"{c}_pred") for c in channels])
    both = top.join(other, ["image_id", "ty", "tx"])
    same = lambda c: F.size(c) == F.size(f"{c}_pred")
    complaint = F.raise_error(F.lit("rasters of different sizes")).cast("array<smallint>")
    gap = lambda c: F.zip_with(c, f"{c}_pred", lambda a, b: quantize(a.cast("int") - b.cast("int"), step).cast("smallint"))
    return both.select(*PLACE, *channels, *[f"{c}_pred" for c in channels], *[F.when(same(c), gap(c)).otherwise(complaint).alias(f"{c}_q") for c in channels])


def reconstruct_check(residuals: DataFrame, step: int = 1, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Largest channel error after putting the residual back, and whether it is exact."""

    def worst(c: str) -> Column:
        def error(p: Column) -> Column:
            back = F.greatest(F.lit(0), F.least(F.lit(255), p[f"{c}_pred"].cast("int") + dequantize(p[f"{c}_q"].cast("int"), step)))
            return F.abs(back - p[c].cast("int"))

        return F.array_max(F.transform(F.arrays_zip(c, f"{c}_pred", f"{c}_q"), error))

    errors = [worst(c) for c in channels]
    per_tile = residuals.select("image_id", (F.greatest(*errors) if len(errors) > 1 else errors[0]).alias("e"))
    return per_tile.groupBy("image_id").agg(F.max("e").alias("max_error")).withColumn("exact", F.col("max_error") == 0)


def shannon_entropy(residuals: DataFrame, channels: Sequence[str] = COLOUR) -> DataFrame:
    """Bits per byte of the little-endian 16-bit residuals of every image; a tile sends its byte counts only."""
    names = [f"{c}_q" for c in channels]

    def count(place, held):
        values = np.concatenate([v.ravel() for v in held.values()]).astype(np.uint16)
        n = np.bincount(values & 255, minlength=256) + np.bincount(values >> 8, minlength=256)
        for symbol in np.flatnonzero(n).tolist():
            yield symbol, int(n[symbol])

    counts = _map_tiles(residuals, count, names, {"symbol": "int", "n": "bigint"})
    return raster.entropy_of_counts(counts.groupBy("image_id", "symbol").agg(F.sum("n").cast("double").alias("n")))


# -- summed areas ----------------------------------------------------------------------


def summed_area(tiles: DataFrame, measure: str = "luma") -> DataFrame:
    """(image_id, w, h, ty, tx, sums): for every pixel the sum of the measure over all pixels above and left of it, itself included.

    Sums inside a tile come first.  Their last column, added up over the tiles to the left, and their last row, added up over the tiles
    above, then carry what lies outside; both are 1/64 of the pixels.
    """
    value = MEASURES[measure]

    def inside(place, held):
        sums = value(*(held[c] for c in COLOUR)).cumsum(axis=0).cumsum(axis=1)
        yield (*place[1:], sums.ravel(), sums[:, -1], sums[-1, :])

    shape = {**{k: "int" for k in PLACE[1:]}, "sums": "array<bigint>", "last_column": "array<bigint>", "last_row": "array<bigint>"}
    own = stage(_map_tiles(tiles, inside, COLOUR, shape), "sums")

    def before(edge: str, across: str, along: str) -> DataFrame:
        """Running totals of an edge over the tiles before, as an array again."""
        window = Window.partitionBy("image_id", across, "at").orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        cells = own.select("image_id", "ty", "tx", F.posexplode(edge).alias("at", "v"))
        run = cells.withColumn("v", F.coalesce(F.sum("v").over(window), F.lit(0)))
        return run.groupBy("image_id", "ty", "tx").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias(f"{edge}_before"))

    left, above = before("last_column", "ty", "tx"), before("last_row", "tx", "ty")
    column = Window.partitionBy("image_id", "tx").orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)
    met = own.join(left, ["image_id", "ty", "tx"]).join(above, ["image_id", "ty", "tx"])
    corner = F.coalesce(F.sum(F.element_at("last_column_before", -1)).over(column), F.lit(0))
    met = met.withColumn("corner", F.array(corner))
    names = ["sums", "last_column_before", "last_row_before", "corner"]
    id_type = tiles.schema["image_id"].dataType.simpleString()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, left, above, corner = (_arrays(batch.column(len(PLACE) + k)) for k in range(4))
            sums = [(o.reshape(len(y), len(x)) + y[:, None] + x[None, :] + c[0]).ravel() for o, y, x, c in zip(own, left, above, corner)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(PLACE))), _lists(sums, pa.int64())], names=[*PLACE, "sums"])

    return map_batches(met.select(*PLACE, *names), total, f"image_id {id_type}, w int, h int, ty int, tx int, sums array<bigint>")


def box_sums(areas: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, box, total) of boxes (image_id, box, x0, y0, x1, y1), ends not included, not empty, inside their image: four look-ups each."""
    corner = lambda y, x, sign: F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(sign).alias("sign"))
    corners = boxes.select("image_id", "box", F.inline(F.array(corner("y1", "x1", 1), corner("y0", "x1", -1), corner("y1", "x0", -1), corner("y0", "x0", 1))))
    located = corners.where("y >= 0 AND x >= 0").select(
        "image_id", "box", "sign", int_div(F.col("y"), TILE).cast("int").alias("ty"), int_div(F.col("x"), TILE).cast("int").alias("tx"),
        F.pmod("y", F.lit(TILE)).alias("iy"), F.pmod("x", F.lit(TILE)).alias("ix"))
    at = (F.col("iy") * edge_of(F.col("w"), F.col("tx")) + F.col("ix")).cast("int")
    looked = located.join(areas, ["image_id", "ty", "tx"]).select("image_id", "box", (F.col("sign") * F.get("sums", at)).alias("v"))
    return looked.groupBy("image_id", "box").agg(F.sum("v").alias("total"))


def patch_variances(areas: DataFrame, patches: Sequence[int]) -> DataFrame:
    """(image_id, patch, patch_variance): for every patch size the population variance of the means of whole patches; 0 when none is whole.

    A tile sends the sums at its patch corners, one per patch; a patch takes the sums at its four corners.
    """
    id_type = areas.schema["image_id"].dataType.simpleString()

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            places = list(zip(*(batch.column(k).to_pylist() for k in range(1, len(PLACE)))))
            for i, ((w, h, ty, tx), sums) in enumerate(zip(places, _arrays(batch.column(len(PLACE))))):
                shape = min(TILE, h - ty * TILE), min(TILE, w - tx * TILE)
                sums = sums.reshape(shape)
                ys, xs = ty * TILE + np.arange(shape[0]) + 1, tx * TILE + np.arange(shape[1]) + 1
                for p in patches:
                    y, x = np.flatnonzero(ys % p == 0), np.flatnonzero(xs % p == 0)
                    n = len(y) * len(x)
                    for column, values in zip(out, (np.full(n, i), np.full(n, p), np.repeat(ys[y] // p, len(x)), np.tile(xs[x] // p, len(y)), sums[np.ix_(y, x)].ravel())):
                        column.append(values)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(flat[0])), *(pa.array(c, pa.int64()) for c in flat[1:])], names=["image_id", "patch", "cy", "cx", "s"])

    points = map_batches(areas.select(*PLACE, "sums"), corners, f"image_id {id_type}, patch bigint, cy bigint, cx bigint, s bigint")
    # The sum at corner (cy, cx) counts for the patch that ends there and for those right of, below, and below right of it.
    to = lambda dy, dx, sign: F.struct((F.col("cy") + dy).alias("cy"), (F.col("cx") + dx).alias("cx"), (F.col("s") * sign).alias("v"), F.lit(dy + dx == 0).alias("whole"))
    sent = points.select("image_id", "patch", F.inline(F.array(to(0, 0, 1), to(0, 1, -1), to(1, 0, -1), to(1, 1, 1))))
    cells = sent.groupBy("image_id", "patch", "cy", "cx").agg(F.sum("v").alias("total"), F.max("whole").alias("whole"))
    # From whole-number sums, so that the result does not depend on the order of additions.
    whole = lambda c: c.cast("decimal(38,0)")
    n, s = whole(F.count(F.lit(1))), whole(F.sum("total"))
    measured = cells.where("whole").groupBy("image_id", "patch").agg(
        (n * F.sum(whole(F.col("total") * F.col("total"))) - s * s).cast("double").alias("top"), (F.count(F.lit(1)) * F.count(F.lit(1))).alias("n2"))
    measured = measured.withColumn("v", F.col("top") / (F.col("n2") * F.col("patch") * F.col("patch") * F.col("patch") * F.col("patch")))
    wanted = areas.select("image_id").distinct().select("image_id", F.explode(F.array(*[F.lit(int(p)).cast("bigint") for p in patches])).alias("patch"))
    return wanted.join(measured, ["image_id", "patch"], "left").select("image_id", F.col("patch").cast("int").alias("patch"), F.coalesce("v", F.lit(0.0)).alias("patch_variance"))


def average_hash(weighted_areas: DataFrame) -> DataFrame:
    """As ``raster.average_hash``, of the summed areas of ``weighted``: the 64 cells of an image are 64 boxes, whatever its size.

    A tile sends, per box, the signed sums of those of its corners that lie in the tile; the tables themselves stay where they are.
    """
    id_type = weighted_areas.schema["image_id"].dataType.simpleString()

    def spans(extent: int) -> tuple[np.ndarray, np.ndarray]:
        cells = np.arange(HASH_EDGE)
        first = cells * extent // HASH_EDGE
        return first, np.minimum(np.maximum((cells + 1) * extent // HASH_EDGE, first + 1), extent)

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            places = zip(*(batch.column(k).to_pylist() for k in range(1, len(PLACE))))
            for i, ((w, h, ty, tx), sums) in enumerate(zip(places, _arrays(batch.column(len(PLACE))))):
                shape = min(TILE, h - ty * TILE), min(TILE, w - tx * TILE)
                sums = sums.reshape(shape)
                (y0, y1), (x0, x1) = spans(h), spans(w)
                total = np.zeros((HASH_EDGE, HASH_EDGE), np.int64)
                hit = np.zeros((HASH_EDGE, HASH_EDGE), bool)
                for y, x, sign in ((y1, x1, 1), (y0, x1, -1), (y1, x0, -1), (y0, x0, 1)):
                    iy, ix = y - 1 - ty * TILE, x - 1 - tx * TILE
                    # A corner above or left of the image counts nothing.
                    cy, cx = np.flatnonzero((y > 0) & (iy >= 0) & (iy < shape[0])), np.flatnonzero((x > 0) & (ix >= 0) & (ix < shape[1]))
                    total[np.ix_(cy, cx)] += sign * sums[np.ix_(iy[cy], ix[cx])]
                    hit[np.ix_(cy, cx)] = True
                box = np.flatnonzero(hit)
                area = np.outer(y1 - y0, x1 - x0).ravel()
                for column, values in zip(out, (np.full(len(box), i), box, area[box], total.ravel()[box])):
                    column.append(values)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(flat[0], pa.int64())), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int64()), pa.array(flat[3], pa.int64())],
                names=["image_id", "cell", "n", "v"])

    parts = map_batches(weighted_areas.select(*PLACE, "sums"), corners, f"image_id {id_type}, cell int, n bigint, v bigint")
    means = parts.groupBy("image_id", "cell").agg((F.sum("v") / (F.max("n") * 1000)).alias("mean"))
    return raster.hash_of_means(means)
