"""Change manifests read by many tasks, also within one file.

Spark splits a file into byte ranges at ``}``; such a piece of text says nothing about where it stands.  A first pass finds for every range
what it does to a reader in each state it can begin in (outside a string, inside one, inside one behind a backslash): the
state it ends in and the change of depth.  These effects follow on each other like numbers add up, so one row per range, combined
in file order, tells every range the state and depth it begins with.  A second pass then cuts entries out: an entry is an object
in a list of the document's own.  An entry that spans ranges is put together from its parts, and numbered by the
entries of the ranges before it.  What is no entry - the document's own fields - is short and is read as one small document.

Ranges are as long as ``spark.sql.files.maxPartitionBytes`` says.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heftmap import schemas
from heftmap.operators import manifest as M
from heftmap.operators.staging import stage
from heftmap.operators.tasks import map_batches

OUTSIDE, INSIDE, ESCAPED = range(3)
#: Depths of the document's lists and of what they hold.
LIST, ENTRY = 2, 3
MOST_RANGES = 100_000
_MARK = re.compile(r'\\.|[\\"{}\[\]]', re.S)


class Lexer:
    """Where a reader stands after the text it was given: in a string or not, and how deep."""

    def __init__(self, state: int = OUTSIDE, depth: int = 0):
        self.state, self.depth = state, depth

    def marks(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, bracket) of the brackets outside strings; depth counts them after each is given out."""
        start, inside = int(self.state == ESCAPED), self.state != OUTSIDE
        if start and not text:
            return
        self.state = INSIDE if inside else OUTSIDE
        for mark in _MARK.finditer(text, start):
            c = mark[0]
            if c == '"':
                inside = not inside
            elif c[0] == "\\":
                if len(c) == 1 and inside:
                    self.state = ESCAPED
                    return
            elif not inside:
                yield mark.start(), c
                self.depth += 1 if c in "{[" else -1
        self.state = INSIDE if inside else OUTSIDE


class Cutter:
    """Cuts a range that begins in a known state into entries, parts of entries and what is left of the document.

    ``lists`` numbers the document's own values that are lists or objects, in order; an entry belongs to the list that was opened last.
    A part is (list, entry, opened here, text): list and entry are counted from the beginning of the range, -1 for those opened before it.
    """

    def __init__(self, state: int, depth: int):
        self.lexer = Lexer(state, depth)
        self.lists = self.entries = -1
        self.parts: list[list] = []
        self.rest: list[str] = []
        self.open: list[str] | None = [] if depth >= ENTRY else None

    def add(self, text: str) -> None:
        at, lexer = 0, self.lexer
        for place, c in lexer.marks(text):
            deeper = c in "{["
            depth = lexer.depth + (1 if deeper else -1)
            if deeper and depth == LIST:
                self.rest.append(text[at:place + 1])
                self.lists += 1
            elif deeper and depth == ENTRY:
                self.entries += 1
                self.open, at = [], place
            elif not deeper and depth == ENTRY - 1 and self.open is not None:
                self.open.append(text[at:place + 1])
                self.flush()
                self.open = None
            elif not deeper and depth == LIST - 1:
                at = place
        if self.open is not None:
            self.open.append(text[at:])
        elif lexer.depth < LIST:
            self.rest.append(text[at:])

    def flush(self) -> None:
        self.parts.append([self.lists, self.entries, "".join(self.open)])

    def finish(self) -> None:
        if self.open:
            self.flush()


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, text): texts between closing braces, in order within a block."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns - 1)))
        for key, text in zip(keys, batch.column(batch.num_columns - 1).to_pylist()):
            yield key, text + "}"


def _effects(pieces: DataFrame) -> DataFrame:
    """(file, block, effect) of every range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, readers = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([[r.state for r in readers]], pa.list_(pa.int32())),
                pa.array([[r.depth for r in readers]], pa.list_(pa.int64()))], names=["file", "block", "states", "depths"])

        for key, text in _by_block(batches):
            if key != held:
                if held:
                    yield row()
                held, readers = key, [Lexer(s) for s in (OUTSIDE, INSIDE, ESCAPED)]
            for reader in readers:
                for _ in reader.marks(text):
                    pass
        if held:
            yield row()

    return map_batches(pieces, run, "file string, block bigint, states array<int>, depths array<bigint>")


def _begins(effects_: DataFrame) -> DataFrame:
    """(file, block, state, depth) at the beginning of every range; a file has as many rows here as ranges."""
    one = F.struct("block", "states", "depths")
    lists = effects_.groupBy("file").agg(F.sort_array(F.collect_list(one)).alias("blocks"))
    start = F.struct(F.lit(OUTSIDE).alias("state"), F.lit(0).cast("bigint").alias("depth"), F.array().cast("array<struct<block:bigint,state:int,depth:bigint>>").alias("out"))
    step = lambda acc, b: F.struct(
        F.get(b["states"], acc["state"]).alias("state"), (acc["depth"] + F.get(b["depths"], acc["state"])).alias("depth"),
        F.array_append(acc["out"], F.struct(b["block"].alias("block"), acc["state"].alias("state"), acc["depth"].alias("depth"))).alias("out"))
    return lists.select("file", F.inline(F.aggregate("blocks", start, step)["out"]))


def _with_begins(pieces: DataFrame, begins: DataFrame) -> DataFrame:
    """Pieces with the state their range begins in, still in order.  Up to ``MOST_RANGES`` rows (about 100 bytes each) go to every task;
    beyond that the texts are shuffled and sorted."""
    if begins.count() <= MOST_RANGES:
        return pieces.join(F.broadcast(begins), ["file", "block"])
    numbered = pieces.withColumn("nth", F.monotonically_increasing_id())
    return numbered.join(begins, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "nth")


def _cut(pieces: DataFrame, begins: DataFrame) -> DataFrame:
    """(file, block, list, entry, text): parts of entries; per range one more row with list NULL: what is left, and in ``lists`` and
    ``entries`` how many were opened in it."""
    met = _with_begins(pieces, begins)
    rows = met.select("file", "block", "state", "depth", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cutter = None, None

        def out(finished: bool) -> pa.RecordBatch:
            parts = [[*held[:2], *p, None, None] for p in cutter.parts]
            if finished:
                parts.append([*held[:2], None, None, "".join(cutter.rest), cutter.lists + 1, cutter.entries + 1])
            cutter.parts = []
            columns = list(zip(*parts))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "list", "entry", "text", "lists", "entries"])

        for key, text in _by_block(batches):
            if key != held:
                if held:
                    cutter.finish()
                    yield out(True)
                held, cutter = key, Cutter(key[2], key[3])
            cutter.add(text)
            if len(cutter.parts) >= 5000:
                yield out(False)
        if held:
            cutter.finish()
            yield out(True)

    return map_batches(rows, run, "file string, block bigint, list bigint, entry bigint, text string, lists bigint, entries bigint")


def _heads(rest: DataFrame) -> DataFrame:
    """(file, head): the document's own fields and which of its lists holds the entries, as one small JSON text; the ``}`` that every
    piece got at its end may be one too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for text in batch.column(1).to_pylist():
                found, _ = json.JSONDecoder().raw_decode(text.lstrip("﻿ \t\r\n"))
                inner = [k for k, v in found.items() if isinstance(v, (list, dict))]
                fields = {k: v for k, v in found.items() if not isinstance(v, (list, dict))}
                heads.append(json.dumps({**fields, "_list": inner.index("entries") if "entries" in inner else -1}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string())], names=["file", "head"])

    texts = rest.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    return map_batches(texts, run, "file string, head string")


def read_manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """(manifest_id, version, created_at, root, mode, seq, the fields of an entry): as ``explode_entries`` of ``read_manifest``, from
    files of one document each, each read by as many tasks as it has ranges.

    ``seq`` is the entry's place in its document.  Unknown fields are skipped; a document of another version stops the read.
    Runs jobs while it is called.
    """
    begins = stage(_begins(_effects(_pieces(spark, path))), "ranges")
    parts = stage(_cut(_pieces(spark, path), begins), "parts")
    rest = parts.where(F.col("list").isNull())
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rest.select("file", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lists", "entries")])
    head_type = "version int, created_at bigint, root string, mode string, _list bigint"
    heads = _heads(rest.select("file", "block", "text")).select("file", F.from_json("head", head_type).alias("h")).select("file", "h.*")
    complaint = F.concat(F.lit("unsupported manifest version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))
    checked = F.when(F.col("version") == M.VERSION, F.col("version")).otherwise(F.raise_error(complaint).cast("int"))
    identity = F.concat_ws("#", "file", "root", "created_at")
    heads = heads.select("file", "_list", identity.alias("manifest_id"), checked.alias("version"), "created_at", "root", "mode")
    # A part counts from the beginning of its range: list and entry -1 are the last ones opened before.
    placed = parts.where(F.col("list").isNotNull()).join(offsets, ["file", "block"]).select(
        "file", "block", (F.col("list") + F.col("lists_before")).alias("list"), (F.col("entry") + F.col("entries_before")).alias("entry"), "text")
    whole = placed.groupBy("file", "list", "entry").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    lists = Window.partitionBy("file").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    sizes = whole.groupBy("file", "list").agg(F.count(F.lit(1)).alias("n"))
    firsts = sizes.select("file", "list", F.coalesce(F.sum("n").over(lists), F.lit(0)).alias("first"))
    mine = heads.join(firsts, (heads["file"] == firsts["file"]) & (heads["_list"] == firsts["list"])).select(heads["*"], "first")
    entries = whole.join(mine, (whole["file"] == mine["file"]) & (whole["list"] == mine["_list"]))
    read = entries.select("manifest_id", "version", "created_at", "root", "mode", (F.col("entry") - F.col("first")).alias("seq"),
                          F.from_json("text", schemas.MANIFEST_ENTRY, {"mode": "FAILFAST"}).alias("e"))
    rows = read.select("manifest_id", "version", "created_at", "root", "mode", "seq", "e.*")
    strips = rows.schema["texture_strips"].dataType
    return rows.withColumn("texture_strips", F.coalesce("texture_strips", F.array().cast(strips)))
