"""Folder trees as a Spark data source: ``spark.read.format("inventory")``.

    register(spark)
    files = spark.read.format("inventory").option("roots", '[[1, "/data/a"], [2, "/data/b"]]').load()
    files = spark.read.format("inventory").load("/data/a")           # one root, with id 0

Gives the FILES columns; ``schema(...)`` may name any of them, and sizes are then looked up only if asked for.  One row per file and
folder below a root, hidden names included, links not followed, what cannot be read left out - as ``scan_inventory``, but planned by
Spark: tasks get subtrees.  Planning lists the upper levels of the trees until there are as many folders as ``partitions``
asks for, never more than that at a level.  Filters on path, size, kind and root are taken over by the source; those on the
path's beginning also keep whole subtrees from being planned or entered.  Tasks must see the trees.
"""

from __future__ import annotations

import json
import operator
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from heftmap import schemas
from heftmap.operators.tasks import ship_package

PARTITIONS = 64
BATCH = 10_000
_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}
_COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


@dataclass
class Folders(ds.InputPartition):
    """Folders (root_id, root, path below it) to list, each alone or with all below it."""

    held: list[tuple[int, str, str]]
    deep: bool


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(InventorySource)


class InventorySource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> T.StructType:
        return schemas.FILES

    def reader(self, schema: T.StructType) -> "InventoryReader":
        unknown = set(schema.names) - set(schemas.FILES.names)
        if unknown:
            raise ValueError(f"an inventory has no columns {sorted(unknown)}")
        if "roots" in self.options:
            roots = [(int(i), os.path.abspath(p)) for i, p in json.loads(self.options["roots"])]
        elif "path" in self.options:
            roots = [(0, os.path.abspath(self.options["path"].removeprefix("file://")))]
        else:
            raise ValueError("name folders by load(path) or by the option roots")
        return InventoryReader(schema, roots, int(self.options.get("partitions", PARTITIONS)))


class InventoryReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, roots: list[tuple[int, str]], most: int):
        self.fields, self.roots, self.most = schema.fields, roots, most
        self.tests: dict[str, list[tuple[str, object]]] = {}
        self.prefix = ""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kind = type(f).__name__
            if column == "path" and isinstance(f, ds.StringStartsWith):
                if f.value.startswith(self.prefix):
                    self.prefix = f.value
            taken = (
                (isinstance(f, tuple(_COMPARE)) and column in ("root_id", "path", "is_dir", "size_bytes") and f.value is not None)
                or (isinstance(f, ds.In) and column in ("root_id", "path") and None not in f.value)
                or (column == "path" and isinstance(f, (ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)))
                or (isinstance(f, ds.IsNotNull) and column in ("root_id", "path", "is_dir", "size_bytes")))
            if not taken:
                yield f
            elif kind != "IsNotNull":
                self.tests.setdefault(column, []).append((kind, f.value))

    def passes(self, column: str) -> Callable[[object], bool]:
        tests = self.tests.get(column, [])
        by_name = {k.__name__: v for k, v in _COMPARE.items()} | {
            "In": lambda x, v: x in v, "StringStartsWith": str.startswith, "StringEndsWith": str.endswith, "StringContains": lambda x, v: v in x}
        return lambda x: all(by_name[kind](x, value) for kind, value in tests)

    def may_hold(self, folder: str) -> bool:
        """Whether a path below this folder can begin with the prefix."""
        below = f"{folder}/" if folder else ""
        return below.startswith(self.prefix) or self.prefix.startswith(below)

    def partitions(self) -> list[Folders]:
        wanted = self.passes("root_id")
        level = [(i, root, "") for i, root in self.roots if wanted(i)]
        listed: list[tuple[int, str, str]] = []
        while level and len(level) < self.most:
            below = [(i, root, rel) for i, root, folder in level for item, rel in _listing(root, folder) if _is_dir(item) and self.may_hold(rel)]
            listed += level
            level = below
        alone = [Folders(part, False) for part in (listed[k::self.most] for k in range(self.most)) if part]
        return alone + [Folders(part, True) for part in (level[k::4 * self.most] for k in range(4 * self.most)) if part]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.fields]
        arrow = [_ARROW[f.dataType] for f in self.fields]
        sized = "size_bytes" in names or "size_bytes" in self.tests
        ok = {c: self.passes(c) for c in ("path", "is_dir", "size_bytes")}
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=names)

        for root_id, root, start in partition.held:
            pending = [start]
            while pending:
                for item, rel in _listing(root, pending.pop()):
                    is_dir = _is_dir(item)
                    if is_dir and partition.deep and self.may_hold(rel):
                        pending.append(rel)
                    if not ok["is_dir"](is_dir) or not ok["path"](rel):
                        continue
                    try:
                        if not is_dir and not item.is_file(follow_symlinks=False):
                            continue
                        size = 0 if is_dir or not sized else item.stat(follow_symlinks=False).st_size
                    except OSError:
                        continue
                    if sized and not ok["size_bytes"](size):
                        continue
                    known = {"root_id": root_id, "path": rel, "is_dir": is_dir, "size_bytes": size}
                    rows.append(tuple(known.get(n) for n in names))
                    if len(rows) >= BATCH:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()


def _listing(root: str, folder: str) -> Iterator[tuple[os.DirEntry, str]]:
    """Items of a folder with their path below the root; nothing where it cannot be read."""
    try:
        with os.scandir(os.path.join(root, folder) if folder else root) as items:
            for item in items:
                yield item, f"{folder}/{item.name}" if folder else item.name
    except OSError:
        return


def _is_dir(item: os.DirEntry) -> bool:
    try:
        return item.is_dir(follow_symlinks=False)
    except OSError:
        return False
