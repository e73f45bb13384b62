"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints that differ in at most three bits agree on one of four 16-bit blocks.  For each block
the distinct fingerprints are turned so that it comes first and dealt out by it; below depth 16 the
trie of each block is joined with itself: a pair of nodes is followed to its children's
pairs, adding up the bits in which they differ, and dropped once that is more than the budget.
A block with more than ``leaf`` fingerprints is first unfolded, in Spark, into the pairs of its nodes
eight bits further down that are still within the budget, as often as needed.  Tasks report a spanning
forest of the links, never all pairs; components come from alternating large-star and small-star rounds,
or, where the links are few enough for one small task, from one forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.llm.common import map_rows
from heftmap.operators.staging import discard, stage

SEED = 42
SHINGLE = 3
BUDGET = 3
BLOCK = 16
STEP = 8
LEAF = 1 << 18
FRONTIER = 1 << 19
CHUNK = 1 << 16
#: Edges (16 bytes each) that one task takes at once; more go through the rounds, each of them several queries that the driver has to plan.
FEW = 1 << 17


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit i is set where more than half of the shingles' XXH64 have it.  ``bytes.lower`` and ``split`` see ASCII only."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digests = np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=SEED), shingles)), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 16):
        counts += np.unpackbits(digests[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str, text: str, width: int = SHINGLE) -> DataFrame:
    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias("_text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "print"])

    return map_rows(rows, take, f"id {rows.schema[0].dataType.simpleString()}, print bigint")


class Forest:
    """Smallest position that each position is linked to, by hooking and pointer jumping."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_links(values: np.ndarray, left: np.ndarray, right: np.ndarray, depth: np.ndarray, used: np.ndarray, budget: int) -> np.ndarray:
    """Joins node pairs of tries and returns, for every position, the smallest position it is linked to.

    ``values``: unsigned, ascending inside every node.  ``left`` and ``right``: (lo, hi) positions of
    each pair's nodes, equal for a node with itself; ``depth``, ``used``: bits above and the difference in them.
    """
    ones = {}
    forest = Forest(len(values))

    def middle(lo: np.ndarray, hi: np.ndarray, at: int) -> np.ndarray:
        if at not in ones:
            bit = (values >> np.uint64(63 - at)) & np.uint64(1)
            ones[at] = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
        return hi - (ones[at][hi] - ones[at][lo])

    stack = [(int(d), np.column_stack([left[depth == d], right[depth == d], used[depth == d]]).astype(np.int32)) for d in np.unique(depth)]
    while stack:
        at, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(at, pairs[:half]), (at, pairs[half:])]
            continue
        a_lo, a_hi, b_lo, b_hi, cost = pairs.T
        same = a_lo == b_lo
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        ends = pairs[single & ~same]
        if len(ends):
            near = np.bitwise_count(values[ends[:, 0]] ^ values[ends[:, 2]]) <= budget
            forest.link(ends[near, 0], ends[near, 2])
        pairs = pairs[~single]
        if not len(pairs) or at == 64:
            continue
        a_lo, a_hi, b_lo, b_hi, cost = pairs.T
        same = a_lo == b_lo
        a_mid, b_mid = middle(a_lo, a_hi, at), middle(b_lo, b_hi, at)
        children = [
            (a_lo, a_mid, b_lo, b_mid, cost, None), (a_mid, a_hi, b_mid, b_hi, cost, None),
            (a_lo, a_mid, b_mid, b_hi, cost + 1, None), (a_mid, a_hi, b_lo, b_mid, cost + 1, ~same),
        ]
        grown = []
        for lo, hi, lo2, hi2, c, only in children:
            keep = (hi > lo) & (hi2 > lo2) & (c <= budget)
            if only is not None:
                keep &= only
            grown.append(np.column_stack([lo, hi, lo2, hi2, c])[keep])
        stack.append((at + 1, np.concatenate(grown)))
    return forest.root


def _turned(value, block: int):
    return F.call_function("shiftleft", value, F.lit(BLOCK * block)).bitwiseOR(
        F.call_function("shiftrightunsigned", value, F.lit(64 - BLOCK * block))) if block else value


def _prefix(value, depth):
    return F.call_function("shiftrightunsigned", value, F.lit(64) - depth)


def _unfold(members: DataFrame, budget: int) -> DataFrame:
    """Members of node pairs, filed under the pairs of their nodes ``STEP`` bits down."""
    pair = ["block", "depth", "a", "b", "used"]
    down = members.withColumn("child", _prefix(F.col("value"), F.col("depth") + STEP))
    nodes = down.groupBy(*pair, "side").agg(F.collect_set("child").alias("others"))
    self_pair = F.col("a") == F.col("b")
    facing = nodes.withColumn("side", F.when(self_pair, F.col("side")).otherwise(1 - F.col("side")))
    met = down.join(facing, [*pair, "side"]).withColumn("other", F.explode("others"))
    cost = F.bit_count(F.col("child").bitwiseXOR(F.col("other")))  # of all bits above, so it holds what was used before
    met = met.withColumn("cost", cost).where(F.col("cost") <= budget)
    first = F.when(self_pair, F.col("child") <= F.col("other")).otherwise(F.col("side") == 0)
    return met.select(
        "block", (F.col("depth") + STEP).alias("depth"), F.when(first, F.col("child")).otherwise(F.col("other")).alias("a"),
        F.when(first, F.col("other")).otherwise(F.col("child")).alias("b"), F.col("cost").alias("used"),
        F.when(first, 0).otherwise(1).alias("side"), "value")


def links(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Spanning links (a, b), a < b, between distinct values of ``prints`` (print) that differ in at most ``budget`` < 4 bits."""
    if not 0 <= budget < 64 // BLOCK:
        raise ValueError("four blocks find differences of at most three bits")
    pair = ["block", "depth", "a", "b", "used"]
    turned = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), _turned(F.col("print"), k).alias("value")) for k in range(4)))).alias("t")
    members = prints.select(turned).select("t.block", "t.value").select(
        "block", F.lit(BLOCK).alias("depth"), _prefix(F.col("value"), F.lit(BLOCK)).alias("a"),
        _prefix(F.col("value"), F.lit(BLOCK)).alias("b"), F.lit(0).alias("used"), F.lit(0).alias("side"), "value")
    ready: DataFrame | None = None
    full = members.groupBy(*pair).count().where((F.col("count") > leaf) & (F.col("depth") < 64)).select(*pair)
    while not full.isEmpty():
        full = stage(full, "nodes")
        done = members.join(full, pair, "left_anti")
        ready = done if ready is None else ready.unionByName(done)
        members = stage(_unfold(members.join(full, pair), budget), "pairs")
        full = members.groupBy(*pair).count().where((F.col("count") > leaf) & (F.col("depth") < 64)).select(*pair)
    members = members if ready is None else ready.unionByName(members)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair, side and value; whole pairs are joined together, about ``CHUNK`` rows at a time."""
        held = np.zeros((7, 0), np.uint64)
        for batch in batches:
            fresh = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns])
            held = np.concatenate([held, fresh], axis=1)
            if held.shape[1] >= CHUNK:
                change = np.flatnonzero((held[:5, 1:] != held[:5, :-1]).any(axis=0)) + 1
                if len(change):
                    yield from found(held[:, :change[-1]])
                    held = held[:, change[-1]:]
        if held.shape[1]:
            yield from found(held)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = rows.shape[1]
        starts = np.concatenate([[0], np.flatnonzero((rows[:5, 1:] != rows[:5, :-1]).any(axis=0)) + 1]).astype(np.int64)
        ends = np.append(starts[1:], n)
        side_ones = np.concatenate([[0], np.cumsum(rows[5])]).astype(np.int64)
        middles = ends - (side_ones[ends] - side_ones[starts])
        self_pair = rows[2, starts] == rows[3, starts]
        left = np.column_stack([starts, np.where(self_pair, ends, middles)])
        right = np.column_stack([np.where(self_pair, starts, middles), ends])
        some = (left[:, 1] > left[:, 0]) & (right[:, 1] > right[:, 0])
        values = rows[6]
        roots = trie_links(values, left[some], right[some], rows[1, starts][some].astype(np.int64), rows[4, starts][some].astype(np.int64), budget)
        linked = np.flatnonzero(roots != np.arange(n))
        turn = np.uint64(BLOCK) * rows[0]
        back = np.where(turn == 0, values, (values >> turn) | (values << ((np.uint64(64) - turn) & np.uint64(63)))).view(np.int64)
        x, y = back[linked], back[roots[linked]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    dealt = members.repartition("block", "a", "b").sortWithinPartitions(*pair, "side", "value").select(*pair, "side", "value")
    return map_rows(dealt, join, "a bigint, b bigint").where("a <> b").distinct()


def _forest(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of at most ``FEW`` edges (a, b), in one task."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        if pairs:
            nodes, ends = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
            forest = Forest(len(nodes))
            forest.link(*ends.reshape(2, -1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.root])], names=["node", "root"])

    return map_rows(edges.coalesce(1), link, "node bigint, root bigint")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component."""
    spark = edges.sparkSession
    edges = stage(edges.select("a", "b"), "edges")
    if edges.count() <= few:
        return _forest(edges)
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = stage(large, "large")
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = (large.withColumnRenamed("a", "v").join(least, F.col("b") == F.col("u"))
                 .select(F.col("m").alias("a"), F.explode(F.array("v", "u")).alias("b")).where("a <> b").distinct())
        after = stage(small, "edges")
        state = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        discard(spark, edges, large)
        edges = after
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = SHINGLE,
                    budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 lowercase hex digits and the smallest id reachable over links.

    Null texts and texts without a word have fingerprint zero and are linked like any other; texts with fewer words than
    ``width`` have one shingle.  Repeated rows keep a row each; rows without an id take part and get null
    only where no row of their component has an id.  An empty table gives no rows; other columns are not read.
    """
    held = stage(fingerprints(docs, id_column, text, width), "prints")
    distinct = stage(held.groupBy("print").agg(F.min("id").alias("first")), "distinct")
    nodes = stage(components(links(distinct.select("print"), budget, leaf)), "components")
    member = nodes.join(distinct, nodes.node == distinct.print)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = nodes.join(least, "root").select(F.col("node").alias("print"), "component_id")
    alone = distinct.join(nodes.select(F.col("node").alias("print")), "print", "left_anti").select("print", F.col("first").alias("component_id"))
    where = moved.unionByName(alone)
    return held.join(where, "print").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
