"""Near copies of documents by the exact Jaccard similarity of their word shingles.

Two sets whose similarity is at least ``SIMILARITY`` share one of the first ``n - ceil(SIMILARITY * n) + 1`` members of each in any
common order (prefix filtering), so documents are filed under those only.  The order puts shingles that are frequent in a sample of
the documents last, which keeps common passages out of the prefixes; it only balances work, results do not depend on it.  Most keys are
in one document only: once- and twice-seen Bloom filters over all of them leave those out before anything is filed.  Before that,
the trie self-join of ``simhash`` links fingerprints of at most three differing bits, and these pairs are compared first: a large group of near copies
is mostly one component before a prefix is looked at.  Fingerprints miss similar pairs that differ in more bits, which the prefixes find.  Under
every key each document is first compared with the one that has the fewest members before the key and with its neighbour, the most promising first and in two rounds;
then all documents that share a key and are still in different components are, under crowded keys only those that can be similar by such keys alone, where
the smaller set needs only its even shorter index prefix.  So no pair is left out, and of a large group of near copies the documents that are similar to none drop out before pairs are made.

A pair is refused without its texts where its sizes, the members of other components before the shared key or the counts of both sets in bins of their hashes
show that too little is shared; these are upper bounds of the overlap, so no similar pair is refused.  Sets that share nearly enough with each other and
are in different components are still compared pair by pair.  Of what is left, the larger
set's text goes to the smaller one's place, where that text comes once for all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heftmap.llm import simhash
from heftmap.llm.common import map_rows
from heftmap.llm.linededup import Bits, repeat_filter
from heftmap.llm.simhash import SEED, components
from heftmap.operators.staging import discard, stage

SHINGLE = 5
#: At least 4 of 5.
OVER, OF = 4, 5
SAMPLE = 1 << 14
FREQUENT, MOST = 8, 1 << 17
#: Bits of the filters; fuller ones let more keys and texts through and lose none.
KEY_BITS, ID_BITS = 1 << 27, 1 << 24
#: Members of a set per bin, about; a set with more than 255 in one has no bins and is never refused by them.
PER_BIN = 1
SALTS = 32
#: Pairs of a set that are compared first, and how often this is repeated among what is still apart; they only balance work.
TRIES, ROUNDS = 64, 2
#: Documents of a key from which on it is crowded: its pairs have to be possible without the other keys.  It only balances work.
CROWDED = 32


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the shingles, ascending; a text of fewer words is one shingle.  Case and white space are ASCII's, as in ``simhash``."""
    words = (text or "").encode().lower().split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=SEED), parts)), ">u8").astype(np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= OVER * (len(a) + len(b) - both)


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in about ``SAMPLE`` rows, at most ``MOST``, ascending, and their counts there."""
    share = min(1.0, SAMPLE / max(rows.count(), 1))
    drawn = rows.where(F.call_function("shiftrightunsigned", F.xxhash64("_text"), F.lit(11)) < F.lit(share * float(1 << 53))).select("_text").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["key"])

    counts = map_rows(drawn, cut, "key bigint").groupBy("key").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "key").limit(MOST).toArrow()
    keys, n = found["key"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _bins(found: np.ndarray) -> bytes | None:
    log = max(3, int(len(found) // PER_BIN).bit_length())
    counts = np.bincount((found >> np.uint64(64 - log)).astype(np.int64), minlength=1 << log)
    return None if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def _may_overlap(a: bytes | None, b: bytes | None, sizes: int) -> bool:
    """Whether sets of together ``sizes`` members with these bins can be similar."""
    if a is None or b is None:
        return True
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in sorted((a, b), key=len))
    shared = int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())
    return (OF + OVER) * shared >= OVER * sizes


def _prefixes(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(id, node, print, size, bins, keys): a document's set of shingles as its hash, its fingerprint, the set's size and bins and its first members in the common order."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            nodes, prints, sizes, bins, keys = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                n = len(found)
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    rank = np.where(known[at] == found, counts[at], 0)
                first = found[np.argsort(rank, kind="stable")][:n + (-OVER * n) // OF + 1]
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), seed=SEED))
                prints.append(simhash.fingerprint(text))
                sizes.append(n)
                bins.append(_bins(found))
                keys.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(np.array(v, np.uint64).view(np.int64)) for v in (nodes, prints)), pa.array(sizes, pa.int32()), pa.array(bins, pa.binary()),
                pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "print", "size", "bins", "keys"])

    return map_rows(rows, take, f"id {rows.schema[0].dataType.simpleString()}, node bigint, print bigint, size int, bins binary, keys array<bigint>")


def _by_prints(distinct: DataFrame) -> DataFrame:
    """(a, b, sizes): the sets of one fingerprint with their smallest, and the smallest ones of fingerprints that the tries link, where the sizes allow similarity."""
    own = distinct.select("print", F.struct("size", "node").alias("x"))
    least = stage(own.groupBy("print").agg(F.min("x").alias("x")), "prints")
    alike = own.withColumnRenamed("x", "y").join(least, "print").where("x <> y").select("x", "y")
    ends = lambda print_, name: least.select(F.col("print").alias(print_), F.col("x").alias(name))
    linked = simhash.links(least.select("print")).join(ends("a", "x"), "a").join(ends("b", "y"), "b").select("x", "y")
    small, large = F.least("x", "y"), F.greatest("x", "y")
    return alike.unionByName(linked).select(small.alias("x"), large.alias("y")).where(OF * F.col("x.size") >= OVER * F.col("y.size")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), (F.col("x.size") + F.col("y.size")).alias("sizes"))


def _keys_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(2).flatten().to_numpy().view(np.uint64)


def _filed(rows: DataFrame, twice: Broadcast) -> DataFrame:
    """(key, at, node, size) of the prefix members of ``rows`` (node, size, keys) that may be in another prefix as well."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(KEY_BITS, twice.value)
        for batch in batches:
            lists = batch.column(2)
            flat, bounds = _keys_of(batch), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(len(lists)), np.diff(bounds))
            chosen = np.flatnonzero(known.has(flat))
            row, at = row[chosen], chosen - bounds[row[chosen]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[chosen].view(np.int64)), pa.array(at.astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                names=["key", "at", "node", "size"])

    return map_rows(rows, file, "key bigint, at int, node bigint, size int")


def _possible(found: DataFrame, x: str, before: str = "open") -> DataFrame:
    """(a, b, sizes, overlap, own): pairs of ``x`` (a struct) and the row's own set, the smaller first, that sizes and the shared key's places allow, and the most they can share.

    What both sets have before the key is in both prefixes; of these members ``before`` counts those that can be shared, for each set."""
    small, large, at = F.least(f"{x}.size", "size"), F.greatest(f"{x}.size", "size"), F.col("at")
    overlap = F.least(f"{x}.{before}", before) + F.least(F.col(f"{x}.size") - F.col(f"{x}.at"), F.col("size") - at)
    ahead = F.struct(f"{x}.size", f"{x}.node") < F.struct("size", "node")
    return found.where((F.col(f"{x}.node") != F.col("node")) & (OF * small >= OVER * large) & ((OF + OVER) * overlap >= OVER * (small + large))).select(
        F.when(ahead, F.col(f"{x}.node")).otherwise(F.col("node")).alias("a"), F.when(ahead, F.col("node")).otherwise(F.col(f"{x}.node")).alias("b"),
        (small + large).alias("sizes"), overlap.alias("overlap"), F.col("node").alias("own"))


def _left_over(rows: DataFrame) -> DataFrame:
    """(a, b, sizes): pairs of different components under a shared key, from ``apart``'s rows; none that can be similar is left out.

    One end of each is outside the key's ``main`` component.  Under a key that is not crowded all are made.  What is found under crowded keys only shares
    nothing but crowded keys in both prefixes, so there the members of other keys do not count, and a set that has too few for the smallest set it may be
    similar to does not take part."""
    least = F.greatest("smallest", F.ceil(F.col("size") * OVER / OF))
    rows = rows.where(~F.col("crowded") | ((OF + OVER) * (F.col("firm") + F.col("size") - F.col("at")) >= OVER * (F.col("size") + least)))
    mine = F.struct("node", "size", "at", "open", "firm")
    outside = rows.where("root <> main").select("key", mine.alias("x"), F.col("root").alias("x_root"))
    ahead = F.struct("x.size", "x.node") < F.struct("size", "node")
    met = rows.join(outside, "key").where((F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("main")) | ahead))
    # Of the smaller set the first n - ceil(2 s / (1 + s) n) + 1 members will do.
    small, at = F.least("x.size", "size"), F.when(ahead, F.col("x.at")).otherwise(F.col("at"))
    crowded = _possible(met.where(F.col("crowded") & (at < small - F.ceil(small * (2 * OVER) / (OF + OVER)) + 1)), "x", "firm")
    return crowded.unionByName(_possible(met.where(~F.col("crowded")), "x")).select("a", "b", "sizes").distinct()


def _overlapping(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs that their bins allow."""
    bins = lambda node, name: distinct.select(F.col("node").alias(node), F.col("bins").alias(name))
    met = pairs.join(bins("a", "x"), "a").join(bins("b", "y"), "b").select("a", "b", "sizes", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_may_overlap(x, y, n) for n, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return map_rows(met, check, "a bigint, b bigint")


def _ids(wanted: DataFrame) -> np.ndarray:
    """Bits of a filter of the ids."""
    doubled = lambda batch: np.repeat(batch.column(0).to_numpy().view(np.uint64), 2)
    return repeat_filter(wanted.select(F.xxhash64("id").alias("h")), ID_BITS, doubled)


def _texts_of(rows: DataFrame, wanted: DataFrame, known: Broadcast) -> DataFrame:
    """(node, text) of the wanted (node, id); the filter ``known`` of their ids keeps the texts of most others from being shuffled."""
    id_type = rows.schema["id"].dataType.simpleString()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(ID_BITS, known.value)
        for batch in batches:
            yield batch.select([1, 2]).filter(pa.array(bits.has(batch.column(0).to_numpy().view(np.uint64))))

    sifted = map_rows(rows.select(F.xxhash64("id").alias("h"), "id", "_text"), sift, f"id {id_type}, _text string")
    return sifted.join(wanted, "id").dropDuplicates(["node"]).select("node", "_text")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar.  Texts of b go to a's place, in parts where a has many pairs."""
    salted = pairs.withColumn("salt", F.pmod("b", F.lit(SALTS)).cast("int"))
    of_b = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "_text")
    of_a = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "_text")
    met = of_b.unionByName(of_a).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for b, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = shingles(text)
                if b is None:
                    own = found
                ok.append(b is not None and similar(own, found))
            yield batch.select([0, 2]).filter(pa.array(ok, pa.bool_()))

    return map_rows(met, check, "a bigint, b bigint")


def near_copies(docs: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, component_id) of every row: the smallest id reachable over pairs of similarity ``OVER / OF`` or more.

    Ids are not null.  Null texts and texts without a word are copies of each other; repeated rows keep a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("_text"))
    # Broadcasts are destroyed once what needs them is written, so that executors do not hold those of earlier steps.
    frequent = spark.sparkContext.broadcast(_frequent(rows))
    whole = stage(_prefixes(rows, frequent), "prefixes")
    frequent.destroy()
    distinct = stage(whole.groupBy("node").agg(F.min("id").alias("first"), F.max(F.struct("size", "print", "bins", "keys")).alias("v")).select("node", "first", "v.*"), "sets")
    held = stage(whole.select("id", "node"), "nodes")
    discard(spark, whole)
    # Sets of one size are told apart by their hash, so of every pair one is the smaller.
    by_size = Window.partitionBy("key").orderBy("size", "node")
    keyed = distinct.select("node", "size", "keys")
    twice = spark.sparkContext.broadcast(repeat_filter(keyed, KEY_BITS, _keys_of))
    shared = stage(_filed(keyed, twice).select("key", "at", "node", "size", F.lag("node").over(by_size).alias("before"), F.lead("node").over(by_size).alias("after"))
                   .where(F.col("before").isNotNull() | F.col("after").isNotNull()).drop("before", "after"), "shared")
    twice.destroy()

    def verify(candidates: DataFrame) -> DataFrame:
        likely = stage(_overlapping(candidates, distinct), "pairs")
        if likely.isEmpty():
            return likely
        wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", F.col("first").alias("id")), "node")
        wanted = stage(wanted, "wanted")
        known = spark.sparkContext.broadcast(_ids(wanted))
        texts = stage(_texts_of(rows, wanted, known), "texts")
        known.destroy()
        links = stage(_verified(likely, texts), "links")
        discard(spark, likely, wanted, texts)
        return links

    def apart(nodes: DataFrame) -> DataFrame:
        """Rows of the keys whose documents are in several components.  ``main``: the component of the set with the fewest members before the key;
        ``open``: the set's rows here with an earlier key, ``firm``: those of crowded keys."""
        rooted = shared.join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.min("size").alias("smallest"),
                                           F.min(F.struct("at", "size", "node", "root")).alias("hub"))
        split = split.where("low <> high").select("key", "smallest", F.col("hub.root").alias("main"), (F.col("n") > CROWDED).alias("crowded"))
        earlier = Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rooted.join(split, "key").withColumn("open", F.count("*").over(earlier) - 1).withColumn(
            "firm", F.count_if("crowded").over(earlier) - F.col("crowded").cast("int"))

    def first_tries(open_: DataFrame) -> DataFrame:
        """(a, b, sizes): under every key each set with the one that has the fewest members before it and with its neighbour, the ``TRIES`` of a set that may share most.
        What is left out here is only put off: in the end all pairs of different components are compared."""
        whole = F.struct("node", "size", "at", "open", "root")
        met = open_.select("*", F.first(whole).over(Window.partitionBy("key").orderBy("at", "size", "node")).alias("hub"), F.lag(whole).over(by_size).alias("before"))
        found = reduce(DataFrame.unionByName, (_possible(met.where(F.col(f"{x}.root") != F.col("root")), x) for x in ("hub", "before")))
        best = found.groupBy("a", "b").agg(F.max("sizes").alias("sizes"), F.max("overlap").alias("overlap"), F.min("own").alias("own"))
        order = Window.partitionBy("own").orderBy(F.desc(F.col("overlap") / F.col("sizes")), "a", "b")
        return best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TRIES).select("a", "b", "sizes")

    # Unions of written tables are not written again: every query takes the driver memory and time.
    tried = stage(_by_prints(distinct), "tries")
    written = [tried]
    links = verify(tried)
    nodes = stage(components(links), "components")
    for _ in range(ROUNDS):
        rest_rows = stage(apart(nodes), "apart")
        tries = stage(first_tries(rest_rows).join(tried, ["a", "b"], "left_anti"), "tries")
        written.append(tries)
        tried = tried.unionByName(tries)
        if tries.isEmpty() or (new := verify(tries)).isEmpty():
            break
        discard(spark, rest_rows)
        links = links.unionByName(new)
        nodes = stage(components(links), "components")
    else:
        rest_rows = stage(apart(nodes), "apart")
    rest = stage(_left_over(rest_rows).join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(spark, shared, rest_rows)
    if not rest.isEmpty():
        nodes = stage(components(links.unionByName(verify(rest))), "components")
    discard(spark, *written, rest)
    member = nodes.join(distinct.select("node", "first"), "node")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = nodes.join(least, "root").select("node", "component_id")
    alone = distinct.join(nodes, "node", "left_anti").select("node", F.col("first").alias("component_id"))
    return held.join(moved.unionByName(alone), "node").select(F.col("id").alias(id_column), "component_id")
