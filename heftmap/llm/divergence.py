"""Which words set a source apart from its language and from the other sources of that language.

Terms are runs of ASCII letters and characters beyond ASCII, lower-cased in ASCII.  A slice of a task's texts lies in one byte
buffer; pointers to the starts of its terms are sorted by multikey quicksort, eight bytes being a symbol: by the first
symbol, then only runs of equal symbols whose terms go on by the next one, and so on.  A run of equal terms then yields one row
for every language and source it occurs in, with its occurrences and its documents; only such rows are shuffled.

Shares are billionths with one added to every count, in whole numbers throughout.  A source that lacks a term has the same share for
all terms it lacks, so the sum over all terms of a pair of sources is taken from what they both have, from each one's counts of
counts, and from the number of terms; no row is made for a term that a source lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heftmap.llm.bpe import in_groups
from heftmap.llm.common import map_rows
from heftmap.operators.staging import discard, stage

LEAST_DOCS = 3
UNIT = 1_000_000_000
TOP = 200
#: Sources of a language are taken in blocks of so many; a task keeps the sums of at most ``HELD`` pairs of blocks.
BLOCK, HELD = 64, 500

_TERM = np.zeros(256, bool)
_TERM[ord("A"):ord("Z") + 1] = _TERM[ord("a"):ord("z") + 1] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def term_pointers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every term of a byte buffer that ends with a byte of no term."""
    inside = _TERM[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    return edge[::2], edge[1::2] - edge[::2]


def sort_pointers(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers in the order of their terms, and where in that order a run of equal terms begins."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])

    def symbol(which: np.ndarray, depth: int) -> np.ndarray:
        held = padded[(start[which] + 8 * depth)[:, None] + np.arange(8)].view(">u8")[:, 0].astype(np.uint64)
        left = np.minimum(length[which] - 8 * depth, 8)
        spare = (8 * (8 - np.maximum(left, 1))).astype(np.uint64)
        return np.where(left > 0, held >> spare << spare, np.uint64(0))

    first = symbol(np.arange(len(start)), 0)
    order = np.argsort(first)
    first = first[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = first[1:] != first[:-1]
    depth = 1
    # No term holds a zero byte: one that ends with a symbol has 0 as its next, and terms of equal symbols go on or not together.
    open_ = np.flatnonzero(length[order] >= 8)
    while len(open_):
        run = np.cumsum(fresh)[open_]
        many = np.bincount(run)[run] > 1
        open_, run = open_[many], run[many]
        next_ = symbol(order[open_], depth)
        by = np.lexsort((next_, run))
        order[open_] = order[open_[by]]
        next_ = next_[by]
        fresh[open_[1:]] |= next_[1:] != next_[:-1]
        depth += 1
        open_ = open_[length[order[open_]] >= 8 * depth]
    return order, fresh


def slice_counts(texts: list[bytes], groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term number, group, occurrences, documents): the last four a row for every term and group (of texts) it occurs in."""
    by_group = np.argsort(groups, kind="stable")
    data = _LOWER[np.frombuffer(b"\n".join([*(texts[i] for i in by_group), b""]), np.uint8)]
    start, length = term_pointers(data)
    order, fresh = sort_pointers(data, start, length)
    lead = order[fresh]
    number = np.empty(len(start), np.int64)
    number[order] = np.cumsum(fresh) - 1
    text_ends = np.cumsum([len(texts[i]) + 1 for i in by_group])
    found = np.sort(number * max(len(texts), 1) + np.searchsorted(text_ends, start, "right"))
    changed = np.ones(len(found), bool)
    changed[1:] = found[1:] != found[:-1]
    at = np.flatnonzero(changed)
    term, text = np.divmod(found[at], max(len(texts), 1))
    group = np.asarray(groups, np.int64)[by_group][text]
    times = np.diff(np.append(at, len(found)))
    cell = np.ones(len(at), bool)
    cell[1:] = (term[1:] != term[:-1]) | (group[1:] != group[:-1])
    cell = np.flatnonzero(cell)
    sizes = length[lead]
    ends = np.cumsum(sizes)
    letters = data[np.repeat(start[lead] - (ends - sizes), sizes) + np.arange(sizes.sum())]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(lead), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    occurrences = np.add.reduceat(times, cell) if len(cell) else times
    return terms, term[cell], group[cell], occurrences, np.diff(np.append(cell, len(at)))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every language and source, and the rows it occurs in; nulls count as ''."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, lang, source)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            for a, b in in_groups(texts):
                names = list(zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in (1, 2))))
                distinct = {name: i for i, name in enumerate(dict.fromkeys(names))}
                terms, term, group, n, in_docs = slice_counts(texts[a:b], np.array([distinct[x] for x in names]))
                langs, sources = (pa.array(x, pa.string()) for x in zip(*distinct))
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(group)), sources.take(pa.array(group)), terms.take(pa.array(term)), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

    partial = map_rows(rows, count, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exact for any long counts; null without terms."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", wide, (total + terms).cast("decimal(20,0)")).cast("bigint") + 1)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so it fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def shared_gaps(cells: DataFrame) -> DataFrame:
    """(lang, a, b, value) partial sums over terms of both sources, from one row (lang, cells array<struct<source, p, zero>>) per term.

    A term that a and b both have stands for gap(p_a, p_b) and takes the place of what the counts of each one alone give for it.
    """

    def flush(held: dict) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], []]
        for (lang, x, y), sums in held.items():
            for direction, (one, two) in zip(sums, ((x, y), (y, x))):
                i, j = np.nonzero(direction)
                keep = (i + one * BLOCK) != (j + two * BLOCK)
                i, j = i[keep], j[keep]
                for column, values in zip(rows, ([lang] * len(i), (i + one * BLOCK).tolist(), (j + two * BLOCK).tolist(), direction[i, j].tolist())):
                    column.extend(values)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(c, pa.int64()) for c in rows[1:])], names=["lang", "a", "b", "value"])

    def over(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def excess(p: np.ndarray, pz: np.ndarray, q: np.ndarray, qz: np.ndarray) -> np.ndarray:
        p, pz, q, qz = p[:, :, None], pz[:, :, None], q[:, None, :], qz[:, None, :]
        return (over(p, q) - over(p, qz) - over(pz, q) + over(pz, qz)).sum(axis=0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                source, p, zero = (flat.field(k).to_numpy() for k in range(3))
                langs = part.column(0).to_pylist()
                for lang in set(langs):
                    mine = np.array([x == lang for x in langs])[row]
                    blocks = np.unique(source[mine] // BLOCK)
                    dense = {}
                    for k in blocks.tolist():
                        of = np.flatnonzero(mine & (source // BLOCK == k))
                        shares, zeros = np.ones((2, len(lists), int(source[of].max()) % BLOCK + 1), np.int64)
                        shares[row[of], source[of] % BLOCK] = p[of]
                        zeros[row[of], source[of] % BLOCK] = zero[of]
                        dense[k] = np.unique(row[of]), shares, zeros
                    for x in dense:
                        for y in dense:
                            if x > y:
                                continue
                            both = np.intersect1d(dense[x][0], dense[y][0], assume_unique=True)
                            (_, p1, z1), (_, p2, z2) = dense[x], dense[y]
                            sums = held.setdefault((lang, x, y), np.zeros((2, BLOCK, BLOCK), np.int64))
                            sums[0, :p1.shape[1], :p2.shape[1]] += excess(p1[both], z1[both], p2[both], z2[both])
                            if x != y:
                                sums[1, :p2.shape[1], :p1.shape[1]] += excess(p2[both], z2[both], p1[both], z1[both])
                    if len(held) > HELD:
                        yield flush(held)
        yield flush(held)

    return map_rows(cells, add, "lang string, a bigint, b bigint, value bigint")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source.

    Part ``pair``: every other source of the language with the gap summed over all kept terms.  Part ``term``: the ``top`` terms that
    the source uses more than its language, by their gap.  A term is kept in a language if at least ``least_docs`` rows hold it; repeated
    rows count each.  Null texts, languages and sources count as ''; an empty table gives none; a source without terms has pairs only,
    of value 0 if its language keeps no term; other columns are not read.
    """
    spark = docs.sparkSession
    counts = term_counts(docs, text, lang, source)
    kept = stage(counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("in_lang"), F.collect_list(F.struct("source", "n")).alias("cells"),
    ).where(F.col("docs") >= least_docs).drop("docs"), "terms")
    cells = kept.select("lang", "term", "in_lang", F.inline("cells"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source")))).distinct()
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    of_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.join(of_lang, "lang", "left").join(of_source, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"])
    zero = share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))
    at = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint")
    groups = stage(groups.withColumns({"zero": zero, "at": at}), "sources")
    scored = stage(cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "at", "zero", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q")), "shares")

    by_source = Window.partitionBy("lang", "source")
    terms = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_source.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    gathered = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "zero")).alias("cells")).select("lang", "cells")
    same = scored.groupBy("lang", "at", "zero", "p").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("lang", F.col("at").alias("at2"), F.col("zero").alias("zero2"))
    met = same.join(other, "lang").where("at <> at2")
    p, z, z2, n = (F.col(c) for c in ("p", "zero", "zero2", "n"))
    alone = met.select("lang", F.inline(F.array(
        F.struct(F.col("at").alias("a"), F.col("at2").alias("b"), (n * (gap(p, z2) - gap(z, z2))).alias("value")),
        F.struct(F.col("at2").alias("a"), F.col("at").alias("b"), (n * (gap(z2, p) - gap(z2, z))).alias("value")))))
    base = groups.join(other, "lang").where("at <> at2").select(
        "lang", F.col("at").alias("a"), F.col("at2").alias("b"), F.coalesce(F.col("terms") * gap(F.col("zero"), z2), F.lit(0)).alias("value"))
    sums = shared_gaps(gathered).unionByName(alone).unionByName(base).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = lambda at, name: groups.select("lang", F.col("at").alias(at), F.col("source").alias(name))
    pairs = sums.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    pairs = pairs.withColumn("rank", F.row_number().over(by_source.orderBy(F.desc("value"), "item")))
    result = stage(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")), "divergence")
    discard(spark, kept, groups, scored)
    return result
