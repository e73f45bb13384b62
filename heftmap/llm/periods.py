"""Periodic runs of words, found on a grammar of every text.

A run is a stretch of consecutive words of smallest period q that no neighbouring word extends, at least ``LEAST`` words and
``TIMES`` periods long.  All texts of a batch go through the same numpy rounds, each with a grammar of its own:

* Re-Pair: a round counts the pairs of neighbouring symbols (occurrences that overlap once), ranks those that occur twice or more by
  frequency, and replaces every occurrence that ranks above the two it overlaps by a new symbol, all pairs at once.  Symbols are
  linked by their places, so a round costs what may still change, not the length of the text.  What is left of a text
  becomes one symbol by a balanced tree over it.
* Every symbol is looked at once, at its first place: which runs inside it cross the border of its two halves?  Such a run holds
  ``GRAM`` words on one side of the border that are found again q words on, which gives the few periods to try; each is extended
  word by word to both sides.  A run lies in the smallest symbol that holds it whole, so none is missed.
* Runs of a symbol are moved to all places where the symbol was put, and those within a longer run of the same or a smaller
  period are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.llm.bpe import in_groups
from heftmap.llm.common import map_rows

LEAST, TIMES = 24, 3
#: A run of at least 24 words and three periods reaches q + 4 words from any border to one side of it.
GRAM = 4
#: How many periods of a symbol are tried one after the other, so that multiples of a period found can be left out; the rest goes together.
IN_TURN = 64
CELLS = 1 << 21


def _groups(*sorted_by: np.ndarray) -> np.ndarray:
    """Numbers of the groups of equal entries, which lie side by side."""
    fresh = np.ones(len(sorted_by[0]), bool)
    fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return np.cumsum(fresh) - 1


class Grammars:
    """Re-Pair of texts that lie in one array of word numbers, with a place of -1 before the first and behind every text."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = words
        text = np.cumsum(words < 0)
        symbol = words.astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        dead = np.zeros(n, bool)
        rank = np.zeros(n, np.int64)
        top = int(words.max(initial=0)) + 1
        rules, places = [], []
        live = np.flatnonzero((symbol[:-1] >= 0) & (symbol[1:] >= 0))
        self.repeated = np.zeros(n, bool)
        first = True
        while len(live):
            left, right = symbol[live], symbol[after[live]]
            # In a run of one symbol every other pair counts.
            same = np.zeros(len(live), bool)
            same[1:] = (live[1:] == after[live[:-1]]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])
            at = np.arange(len(live))
            odd = (at - np.maximum.accumulate(np.where(same, 0, at))) % 2 == 1
            even = live[~odd]
            key = (left * top + right)[~odd]
            order = np.argsort(key, kind="stable")
            group = _groups(key[order], text[even[order]])
            count = np.bincount(group)
            if first:
                self.repeated[even[order]] = count[group] > 1
                self.repeated[live[same]] = self.repeated[live[np.flatnonzero(same) - 1]] = True
                first = False
            if count.max() < 2:
                break
            by_count = np.empty(len(count), np.int64)
            by_count[np.argsort(count, kind="stable")] = np.arange(1, len(count) + 1)
            many = count[group] > 1
            candidate, group = even[order[many]], group[many]
            rank[candidate] = by_count[group]
            wins = (rank[candidate] > rank[before[candidate]]) & (rank[candidate] > rank[after[candidate]])
            rank[candidate] = 0
            taken = np.bincount(group[wins], minlength=len(count))
            wins &= taken[group] > 1
            chosen, group = candidate[wins], group[wins]
            number = _groups(group)
            middle = after[chosen]
            end = after[middle]
            rules.append(np.stack([np.full(len(chosen), len(rules)), number, chosen, middle, end]))
            symbol[chosen] = top + number
            after[chosen] = end
            before[end] = chosen
            dead[middle] = True
            top += int(number[-1]) + 1
            live = np.unique(np.concatenate([candidate, live[odd], chosen, before[chosen]]))
            live = live[~dead[live] & (symbol[live] >= 0) & (symbol[after[live]] >= 0)]
        put = np.concatenate(rules, axis=1) if rules else np.zeros((5, 0), np.int64)
        #: Of every place of a rule's symbol: the rule, its start; and of every rule: start, border and end at its first place.
        rule = _groups(put[0], put[1]) if put.shape[1] else np.zeros(0, np.int64)
        lead = np.searchsorted(rule, np.arange(rule[-1] + 1 if len(rule) else 0))
        self.place_rule, self.place = rule, put[2]
        self.low, self.border, self.high = put[2][lead], put[3][lead], put[4][lead]
        starts = np.flatnonzero(~dead & (symbol >= 0))
        self._balance(starts, after[starts], text[starts])

    def _balance(self, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> None:
        """What is left of every text becomes a symbol by pairs of neighbours, pairs of those, and so on."""
        found = [[self.low, self.border, self.high]]
        while len(starts):
            at = np.arange(len(starts))
            begins = np.searchsorted(text, text)
            right = (at - begins) % 2 == 1
            if not right.any():
                break
            second = np.flatnonzero(right)
            found.append([starts[second - 1], starts[second], ends[second]])
            ends[second - 1] = ends[second]
            starts, ends, text = starts[~right], ends[~right], text[~right]
        self.low, self.border, self.high = (np.concatenate(x) for x in zip(*found))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of runs, among them every maximal one; others lie within one of the same or a smaller period."""
        big = np.flatnonzero(self.high - self.low >= LEAST)
        node, start, end, period = self._crossing(big)
        size = np.ones(len(node), np.int64)
        of_rule = node < (self.place_rule[-1] + 1 if len(self.place_rule) else 0)
        first = np.searchsorted(self.place_rule, node, "left")
        size[of_rule] = (np.searchsorted(self.place_rule, node, "right") - first)[of_rule]
        which = np.repeat(np.arange(len(node)), size)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        moved = np.zeros(len(which), np.int64)
        ruled = of_rule[which]
        moved[ruled] = self.place[(first[which] + nth)[ruled]] - self.low[node[which[ruled]]]
        return start[which] + moved, end[which] + moved, period[which]

    def _crossing(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words, r = self.words, self.repeated
        n = len(words)
        grams = np.flatnonzero(r[:-2] & r[1:-1] & r[2:]) if n > 2 else np.zeros(0, np.int64)
        mixed = np.zeros(len(grams), np.uint64)
        for k in range(GRAM):
            mixed = (mixed ^ words[grams + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed, kind="stable")
        grams = grams[order]
        group = _groups(mixed[order]) if len(grams) else np.zeros(0, np.int64)
        ordered = group * (n + 1) + grams
        group_of = np.full(n + 1, -1, np.int64)
        group_of[grams] = group

        def again(at: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places in [low, high] of the words at ``at``, with their node."""
            known = (at >= 0) & (group_of[at] >= 0) & (low <= high)
            low, high, of, base = low[known], high[known], of[known], group_of[at[known]] * (n + 1)
            first, past = np.searchsorted(ordered, base + low), np.searchsorted(ordered, base + high, "right")
            size = past - first
            return np.repeat(of, size), grams[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]

        found = []
        low, border, high = self.low[nodes], self.border[nodes], self.high[nodes]
        most = (high - low) // TIMES
        # As many nodes at a time as may have CELLS periods to try.
        for part in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(np.cumsum(2 * most) // CELLS)) + 1):
            lo, b, hi, m, of = low[part], border[part], high[part], most[part], nodes[part]
            node, place = again(b, b + 1, np.minimum(b + m, hi - GRAM), of)
            left = b - GRAM
            node2, place2 = again(np.where(left >= lo, left, -1), np.maximum(left - m, lo), left - 1, of)
            found.append(self._tried(np.concatenate([node, node2]), np.concatenate([self.border[node], place2]),
                                     np.concatenate([place - self.border[node], self.border[node2] - GRAM - place2])))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found))

    def _tried(self, node: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of the given periods around the given places."""
        order = np.lexsort((period, node))
        node, at, period = node[order], at[order], period[order]
        out = []
        for turn in range(IN_TURN + 1):
            if not len(node):
                break
            lead = np.ones(len(node), bool)
            if turn < IN_TURN:
                lead[1:] = node[1:] != node[:-1]
            start, end = self._extended(node[lead], at[lead], period[lead])
            out.append((node[lead], start, end, period[lead]))
            if turn == IN_TURN:
                break
            # A multiple of a period, with both its places in the run, has just this run.
            mine = np.cumsum(lead) - 1
            q, s, e = period[lead][mine], start[mine], end[mine]
            rest = ~lead & ~((period % q == 0) & (at >= s) & (at + period + GRAM <= e))
            node, at, period = node[rest], at[rest], period[rest]
        node, start, end, period = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        long = end - start >= np.maximum(LEAST, TIMES * period)
        return node[long], start[long], end[long], period[long]

    def _extended(self, node: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch around ``at`` of words that equal the one a period on, inside the node."""
        ahead = self._equal(at, period, 1, self.high[node] - period - at)
        behind = self._equal(at - 1, period, -1, at - self.low[node])
        return at - behind, at + ahead + period

    def _equal(self, at: np.ndarray, period: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
        """How many words from ``at`` on, at most ``most``, equal those a period further."""
        length = np.zeros(len(at), np.int64)
        open_, width = np.flatnonzero(most > 0), 8
        while len(open_):
            still = []
            for some in np.split(open_, range(max(1, CELLS // width), len(open_), max(1, CELLS // width))):
                ahead = length[some][:, None] + np.arange(width)
                inside = ahead < most[some][:, None]
                place = np.where(inside, at[some][:, None] + step * ahead, 0)
                equal = inside & (self.words[place] == self.words[place + np.where(inside, period[some][:, None], 0)])
                n = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
                length[some] += n
                still.append(some[n == width])
            open_, width = np.concatenate(still), min(4 * width, 1 << 12)
        return length


def maximal(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, period), what lies in no other of the same or a smaller period, by start, then period."""
    kept, near = [], []
    for start, end, period in sorted(set(found), key=lambda r: (r[0], -r[1], r[2])):
        near = [(e, q) for e, q in near if e > start]
        if not any(e >= end and q <= period for e, q in near):
            near.append((end, period))
            kept.append((start, end, period))
    return sorted(kept, key=lambda r: (r[0], r[2]))


def text_runs(texts: list[list[bytes]]) -> dict[int, list[tuple[int, int, int]]]:
    """Number of a text (a list of words) -> its runs as (start, end, period), for those that have any."""
    sizes = np.array([len(t) for t in texts], np.int64)
    numbered = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
    begins = np.cumsum(sizes + 1) - sizes  # the -1 before the first text is at 0
    flat = np.full(int(sizes.sum()) + len(texts) + 1, -1, np.int64)
    flat[np.arange(len(numbered)) + np.repeat(np.arange(1, len(texts) + 1), sizes)] = numbered
    start, end, period = Grammars(flat).runs()
    text = np.searchsorted(begins, start, "right") - 1
    order = np.argsort(text, kind="stable")
    text, base = text[order], begins[text[order]]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for t, s, e, q in zip(text.tolist(), (start[order] - base).tolist(), (end[order] - base).tolist(), period[order].tolist()):
        found.setdefault(t, []).append((s, e, q))
    return {t: maximal(r) for t, r in found.items()}


def find_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) of every row: its runs by start, then period, and the words
    that are left, joined by one space, when every run keeps its first period only.

    Words stand between ASCII white space.  Null texts and texts without a word have no words and no runs; repeated rows and null ids
    give a row each, an empty table none; other columns are not read.
    """
    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias("_text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_groups(texts):
                words = [t.encode().split() for t in texts[a:b]]
                found = text_runs(words)
                for t, runs in found.items():
                    gone = np.zeros(len(words[t]), bool)
                    for s, e, q in runs:
                        gone[s + q:e] = True
                    found[t] = [{"start": s, "length": e - s, "period": q} for s, e, q in runs]
                    words[t] = (words[t], gone)
                sizes = [len(w[0]) if isinstance(w, tuple) else len(w) for w in words]
                left = [b" ".join([x for x, g in zip(w[0], w[1].tolist()) if not g] if isinstance(w, tuple) else w) for w in words]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array([found.get(t, []) for t in range(b - a)], run_type),
                    pa.array(left, pa.binary()).cast(pa.string())], names=[id_column, "n_words", "runs", "collapsed"])

    kind = rows.schema[0].dataType.simpleString()
    return map_rows(rows, find, f"`{id_column}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
