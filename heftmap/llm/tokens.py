"""Token counts by a two-tier lookup of pre-token lengths.

A SentencePiece BPE model whose pieces hold the word mark only in front never merges across the
start of a word, so a text's length is the sum of the lengths of its pre-tokens (what stands
between single spaces).  The first tier is a broadcast table of the lengths of the most frequent
pre-tokens, at most ``FREQUENT`` entries; what it misses is encoded once per Python worker and
kept in a bounded cache.  Pre-tokens are never shuffled: a task sends one summary row of its most
frequent ones, and summaries are merged in a tree of rows of bounded size.  The table only saves time.
Texts in which a run of spaces or a literal word mark makes this split unsafe are encoded whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heftmap.llm.common import map_rows

MARK = "▁"
FREQUENT = 32_768
SUMMARY = 16_384
TRACKED = 300_000
CACHED = 500_000
LONGEST = 64
_models: dict[str, sentencepiece.SentencePieceProcessor] = {}
_caches: dict[str, "Lengths"] = {}


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


class Lengths(dict):
    """Pre-token -> number of tokens; None where the text around it must be encoded whole."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> int | None:
        if not part or part[0] == MARK or part[-1] == MARK:
            return None
        if len(self) >= CACHED:
            self.clear()
        n = self[part] = len(self.model.encode(part))
        return n


def text_tokens(text: str, frequent: dict[str, int], misses: Lengths) -> int:
    if not text:
        return 0
    total = 0
    for part in text.split(" "):
        n = frequent.get(part)
        if n is None:
            n = misses[part]
            if n is None:
                return len(misses.model.encode(text))
        total += n
    return total


def splits_safely(model: sentencepiece.SentencePieceProcessor) -> bool:
    """No piece holds the word mark after another character, and white space is kept as it is."""
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    return not any(MARK in p.lstrip(MARK) for p in pieces) and len(model.encode("a  b")) > len(model.encode("a b"))


def frequent_pretokens(texts: DataFrame, keep: int = FREQUENT) -> list[str]:
    """About the most frequent pre-tokens of a one-column table of texts, most frequent first."""

    def summary(counts: Counter) -> pa.RecordBatch:
        top = counts.most_common(SUMMARY)
        return pa.RecordBatch.from_arrays([pa.array([[p for p, _ in top]], pa.list_(pa.string())),
                                           pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["parts", "ns"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.split(" "))
                if len(counts) > TRACKED:
                    counts = Counter(dict(counts.most_common(TRACKED // 3)))
        yield summary(Counter({p: n for p, n in counts.items() if 0 < len(p) <= LONGEST and n > 1}))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for parts, ns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part, n in zip(parts, ns):
                    counts[part] += n
                if len(counts) > TRACKED:
                    counts = Counter(dict(counts.most_common(TRACKED // 3)))
        yield summary(counts)

    schema = "parts array<string>, ns array<bigint>"
    summaries = map_rows(texts.where(F.col(texts.columns[0]).isNotNull()), count, schema)
    tasks = max(1, math.isqrt(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    merged = map_rows(summaries.repartition(tasks), merge, schema).collect()  # isqrt(tasks) rows of bounded size
    counts: Counter = Counter()
    for row in merged:
        counts.update(dict(zip(row["parts"], row["ns"])))
    return [p for p, _ in counts.most_common(keep)]


def count_tokens(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, as the SentencePiece library counts without added tokens.

    ``model_path`` must be readable on every host.  Null texts count as empty: 0 bytes, 0 tokens.
    Repeated rows and null ids give a row each; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    model = load(model_path)
    if not splits_safely(model):
        raise ValueError("the model merges across word starts; its texts cannot be counted by pre-token")
    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias("_text"))
    parts = [p for p in frequent_pretokens(rows.select("_text")) if p[0] != MARK and p[-1] != MARK]
    lengths = dict(zip(parts, map(len, model.encode(parts)))) if parts else {}
    table = spark.sparkContext.broadcast(lengths)
    id_type = rows.schema[0].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = table.value
        misses = _caches.setdefault(model_path, Lengths(load(model_path)))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            tokens = [text_tokens(t, frequent, misses) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    return map_rows(rows, count, f"`{id_column}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
