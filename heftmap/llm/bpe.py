"""Byte-level BPE encoding and decoding in batched merge rounds.

The pieces that the vocabulary's split pattern cuts texts into are found from the kinds of their characters, for all texts of a batch at
once, and numbered by Arrow.  The distinct ones lie byte by byte in one flat array of symbols.  A round looks up the rank of
every pair that is new by binary search over the sorted pair keys, takes the lowest rank of every word, merges all its occurrences
from left to right, and closes the gaps; words without a pair left leave the array.  So the number of numpy calls is that of the
rounds of the longest word, not that of words or merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heftmap.llm.common import map_rows

NONE = np.iinfo(np.int32).max
#: Texts are taken together until they have this many characters; it only bounds memory.
TOGETHER = 1 << 22
WHITE, END, UNKNOWN = 3, 4, 5
#: A character that no text should hold; texts that do are encoded by the library.
STOP = 0x10FFFF
STOP_TEXT = chr(STOP)
# The contractions of the split pattern, 's 't 'm 'd and 're 've 'll.
SHORT = np.array([ord(c) for c in "stmd"])
LONG = np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
_vocabularies: dict[str, "Vocabulary"] = {}


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where it is printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        model, before = described["model"], described["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or described["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("only byte-level BPE without normalization, prefix space and word marks")
        ids = model["vocab"]
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        self.ranks = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.ranks]
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        letters = byte_letters()
        self.of_byte = np.array([ids[c] for c in letters], np.int32)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens must stand for their own text")
        self.added = {t.content: np.array([i], np.int32).tobytes() for i, t in added.items()}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) if byte_of.keys() >= set(t) else t.encode() for t, i in self.tokenizer.get_vocab(True).items()}
        self.kind_of = np.full(STOP + 1, UNKNOWN, np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], np.int32(NONE))

    def merge(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, none of them empty, in a row, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
        sizes = np.diff(offsets).astype(np.int64)
        symbols = self.of_byte[np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
        numbers = np.arange(len(words))
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        ranks = np.full(len(symbols), NONE, np.int32)
        inner = np.flatnonzero(~last)
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        out_numbers, out_symbols = [], []
        while len(numbers):
            lowest = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            done = lowest == NONE
            if done.any():
                of_done = np.repeat(done, sizes)
                out_numbers.append(np.repeat(numbers[done], sizes[done]))
                out_symbols.append(symbols[of_done])
                symbols, ranks, last = symbols[~of_done], ranks[~of_done], last[~of_done]
                numbers, sizes, lowest = numbers[~done], sizes[~done], lowest[~done]
                if not len(numbers):
                    break
            hit = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # Of occurrences that overlap, in a run of one symbol, every other is merged.
            fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            if not fresh.all():
                run = hit[fresh][np.cumsum(fresh) - 1]
                hit = hit[(hit - run) % 2 == 0]
            symbols[hit] = self.merged[ranks[hit]]
            last[hit] = last[hit + 1]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            sizes = sizes - np.add.reduceat(gone, np.cumsum(sizes) - sizes, dtype=np.int64)
            symbols, ranks, last = symbols[~gone], ranks[~gone], last[~gone]
            hit = hit - np.arange(len(hit))
            ranks[hit] = NONE
            before = hit[hit > 0] - 1
            changed = np.concatenate([hit, before])
            changed = changed[~last[changed]]
            ranks[changed] = self.rank(symbols[changed], symbols[changed + 1])
        order = np.argsort(np.concatenate(out_numbers), kind="stable")
        return np.concatenate(out_symbols)[order], np.bincount(np.concatenate(out_numbers), minlength=len(words))

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The kind of every code point as the tokenizer itself cuts it: with which of three others it stays in one piece."""
        for c in np.unique(points[self.kind_of[points] == UNKNOWN]).tolist():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.kind_of[c] = next((k for k, other in enumerate("a1!") if len(cut(other + chr(c))) == 1), WHITE)
        return self.kind_of[points]

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Where the pieces of a text of these code points begin; every ``STOP`` is a piece and ends the text before it.

        A piece is a run of one kind with the single space before it, a contraction, or white space: all of a run but its last
        character, and that one by itself unless it is a space before something else.
        """
        kind = self.kinds(points)
        kind[points == STOP] = END
        start = np.ones(len(points), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
        after = np.flatnonzero((kind[1:] < WHITE) & (kind[:-1] == WHITE)) + 1
        start[after - 1] = True
        start[after] = points[after - 1] != 0x20
        mark = np.flatnonzero(points == 0x27)
        mark = mark[start[mark]]
        padded = np.concatenate([points[:], [STOP, STOP]])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, SHORT)
        long = np.isin(one << 32 | two, LONG)
        start[mark[short | long] + 1] = False
        ends = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[ends[ends < len(points)]] = True
        return start

    def pieces(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """The pieces of all texts, none of which has an added token, in order; behind every text comes a piece for its end, marked in the mask."""
        joined = chr(STOP).join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        begin = np.flatnonzero(self.starts(points))
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.concatenate([(np.cumsum(widths) - widths)[begin], [widths.sum()]]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.encode())])
        return pieces, points[begin] == STOP

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each end."""
        added = self.cut_added
        whole = [STOP_TEXT not in t and not (added and added.search(t)) for t in texts]
        if not all(whole):
            done = [self._one_by_one(t) if not w else self.encode([t])[0] for t, w in zip(texts, whole)]
            return np.concatenate(done), np.cumsum([len(x) for x in done])
        pieces, stops = self.pieces(texts)
        coded = pieces.dictionary_encode()
        flat, sizes = self.merge(coded.dictionary)
        begins = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        size = np.where(stops, 0, sizes[word])
        ends = np.cumsum(size)
        ids = flat[np.repeat(begins[word] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, ends[stops]

    def _one_by_one(self, text: str) -> np.ndarray:
        """A text with added tokens, or with the character that marks ends: its parts between those."""
        parts = regex.split("(" + "|".join(regex.escape(t) for t in [*sorted(self.added, key=len, reverse=True), STOP_TEXT]) + ")", text)
        out = [np.zeros(0, np.int32)]
        for k, part in enumerate(parts):
            if k % 2 == 0:
                out.append(self.encode([part])[0])
            elif part in self.added:
                out.append(np.frombuffer(self.added[part], "<i4"))
            else:
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.concatenate(out)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def in_groups(texts: list[str], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row, as the tokenizers library encodes its whole text without added special tokens.

    ``tokenizer_path`` must be readable on every host.  Null texts count as empty: no ids.  Repeated rows and null ids give a row each,
    an empty table none; other columns are not read.  The strings of special tokens inside a text become their ids, as in the library.
    """
    vocabulary(tokenizer_path)  # refuses other kinds of vocabulary at once
    rows = docs.select(F.col(id_column), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_groups(texts):
                ids, ends = known.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_column, "ids"])

    return map_rows(rows, run, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, ids, text) of every row: the text of its ids, special tokens included; bytes that are no UTF-8 become U+FFFD.

    Ids outside the vocabulary give nothing, null arrays and arrays without an id the empty text; nulls among the ids are left out.
    """
    rows = encoded.select(F.col(id_column), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in batches:
            texts = [known.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_column, "ids", "text"])

    kinds = [f.dataType.simpleString() for f in rows.schema]
    return map_rows(rows, run, f"`{id_column}` {kinds[0]}, ids {kinds[1]}, text string")
