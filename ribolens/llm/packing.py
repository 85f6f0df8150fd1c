"""Harmonic packing of tokenised documents into fixed-length sequences.

A document gives whole pieces of the capacity C, and its rest is cut into pieces as long as a class capacity C // k for
the ``k`` of ``CLASSES`` (reciprocal-capacity classes), largest first; what is shorter than the last class's capacity
joins that last class. A bin of class k always holds k pieces, so each worker fills its classes' bins by counting alone,
without looking at the others. What is left in unfilled bins at a worker's end is packed next-fit, cut where a bin ends.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, slices, texts

CAPACITY = 1024
CLASSES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
#: White space of the tokenizer's pattern: Unicode White_Space.
_WS = "\t-\r \x85\xa0  -     　"
#: A part of a text that the tokenizer treats alone: a token never crosses from a letter to ASCII punctuation or to
#: white space, nor from anything else to white space.
PART = re.compile(rf"[{_WS}]*(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{_WS}!-/:-@\[-`{{-~]|\Z)|[^{_WS}]+|\Z)")
#: Words whose ids a task remembers; characters given to the tokenizer at once.
KNOWN, LONG = 100_000, 1 << 16
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: The tokenizer's own words, for a text of Latin-1 characters alone.
LATIN = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_WS}{_L}{_N}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else 256 and on."""
    out, n = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], n = chr(n), n + 1
    return out


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Words(dict):
    """Little-endian 32-bit ids, as bytes, of words that the tokenizer's pattern gives; kept for up to KNOWN words."""

    LETTERS = byte_letters()

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            letters = word.replace(" ", self.LETTERS[32])
        else:
            letters = word.encode().decode("latin-1").translate(self.LETTERS)
        found = _little([t.id for t in self.tokenize(letters)])
        if len(word) <= 256:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


class Parts:
    """The ids of whole texts. Words of a Latin-1 text are looked up; other texts go to the tokenizer part by part."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = {} if special_as_text else {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = Words(self.tokenizer.model)

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return b"".join(_little([self.special[t]]) if t in self.special else self._ids(t) for t in self.split.split(text))
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        if not text:
            return b""
        if latin(text):
            found = LATIN.findall(text) if len(text) < LONG else (m[0] for m in LATIN.finditer(text))
            return b"".join(map(self.words.__getitem__, found))
        out, some, size = [], [], 0
        for m in PART.finditer(text):
            some.append(m[0])
            size += len(m[0])
            if size >= LONG:
                out.append(self._plain("".join(some)))
                some, size = [], 0
        return b"".join([*out, self._plain("".join(some))])

    def _plain(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def tokenizer(path: str, special_as_text: bool = False) -> Parts:
    return Parts(path, special_as_text)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(class, length) of the pieces of ``n`` tokens, in order."""
    out = [(1, capacity)] * (n // capacity)
    rest = n % capacity
    for k in CLASSES:
        each = capacity // k
        while each and rest >= each:
            out.append((k, each))
            rest -= each
    if rest:
        out.append((CLASSES[-1], rest))
    return out


def _little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Bins:
    """One worker's bins: ``add`` gives the pieces of bins that became full, ``close`` those of the others."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {k: [] for k in CLASSES}

    def _seal(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, self.next, at
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        for k, n in cut(total, self.capacity):
            bin_ = self.open[k]
            bin_.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            start += n
            if len(bin_) == k:
                self.open[k] = []
                yield from self._seal(bin_)

    def close(self) -> Iterator[tuple]:
        bin_, room = [], self.capacity
        for k in CLASSES:
            for doc, start, ids, total in self.open[k]:
                while ids:
                    take = ids[: 4 * room]
                    bin_.append((doc, start, take, total))
                    start, ids, room = start + len(take) // 4, ids[4 * room :], room - len(take) // 4
                    if not room:
                        yield from self._seal(bin_)
                        bin_, room = [], self.capacity
        if bin_:
            yield from self._seal(bin_)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit, as bytes), ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file ``vocabulary`` with none added, then ``end_id``; a special token's string
    in a text gives its id, or with ``special_as_text`` the ids of ordinary text. A null or empty text is ``end_id`` alone;
    texts of any length are read whole; columns but doc_id and text are ignored. Each id lies in exactly one piece; a sequence's pieces lie at offsets without gaps
    and fill ``capacity`` at most. sequence_id holds the worker's partition, so workers number alone. Rows that repeat a
    doc_id, or have a null one, are packed as documents of their own. No rows give no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = tokenizer(vocabulary, special_as_text)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        end = end_id.to_bytes(4, "little")

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in PIECE.split(", ")]
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.record_batch([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names)], names)

        for batch in slices(batches, 256):
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"])):
                rows.extend(bins.add(doc, parts.ids(text) + end))
            yield batch_of(rows)
        yield batch_of(list(bins.close()))
        parts.words.clear()  # an idle worker holds no words

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freeing(work), PIECE)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """One row per sequence of pack()'s pieces: sequence_id, length, ids (array, filled with ``pad_id`` to ``capacity``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = pad_id.to_bytes(4, "little")
        for batch in slices(batches):
            ids = [b"".join(x["ids"] for x in row) for row in batch["pieces"].to_pylist()]
            filled = [np.frombuffer(x + pad * (capacity - len(x) // 4), "<i4") for x in ids]
            yield pa.record_batch({
                "sequence_id": batch["sequence_id"],
                "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": pa.array(filled, pa.list_(pa.int32())),
            })

    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return rows.mapInArrow(freeing(work), "sequence_id long, length long, ids array<int>")
