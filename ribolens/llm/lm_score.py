"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

The relation of n-grams is exploded for chunks of documents: a chunk names each different n-gram of its documents once,
with its count. These rows are dealt by ranges of a 64-bit hash; each range sums them into its part of the count table
and joins the sums to the rows that asked, and each chunk gets its counts back. With them it looks up every word of its
documents and sums the scores for each. Rows travel packed, a range of a chunk at a time, so that neither a frequent
n-gram nor a long document weighs more than one entry for each chunk.

Words and pairs are counted in one pass, each longer order in one of its own: an n-gram can only reach ``min_count`` where
both (n-1)-grams in it do, so that a chunk names no others, and loses none. The chunks lie in buckets of one table, to which
the counts come.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallel, raw, shared_dir, slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Words of a chunk, and entries of a hash range, at which another one begins.
CHUNK, RANGE = 1 << 20, 1 << 21


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, so that those of small numbers compress."""
    return zstandard.compress(np.ascontiguousarray(x.view("u1").reshape(len(x), x.dtype.itemsize).T).tobytes(), 1)


def unplanes(b: bytes, dtype: str) -> np.ndarray:
    n = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), "u1").reshape(n, -1).T).view(dtype).reshape(-1)


def places(h: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different values there are, and each one's place among them, in order; by one sort, not by searches."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    out = np.empty(len(h), "i8")
    out[order] = np.cumsum(new) - 1
    return int(new.sum()), out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(words: np.ndarray, lengths: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of the last word, hash) of the n-grams within documents, for n from 1 to ``order``."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, h = [(np.arange(len(words)), words)], words
    for n in range(2, order + 1):
        h = mix(h[:-1] if len(h) else h, words[n - 1 :])  # of all neighbours, also across documents
        at = np.flatnonzero(place[n - 1 :] >= n - 1)
        out.append((at + n - 1, h[at] ^ np.uint64(n)))
    return out


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents as local word numbers, and the words' hashes, about CHUNK words in a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        words: list[np.ndarray] = []
        local: dict[bytes, int] = {}
        held = 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate(words) if words else np.zeros(0, "u4")
            vocabulary = np.fromiter(map(xxhash.xxh3_64_intdigest, local), "u8", len(local))
            return pa.record_batch({
                "chunk": pa.array([(part << 32) + k], pa.int64()),
                "n": pa.array([len(flat)], pa.int64()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "lengths": pa.array([planes(np.array(lengths, "u4"))], pa.binary()),
                "words": pa.array([planes(flat)], pa.binary()),
                "vocabulary": pa.array([vocabulary.tobytes()], pa.binary()),
            })

        for batch in slices(batches):
            for doc, t in zip(batch["doc_id"].to_pylist(), raw(batch["text"])):
                found = WORD.findall(t.lower())
                add = local.setdefault
                words.append(np.fromiter([add(w, len(local)) for w in found], "u4", len(found)))
                ids.append(doc)
                lengths.append(len(found))
                held += len(found)
                if held >= CHUNK:
                    yield out()
                    ids, lengths, words, local, held, k = [], [], [], {}, 0, k + 1
        if ids:
            yield out()

    schema = "chunk long, n long, ids array<long>, lengths binary, words binary, vocabulary binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words' hashes, the number of each word in them, the documents' lengths."""
    return np.frombuffer(row["vocabulary"], "u8"), unplanes(row["words"], "u4"), unplanes(row["lengths"], "u4").astype("i8")


def _range(h: np.ndarray, n: int) -> np.ndarray:
    """The range of each hash, in order: the sorted hashes of a chunk are its ranges one after the other."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _asked(chunk: int, h: np.ndarray, n_ranges: int) -> dict:
    """Rows, a range at a time, that ask for the counts of the n-grams ``h``."""
    h, n = np.unique(h, return_counts=True)
    ends = np.searchsorted(_range(h, n_ranges), np.arange(n_ranges + 1))
    at = [r for r in range(n_ranges) if ends[r] < ends[r + 1]]
    return {
        "range": pa.array(at, pa.int32()),
        "chunk": pa.array([chunk] * len(at), pa.int64()),
        "hashes": pa.array([planes(np.diff(h[ends[r] : ends[r + 1]], prepend=np.uint64(0))) for r in at], pa.binary()),
        "counts": pa.array([planes(n[ends[r] : ends[r + 1]].astype("u8")) for r in at], pa.binary()),
    }


def wanted(found: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], n: int, n_words: int, min_count: int) -> np.ndarray:
    """Of each n-gram, whether both (n-1)-grams in it have ``min_count``; ``counts``: of those."""
    by_end = np.zeros(n_words)
    by_end[found[n - 2][0]] = counts[n - 2]
    at = found[n - 1][0]
    return (by_end[at] >= min_count) & (by_end[at - 1] >= min_count)


def _known(found: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, ids: np.ndarray, replies: pa.Table, low: int, high: int, min_count: int) -> list[np.ndarray]:
    """Counts of the n-grams of a chunk, order by order: of ``low`` and under in one pass, then to ``high`` one by one."""
    parts = sorted(zip(*(replies[c].to_pylist() for c in ("level", "range", "counts"))))
    out: list[np.ndarray] = []
    for level in range(low, high + 1):
        sums = np.concatenate([np.zeros(0, "u8"), *(unplanes(c, "u8") for n, _, c in parts if n == level)])
        if level == low:
            n, place = places(np.concatenate([vocabulary, *(g for _, g in found[1:low])]))
        else:
            ok = wanted(found, out, level, len(ids), min_count)
            n, place = places(found[level - 1][1][ok])
        if len(sums) != n:
            raise ValueError("a chunk's counts are not those it asked for")
        sums = sums[place]
        if level == low:
            out += np.split(sums, np.cumsum([len(vocabulary), *(len(g) for _, g in found[1:low])])[:-1])
            out[0] = out[0][ids]
        else:
            out.append(np.zeros(len(ok), "u8"))
            out[-1][ok] = sums
    return out


def _bucketed(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, dealt by chunk, as a table of as many buckets in the shared folder: reading it by chunk needs no shuffle."""
    spark = rows.sparkSession
    n, name = parallel(spark), f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    rows.repartition(n, "chunk").write.format("parquet").bucketBy(n, "chunk").option("path", path).saveAsTable(name)
    return spark.table(name)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their range: the counts of the whole corpus for each row that asked."""

    def out(now: int, rows: list[tuple]) -> pa.RecordBatch:
        hashes = [np.cumsum(unplanes(h, "u8"), dtype="u8") for _, h, _ in rows]
        n, where = places(np.concatenate(hashes))
        del hashes
        counts = [unplanes(c, "u8") for _, _, c in rows]
        sizes = [len(c) for c in counts]
        sums = np.bincount(where, np.concatenate(counts), n).astype("u8")
        back = np.split(sums[where], np.cumsum(sizes)[:-1])
        return pa.record_batch({
            "chunk": pa.array([c for c, _, _ in rows], pa.int64()),
            "range": pa.array([now] * len(rows), pa.int32()),
            "counts": pa.array(list(map(planes, back)), pa.binary()),
        })

    now, held = None, []
    for batch in batches:
        for r, c, h, n in zip(*(batch[x].to_pylist() for x in ("range", "chunk", "hashes", "counts"))):
            if r != now and held:
                yield out(now, held)
                held = []
            now = r
            held.append((c, h, n))
    if held:
        yield out(now, held)


def backoff(found: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], total: int, n_words: int, rate: float, min_count: int) -> np.ndarray:
    """Log score of each word: its longest n-gram seen ``min_count`` times over its context's count, backed off to it."""
    out = np.log(counts[0] / total) if n_words else np.zeros(0)
    by_end = np.zeros(n_words)
    by_end[found[0][0]] = counts[0]
    for (at, _), n in zip(found[1:], counts[1:]):
        context = by_end[at - 1]  # the shorter n-gram that ends one word before
        known = n >= min_count
        out[at] = np.where(known, np.log(np.maximum(n, 1) / np.maximum(context, 1)), out[at] + np.log(rate))
        by_end = np.zeros(n_words)
        by_end[at] = n
    return out


def score(docs: DataFrame, order: int = ORDER, rate: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log_score (sum of natural logs over words), score (its mean).

    Words are runs of digits, letters a-z and code points from U+0080 after lower-casing A-Z. The model is of ``docs``
    itself: S(w | context) = count(context w) / count(context) where count(context w) >= min_count, else rate * S(w |
    shorter context), down to count(w) / words. A document's first words have shorter contexts. A text that is null,
    empty or without words has n_words 0 and null scores. Rows that repeat a doc_id, or have a null one, each count and are
    each scored. A text of any length is read whole, in one chunk. Columns but doc_id and text are ignored; no rows give no
    rows.
    """
    chunks = _bucketed(_chunks(docs), "chunks")
    total, n_chunks = chunks.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, low = total or 0, min(order, 2)
    n_ranges = max(1, min(parallel(docs.sparkSession), n_chunks), -(-total * order // RANGE))
    asks = "range int, chunk long, hashes binary, counts binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                vocabulary, ids, lengths = _unpack(row)
                yield pa.record_batch(_asked(row["chunk"], np.concatenate([g for _, g in grams(vocabulary[ids], lengths, low)]), n_ranges))

    def longer(n: int):
        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            vocabulary, ids, lengths = _unpack(row)
            found = grams(vocabulary[ids], lengths, n)
            counts = _known(found, vocabulary, ids, right, low, n - 1, min_count)
            return pa.table(_asked(row["chunk"], found[n - 1][1][wanted(found, counts, n, len(ids), min_count)], n_ranges))

        return ask

    def replies(asked: DataFrame, level: int) -> DataFrame:
        dealt = asked.repartition(max(n_ranges, parallel(docs.sparkSession)), "range").sortWithinPartitions("range")
        return dealt.mapInArrow(_answer, "chunk long, range int, counts binary").withColumn("level", F.lit(level))

    held = replies(chunks.select("chunk", "lengths", "words", "vocabulary").mapInArrow(first, asks), low)
    for n in range(low + 1, order + 1):
        held = _bucketed(held, "counts")
        held = held.unionByName(replies(chunks.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(longer(n), asks), n))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        vocabulary, ids, lengths = _unpack(row)
        found = grams(vocabulary[ids], lengths, order)
        counts = [n.astype("f8") for n in _known(found, vocabulary, ids, right, low, order, min_count)]
        value = backoff(found, counts, total, len(ids), rate, min_count)
        ends = np.cumsum(lengths)
        sums = np.array([value[e - n : e].sum() for e, n in zip(ends, lengths)])
        some = lengths > 0
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()),
            "n_words": pa.array(lengths),
            "log_score": pa.array(sums, mask=~some),
            "score": pa.array(sums / np.maximum(lengths, 1), mask=~some),
        })

    return chunks.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(work, "doc_id long, n_words long, log_score double, score double")
