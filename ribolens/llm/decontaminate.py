"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of words. A block is the last ``BLOCK`` words of a position. The shift table says how far the
search may jump from a block: to its last place in any pattern, or past it. At shift 0 the block picks its bucket, and
the words of the document are compared directly with the bucket's patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, materialize, slices, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Bytes of benchmark text that one pass over the documents searches for.
BLOCK_BYTES = 8 << 20
FOUND = "row long, doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWERED))


class WuManber:
    """Patterns of one length ``m``, as tuples of words, each with the ids that hold it."""

    def __init__(self, patterns: dict[tuple[str, ...], set], m: int):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], dict[tuple[str, ...], set]] = defaultdict(dict)
        for p, ids in patterns.items():
            for end in range(self.block, m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.far), m - end)
            self.bucket[p[-self.block :]][p] = ids

    def search(self, doc: list[str]) -> Iterator[tuple[int, set]]:
        """Starts of the places where a pattern occurs, with its ids."""
        end, n, block, far, shift = self.m, len(doc), self.block, self.far, self.shift.get
        while end <= n:
            b = tuple(doc[end - block : end])
            jump = shift(b, far)
            if jump:
                end += jump
                continue
            ids = self.bucket.get(b, {}).get(tuple(doc[end - self.m : end]))  # the bucket's texts, compared whole
            if ids:
                yield end - self.m, ids
            end += 1


def windows(text: str, n: int) -> list[tuple[str, ...]]:
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


@lru_cache(maxsize=2)
def searchers(items: tuple[tuple[object, str], ...], n: int) -> list[WuManber]:
    by: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for w in windows(text, n):
            by[len(w)][w].add(item)
    return [WuManber(p, m) for m, p in sorted(by.items())]


def find(doc: list[str], searches: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Joined spans of hit words, and the ids of the items found."""
    found, ids = [], set()
    for s in searches:
        for at, mine in s.search(doc):
            found.append((at, at + s.m))
            ids |= mine
    return join_spans(found), ids


def join_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, items: list[tuple[object, str]], n: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(tuple(items))  # at most about BLOCK_BYTES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = searchers(held.value, n)
        for batch in slices(batches):
            count, spans, ids = [], [], []
            for t in texts(batch["text"]):
                w = words(t)
                s, i = find(w, searches)
                count.append(len(w))
                spans.append([{"start": a, "end": b} for a, b in s])
                ids.append(sorted(i))
            yield pa.record_batch({
                "row": batch["row"],
                "doc_id": batch["doc_id"],
                "n_words": pa.array(count, pa.int64()),
                "hits": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "items": pa.array(ids, pa.list_(pa.string())),
            })

    return docs.mapInArrow(freeing(search), FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, hits (spans of words, end exclusive), items (ids found, sorted as strings).

    Words are runs of digits, letters a-z and all code points from U+0080, after lower-casing A-Z. An item's window is
    ``n`` consecutive words; an item of fewer words is one window; an item without words has none. Null or empty texts
    have no words and give no hits; a null item_id is ignored. Rows that repeat an item_id count as one item. Rows of
    ``docs`` that repeat a doc_id are each searched. Benchmarks over ``block_bytes`` are searched in blocks of about
    that size, one pass over the documents each, so that what is broadcast is bounded however many items there are.
    """
    docs = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).filter("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes)
    if n_blocks <= 1:
        return _pass(docs, [tuple(r) for r in items.collect()], n).drop("row")
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    of = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    parts = [_pass(docs, [tuple(r) for r in items.filter(of == b).collect()], n) for b in range(n_blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    merged = found.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.array_sort("hits")
    joined = F.aggregate(
        start,
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.withColumn("hits", joined).drop("row")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def sha(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
