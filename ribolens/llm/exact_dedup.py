"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition turns its digests into sorted runs, dealt over shards by digest. In binomial rounds the runs
whose numbers agree above the next ``FAN_BITS`` bits are exchanged to one task and merged there, multiway and
streaming: a run travels as blocks, blocks are met in order of their first digest, and an entry leaves as soon as no
later block can hold its digest. Each level keeps one entry for a digest: the identifier that stays and the row count.
An entry is keyed by SHA-256 *and* byte length, so that a level only joins rows that both values verify as equal.
A group of copies, however large, is one entry in a run, so no task ever holds a group's members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, materialize, parallel, raw, slices

ENTRY = np.dtype([("a", ">u8"), ("b", ">u8"), ("c", ">u8"), ("d", ">u8"), ("size", ">i8"), ("best", "<i8"), ("n", "<i8")])
HEAD = np.dtype(ENTRY.descr[:5])
KEYS = ("a", "b", "c", "d", "size")
BLOCK = 8192
RUN = 1 << 18
FAN_BITS = 3
#: Groups with this share of all rows are joined by broadcast; there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 256
BLOCKS = "shard int, run long, first binary, payload binary"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, size of every row; the text is lower-cased for A-Z alone, null counts as empty."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            low = [t.lower() for t in raw(batch["text"])]
            yield pa.record_batch({
                "doc_id": batch["doc_id"],
                "digest": pa.array([hashlib.sha256(t).digest() for t in low], pa.binary()),
                "size": pa.array(list(map(len, low)), pa.int64()),
            })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freeing(digest), "doc_id long, digest binary, size long")


def collapse(entries: np.ndarray) -> np.ndarray:
    """Sorted, one entry for each key: the best identifier, the sum of rows."""
    if not len(entries):
        return entries
    entries = entries.astype(ENTRY, copy=False)  # concatenate() changes the byte order
    entries = entries[np.lexsort([entries[k] for k in reversed(KEYS)])]
    new = np.ones(len(entries), bool)
    new[1:] = np.logical_or.reduce([entries[k][1:] != entries[k][:-1] for k in KEYS])
    at = np.flatnonzero(new)
    out = entries[at].copy()
    out["best"] = np.maximum.reduceat(entries["best"], at)
    out["n"] = np.add.reduceat(entries["n"], at)
    return out


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    shard, run, payload = zip(*rows) if rows else ((), (), ())
    return pa.record_batch({
        "shard": pa.array(shard, pa.int32()),
        "run": pa.array(run, pa.int64()),
        "first": pa.array([p[:1].tobytes()[:40] for p in payload], pa.binary()),
        "payload": pa.array([p.tobytes() for p in payload], pa.binary()),
    })


def _runs(shards: int, sign: int, n_parts: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            run = collapse(np.concatenate(held))
            of = (run["a"].astype("u8") >> np.uint64(32)) % np.uint64(shards)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(shards + 1))
            for s in range(shards):
                mine = run[order[ends[s] : ends[s + 1]]]
                for at in range(0, len(mine), BLOCK):
                    yield s, part + n_parts * k, mine[at : at + BLOCK]

        for batch in batches:
            if not batch.num_rows:
                continue
            e = np.zeros(batch.num_rows, ENTRY)
            four = np.frombuffer(b"".join(batch["digest"].to_pylist()), ">u8").reshape(-1, 4)
            for i, c in enumerate("abcd"):
                e[c] = four[:, i]
            e["size"] = batch["size"].to_numpy()
            ids = batch["doc_id"]
            e["best"] = np.where(ids.is_null().to_numpy(zero_copy_only=False), -(1 << 63), ids.fill_null(0).to_numpy(zero_copy_only=False) * sign)
            e["n"] = 1
            held.append(e)
            rows += len(e)
            if rows >= RUN:
                yield _blocks(list(flush()))
                held, rows, k = [], 0, k + 1
        if held:
            yield _blocks(list(flush()))

    return make


def _head(entries: np.ndarray, first: bytes) -> int:
    """How many of the sorted entries come before the key ``first``."""
    h = np.frombuffer(first, HEAD)[0]
    lo, hi = 0, len(entries)
    for k in KEYS:
        lo, hi = lo + int(np.searchsorted(entries[k][lo:hi], h[k], "left")), lo + int(np.searchsorted(entries[k][lo:hi], h[k], "right"))
        if lo == hi:
            break
    return lo


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of shard, run and first key: the merged blocks of each run."""
    now, pending = None, np.zeros(0, ENTRY)
    for batch in batches:
        out = []
        for shard, run, first, payload in zip(*(batch[c].to_pylist() for c in ("shard", "run", "first", "payload"))):
            if (shard, run) != now:
                if len(pending):
                    out.append((*now, pending))
                now, pending = (shard, run), np.zeros(0, ENTRY)
            done = _head(pending, first)
            if done:
                out.append((shard, run, pending[:done]))
            pending = collapse(np.concatenate([pending[done:], np.frombuffer(payload, ENTRY)]))
        if out:
            yield _blocks(out)
    if len(pending):
        yield _blocks([(*now, pending)])


def tree_merge(found: DataFrame, keep: str = "max") -> DataFrame:
    """digest, size, keep_id, group_size: one row for each different text. ``found``: what digests() returns."""
    sign = 1 if keep == "max" else -1
    spark = found.sparkSession
    shards, n_parts = parallel(spark), found.rdd.getNumPartitions()
    runs = materialize(found.mapInArrow(_runs(shards, sign, max(1, n_parts)), BLOCKS), "runs")
    last = runs.agg(F.max("run")).first()[0] or 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch["payload"].to_pylist():
                e = np.frombuffer(payload, ENTRY)
                wide = np.stack([e[c] for c in "abcd"], 1).astype(">u8")
                yield pa.record_batch({
                    "digest": pa.array([r.tobytes() for r in wide], pa.binary()),
                    "size": pa.array(e["size"].astype("i8")),
                    "keep_id": pa.array(e["best"] * sign, mask=e["best"] == -(1 << 63)),
                    "group_size": pa.array(e["n"].copy()),
                })

    step = None  # the last round gives rows at once: no second Python worker beside the one that merges
    while last:
        dealt = (runs if step is None else runs.mapInArrow(step, BLOCKS)).withColumn("run", F.shiftright("run", FAN_BITS))
        runs, step = dealt.repartition(shards, "shard", "run").sortWithinPartitions("shard", "run", "first"), _merge
        last >>= FAN_BITS
    final = rows if step is None else lambda batches: rows(_merge(batches))
    return runs.mapInArrow(freeing(final), "digest binary, size long, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. ``keep`` names the identifier that stays: ``max`` or
    ``min``. A null text counts as empty and equals an empty one. A null doc_id never stays where the group has another;
    rows that repeat one doc_id with equal text count each and stay or go together. No rows give no rows. Columns but
    doc_id and text are ignored.
    """
    found = materialize(digests(docs), "digests")
    groups = materialize(tree_merge(found, keep).filter("group_size > 1"), "groups")
    total = found.count()
    hot = groups.filter(F.col("group_size") >= max(1000, int(total * HOT_SHARE)))
    key = ["digest", "size"]
    seen = found.join(F.broadcast(hot), key, "left")  # at most 1 / HOT_SHARE rows
    rest = seen.filter("group_size is null").drop("keep_id", "group_size").join(groups, key, "left")
    return seen.filter("group_size is not null").unionByName(rest).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
