"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A document's features are its distinct character n-grams, hashed. The naive Bayes ratio r of a feature is
log((p + 1) / |p|) - log((q + 1) / |q|) over the documents of each label; a logistic regression is fitted on the
features times r, those whose rates differ by ``ERRORS`` standard errors. The fit uses at most ``SAMPLE`` labelled rows of each label with ``ENTRIES`` features in all,
the ones with the smallest hash of the id, so that what the driver holds is bounded; scores cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialize, slices, texts

ORDERS = (3, 4, 5)
BITS = 18
#: Labelled rows of each label that the fit uses at most, and features of theirs in all.
SAMPLE, ENTRIES = 2000, 1 << 23
#: A feature has a weight if its rates in the two labels differ by this many standard errors; others are noise to the fit.
ERRORS = 3.0
#: Characters that are turned into n-grams at once.
STEP = 1 << 20


@lru_cache(maxsize=4)
def _flags(bits: int) -> np.ndarray:
    return np.zeros(1 << bits, bool)


def grams(text: str, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed n-grams of the lower-cased text with a space before and after."""
    flags, top = _flags(bits), max(orders)
    text = f" {text.lower()} "
    for at in range(0, len(text), STEP):
        c = np.frombuffer(text[at : at + STEP + top - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        h = np.zeros(len(c), "u4")
        for n in range(1, top + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
            if n in orders:
                x = h + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                flags[x >> np.uint32(32 - bits)] = True
    found = np.flatnonzero(flags).astype("i4")
    flags[found] = False
    return found


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bits: int = BITS, rounds: int = 200, l2: float = 2e-2) -> tuple[np.ndarray, float]:
    """Weight of each feature (times its ratio) and the bias."""
    size = 1 << bits
    if not len(rows) or labels.min() == labels.max():  # nothing to tell apart
        share = float(np.average(labels, weights=weights)) if len(rows) else 0.0
        share = min(max(share, 0.01), 0.99)
        return np.zeros(size), float(np.log(share / (1 - share)))
    in_label = [np.zeros(size, "i8"), np.zeros(size, "i8")]
    for r, y in zip(rows, labels):
        in_label[int(y)][r] += 1
    count = in_label[0] + in_label[1]
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    rate = count / n.sum()
    error = np.sqrt(np.maximum(rate * (1 - rate) * (1 / n[0] + 1 / n[1]), 1e-12))
    apart = np.abs(in_label[1] / n[1] - in_label[0] / n[0])
    ids = np.flatnonzero((count > 0) & (apart >= ERRORS * error))
    if not len(ids):  # a few rows: no feature's rates differ by so much
        ids = np.flatnonzero(count)
    kept = np.full(size, -1, "i4")
    kept[ids] = np.arange(len(ids))
    rows = [k[k >= 0] for r in rows for k in (kept[r],)]
    sizes = np.array([len(r) for r in rows])
    groups, at = [], 0  # rows whose features make about a million
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 20)) + at)
        groups.append((at, end, np.concatenate(rows[at:end]), np.repeat(np.arange(end - at, dtype="i4"), sizes[at:end])))
        at = end
    del rows

    def per_row(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(owner, x[flat], end - at) for at, end, flat, owner in groups])

    def per_feature(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(flat, x[at:end][owner], len(ids)) for at, end, flat, owner in groups)

    p, q = per_feature(labels) + 1, per_feature(1 - labels) + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    w, bias = np.zeros(len(ids)), 0.0
    m, v, mb, vb, rate = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.02
    weights = weights / weights.sum()
    for t in range(1, rounds + 1):
        z = per_row(ratio * w) + bias
        g = weights * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        grad = per_feature(g) * ratio + l2 * w / len(ids) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        fix = (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        w -= rate * fix * m / (v**0.5 + 1e-8)
        bias -= rate * fix * mb / (vb**0.5 + 1e-8)
    out = np.zeros(size)
    out[ids] = w * ratio
    return out, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The classifier from labelled rows that aren't held out; a doc_id labelled both ways counts by its larger label."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for y in counts:
        some = known.filter(F.col("label") == y).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return np.zeros(1 << BITS), -20.0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            g = [grams(t) for t in texts(batch["text"])]
            yield pa.record_batch({"h": batch["h"], "label": batch["label"], "size": pa.array(list(map(len, g)), pa.int64()), "grams": pa.array([x.tobytes() for x in g], pa.binary())})

    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = text.join(F.broadcast(chosen), "doc_id").select("h", "label", "text").mapInArrow(features, "h long, label int, size long, grams binary")  # at most 2 x sample ids
    found = materialize(found, "labelled")
    # the first rows by hash that have at most ENTRIES features together
    order = Window.partitionBy("label").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = found.select("h", "label", "size").withColumn("sum", F.sum("size").over(order)).groupBy("label").agg(F.max(F.when(F.col("sum") <= ENTRIES, F.col("h"))).alias("last"))
    found = found.join(F.broadcast(sizes), "label").filter("h <= last").toArrow()
    rows = [np.frombuffer(g, "i4") for g in found["grams"].to_pylist()]
    y = found["label"].to_numpy().astype("f8")
    share = {k: n / max(1, (y == k).sum()) for k, n in counts.items()}
    weights = np.where(y == 1, share.get(1, 1.0), share.get(0, 1.0))
    order = np.lexsort([[len(r) for r in rows], y])  # the same fit in whatever order rows arrive
    return fit([rows[i] for i in order], y[order], weights[order])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (score >= 0.5).

    A null text counts as empty and scores by the classifier's bias; so does any text if labels hold one value alone,
    and without usable labels every score is near 0. A null doc_id counts as held out. Rows that repeat a doc_id are each
    scored; texts of any length are scored whole; columns but doc_id, text, toxic are ignored; no rows give no rows.
    """
    weights, bias = train(docs, labels, sample)
    held = docs.sparkSession.sparkContext.broadcast((weights.astype("f4"), bias))  # 2 ** BITS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = held.value
        for batch in slices(batches):
            z = np.array([w[grams(t)].sum(dtype="f8") + b for t in texts(batch["text"])], "f8")
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype("i4"))})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out())
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
