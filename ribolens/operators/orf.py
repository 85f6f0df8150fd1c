"""Reading-frame scores: hexamer log-odds learned from labelled sequences, best run of codon steps in each frame.

This stands in for an external ORF scorer whose reports read_orf() takes; its columns are named as approximations.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "ACGTN"
_CODE = np.full(256, 4, np.int64)
_CODE[[ord(b) for b in "ACGT"]] = range(4)
HEXAMERS = 5**6


def hexamer_index(hexamer: str) -> int:
    out = 0
    for b in hexamer:
        out = out * 5 + LETTERS.index(b)
    return out


def rule_weights(stop: float = -5.0, gc: float = 0.25) -> np.ndarray:
    """Weights by the first codon alone: ``stop`` for a stop codon, else ``gc`` times (G and C of the codon, less one)."""
    out = np.zeros(HEXAMERS)
    for i, h in enumerate(product(LETTERS, repeat=6)):
        codon = "".join(h[:3])
        out[i] = stop if codon in ("TAA", "TAG", "TGA") else gc * (sum(b in "GC" for b in codon) - 1)
    return out


def table_weights(rows: DataFrame) -> np.ndarray:
    """Weights from a table (hexamer, weight); hexamers that it lacks weigh 0, of repeated ones the largest counts.

    Rows that aren't six of LETTERS, or have no weight, are left out.
    """
    held = rows.select(F.upper("hexamer").alias("hexamer"), "weight").filter(F.rlike("hexamer", F.lit(f"^[{LETTERS}]{{6}}$")) & F.col("weight").isNotNull())
    out = np.zeros(HEXAMERS)
    for r in held.groupBy("hexamer").agg(F.max("weight").alias("weight")).collect():  # at most 5 ** 6 rows
        out[hexamer_index(r["hexamer"])] = r["weight"]
    return out


def learn_weights(df: DataFrame, seq: str = "seq", label: str = "label", smoothing: float = 1.0) -> np.ndarray:
    """Log-odds of in-frame hexamers of coding against other sequences; counts cover every row, ACGT hexamers alone."""

    def count(batches):
        held = np.zeros((2, HEXAMERS), np.int64)
        for batch in batches:
            for s, y in zip(batch["seq"].to_pylist(), batch["label"].to_pylist()):
                if s and y in (0, 1):
                    steps = _hexamers(s)
                    np.add.at(held[y], np.concatenate([steps[f::3] for f in ((0,) if y else (0, 1, 2))]) if len(steps) else steps, 1)
        y, h = np.nonzero(held)
        yield pa.record_batch({"label": pa.array(y.astype(np.int32)), "hexamer": pa.array(h.astype(np.int32)), "n": pa.array(held[y, h])})

    rows = df.select(F.col(seq).alias("seq"), F.col(label).cast("int").alias("label")).mapInArrow(count, "label int, hexamer int, n long")
    found = rows.groupBy("label", "hexamer").agg(F.sum("n").alias("n")).collect()  # at most 2 x 5 ** 6 rows
    n = np.zeros((2, HEXAMERS))
    for r in found:
        n[r["label"], r["hexamer"]] = r["n"]
    share = (n + smoothing) / (n.sum(1, keepdims=True) + smoothing * HEXAMERS)
    return np.log(share[1] / share[0])


def _hexamers(seq: str) -> np.ndarray:
    c = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    if len(c) < 6:
        return np.zeros(0, np.int64)
    out = np.zeros(len(c) - 5, np.int64)
    for j in range(6):
        out = out * 5 + c[j : len(c) - 5 + j]
    return out


def best_run(w: np.ndarray) -> tuple[float, int, int]:
    """Largest sum of neighbouring weights, its first step and the step after its last; 0 steps give 0."""
    if not len(w):
        return 0.0, 0, 0
    run = np.concatenate(([0.0], np.cumsum(w)))
    low = np.minimum.accumulate(run)[:-1]
    end = int(np.argmax(run[1:] - low)) + 1
    start = int(np.argmin(run[:end]))
    return float(run[end] - run[start]), start, end


def score_orfs(df: DataFrame, weights: np.ndarray, seq: str = "seq", keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``keep`` columns, score_f0, score_f1, score_f2, orf_frame (the first best), orf_score_approx, orf_coverage (percent).

    Null or short sequences (under six bases) have scores of 0. ``weights``: HEXAMERS numbers, sent to each task.
    """
    held = df.sparkSession.sparkContext.broadcast(np.asarray(weights, float))

    def work(batches):
        for batch in batches:
            out = {k: [] for k in ("score_f0", "score_f1", "score_f2", "orf_frame", "orf_score_approx", "orf_coverage")}
            for s in batch["_seq"].to_pylist():
                w = held.value[_hexamers(s or "")]
                runs = [best_run(w[f::3]) for f in range(3)]
                best = max(range(3), key=lambda f: (runs[f][0], -f))
                bases = min(len(s or ""), 3 * runs[best][2] + 3) - 3 * runs[best][1] if runs[best][2] else 0
                for f in range(3):
                    out[f"score_f{f}"].append(runs[f][0])
                out["orf_frame"].append(best)
                out["orf_score_approx"].append(runs[best][0])
                out["orf_coverage"].append(100.0 * bases / len(s) if s else 0.0)
            yield pa.record_batch([*(batch[k] for k in keep), *(pa.array(v, pa.int32() if k == "orf_frame" else pa.float64()) for k, v in out.items())], [*keep, *out])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "score_f0 double, score_f1 double, score_f2 double, orf_frame int, orf_score_approx double, orf_coverage double"])
    return df.select(*keep, F.col(seq).alias("_seq")).mapInArrow(work, schema)
