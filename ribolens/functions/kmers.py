"""Overlapping trimer counts: an Arrow function that counts a whole batch at once, and the same in SQL functions."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TRIMERS
from .sequence import column

_CODE = np.full(256, 64, np.int64)
_CODE[[ord(b) for b in "ACGT"]] = range(4)
#: Place of each trimer, read as a base-4 number, in the feature order.
_PLACE = np.array([TRIMERS.index("".join(t)) for t in product("ACGT", repeat=3)])


def count_trimers(seqs: pa.Array) -> np.ndarray:
    """(sequence, trimer in feature order). Only upper-case ACGT match; a trimer never spans two sequences."""
    raw = [b or b"" for b in seqs.cast(pa.binary()).to_pylist()]
    code = _CODE[np.frombuffer(b"\n\n".join(raw), np.uint8)]
    if len(code) < 3:
        return np.zeros((len(raw), 64), np.int64)
    kmer = code[:-2] * 16 + code[1:-1] * 4 + code[2:]
    sizes = np.array([len(b) + 2 for b in raw])
    owner = np.repeat(np.arange(len(raw)), sizes)[: len(kmer)]
    valid = (code[:-2] < 4) & (code[1:-1] < 4) & (code[2:] < 4)
    counts = np.bincount(owner[valid] * 64 + _PLACE[kmer[valid]], minlength=len(raw) * 64)
    return counts.reshape(len(raw), 64)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def trimer_counts(seq: pa.Array) -> pa.Array:
    """The 64 overlapping counts of a sequence, in feature order; null for a null sequence."""
    counts = count_trimers(seq)
    n = len(seq)
    out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(counts.reshape(-1).astype(np.int32)))
    return pa.compute.if_else(seq.is_valid(), out, pa.scalar(None, out.type)) if seq.null_count else out


def trimer_counts_sql(seq: Column | str) -> Column:
    """The same counts without Python: one look-ahead pattern for each trimer."""
    return F.array(*(F.regexp_count(column(seq), F.lit(f"(?={t})")) for t in TRIMERS))


def with_trimers(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``df`` with the 64 trimer columns, in percent of the windows, and ``length``.

    The percentage is null for sequences shorter than three, which have no window.
    """
    windows = F.length(seq) - 2
    counted = df.withColumn("_trimers", trimer_counts(F.col(seq)))
    share = [F.when(windows > 0, F.col("_trimers")[i] * 100.0 / windows).alias(t) for i, t in enumerate(TRIMERS)]
    return counted.select(*df.columns, *share, F.length(seq).alias("length"))
