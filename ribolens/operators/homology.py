"""A seed search of transcripts against proteins (an extension): six-frame translation, then shared residue words.

It stands in for an external translated search whose tables read_hits() takes, and gives rows of the same columns. Scores
count matched residues on the best diagonal; e-values are rough, from two bits a residue, so its columns are estimates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The standard genetic code, codons in the order of TCAG.
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
FRAMES = (1, 2, 3, -1, -2, -3)
BITS = 2.0

_CODE = np.full(256, 64, np.int64)
for _i, _b in enumerate("TCAG"):
    _CODE[[ord(_b), ord(_b.lower())]] = _i
_CODE[[ord("U"), ord("u")]] = 0
_TABLE = np.frombuffer((RESIDUES + "X").encode(), np.uint8)


def translate(seq: str, frame: int) -> str:
    """Residues of a frame: 1 to 3 forward, -1 to -3 on the reverse complement; X for a codon with another letter."""
    c = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    if frame < 0:
        c = np.where(c < 4, c ^ 2, c)[::-1]  # T-A and C-G differ by 2
    c = c[abs(frame) - 1 :]
    c = c[: len(c) // 3 * 3].reshape(-1, 3)
    at = np.where((c < 4).all(1), c[:, 0] * 16 + c[:, 1] * 4 + c[:, 2], 64)
    return _TABLE[at].tobytes().decode()


def six_frames(df: DataFrame) -> DataFrame:
    """seq_id, qframe, protein of each sequence."""

    def work(batches):
        for batch in batches:
            ids, frames, out = [], [], []
            for i, s in zip(batch["seq_id"].to_pylist(), batch["seq"].to_pylist()):
                for f in FRAMES:
                    ids.append(i)
                    frames.append(f)
                    out.append(translate(s or "", f))
            yield pa.record_batch({"seq_id": pa.array(ids, pa.string()), "qframe": pa.array(frames, pa.int32()), "protein": pa.array(out, pa.string())})

    return df.select("seq_id", "seq").mapInArrow(work, "seq_id string, qframe int, protein string")


def _words(df: DataFrame, keys: list[str], seq: str, k: int, place: str) -> DataFrame:
    """The words of k residues without stop or unknown, with their places."""
    places = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    rows = df.select(*keys, seq, F.explode(places).alias(place)).select(*keys, place, F.substr(F.col(seq), F.col(place), F.lit(k)).alias("word"))
    return rows.filter(~F.rlike("word", F.lit("[*X]")))


def seed_hits(transcripts: DataFrame, proteins: DataFrame, k: int = 5, min_seeds: int = 3) -> DataFrame:
    """The best diagonal of each transcript, protein and frame with at least ``min_seeds`` shared words, as hit rows.

    ``transcripts`` has seq_id and seq, ``proteins`` seq_id and seq (residues). Seeds of a diagonal are counted before they
    are dealt out again, so a frequent word weighs as its join alone.
    """
    asked = _words(six_frames(transcripts), ["seq_id", "qframe"], "protein", k, "qpos")
    held = _words(proteins.select(F.col("seq_id").alias("sseqid"), F.upper("seq").alias("residues")), ["sseqid"], "residues", k, "spos")
    seeds = asked.join(held, "word").groupBy("seq_id", "qframe", "sseqid", (F.col("qpos") - F.col("spos")).alias("diagonal"))
    found = seeds.agg(F.count(F.lit(1)).alias("seeds"), F.min("qpos").alias("first"), F.max("qpos").alias("last")).filter(F.col("seeds") >= min_seeds)
    best = Window.partitionBy("seq_id", "qframe", "sseqid").orderBy(F.desc("seeds"), "diagonal")
    found = found.withColumn("n", F.row_number().over(best)).filter("n = 1")
    size = transcripts.select("seq_id", F.length("seq").alias("bases"))
    total = proteins.agg(F.sum(F.length("seq")).cast("double").alias("database"))
    found = found.join(size, "seq_id").join(F.broadcast(total))
    residues = F.col("seeds") + (k - 1)
    covered = F.least(F.lit(100.0), (F.col("last") - F.col("first") + k) * 300.0 / F.col("bases"))
    return found.select(
        F.col("seq_id").alias("qseqid"),
        "sseqid",
        F.least(F.lit(100.0), residues * 100.0 / (F.col("last") - F.col("first") + k)).alias("pident"),
        (F.col("database") * F.col("bases") * F.pow(F.lit(2.0), -BITS * residues)).alias("evalue"),
        covered.alias("qcovs"),
        covered.alias("qcovhsp"),
        residues.cast("double").alias("score"),
        (BITS * residues).alias("bitscore"),
        "qframe",
        F.lit("1").alias("sframe"),
    )
