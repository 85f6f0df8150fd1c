"""Length filters, and the extraction of the sequences of a predicted class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def min_length(df: DataFrame, least: int, length: str = "seq_len") -> DataFrame:
    """Sequences of at least ``least`` bases."""
    return df.filter(F.col(length) >= least)


def min_length_counts(df: DataFrame, least: int, length: str = "seq_len") -> DataFrame:
    return df.agg(F.count_if(F.col(length) < least).alias("removed"), F.count_if(F.col(length) >= least).alias("retained"))


def length_range(df: DataFrame, least: int = 0, most: float = float("inf"), length: str = "seq_len") -> DataFrame:
    """Both bounds inclusive."""
    held = df.filter(F.col(length) >= least)
    return held if most == float("inf") else held.filter(F.col(length) <= int(most))


def check(label: int | str, cutoff: float, least: int, most: float) -> int:
    """The label as a number; raises ValueError where a parameter is out of range."""
    if str(label) not in ("0", "1"):
        raise ValueError(f"label must be 0 or 1, not {label!r}")
    if not 0 <= cutoff <= 1:
        raise ValueError(f"cutoff must lie between 0 and 1, not {cutoff}")
    if not most > least:
        raise ValueError(f"the largest length {most} must be above the least {least}")
    return int(label)


def of_class(preds: DataFrame, label: int, cutoff: float = 0.0) -> DataFrame:
    """Predictions of ``label`` whose own probability reaches ``cutoff``."""
    return preds.filter((F.col("prediction") == label) & (F.col("p_coding" if label == 1 else "p_noncoding") >= cutoff))


def extract(fasta: DataFrame, preds: DataFrame, label: int | str = 0, cutoff: float = 0.0, least: int = 0, most: float = float("inf")) -> DataFrame:
    """The sequences of a predicted class within a length range. Every record of an id is given."""
    chosen = of_class(preds, check(label, cutoff, least, most), cutoff)
    return length_range(fasta.join(chosen.select("seq_id"), "seq_id", "left_semi"), least, most)


def report(fasta: DataFrame, preds: DataFrame, label: int | str = 0, cutoff: float = 0.0, least: int = 0, most: float = float("inf")) -> DataFrame:
    """matched, too_long, too_short, written, not_found: of different ids. Too long is tested first."""
    chosen = of_class(preds, check(label, cutoff, least, most), cutoff).select("seq_id").distinct()
    sizes = fasta.groupBy("seq_id").agg(F.max("seq_len").alias("longest"), F.min("seq_len").alias("shortest"), F.lit(True).alias("there"))
    found = chosen.join(sizes, "seq_id", "left")
    there = F.coalesce(F.col("there"), F.lit(False))
    long: Column = F.lit(False) if most == float("inf") else F.col("shortest") > int(most)
    short = ~long & (F.col("longest") < least)
    return found.agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(there & long).alias("too_long"),
        F.count_if(there & short).alias("too_short"),
        F.count_if(there & ~long & ~short).alias("written"),
        F.count_if(~there).alias("not_found"),
    )
