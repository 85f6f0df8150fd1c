"""Aggregation of homology hits for each query sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import entropy, natural_log_or

#: Ln stands in for an e-value of 0; the entropy of a query without framed hits.
ZERO_LOG, NO_FRAME_ENTROPY = -250.0, 1.0


def hit_score(evalue: Column) -> Column:
    """Sum of -ln(e-value); 0 counts 250."""
    return F.sum(-natural_log_or(evalue, ZERO_LOG))


def frame_count(frame: int) -> Column:
    return F.count_if(F.col("qframe") == frame)


def frame_entropy(counts: list[Column]) -> Column:
    """Entropy of the counts of frames 1, 2, 3; 1 if all are 0. Negative frames don't count."""
    return entropy(counts, NO_FRAME_ENTROPY)


def hit_features(hits: DataFrame, key: str = "qseqid") -> DataFrame:
    """seq_id, all_numhits, all_HitScore, all_Frame_Entropy, all_Bitscore: partial sums, then one row for each query."""
    sums = hits.groupBy(F.col(key).alias("seq_id")).agg(
        F.count(F.lit(1)).alias("all_numhits"),
        hit_score(F.col("evalue")).alias("all_HitScore"),
        *(frame_count(k).alias(f"_f{k}") for k in (1, 2, 3)),
        F.sum("bitscore").alias("all_Bitscore"),
    )
    return sums.select("seq_id", "all_numhits", "all_HitScore", frame_entropy([F.col(f"_f{k}") for k in (1, 2, 3)]).alias("all_Frame_Entropy"), "all_Bitscore")


def coverage_filter(hits: DataFrame, least: float = 30.0) -> DataFrame:
    """The search's own filter on the coverage of an aligned pair, for hits that were made without it."""
    return hits.filter(F.col("qcovhsp") >= least)


def distinct_queries(hits: DataFrame, order: str, key: str = "qseqid") -> DataFrame:
    """Each query once, with the place where it is first seen."""
    return hits.groupBy(key).agg(F.min(order).alias("first_seen"))
