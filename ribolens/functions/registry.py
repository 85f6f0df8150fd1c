"""The sequence functions under SQL names (an extension)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .kmers import trimer_counts


def register(spark: SparkSession) -> None:
    """trimer_counts(seq), gc_percent(seq), base_count(seq, base) and reverse_complement(seq) for spark.sql()."""
    spark.udf.register("trimer_counts", trimer_counts)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION base_count(seq STRING, base STRING) RETURNS INT RETURN length(seq) - length(replace(seq, base, ''))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gc_percent(seq STRING) RETURNS DOUBLE RETURN CASE WHEN length(seq) > 0 THEN 100.0D * length(regexp_replace(seq, '[^GC]', '')) / length(seq) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(seq STRING) RETURNS STRING RETURN reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))")
