"""FASTA files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """Transcripts from records as ``value`` (a record after its ``>``) with ``ord``."""
    value = F.regexp_replace("value", "\r", "")
    head = F.regexp_extract(value, r"^([^\n]*)", 1)
    body = F.regexp_replace(F.substr(value, F.length(head) + 1), r"\s", "")
    return lines.filter(F.trim(value) != "").select(
        "ord",
        F.regexp_extract(head, r"^\s*(\S*)", 1).alias("seq_id"),
        head.alias("description"),
        body.alias("seq"),
        F.length(body).cast("int").alias("seq_len"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """ord, seq_id, description, seq, seq_len. Records may be wrapped, with LF or CRLF; ``ord`` grows in file order.

    A record starts at a ``>`` that begins a line. The reader splits at a line feed and ``>``, so a ``>`` inside a
    description stays there; the very first record's own ``>`` is cut here. Splits of a large file are read in parallel.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"^\s*>", "").alias("value"))
    return parse(rows)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """One record per row, residues wrapped at ``width``; rows keep the order of ``ord`` where it is there."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    rows = df.orderBy("ord") if "ord" in df.columns else df
    text = F.concat(F.lit(">"), F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("seq_id")), F.lit("\n"), wrapped)
    rows.select(text.alias("value")).write.mode("overwrite").text(path)
