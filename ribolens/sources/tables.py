"""Homology hits, ORF reports, label vectors, predictions, feature tables and hexamer weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import HIT, PREDICTION


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Ten tab-separated columns without a header; both dialects (the last column is a frame or a strand, as text).

    A malformed line keeps what could be read and holds itself in ``corrupt``; see corrupt_hits().
    """
    schema = T.StructType([*HIT.fields, T.StructField("corrupt", T.StringType())])
    return spark.read.csv(path, sep="\t", header=False, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")


def good_hits(hits: DataFrame) -> DataFrame:
    return hits.filter("corrupt is null and qseqid is not null and evalue is not null").drop("corrupt")


def corrupt_hits(hits: DataFrame) -> DataFrame:
    """One row: how many lines could not be used."""
    return hits.agg(F.count_if(~F.expr("corrupt is null and qseqid is not null and evalue is not null")).alias("corrupt_lines"))


def orf_columns(value: Column | str) -> dict[str, Column]:
    """seq_id, score, orf_coverage of a report line; scores may be negative or whole numbers."""
    value = F.regexp_replace(value, "\r", "")
    number = r"(-?\d+(?:\.\d+)?)"
    return {
        "seq_id": F.regexp_extract(value, r">\s*(\S+)", 1),
        "score": F.regexp_extract(value, f"score={number}", 1).try_cast("double"),
        "orf_coverage": F.regexp_extract(value, f"used={number}", 1).try_cast("double"),
    }


def parse_orf(lines: DataFrame, value: str = "value") -> DataFrame:
    """The report's header lines: those with both ``>`` and ``{``."""
    held = lines.filter(F.contains(value, F.lit(">")) & F.contains(value, F.lit("{")))
    return held.select(*(c.alias(n) for n, c in orf_columns(value).items()))


def read_orf(spark: SparkSession, path: str) -> DataFrame:
    return parse_orf(spark.read.text(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=False, schema=PREDICTION)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select(*PREDICTION.fieldNames()).write.mode("overwrite").csv(path, sep="\t", header=False)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """ord, label: one integer per line; a line that is none gives a null label."""
    return spark.read.text(path).filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("ord"), F.trim("value").try_cast("int").alias("label"))


def label_generator(spark: SparkSession, n1: int, n0: int) -> DataFrame:
    """n1 ones, then n0 zeros."""
    return spark.range(n1 + n0).select(F.col("id").alias("ord"), F.when(F.col("id") < n1, 1).otherwise(0).alias("label"))


def read_features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A feature table with header: Label, seqid, then ``columns``."""
    schema = ", ".join(["Label int", "seqid string", *(f"`{c}` double" for c in columns)])
    return spark.read.csv(path, sep="\t", header=True, schema=schema).withColumnsRenamed({"Label": "label", "seqid": "seq_id"})


def write_features(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(F.col("label").alias("Label"), F.col("seq_id").alias("seqid"), *columns).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_hexamer_weights(spark: SparkSession, weights: dict[str, float], path: str) -> None:
    """The table that read_hexamer_weights() reads."""
    rows = [(f"{w!r} {h}",) for h, w in weights.items()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def read_hexamer_weights(spark: SparkSession, path: str) -> DataFrame:
    """hexamer, weight of a weight table: ``#`` lines, then ``weight hexamer``."""
    lines = spark.read.text(path).filter(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(parts[1].alias("hexamer"), parts[0].try_cast("double").alias("weight"))
