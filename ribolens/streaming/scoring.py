"""Scoring of FASTA files as they arrive (an extension): stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.kmers import with_trimers
from ..operators import model
from ..sources.fasta import parse


def stream_fasta(spark: SparkSession, directory: str) -> DataFrame:
    """Transcripts of the FASTA files that arrive in ``directory``; ``ord`` is null, as a stream has no whole order."""
    rows = spark.readStream.option("lineSep", "\n>").text(directory)
    return parse(rows.select(F.lit(None).cast("long").alias("ord"), F.regexp_replace("value", r"^\s*>", "").alias("value")))


def score_stream(spark: SparkSession, directory: str, forest: model.Forest, out: str, checkpoint: str) -> StreamingQuery:
    """Features and predictions of each arriving file, appended to Parquet; sequence features alone."""
    preds = model.predict(with_trimers(stream_fasta(spark, directory).filter("seq_len > 2")), forest)
    return preds.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
