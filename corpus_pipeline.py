"""Corpus pipeline: language ID, exact dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
they are called. The stages that compare documents drop rows by a number: the doc_id if each row has its own, else one given
to each row, so that rows which repeat a doc_id, or have none, are judged as rows of their own. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribolens.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from ribolens.llm.common import materialize, numbered
from ribolens.llm.queries import vocabulary

#: A document without a language of at least this mean probability is rejected, besides those in no learned language,
#: which the field finds by its certainty. A higher floor would also reject clean documents in several languages.
LEAST_PROBABILITY = 0.0
#: Two documents link at this Jaccard similarity (in percent) of their shingles of so many words.
NEAR_PERCENT, NEAR_SHINGLE = 80, 5


#: Rows of an Arrow batch: whole texts are held twice on their way to a Python worker and back.
BATCH = 1000


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def _texts(rows: DataFrame, number: str) -> DataFrame:
    """The rows by their numbers, as an operator wants them: doc_id, text."""
    return rows.select(F.col(number).alias("doc_id"), "text")


def _without(rows: DataFrame, number: str, dropped: DataFrame) -> DataFrame:
    """The rows whose number isn't a doc_id of ``dropped``, without the numbers that aren't ids."""
    gone = materialize(dropped.select(F.col("doc_id").alias(number)), "dropped")
    return rows.join(gone, number, "left_anti").select(*(f"`{c}`" for c in rows.columns if c == "doc_id" or c != number))


def _others(rows: DataFrame, number: str, groups: DataFrame, best: Column) -> DataFrame:
    """doc_id (row number) of all but one row of each group (doc_id, of): the one that ``best``, over id and doc_id, names."""
    ids = rows.select(F.col(number).alias("doc_id"), F.col("doc_id").cast("long").alias("id"))
    kept = groups.join(ids, "doc_id").groupBy("of").agg(best.alias("best")).select(F.col("best.doc_id").alias("doc_id"))
    return groups.select("doc_id").join(kept, "doc_id", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null or empty ones too), or in no learned language by the field's certainty, go.

    Texts of any length are judged whole, rows with equal or null ids each. Where no row has a lang to learn from, all go.
    """
    _batches(spark)
    return language_id.accepted(docs, LEAST_PROBABILITY)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one row alone even if ids are equal or null.

    A null id counts as smallest, a null text as empty; texts of any length are compared whole.
    """
    _batches(spark)
    rows, number = numbered(docs, "exact")
    groups = exact_dedup.exact_groups(_texts(rows, number)).filter("group_size > 1").select("doc_id", F.col("keep_id").alias("of"))
    return _without(rows, number, _others(rows, number, materialize(groups, "groups"), F.max(F.struct("id", "doc_id"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are joined by links, the one with the smallest doc_id stays, one row alone even if ids are equal.

    A null id counts as largest; a text that is null, or has no word, stays; texts of any length are compared whole.
    """
    _batches(spark)
    rows, number = numbered(docs, "near")
    found = materialize(ngram_join.similar_groups(_texts(rows, number), NEAR_PERCENT, NEAR_SHINGLE), "near-groups")
    rest = found.filter("component_id <> doc_id").select("doc_id", F.col("component_id").alias("of"))
    groups = rest.unionByName(rest.select(F.col("of").alias("doc_id"), "of").distinct())
    return _without(rows, number, _others(rows, number, groups, F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, whatever their id; null and empty texts hold none and stay."""
    _batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, number = numbered(docs, "benchmark")
    return _without(rows, number, decontaminate.contamination(_texts(rows, number), items).filter("size(hits) > 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in sequences: packing.pack()'s rows.

    A null or empty text is one end token; rows with equal or null ids are documents of their own; a text of any length is
    packed whole.
    """
    _batches(spark)
    return packing.pack(docs, vocabulary())


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", benchmark), ("packing", packed)]
#: The language stage is a trained model, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
