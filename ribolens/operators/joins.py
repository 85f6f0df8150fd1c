"""Joins of feature groups: by id, by position, and by first substring match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HIT_FEATURES, NO_HITS
from .ordinal import with_ordinal


def join_orf(features: DataFrame, orf: DataFrame, strict: bool = True) -> DataFrame:
    """By seq_id. ``strict`` raises where an id of ``features`` has no or several ORF rows."""
    if strict:
        of = features.select("seq_id").join(orf.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")), "seq_id", "left")
        bad = of.filter("n is null or n > 1").limit(1).collect()
        if bad:
            raise ValueError(f"ORF rows for {bad[0]['seq_id']!r}: {bad[0]['n'] or 0}, not 1")
    return features.join(orf, "seq_id")


def zip_rows(left: DataFrame, right: DataFrame, by: str = "ord") -> DataFrame:
    """Row i with row i, along ``by`` on both sides; raises where the lengths differ."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} and {m} rows can't be paired by position")
    return with_ordinal(left, by).join(with_ordinal(right, by).drop(by), "ordinal")


def join_hits(features: DataFrame, hits: DataFrame) -> DataFrame:
    """By seq_id, with the defaults of a sequence without hits."""
    found = features.join(hits, "seq_id", "left")
    return found.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(d)) for c, d in zip(HIT_FEATURES, NO_HITS)})


def first_substring_match(ids: DataFrame, lines: DataFrame, id_col: str, line_col: str, order: str) -> DataFrame:
    """For each id the first line, along ``order``, that holds it anywhere; null where none does.

    Lines are cut into their substrings of the ids' lengths, which join the ids by equality: the work grows with the text
    and with the number of different id lengths, not with ids times lines.
    """
    lengths = ids.select(F.length(id_col).alias("n")).distinct()
    sizes = [r["n"] for r in lengths.orderBy("n").collect() if r["n"]]  # as many as there are id lengths
    cut = [F.when(F.length(line_col) >= n, F.transform(F.sequence(F.lit(1), F.length(line_col) - n + 1), lambda p: F.substr(F.col(line_col), p, F.lit(n)))) for n in sizes]
    parts = F.array_distinct(F.flatten(F.array_compact(F.array(*cut)))) if cut else F.array().cast("array<string>")
    parts = lines.select(line_col, order, F.explode(parts).alias("_part"))
    wanted = ids.select(F.col(id_col).alias("_part")).distinct()
    first = parts.join(wanted, "_part").groupBy("_part").agg(F.min_by(line_col, order).alias("matched"), F.min(order).alias("matched_order"))
    return ids.join(first, F.col(id_col) == F.col("_part"), "left").drop("_part")


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_n", place).filter("_n = 1").drop("_n")


def union_classes(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """Both classes with their labels: 0, then 1."""
    return negative.withColumn("label", F.lit(0)).unionByName(positive.withColumn("label", F.lit(1)))
