"""Row numbers and running sums over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: list[Column], block: Column, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """``df`` with, for each of ``sums``, its running sum over all rows up to and with this one.

    ``block`` must not fall (or not rise, if ``descending``) along ``order``. Rows are summed within their block, and the
    blocks' totals, one row each, are summed over the blocks.
    """
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = df.withColumn("_block", block)
    parts = parts.withColumns({f"_in_{k}": F.sum(v).over(inside) for k, v in sums.items()})
    totals = df.groupBy(block.alias("_b")).agg(*(F.sum(v).alias(f"_all_{k}") for k, v in sums.items()))
    over = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_b", *(F.coalesce(F.sum(f"_all_{k}").over(over), F.lit(0)).alias(f"_before_{k}") for k in sums))
    joined = parts.join(before, F.col("_block").eqNullSafe(F.col("_b")))
    return joined.select(*df.columns, *((F.col(f"_in_{k}") + F.col(f"_before_{k}")).alias(k) for k in sums))


def with_ordinal(df: DataFrame, by: str, name: str = "ordinal", block: int = 1 << 16) -> DataFrame:
    """Row numbers from 1 along the unique whole number ``by``."""
    return running(df, [F.col(by)], F.floor(F.col(by) / block), {name: F.lit(1).cast("long")})
