"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, materialize


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component (its smallest node), of the nodes in ``links`` (a, b).

    Each round a node takes the smallest label among its neighbours' and its own, then its label's label. A node may have
    any number of links, and a component any number of nodes: minima are taken before the shuffle, and the rows of a node
    with many links, or of a label with many nodes, are dealt over many tasks. Every round is a table in the shared
    folder; it ends when no label changes.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    hubs = hot_keys(both, "b")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        theirs = labels.select(F.col("node").alias("b"), "component")
        seen = join_hot(both, theirs, "b", hubs, "a").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = materialize(labels.join(seen, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was")), "moved")
        jumps = moved.select(F.col("node").alias("to"), F.col("to").alias("jump"))
        new = join_hot(moved, jumps, "to", hot_keys(moved, "to"), "node").select("node", F.least("to", "jump").alias("component"), "was")
        new = materialize(new, "labels")
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            break
    else:
        raise RuntimeError("components have not settled")
    return labels
