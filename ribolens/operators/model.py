"""Random forests: grouped out-of-bag training, choice of the best of several, scoring, saving with their features."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forests that a build tries, and trees of each.
FORESTS, TREES = 5, 1000


@dataclass
class Forest:
    """An ensemble of groups of trees over ordered ``features``; its score is its out-of-bag accuracy."""

    features: list[str]
    groups: list[RandomForestClassificationModel]
    oob: float | None = None
    seed: int = 0
    meta: dict = field(default_factory=dict)

    def importances(self, spark: SparkSession) -> DataFrame:
        """feature, importance of this forest, rounded to 4 places; largest first, then by name, both descending."""
        sums = [0.0] * len(self.features)
        for g in self.groups:
            for i, v in enumerate(g.featureImportances.toArray()):
                sums[i] += float(v) / len(self.groups)
        rows = spark.createDataFrame(list(zip(self.features, sums)), "feature string, importance double")
        return sort_importances(rows)


def sort_importances(rows: DataFrame) -> DataFrame:
    rounded = rows.withColumn("importance", F.round("importance", 4))
    return rounded.orderBy(F.desc("importance"), F.desc("feature"))


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with the vector ``features``; raises where a column is missing."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"the model needs columns that are not there: {', '.join(missing[:5])}")
    numbers = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in features})
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(numbers)


def _subset(n: int) -> str:
    """Features tried at a split: the whole part of the square root."""
    return str(max(1, int(n**0.5)))


def poisson_weight(key: Column, group: int, seed: int) -> Column:
    """A Poisson(1) draw from a hash of the row's key: how often a bootstrap of this group holds the row."""
    u = (F.pmod(F.xxhash64(key, F.lit(group), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    bounds, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        bounds.append((k, total))
        p /= k + 1
    out = F.lit(8.0)
    for k, bound in reversed(bounds):
        out = F.when(u < bound, float(k)).otherwise(out)
    return out


def train(df: DataFrame, features: list[str], trees: int = TREES, groups: int = 20, seed: int = 1, key: str = "seq_id", depth: int = 30) -> Forest:
    """A forest of ``groups`` bootstraps; rows that a group's bootstrap leaves out are out of bag for all its trees.

    ``df`` has label (0 or 1), ``key`` and the feature columns. The out-of-bag accuracy averages, for each row, the
    probabilities of the groups that left it out.
    """
    rows = assemble(df, features).select(F.col(key).alias("_key"), F.col("label").cast("double").alias("label"), "features").persist()
    try:
        each = max(1, trees // groups)
        made, scored = [], None
        for g in range(groups):
            weighted = rows.withColumn("_w", poisson_weight(F.col("_key"), g, seed))
            fit = RandomForestClassifier(
                numTrees=each, maxDepth=depth, maxBins=128, featureSubsetStrategy=_subset(len(features)), impurity="gini", weightCol="_w", bootstrap=False, seed=seed * 1000 + g
            ).fit(weighted.filter("_w > 0"))
            made.append(fit)
            left = fit.transform(weighted.filter("_w = 0")).select("_key", "label", vector_to_array("probability")[1].alias("p"))
            scored = left if scored is None else scored.unionByName(left)
        mean = scored.groupBy("_key").agg(F.avg("p").alias("p"), F.first("label").alias("label"))
        oob = mean.agg(F.avg(((F.col("p") > 0.5).cast("double") == F.col("label")).cast("double"))).first()[0]
    finally:
        rows.unpersist()
    return Forest(features, made, oob, seed)


def select_best(scores: list[float | None]) -> int:
    """The place of the largest score; the earliest of equals."""
    return max(range(len(scores)), key=lambda i: (scores[i] if scores[i] is not None else -1.0, -i))


def train_best(df: DataFrame, features: list[str], forests: int = FORESTS, **options) -> Forest:
    """The forest with the best out-of-bag accuracy of ``forests`` seeds."""
    seed = options.pop("seed", 1)
    made = [train(df, features, seed=seed + i, **options) for i in range(forests)]
    return made[select_best([m.oob for m in made])]


def predict(df: DataFrame, forest: Forest, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """``keep`` columns, prediction, p_coding, p_noncoding: the mean of the groups' probabilities."""
    rows = assemble(df, forest.features)
    names = []
    for i, g in enumerate(forest.groups):
        g = g.copy()
        g.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_p{i}")
        rows = g.transform(rows)
        names.append(f"_p{i}")
    p = sum((vector_to_array(n)[1] for n in names[1:]), vector_to_array(names[0])[1]) / len(names)
    out = rows.withColumn("p_coding", p)
    return out.select(*keep, (F.col("p_coding") > 0.5).cast("int").alias("prediction"), "p_coding", (1 - F.col("p_coding")).alias("p_noncoding"))


def save(forest: Forest, spark: SparkSession, path: str) -> None:
    """The groups as Spark ML models, and the ordered features beside them."""
    for i, g in enumerate(forest.groups):
        g.write().overwrite().save(f"{path}/group-{i:04d}")
    meta = json.dumps({"features": forest.features, "groups": len(forest.groups), "oob": forest.oob, "seed": forest.seed, "meta": forest.meta})
    spark.createDataFrame([(meta,)], T.StructType([T.StructField("value", T.StringType())])).coalesce(1).write.mode("overwrite").text(f"{path}/forest")


def load(spark: SparkSession, path: str) -> Forest:
    meta = json.loads(spark.read.text(f"{path}/forest").first()[0])
    groups = [RandomForestClassificationModel.load(f"{path}/group-{i:04d}") for i in range(meta["groups"])]
    return Forest(meta["features"], groups, meta["oob"], meta["seed"], meta.get("meta", {}))


__all__ = ["Forest", "assemble", "load", "predict", "save", "select_best", "sort_importances", "train", "train_best"]
