import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribolens.operators import evaluate, extract, hits, joins, model, orf, ordinal

HITS = "qseqid string, evalue double, bitscore double, qframe int"


def test_hit_features(spark):
    rows = [("a", 0.0, 5.0, 1), ("a", math.exp(-2), 1.0, 2), ("a", 1.0, 1.0, -3), ("b", 1.0, 2.0, -1), ("c", 1.0, 1.0, 1), ("c", 1.0, 1.0, 2), ("c", 1.0, 1.0, 3)]
    out = {r["seq_id"]: r for r in hits.hit_features(spark.createDataFrame(rows, HITS)).collect()}
    a = out["a"]
    assert (a["all_numhits"], a["all_Bitscore"], a["all_Frame_Entropy"]) == (3, 7.0, 1.0)
    assert a["all_HitScore"] == pytest.approx(252)
    assert out["b"]["all_Frame_Entropy"] == 1.0  # no framed hit
    assert out["c"]["all_Frame_Entropy"] == pytest.approx(math.log2(3))
    assert hits.hit_features(spark.createDataFrame([], HITS)).count() == 0


def test_join_hits_fills_defaults(spark):
    features = spark.createDataFrame([("T1",), ("T10",)], "seq_id string")
    found = hits.hit_features(spark.createDataFrame([("T10", 1.0, 3.0, 1)], HITS))
    out = {r["seq_id"]: tuple(r)[1:] for r in joins.join_hits(features, found).collect()}
    assert out["T1"] == (-1.0, 0.0, 2.0, 0.0)
    assert out["T10"] == (1.0, 0.0, 0.0, 3.0)


def test_substring_match(spark):
    ids = spark.createDataFrame([("T1",), ("T10",), ("X",)], "id string")
    lines = spark.createDataFrame([(0, "T10\t5"), (1, "T1\t7"), (2, "")], "o long, line string")
    out = {r["id"]: r["matched"] for r in joins.first_substring_match(ids, lines, "id", "line", "o").collect()}
    assert out == {"T1": "T10\t5", "T10": "T10\t5", "X": None}


def test_zip_and_ordinals(spark):
    n = 5000
    left = spark.range(n).select((F.col("id") * 37 + 5).alias("ord"), F.col("id").alias("a"))
    right = spark.range(n).select((F.col("id") * 11).alias("ord"), F.col("id").alias("b"))
    out = joins.zip_rows(left, right).drop("ord").collect()
    assert len(out) == n and all(r["a"] == r["b"] for r in out)
    with pytest.raises(ValueError):
        joins.zip_rows(left, right.limit(3))
    some = ordinal.with_ordinal(left, "ord", block=100).collect()
    assert all(r["ordinal"] == r["a"] + 1 for r in some)


def test_join_orf_strict(spark):
    f = spark.createDataFrame([("a",), ("b",)], "seq_id string")
    o = spark.createDataFrame([("a", 1.0, 2.0)], "seq_id string, score double, orf_coverage double")
    with pytest.raises(ValueError):
        joins.join_orf(f, o)
    assert joins.join_orf(f, o, strict=False).count() == 1


def test_metrics(spark):
    random.seed(3)
    rows = [(random.randint(0, 1), random.randint(0, 1), random.choice([0.1, 0.2, 0.5, 0.9])) for _ in range(300)] + [(2, 0, 0.5), (None, 1, 0.5)]
    df = spark.createDataFrame(rows, "label int, prediction int, score double")
    m = evaluate.metrics(evaluate.confusion(df)).first()
    tp, fn = sum(r[:2] == (1, 1) for r in rows), sum(r[:2] == (1, 0) for r in rows)
    assert (m["tp"], m["fn"], m["other"]) == (tp, fn, 2)
    assert m["sensitivity"] == pytest.approx(tp / (tp + fn))
    auc = evaluate.roc_auc(df, "score", "label", width=0.25).first()[0]
    pos, neg = [r[2] for r in rows if r[0] == 1], [r[2] for r in rows if r[0] == 0]
    assert auc == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
    points = {r["threshold"]: (r["tp"], r["fp"]) for r in evaluate.roc_points(df, "score", "label", width=0.25).collect()}
    assert points == {t: (sum(p >= t for p in pos), sum(n >= t for n in neg)) for t in (0.1, 0.2, 0.5, 0.9)}


def test_metrics_without_a_class(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "label int, prediction int, score double")
    m = evaluate.metrics(evaluate.confusion(df)).first()
    assert m["specificity"] is None and m["mcc"] is None and m["accuracy"] == 100.0
    assert evaluate.roc_auc(df, "score", "label").first()[0] is None
    none = evaluate.metrics(evaluate.confusion(df.limit(0))).first()
    assert none["accuracy"] is None


def test_labels_by_position(spark):
    p = spark.createDataFrame([(0, "a"), (5, "b")], "ord long, seq_id string")
    y = spark.createDataFrame([(0, 1), (1, 0)], "ord long, label int")
    assert {(r["seq_id"], r["label"]) for r in evaluate.join_labels(p, y).collect()} == {("a", 1), ("b", 0)}
    with pytest.raises(ValueError):
        evaluate.join_labels(p, y.limit(1))


def test_extract(spark):
    seqs = spark.createDataFrame([("a", "ACG", 3), ("b", "ACGTA", 5), ("c", "A" * 9, 9), ("b", "ACGTT", 5)], "seq_id string, seq string, seq_len int")
    preds = spark.createDataFrame([("a", 1, 0.9, 0.1), ("b", 1, 0.8, 0.2), ("c", 1, 0.8, 0.2), ("d", 1, 0.8, 0.2), ("e", 0, 0.1, 0.9)], "seq_id string, prediction int, p_coding double, p_noncoding double")
    assert [r["seq"] for r in extract.extract(seqs, preds, "1", 0.8, 4, 8).orderBy("seq").collect()] == ["ACGTA", "ACGTT"]
    assert tuple(extract.report(seqs, preds, 1, 0.8, 4, 8).first()) == (4, 1, 1, 1, 1)
    for bad in ((2, 0.5, 0, 9), (1, 1.5, 0, 9), (1, 0.5, 9, 9)):
        with pytest.raises(ValueError):
            extract.check(*bad)


def test_orf_scores(spark):
    w = orf.rule_weights()
    assert w[orf.hexamer_index("TAAAAA")] == -5.0 and w[orf.hexamer_index("GGGACT")] == 0.5
    random.seed(5)
    seqs = ["", None, "ACG", "GGGGGGGGG"] + ["".join(random.choices("ACGTN", k=k)) for k in (6, 7, 30, 200)]
    out = orf.score_orfs(spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "seq_id string, seq string"), w).collect()
    for r in out:
        s = seqs[int(r["seq_id"])] or ""
        for f in range(3):
            steps = [w[orf.hexamer_index(s[i : i + 6])] for i in range(f, len(s) - 5, 3)]
            want = max((sum(steps[i:j]) for i in range(len(steps)) for j in range(i + 1, len(steps) + 1)), default=0.0)
            assert r[f"score_f{f}"] == pytest.approx(want)
        assert 0 <= r["orf_coverage"] <= 100


def test_learned_weights(spark):
    coding = ["ATGGCC" * 20] * 5
    other = ["TTTTAA" * 20] * 5
    df = spark.createDataFrame([(s, 1) for s in coding] + [(s, 0) for s in other] + [(None, 1)], "seq string, label int")
    w = orf.learn_weights(df)
    assert w[orf.hexamer_index("ATGGCC")] > 1 > -1 > w[orf.hexamer_index("TTTTAA")]


def test_forest(spark, tmp_path):
    random.seed(2)
    rows = [(f"s{i}", y, y + random.gauss(0, 0.2), random.random()) for i in range(120) for y in (i % 2,)]
    df = spark.createDataFrame(rows, "seq_id string, label int, x double, y double")
    forest = model.train_best(df, ["x", "y"], forests=2, trees=4, groups=2, depth=4)
    assert forest.oob > 0.9
    top = forest.importances(spark).first()
    assert top["feature"] == "x"
    model.save(forest, spark, str(tmp_path / "m"))
    back = model.load(spark, str(tmp_path / "m"))
    a, b = (sorted(tuple(r) for r in model.predict(df, m).collect()) for m in (forest, back))
    assert a == b and back.features == ["x", "y"]
    with pytest.raises(ValueError):
        model.predict(df.drop("y"), back)
    assert model.select_best([0.5, None, 0.7, 0.7]) == 2
