"""The three plans: build a model, predict with it, and extract the sequences of a class."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import with_trimers
from ..operators import evaluate, extract, hits, homology, joins, model, orf
from ..schemas import feature_order
from ..sources import fasta, tables


@dataclass(frozen=True)
class Groups:
    """Which feature groups a model uses beside the trimers and the length."""

    orf: bool = True
    hits: bool = True


def features(seqs: DataFrame, groups: Groups, hit_rows: DataFrame | None = None, orf_rows: DataFrame | None = None, weights: np.ndarray | None = None, min_qcovhsp: float | None = None) -> DataFrame:
    """The feature matrix: one row per sequence, other columns of ``seqs`` kept.

    ORF columns come from ``orf_rows`` (a parsed report) or, without one, from the surrogate scorer with ``weights``.
    """
    out = with_trimers(seqs)
    if groups.orf:
        if orf_rows is None:
            made = orf.score_orfs(seqs, orf.rule_weights() if weights is None else weights)
            orf_rows = made.select("seq_id", F.col("orf_score_approx").alias("score"), "orf_coverage")
        out = joins.join_orf(out, orf_rows, strict=False)
    if groups.hits:
        if hit_rows is None:
            raise ValueError("hits are needed, or Groups(hits=False)")
        rows = hits.coverage_filter(hit_rows, min_qcovhsp) if min_qcovhsp is not None else hit_rows
        out = joins.join_hits(out, hits.hit_features(rows))
    return out


def build(spark: SparkSession, pos: str, neg: str, out: str, columns: Groups = Groups(), pos_hits: str | None = None, neg_hits: str | None = None, min_len: int = 0, min_qcovhsp: float | None = None, pos_orf: str | None = None, neg_orf: str | None = None, weights: str | None = None, learn: bool = False, proteins: str | None = None, **training) -> model.Forest:
    """Train on two FASTA files and save the best forest to ``out``. Both classes pass the features in one go.

    Hits come from files of both classes or, without them, from the seed search of ``proteins`` (FASTA). ORF columns come
    from reports of both classes, else from the surrogate scorer, whose weights are a table's (``weights``), are learned
    from the two classes (``learn``; the out-of-bag score then has seen them), or are a rule; they are saved with the model.
    """
    seqs = joins.union_classes(fasta.read_fasta(spark, neg), fasta.read_fasta(spark, pos))
    seqs = extract.min_length(seqs, min_len) if min_len else seqs
    found = None
    if columns.hits:
        if proteins and not pos_hits and not neg_hits:
            found = homology.seed_hits(seqs, fasta.read_fasta(spark, proteins))
        elif not pos_hits or not neg_hits:
            raise ValueError("hit files of both classes or proteins are needed, or Groups(hits=False)")
        else:
            found = tables.good_hits(tables.read_hits(spark, pos_hits)).unionByName(tables.good_hits(tables.read_hits(spark, neg_hits)))
    reports, used = None, None
    if bool(pos_orf) != bool(neg_orf):
        raise ValueError("ORF reports of both classes are needed, or of none")
    if columns.orf and pos_orf:
        reports = tables.read_orf(spark, pos_orf).unionByName(tables.read_orf(spark, neg_orf))
    elif columns.orf and weights:
        used = orf.table_weights(tables.read_hexamer_weights(spark, weights))
    elif columns.orf and learn:
        used = orf.learn_weights(seqs)
    rows = features(seqs, columns, hit_rows=found, orf_rows=reports, weights=used, min_qcovhsp=min_qcovhsp)
    forest = model.train_best(rows.filter("seq_len > 2"), feature_order(columns.orf, columns.hits), **training)
    forest.meta = {"reports": reports is not None, "weights": used is not None}
    model.save(forest, spark, out)
    if used is not None:
        named = {"".join(h): float(w) for h, w in zip(product(orf.LETTERS, repeat=6), used)}
        tables.write_hexamer_weights(spark, named, f"{out}/weights")
    return forest


def predict(spark: SparkSession, infile: str, model_path: str, out: str | None = None, hit_file: str | None = None, orf_report: str | None = None, labels: str | None = None, min_len: int = 0, min_qcovhsp: float | None = None, proteins: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Predictions, in the order of the FASTA file, and the evaluation against ``labels`` (None without them).

    Labels are matched to the unfiltered input by position, so a length filter doesn't shift them. Without a hit file, the
    seed search of ``proteins`` finds the hits; a model of ORF reports needs one, others use the weights they were built with.
    """
    forest = model.load(spark, model_path)
    groups = Groups("score" in forest.features, "all_numhits" in forest.features)
    seqs = fasta.read_fasta(spark, infile)
    if labels is not None:
        seqs = evaluate.join_labels(seqs, tables.read_labels(spark, labels))
    seqs = extract.min_length(seqs, min_len) if min_len else seqs
    found = tables.good_hits(tables.read_hits(spark, hit_file)) if hit_file else None
    if found is None and groups.hits and proteins:
        found = homology.seed_hits(seqs, fasta.read_fasta(spark, proteins))
    if groups.orf and forest.meta.get("reports") and not orf_report:
        raise ValueError("the model was built on ORF reports and needs one")
    weights = orf.table_weights(tables.read_hexamer_weights(spark, f"{model_path}/weights")) if forest.meta.get("weights") else None
    rows = features(seqs, groups, hit_rows=found, weights=weights, orf_rows=tables.read_orf(spark, orf_report) if orf_report else None, min_qcovhsp=min_qcovhsp)
    keep = ("ord", "seq_id", *(("label",) if labels is not None else ()))
    preds = model.predict(rows, forest, keep)
    if out:
        tables.write_predictions(preds.orderBy("ord"), out)
    report = None
    if labels is not None:
        report = evaluate.metrics(evaluate.confusion(preds)).join(F.broadcast(evaluate.roc_auc(preds, "p_coding", "label")))
    return preds, report


def predtoseq(spark: SparkSession, fasta_file: str, preds_file: str, out: str, label: int | str = 0, cutoff: float = 0.0, min_len: int = 0, max_len: float = float("inf")) -> DataFrame:
    """Write the sequences of a predicted class as FASTA; returns the counters."""
    seqs, preds = fasta.read_fasta(spark, fasta_file), tables.read_predictions(spark, preds_file)
    fasta.write_fasta(extract.extract(seqs, preds, label, cutoff, min_len, max_len), out)
    return extract.report(seqs, preds, label, cutoff, min_len, max_len)
