"""Command line: build, predict, predtoseq, labels."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import evaluate
from .plans import classify
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ribolens", description="Classify transcripts as coding or non-coding.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "predict"):
        s = sub.add_parser(name)
        s.add_argument("-m", "--model", required=True)
        s.add_argument("--min_len", type=int, default=0)
        s.add_argument("--qcov_hsp", type=float, default=None, help="least coverage of a hit")
        s.add_argument("-d", "--proteins", help="FASTA of proteins to search where there are no hit files")
    b, q = sub.choices["build"], sub.choices["predict"]
    for short, name in (("-p", "--pos"), ("-n", "--neg")):
        b.add_argument(short, name, required=True)
    b.add_argument("--pos_hits")
    b.add_argument("--neg_hits")
    b.add_argument("--pos_orf")
    b.add_argument("--neg_orf")
    b.add_argument("-w", "--weights", help="table of hexamer weights for the ORF scorer")
    b.add_argument("--learn_weights", action="store_true", help="learn the ORF scorer's weights from the two classes")
    b.add_argument("--no_hits", action="store_true")
    b.add_argument("--no_orf", action="store_true")
    b.add_argument("-k", "--num_trees", type=int, default=1000)
    b.add_argument("--forests", type=int, default=5)
    b.add_argument("--groups", type=int, default=20)
    q.add_argument("-i", "--infile", required=True)
    q.add_argument("-o", "--out", required=True)
    q.add_argument("--hits")
    q.add_argument("--orf_report")
    q.add_argument("-l", "--labels")
    e = sub.add_parser("predtoseq")
    e.add_argument("-f", "--fasta", required=True)
    e.add_argument("-o", "--out", required=True)
    e.add_argument("-p", "--preds", required=True)
    e.add_argument("-l", "--label", default="0")
    e.add_argument("-s", "--cutoff", type=float, default=0.0)
    e.add_argument("--min", type=int, default=0)
    e.add_argument("--max", type=float, default=float("inf"))
    g = sub.add_parser("labels")
    g.add_argument("ones", type=int)
    g.add_argument("zeros", type=int)
    g.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("ribolens").getOrCreate()
    if a.command == "build":
        columns = classify.Groups(orf=not a.no_orf, hits=not a.no_hits)
        forest = classify.build(spark, a.pos, a.neg, a.model, columns, a.pos_hits, a.neg_hits, a.min_len, a.qcov_hsp, a.pos_orf, a.neg_orf, a.weights, a.learn_weights, a.proteins, trees=a.num_trees, forests=a.forests, groups=a.groups)
        print(f"out-of-bag accuracy {forest.oob}")
        forest.importances(spark).show(len(forest.features), truncate=False)
    elif a.command == "predict":
        preds, report = classify.predict(spark, a.infile, a.model, a.out, a.hits, a.orf_report, a.labels, a.min_len, a.qcov_hsp, a.proteins)
        evaluate.class_summary(preds).orderBy("prediction").show()
        if report is not None:
            report.show(truncate=False)
    elif a.command == "predtoseq":
        classify.predtoseq(spark, a.fasta, a.preds, a.out, a.label, a.cutoff, a.min, a.max).show()
    else:
        tables.label_generator(spark, a.ones, a.zeros).orderBy("ord").selectExpr("cast(label as string) as value").coalesce(1).write.mode("overwrite").text(a.out)


if __name__ == "__main__":
    main()
