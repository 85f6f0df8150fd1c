import random

import duckdb
import pytest

import __spark_entry__ as entry_module
from ribolens import cli
from ribolens.operators import homology, joins, orf
from ribolens.plans import catalogue, classify
from ribolens.sources import fasta, tables
from ribolens.streaming import scoring

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"rf_predict"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_against_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_module.entry(spark).columns[0] == "doc_id"
    assert set(catalogue.QUERIES) <= set(entry_module.queries())
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == SLOW


def write(path, rows):
    path.write_bytes("".join(f">{i} about\r\n{s}\r\n" for i, s in rows).encode())


def test_build_predict_extract(spark, tmp_path, capsys):
    random.seed(4)
    seq = lambda w: "".join(random.choices("ACGT", w, k=random.randint(60, 200)))
    pos, neg = [(f"p{i}", seq([1, 4, 4, 1])) for i in range(30)], [(f"n{i}", seq([4, 1, 1, 4])) for i in range(30)]
    write(tmp_path / "pos.fa", pos)
    write(tmp_path / "neg.fa", neg)
    write(tmp_path / "test.fa", neg[:5] + pos[:5] + [("short", "ACGTACGT")])
    (tmp_path / "labels").write_text("0\n" * 5 + "1\n" * 5 + "1\n")
    hits = "".join(f"{i}\tx\t90\t1e-9\t1\t50\t9\t40\t{1 + k % 3}\t1\n" for k, (i, _) in enumerate(pos))
    (tmp_path / "pos.tsv").write_text(hits + "bad line\n")
    (tmp_path / "neg.tsv").write_text("n0\tx\t90\t1.0\t1\t50\t9\t4\t-1\t1\n")
    p = lambda x: str(tmp_path / x)
    forest = classify.build(spark, p("pos.fa"), p("neg.fa"), p("model"), pos_hits=p("pos.tsv"), neg_hits=p("neg.tsv"), trees=4, groups=2, forests=2, depth=5)
    assert len(forest.features) == 71 and forest.oob > 0.8
    preds, report = classify.predict(spark, p("test.fa"), p("model"), p("preds"), p("pos.tsv"), labels=p("labels"), min_len=20)
    assert [r["seq_id"] for r in preds.orderBy("ord").collect()] == [i for i, _ in neg[:5] + pos[:5]]
    r = report.first()
    assert (r["tp"], r["tn"]) == (5, 5) and r["auc"] == 1.0
    counts = classify.predtoseq(spark, p("test.fa"), p("preds"), p("out"), label="1", cutoff=0.5).first()
    assert tuple(counts) == (5, 0, 0, 5, 0)
    assert {x["seq_id"] for x in fasta.read_fasta(spark, p("out")).collect()} == {i for i, _ in pos[:5]}
    cli.main(["predtoseq", "-f", p("test.fa"), "-p", p("preds"), "-o", p("out2"), "-l", "0"])
    assert "matched" in capsys.readouterr().out
    cli.main(["predict", "-i", p("test.fa"), "-m", p("model"), "-o", p("preds3"), "--hits", p("pos.tsv")])
    assert "fraction" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["predict", "-m", "x"])

    plain = classify.build(spark, p("pos.fa"), p("neg.fa"), p("plain"), classify.Groups(False, False), trees=4, groups=2, forests=1, depth=4)
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.fa", neg[:3] + pos[:3])
    scoring.score_stream(spark, p("in"), plain, p("scored"), p("check")).awaitTermination(120)
    assert spark.read.parquet(p("scored")).count() == 6
    with pytest.raises(ValueError):
        classify.predict(spark, p("test.fa"), p("model"))[0].count()


def test_build_without_hit_files(spark, tmp_path, capsys):
    random.seed(5)
    seq = lambda w: "".join(random.choices("ACGT", w, k=random.randint(90, 150)))
    pos, neg = [(f"p{i}", seq([1, 4, 4, 1])) for i in range(20)], [(f"n{i}", seq([4, 1, 1, 4])) for i in range(20)]
    write(tmp_path / "pos.fa", pos)
    write(tmp_path / "neg.fa", neg)
    write(tmp_path / "test.fa", neg[:4] + pos[:4])
    write(tmp_path / "db.fa", [(f"d{i}", homology.translate(s, 1).replace("*", "X")) for i, s in pos])
    p = lambda x: str(tmp_path / x)
    small = ["-k", "4", "--groups", "2", "--forests", "1"]
    cli.main(["build", "-p", p("pos.fa"), "-n", p("neg.fa"), "-m", p("model"), "-d", p("db.fa"), "--learn_weights", *small])
    cli.main(["predict", "-i", p("test.fa"), "-m", p("model"), "-o", p("preds"), "-d", p("db.fa")])
    assert "fraction" in capsys.readouterr().out
    got = {r["seq_id"]: r["prediction"] for r in tables.read_predictions(spark, p("preds")).collect()}
    assert got == {**{i: 0 for i, _ in neg[:4]}, **{i: 1 for i, _ in pos[:4]}}

    saved = orf.table_weights(tables.read_hexamer_weights(spark, p("model") + "/weights"))
    learned = orf.learn_weights(joins.union_classes(fasta.read_fasta(spark, p("neg.fa")), fasta.read_fasta(spark, p("pos.fa"))))
    assert saved.tolist() == learned.tolist() and saved.any()

    for name, rows in (("pos.orf", pos), ("neg.orf", neg), ("all.orf", neg[:4] + pos[:4])):
        (tmp_path / name).write_text("".join(f">{i} {{score={3.5 if i[0] == 'p' else -1} used=50}}\n" for i, _ in rows))
    cli.main(["build", "-p", p("pos.fa"), "-n", p("neg.fa"), "-m", p("reports"), "--no_hits", "--pos_orf", p("pos.orf"), "--neg_orf", p("neg.orf"), *small])
    preds, _ = classify.predict(spark, p("test.fa"), p("reports"), orf_report=p("all.orf"))
    assert preds.count() == 8
    with pytest.raises(ValueError):
        classify.predict(spark, p("test.fa"), p("reports"))
    with pytest.raises(ValueError):
        classify.build(spark, p("pos.fa"), p("neg.fa"), p("x"), classify.Groups(hits=False), pos_orf=p("pos.orf"))
