import pytest
from pyspark.sql import functions as F

from ribolens.sources import fasta, tables


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta(spark, tmp_path, end):
    text = end.join([">t1 first > one", "ACGT", "AC", ">t2", "", ">t3\tx", "N" * 7, ">t1 again", "GG"])
    (tmp_path / "a.fa").write_bytes(text.encode())
    rows = [tuple(r)[1:] for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()]
    assert rows == [("t1", "t1 first > one", "ACGTAC", 6), ("t2", "t2", "", 0), ("t3", "t3\tx", "N" * 7, 7), ("t1", "t1 again", "GG", 2)]


def test_fasta_empty(spark, tmp_path):
    (tmp_path / "e.fa").write_text("")
    assert fasta.read_fasta(spark, str(tmp_path / "e.fa")).count() == 0


def test_fasta_in_many_splits(spark, tmp_path):
    records = [(f"s{i}", "ACGT" * (i % 90)) for i in range(3000)]
    df = spark.createDataFrame([(i, s, f"{s} about it", q) for i, (s, q) in enumerate(records)], "ord long, seq_id string, description string, seq string")
    path = str(tmp_path / "w")
    fasta.write_fasta(df.coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = fasta.read_fasta(spark, path)
        assert back.rdd.getNumPartitions() > 3
        assert [(r["seq_id"], r["seq"]) for r in back.orderBy("ord").collect()] == records
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert max(len(x) for x in spark.read.text(path).toPandas()["value"]) <= 60


def test_hits(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("q1\ts\t90.5\t0\t1\t40\t10\t50\t1\t1\nq1\ts\t90\t1e-5\t1\t20\t10\t7\t-1\t+\nbroken line here\n")
    rows = tables.read_hits(spark, str(tmp_path / "h.tsv")).cache()
    assert tables.good_hits(rows).count() == 2
    assert tables.corrupt_hits(rows).first()[0] == 1
    rows.unpersist()


def test_orf_report(spark):
    lines = ["junk", ">a [framefinder (3,2109) score=12.5 used=99.86% {forward,strict} ]\r", ">b [x score=-3.25 used=100% {forward} ]", ">c no brace score=1.0", "ACGT{"]
    rows = tables.parse_orf(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in rows] == [("a", 12.5, 99.86), ("b", -3.25, 100.0)]


def test_labels_weights_predictions(spark, tmp_path):
    (tmp_path / "l").write_text("0\n1\n1\nx\n")
    assert [r["label"] for r in tables.read_labels(spark, str(tmp_path / "l")).orderBy("ord").collect()] == [0, 1, 1, None]
    (tmp_path / "w").write_text("#Info a\n#Info b\n-1.5 AAAAAA\n0.25 ACGTNN\n")
    assert {(r[0], r[1]) for r in tables.read_hexamer_weights(spark, str(tmp_path / "w")).collect()} == {("AAAAAA", -1.5), ("ACGTNN", 0.25)}
    df = spark.createDataFrame([("a", 1, 0.75, 0.25)], "seq_id string, prediction int, p_coding double, p_noncoding double")
    tables.write_predictions(df, str(tmp_path / "p"))
    assert tables.read_predictions(spark, str(tmp_path / "p")).collect() == df.collect()
    assert [r["label"] for r in tables.label_generator(spark, 2, 3).orderBy("ord").collect()] == [1, 1, 0, 0, 0]


def test_feature_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5, 2.0)], "label int, seq_id string, AAA double, length double")
    tables.write_features(df, str(tmp_path / "f"), ["AAA", "length"])
    assert tables.read_features(spark, str(tmp_path / "f"), ["AAA", "length"]).select(*df.columns).collect() == df.collect()
    assert df.select(F.col("AAA")).first()[0] == 0.5
