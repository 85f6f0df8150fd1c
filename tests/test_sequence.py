import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ribolens.functions import kmers, registry, sequence
from ribolens.schemas import TRIMERS, feature_order


def brute(seq):
    return [sum(seq[i : i + 3] == t for i in range(len(seq) - 2)) for t in TRIMERS]


def test_the_order_has_all_trimers_once():
    assert len(set(TRIMERS)) == 64
    assert [len(feature_order(o, h)) for o, h in ((False, False), (True, False), (False, True), (True, True))] == [65, 67, 69, 71]


@given(st.lists(st.text("ACGTNacgté", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_trimers_of_a_batch(seqs):
    assert kmers.count_trimers(pa.array(seqs, pa.string())).tolist() == [brute(s) for s in seqs]


def test_trimers_known(spark):
    rows = [("AAAAA",), ("",), ("A",), ("AC",), ("ACG",), ("acgACGNAC",), (None,)]
    df = spark.createDataFrame(rows, "seq string")
    out = df.select("seq", kmers.trimer_counts(F.col("seq")).alias("a"), kmers.trimer_counts_sql("seq").alias("b")).collect()
    for r in out:
        if r["seq"] is None:
            assert r["a"] is None
            continue
        assert list(r["a"]) == brute(r["seq"]) == list(r["b"])
    assert out[0]["a"][TRIMERS.index("AAA")] == 3


def test_trimer_shares(spark):
    random.seed(1)
    seqs = ["".join(random.choices("ACGT", k=n)) for n in (0, 1, 2, 3, 50)]
    out = kmers.with_trimers(spark.createDataFrame([(s,) for s in seqs], "seq string")).collect()
    for r in out:
        if r["length"] < 3:
            assert r["AAA"] is None
        else:
            assert sum(r[t] for t in TRIMERS) == pytest.approx(100)


def test_composition(spark):
    df = spark.createDataFrame([("AACG",), ("",), ("NNN",), ("AAAA",)], "seq string")
    r = df.select(sequence.base_percent("seq", "GC").alias("gc"), sequence.sequence_entropy("seq").alias("h")).collect()
    assert [x["gc"] for x in r] == [50.0, None, 0.0, 0.0]
    assert [x["h"] for x in r] == [1.5, 0.0, 0.0, 0.0]


def test_hexamers_and_codons(spark):
    seq = "ACGTACGTTA"
    r = spark.createDataFrame([(seq,), ("ACGTA",)], "seq string").select(*(c.alias(n) for n, c in sequence.hexamer_matrix("seq").items()), *(sequence.codon_position_gc("seq", k).alias(f"gc{k}") for k in (1, 2, 3))).collect()
    windows = [seq[i : i + 6] for i in range(len(seq) - 5)]
    for base in "AGCT":
        for j in range(1, 7):
            assert r[0][f"{base.lower()}{j}"] == pytest.approx(sum(w[j - 1] == base for w in windows) / len(windows))
    assert r[1]["a1"] is None
    for k in (1, 2, 3):
        part = seq[k - 1 :: 3]
        assert r[0][f"gc{k}"] == pytest.approx(100 * sum(b in "GC" for b in part) / len(part))


def test_sql_names(spark):
    registry.register(spark)
    r = spark.sql("SELECT base_count('AACG', 'A') a, gc_percent('AACG') gc, gc_percent('') e, reverse_complement('AACG') rc, trimer_counts('AAAA') t").first()
    assert (r["a"], r["gc"], r["e"], r["rc"], sum(r["t"])) == (2, 50.0, None, "CGTT", 2)
