import random

from ribolens.operators import hits, homology
from ribolens.schemas import HIT


def test_translation():
    assert homology.translate("ATGGCCTAA", 1) == "MA*"
    assert homology.translate("cATGGCCTAAg", 2) == "MA*"
    assert homology.translate("TTAGGCCAT", -1) == "MA*"
    assert homology.translate("ATGNCCTA", 1) == "MX" and homology.translate("AT", 1) == ""
    assert homology.translate("AUG", 1) == "M"


def test_seeds_find_the_frame(spark):
    dice = random.Random(1)
    back = {}
    for a in "TCAG":
        for b in "TCAG":
            for c in "TCAG":
                back.setdefault(homology.translate(a + b + c, 1), a + b + c)
    protein = "".join(dice.choices([r for r in back if r != "*"], k=60))
    gene = "".join(back[r] for r in protein)
    flip = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    noise = "".join(dice.choices("ACGT", k=200))
    rows = [("fwd", "AA" + gene), ("rev", flip + "C"), ("none", noise), ("empty", ""), ("null", None)]
    seqs = spark.createDataFrame(rows, "seq_id string, seq string")
    db = spark.createDataFrame([("P", protein), ("Q", "ACDEFGHIKLMNPQRSTVWY" * 2)], "seq_id string, seq string")
    found = homology.seed_hits(seqs, db)
    assert found.columns == HIT.fieldNames()
    out = {(r["qseqid"], r["sseqid"]): r for r in found.collect()}
    assert set(out) == {("fwd", "P"), ("rev", "P")}
    assert out["fwd", "P"]["qframe"] == 3 and out["rev", "P"]["qframe"] == -2
    assert out["fwd", "P"]["score"] == 60 and out["fwd", "P"]["evalue"] < 1e-20
    assert {r["seq_id"] for r in hits.hit_features(found).collect()} == {"fwd", "rev"}
