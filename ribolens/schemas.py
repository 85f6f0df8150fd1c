"""Schemas, feature order and defaults of the transcript classifier."""

from __future__ import annotations

from pyspark.sql import types as T

# The order of the trimer columns, as existing models expect it.
TRIMERS = (
    "AAT ATT AAA TTT CCA TGG AAC GTT ACT AGT CCG CGG ATC GAT AAG CTT "
    "CGC GCG AGG CCT GAA TTC ACG CGT ACC GGT GAC GTC CCC GGG ACA TGT "
    "CGA TCG GGA TCC CAA TTG AGC GCT GTA TAC AGA TCT CTC GAG CAC GTG "
    "TAA TTA GCA TGC CTA TAG GCC GGC ATG CAT CAG CTG ATA TAT TCA TGA"
).split()
# Names and order of the other feature columns.
ORF_FEATURES = ["score", "orf_coverage"]
HIT_FEATURES = ["all_numhits", "all_HitScore", "all_Frame_Entropy", "all_Bitscore"]
# What a sequence without hits gets, in the order of HIT_FEATURES.
NO_HITS = (-1.0, 0.0, 2.0, 0.0)

BASES = "ACGT"


def feature_order(orf: bool = True, hits: bool = True) -> list[str]:
    """The ordered feature columns of a model: 65, 67, 69 or 71."""
    return [*TRIMERS, "length", *(ORF_FEATURES if orf else []), *(HIT_FEATURES if hits else [])]


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _struct(text: str) -> T.StructType:
    """A schema from ``name kind, ...``; unlike DDL it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


TRANSCRIPT = _struct("ord long, seq_id string, description string, seq string, seq_len int")
HIT = _struct("qseqid string, sseqid string, pident double, evalue double, qcovs double, qcovhsp double, score double, bitscore double, qframe int, sframe string")
ORF = _struct("seq_id string, score double, orf_coverage double")
PREDICTION = _struct("seq_id string, prediction int, p_coding double, p_noncoding double")
