"""Column functions over nucleotide sequences: base counts, entropy, hexamer matrix, codon positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BASES


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_count(seq: Column | str, base: str) -> Column:
    """How often ``base`` occurs; case-sensitive."""
    seq = column(seq)
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is 0."""
    return F.when(whole > 0, part * 100.0 / whole)


def base_percent(seq: Column | str, bases: str) -> Column:
    seq = column(seq)
    return percent(reduce(Column.__add__, [base_count(seq, b) for b in bases]), F.length(seq))


def entropy(counts: list[Column], empty: float | None) -> Column:
    """Shannon entropy, base 2, of the shares of ``counts``; ``empty`` where they sum to 0."""
    total = reduce(Column.__add__, counts)
    share = [c.cast("double") / F.when(total > 0, total) for c in counts]
    h = reduce(Column.__add__, [F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in share])
    return F.when(total > 0, h + 0.0).otherwise(F.lit(empty))


def sequence_entropy(seq: Column | str) -> Column:
    """Entropy over A, C, G, T; 0 for a sequence without any of them. The counts are made once, as the lambda's variable."""
    counts = F.array(*[base_count(seq, b) for b in BASES])
    return F.transform(F.array(counts), lambda n: entropy([n[i] for i in range(len(BASES))], 0.0))[0]


def hexamer_matrix(seq: Column | str) -> dict[str, Column]:
    """a1..a6, g1..g6, c1..c6, t1..t6: the share of the windows of six whose j-th base is that one; null under length 6.

    The j-th bases of all windows are the sequence without its first j - 1 and last 6 - j bases, so that a base is counted
    once over the whole sequence; the count stands outside of any condition, where Spark shares it among the columns.
    """
    seq = column(seq)
    windows = F.length(seq) - 5
    out = {}
    for base in "AGCT":
        for j in range(1, 7):
            ends = F.concat(F.left(seq, F.lit(j - 1)), F.right(seq, F.lit(6 - j)))
            out[f"{base.lower()}{j}"] = (base_count(seq, base) - base_count(ends, base)) / F.when(windows > 0, windows)
    return out


def codon_position(seq: Column | str, position: int) -> Column:
    """The bases at ``position`` (1 to 3) of the codons of frame 1, as a string."""
    return F.regexp_replace(column(seq), f"(?s)(.)(.?)(.?)", f"${position}")


def codon_position_gc(seq: Column | str, position: int) -> Column:
    """GC percent at one codon position; null where no base is there."""
    return base_percent(codon_position(seq, position), "GC")


def natural_log_or(v: Column, zero: float) -> Column:
    return F.when(v == 0, F.lit(zero)).otherwise(F.ln(F.when(v > 0, v)))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(column(seq), "ACGTacgt", "TGCAtgca"))
