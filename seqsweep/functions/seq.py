"""Column functions on nucleotide strings: complements, motif patterns and flanking motifs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and the bases they stand for; a masked base N of the text only matches code N.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGTN",
}


def reverse_complement(c: Column) -> Column:
    """Reverse complement of ACGTN, case kept."""
    return F.reverse(F.translate(c, "ACGTNacgtn", "TGCANtgcan"))


def reverse_complement_text(s: str) -> str:
    return s.translate(str.maketrans("ACGTNacgtn", "TGCANtgcan"))[::-1]


def uracil_to_thymine(c: Column) -> Column:
    return F.translate(c, "Uu", "Tt")


def valid_pattern(c: Column) -> Column:
    """Whether the string is a non-empty run of ACGTN in any case."""
    return F.coalesce(c.rlike("^[ACGTNacgtn]+$"), F.lit(False))


def motif_regex(motif: str) -> str:
    """The regular expression for an IUPAC motif, anchored at the start; what follows it is ignored."""
    motif = motif.upper()
    unknown = sorted(set(motif) - set(IUPAC))
    if unknown:
        raise ValueError(f"not IUPAC codes: {', '.join(unknown)}")
    return "^" + "".join(b if len(b := IUPAC[c]) == 1 else f"[{b}]" for c in motif)


def motif_matches(c: Column, motif: str) -> Column:
    """Whether the string begins with the motif; too short a string does not."""
    return F.coalesce(F.upper(c).rlike(motif_regex(motif)), F.lit(False))


def flank(text: Column, end: Column, span: Column, strand: Column, length: int, side: str) -> Column:
    """The motif bases beside a hit, in the hit's orientation: `span` bases of text end at 1-based position `end`.

    The side is 3' or 5' of the hit. At the text's edges fewer bases are left; null if there are none.
    """
    begin = F.greatest(end - span, F.lit(0))
    after = F.substring(text, end + 1, F.lit(length))
    take = F.least(begin, F.lit(length))
    before = F.substring(text, begin - take + 1, take)
    plus = strand == "+"
    forward_after = plus if side == "3" else ~plus
    raw = F.when(forward_after, after).otherwise(before)
    return F.nullif(F.when(plus, raw).otherwise(reverse_complement(raw)), F.lit(""))


def motif_class(c: Column, side: str = "3") -> Column:
    """NGG, NAG, INCOMPLETE or OTHER; a 5' motif is always OTHER."""
    if side != "3":
        return F.lit("OTHER")
    return F.when(c.isNull() | (F.length(c) < 3), "INCOMPLETE").when(F.substring(c, 2, 2) == "GG", "NGG").when(F.substring(c, 2, 2) == "AG", "NAG").otherwise("OTHER")


def class_priority(c: Column) -> Column:
    """The order of motif classes in ties: NGG, NAG, INCOMPLETE, OTHER."""
    return F.when(c == "NGG", 3).when(c == "NAG", 2).when(c == "INCOMPLETE", 1).otherwise(0)


def has_indel(cigar: Column) -> Column:
    return F.coalesce(cigar.rlike("[ID]"), F.lit(False))


def alignment_exists(pattern: Column, text: Column, k: int) -> Column:
    """Whether the whole pattern aligns with the whole text at a distance of at most k; a masked base of the text costs 1 (patterns have none)."""
    return F.coalesce(F.levenshtein(pattern, text, k) >= 0, F.lit(False))


def encode_text(c: Column) -> Column:
    """Letters of any text as bases, in turn A, C, G, T through the alphabet; z is masked. For tables without sequences."""
    return F.translate(F.lower(F.regexp_replace(c, "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAN")
