"""Activity scores of hits as Column functions.

The position-specific mismatch penalties are a parameter: a mapping (position 1-20, guide base, text base) -> factor,
as published with the score; `load_penalties` reads them from a table. A missing entry counts as 1.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Penalties = dict[tuple[int, str, str], float]

# Factor of the last two bases of a three-base motif; all others are 0.
MOTIF_FACTORS = {"AG": 0.259, "CG": 0.107, "GA": 0.069, "GC": 0.022, "GG": 1.0, "GT": 0.016, "TG": 0.039}
TRAINED_LENGTH = 20


def load_penalties(spark: SparkSession, path: str) -> Penalties:
    """Penalties from a tab-separated table with columns position, guide, text, penalty (at most 20 x 4 x 4 rows)."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path).limit(20 * 4 * 4)
    return {(int(r["position"]), r["guide"].upper(), r["text"].upper()): float(r["penalty"]) for r in rows.collect()}


def linear_penalties() -> Penalties:
    """A stand-in rule for data without published penalties: a mismatch at position p keeps 1 - p / 25."""
    return {(p, a, b): 1 - p / 25 for p in range(1, TRAINED_LENGTH + 1) for a in "ACGT" for b in "ACGT" if a != b}


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())) if values else F.create_map().cast("map<string,double>")


def mismatch_penalty(position: Column, guide: Column, text: Column, penalties: Penalties) -> Column:
    """Factor of one aligned pair; 1 for a match, an unknown base or a position out of range."""
    key = F.concat(position.cast("string"), F.upper(guide), F.upper(text))
    table = _map({f"{p}{a}{b}": v for (p, a, b), v in penalties.items()})
    return F.when(F.upper(guide) == F.upper(text), 1.0).otherwise(F.coalesce(F.try_element_at(table, key), F.lit(1.0)))


def motif_penalty(motif: Column) -> Column:
    """Factor of a motif: bases 2 and 3, or both of a two-base motif; 0 if shorter, absent or unknown."""
    two = F.when(F.length(motif) >= 3, F.substring(motif, 2, 2)).when(F.length(motif) == 2, motif)
    return F.coalesce(F.try_element_at(_map(MOTIF_FACTORS), F.upper(two)), F.lit(0.0))


def class_penalty(motif_class: Column) -> Column:
    """Factor of a motif of which only the class is known: NGG and NAG have their bases' factor, others are inactive."""
    return F.coalesce(F.try_element_at(_map({"NGG": MOTIF_FACTORS["GG"], "NAG": MOTIF_FACTORS["AG"]}), motif_class), F.lit(0.0))


def activity(guide: Column, aligned: Column, cigar: Column, motif: Column, penalties: Penalties) -> Column:
    """Product of the penalties of the first 20 aligned pairs and of the motif's; 0 with an indel or without an alignment."""
    n = F.least(F.length(guide), F.length(aligned), F.lit(TRAINED_LENGTH))
    product = F.aggregate(F.sequence(F.lit(1), n), F.lit(1.0), lambda acc, i: acc * mismatch_penalty(i, F.substring(guide, i, F.lit(1)), F.substring(aligned, i, F.lit(1)), penalties))
    usable = aligned.isNotNull() & (F.length(aligned) > 0) & (F.length(guide) > 0) & ~F.coalesce(cigar.rlike("[ID]"), F.lit(False))
    return F.when(usable, product * motif_penalty(motif)).otherwise(0.0)


def seed_mismatches(guide: Column, aligned: Column, cigar: Column) -> Column:
    """Mismatches at positions 4 to 20, masked bases left out; -1 with an indel, 0 without an alignment."""
    n = F.least(F.length(guide), F.length(aligned), F.lit(20))
    g, t = (lambda i: F.upper(F.substring(guide, i, F.lit(1)))), (lambda i: F.upper(F.substring(aligned, i, F.lit(1))))
    differs = lambda i: F.when((g(i) != t(i)) & (g(i) != "N") & (t(i) != "N"), 1).otherwise(0)
    count = F.aggregate(F.sequence(F.lit(4), n), F.lit(0), lambda acc, i: acc + differs(i))
    return F.when(F.coalesce(cigar.rlike("[ID]"), F.lit(False)), -1).when(aligned.isNull() | (n < 4), 0).otherwise(count)
