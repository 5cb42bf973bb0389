"""A search from its options to a table of hits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqsweep.functions import score
from seqsweep.functions import seq as S
from seqsweep.operators import align, post, report, scan


@dataclass(frozen=True)
class Search:
    """Options of a search. Without a motif and an extract length no motif is read, and activity scores are 0.

    With `ungapped` (Hamming mode) hits have the bases that they cover instead of an alignment.
    """

    threshold: int = 3
    distance_mode: str = "levenshtein"
    strand: str = "both"
    region: str | None = None
    pam: str = ""
    pam_position: str = "3"
    pam_extract_length: int = 0
    compute_mismatches: bool = True
    ungapped: bool = False
    compute_scores: bool = True
    deduplicate: bool = True
    treat_u_as_t: bool = True
    max_hits: int = 0
    max_total_hits: int = 0
    penalties: score.Penalties = field(default_factory=dict)

    def check(self, *, summaries: bool = False) -> None:
        """Raises ValueError for options that do not go together."""
        if not 0 <= self.threshold <= 255:
            raise ValueError("the threshold must be between 0 and 255")
        if self.distance_mode not in ("hamming", "levenshtein"):
            raise ValueError("the distance mode must be hamming or levenshtein")
        if self.strand not in ("both", "plus", "minus"):
            raise ValueError("the strand must be both, plus or minus")
        if self.pam_position not in ("3", "5"):
            raise ValueError("the motif's position must be 3 or 5")
        if self.pam:
            S.motif_regex(self.pam)
        if self.ungapped and self.distance_mode != "hamming":
            raise ValueError("only Hamming hits are without gaps")
        if self.pam and not self.compute_mismatches and self.distance_mode == "levenshtein":
            raise ValueError("a motif filter in Levenshtein mode needs alignments")
        if summaries and (self.max_hits or self.max_total_hits):
            raise ValueError("caps and summaries do not go together")


def parse_region(text: str, lengths: dict[str, int]) -> tuple[str, int, int]:
    """(sequence, start, end), 0-based and half-open, of NAME or NAME:START-END (1-based, END exclusive)."""
    if text in lengths:
        return text, 0, lengths[text]
    name, _, span = text.rpartition(":")
    a, _, b = span.partition("-")
    if name not in lengths or not a.isdigit() or not b.isdigit():
        raise ValueError(f"no such region: {text}")
    start, end = int(a) - 1, int(b) - 1
    if start < 0 or end <= start or end > lengths[name]:
        raise ValueError(f"region out of range: {text}")
    return name, start, end


def search(tiles: DataFrame, guides: DataFrame, options: Search) -> DataFrame:
    """Hits of valid guides (spacer_idx, spacer, sequence), unordered; `post.order_columns` gives the output order.

    The guides are the query set and are collected (their number is checked by the scan); the genome is read once for
    all of them. Only hits are shuffled, for deduplication and caps.
    """
    options.check()
    rows = [(r[0], r[1]) for r in guides.select("spacer_idx", "sequence").limit(scan.MOST_PATTERNS + 1).collect()]
    if options.distance_mode == "hamming" and any(len(s) > 64 for _, s in rows):
        raise ValueError("Hamming mode takes guides of at most 64 bases")
    region = None
    if options.region:
        name = options.region if tiles.where(F.col("chrom") == options.region).limit(1).count() else options.region.rpartition(":")[0]
        lengths = {r[0]: r[1] for r in tiles.where(F.col("chrom") == name).select("chrom", "seq_len").limit(1).collect()}
        region = parse_region(options.region, lengths)
    flank = (options.pam_extract_length or len(options.pam)) + (options.threshold if options.distance_mode == "levenshtein" else 0)
    raw = scan.kernel(tiles, scan.oriented(rows, options.strand), k=options.threshold, mode=options.distance_mode, flank=flank, region=region)
    hits = align.annotate(raw, dict(rows), k=options.threshold, mode=options.distance_mode, motif=options.pam, side=options.pam_position, extract=options.pam_extract_length, alignments=options.compute_mismatches, ungapped=options.ungapped)
    merged = options.deduplicate and options.distance_mode == "levenshtein"
    if merged:
        hits = post.deduplicate(hits, k=options.threshold, side=options.pam_position)
    if options.max_hits:
        hits = post.cap_each(hits, options.max_hits, merged)
    if options.max_total_hits:
        hits = post.cap_all(hits, options.max_total_hits, merged)
    hits = hits.join(F.broadcast(guides.select("spacer_idx", "spacer", F.col("sequence").alias("pattern")).limit(scan.MOST_PATTERNS)), "spacer_idx")
    span = F.when(F.coalesce("target_len", F.lit(0)) > 0, F.col("target_len")).otherwise(F.length("pattern"))
    hits = hits.withColumn("start", F.greatest(F.col("end") - span, F.lit(0)))
    scored = options.compute_scores and options.compute_mismatches
    return hits.withColumn("cfd_score", score.activity(F.col("pattern"), F.col("aligned_seq"), F.col("cigar"), F.col("pam_seq"), options.penalties) if scored else F.lit(0.0))


def margin(longest: int, options: Search) -> int:
    """The tile margin that a search for guides of up to `longest` bases needs."""
    flank = (options.pam_extract_length or len(options.pam)) + (options.threshold if options.distance_mode == "levenshtein" else 0)
    return scan.margin_for(longest, options.threshold, flank)


def observed(hits: DataFrame) -> tuple[DataFrame, Observation]:
    """hits, and their run's totals: total_hits and, by distance, the least and the largest; known once a write or collect has run."""
    seen = Observation("seqsweep")
    return hits.observe(seen, F.count(F.lit(1)).alias("total_hits"), F.min("distance").alias("least_distance"), F.max("distance").alias("largest_distance")), seen


def summarise(hits: DataFrame, guides: DataFrame, options: Search, intervals: DataFrame | None = None, labels: tuple[str, ...] = (), threshold: float = 4.8) -> DataFrame:
    """The summary of each guide, with overlap counts where intervals are given."""
    options.check(summaries=True)
    marked = report.overlaps(hits, intervals) if intervals is not None else hits
    return report.guide_summary(marked, guides, labels=labels, threshold=threshold)
