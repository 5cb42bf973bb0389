"""What follows the search: one hit for each halo, order, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqsweep.functions import seq as S


def deduplicate(hits: DataFrame, *, k: int, side: str = "3") -> DataFrame:
    """The best hit of each island: hits of a guide, strand and sequence that follow each other by at most k positions.

    Best is the least distance, then the motif class (NGG, NAG, INCOMPLETE, OTHER), then the largest end.
    """
    group = Window.partitionBy("spacer_idx", "strand", "chrom_idx").orderBy("end")
    new = F.when(F.col("end") - F.lag("end").over(group) >= k + 1, 1).otherwise(0)
    islands = hits.withColumn("__new", new).withColumn("__island", F.sum("__new").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    priority = S.class_priority(S.motif_class(F.col("pam_seq"), side)) if "pam_seq" in hits.columns else F.lit(0)
    best = Window.partitionBy("spacer_idx", "strand", "chrom_idx", "__island").orderBy("distance", priority.desc(), F.desc("end"))
    return islands.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__new", "__island", "__rank")


def order_columns(deduplicated: bool) -> list:
    """By guide; then by strand and place after deduplication, by place and strand without."""
    place = ["chrom_idx", "end"]
    return ["spacer_idx", "strand", *place] if deduplicated else ["spacer_idx", *place, "strand"]


def cap_each(hits: DataFrame, most: int, deduplicated: bool) -> DataFrame:
    """The first `most` hits of each guide in output order."""
    order = Window.partitionBy("spacer_idx").orderBy(*order_columns(deduplicated)[1:])
    return hits.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank")


def cap_all(hits: DataFrame, most: int, deduplicated: bool) -> DataFrame:
    """The first `most` hits in output order (a top-n, not a sort of all hits)."""
    return hits.orderBy(*order_columns(deduplicated)).limit(most)
