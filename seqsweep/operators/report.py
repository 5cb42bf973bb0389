"""Summaries of hits, overlaps with annotated intervals, and output forms."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from seqsweep.functions import score

BIN = 1 << 14
#: Bins of intervals that are sent to all tasks; beyond, hits are shuffled by their bin.
MOST_BINS = 1_000_000


def by_distance(hits: DataFrame, guides: DataFrame) -> DataFrame:
    """spacer_idx, spacer, sequence, total_hits and a map from distance to count, for every guide."""
    counts = hits.groupBy("spacer_idx", "distance").count().groupBy("spacer_idx").agg(F.sum("count").alias("total_hits"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("distance", "count")))).alias("by_distance"))
    out = guides.select("spacer_idx", "spacer", "sequence").join(counts, "spacer_idx", "left")
    return out.select("spacer_idx", "spacer", "sequence", F.coalesce("total_hits", F.lit(0)).alias("total_hits"), F.coalesce("by_distance", F.create_map().cast("map<int,bigint>")).alias("by_distance"))


def pivot(hits: DataFrame, guides: DataFrame, k: int) -> DataFrame:
    """spacer_idx, spacer, sequence, total_hits, d0 ... dk."""
    counts = hits.groupBy("spacer_idx").agg(F.count("*").alias("total_hits"), *[F.count_if(F.col("distance") == d).alias(f"d{d}") for d in range(k + 1)])
    return guides.select("spacer_idx", "spacer", "sequence").join(counts, "spacer_idx", "left").na.fill(0)


def overlaps(hits: DataFrame, intervals: DataFrame) -> DataFrame:
    """hits with, for each, the labels of intervals that it overlaps (a sorted array).

    Intervals are cut at the borders of bins of positions, and gathered by bin; a hit looks into the one or two bins
    that it touches (hits are shorter than a bin), so the search that gives the hits runs once.
    """
    spans = intervals.where("end > start").select("label", "chrom", "start", "end", F.explode(F.expr(f"sequence(start div {BIN}, (end - 1) div {BIN})")).alias("bin"))
    piece = F.struct(F.greatest(F.col("start"), F.col("bin") * BIN).alias("i0"), F.least(F.col("end"), (F.col("bin") + 1) * BIN).alias("i1"), "label")
    bins = spans.groupBy(F.col("chrom").alias("__chrom"), F.col("bin").alias("__bin")).agg(F.collect_set(piece).alias("__pieces"))
    bins = F.broadcast(bins) if bins.limit(MOST_BINS + 1).count() <= MOST_BINS else bins
    out = hits
    for n, place in enumerate((F.col("start"), F.greatest(F.col("start"), F.col("end") - 1))):
        side = bins.withColumnRenamed("__pieces", f"__pieces{n}")
        out = out.join(side, (F.col("chrom") == F.col("__chrom")) & (F.floor(place / BIN) == F.col("__bin")), "left").drop("__chrom", "__bin")
    met = lambda c: F.transform(F.filter(F.coalesce(c, F.array()), lambda x: (x["i0"] < F.col("end")) & (x["i1"] > F.col("start"))), lambda x: x["label"])
    return out.withColumn("labels", F.sort_array(F.array_distinct(F.concat(met(F.col("__pieces0")), met(F.col("__pieces1")))))).drop("__pieces0", "__pieces1")


def guide_summary(hits: DataFrame, guides: DataFrame, *, labels: tuple[str, ...] = (), threshold: float = 4.8) -> DataFrame:
    """One row for each guide: hits in distance buckets, seed sites, aggregate activity, promiscuity, overlaps by label.

    hits has aligned_seq, cigar, cfd_score and, with labels, `labels`. The aggregate is null for guides not of 20 bases.
    """
    h = hits.join(F.broadcast(guides.select("spacer_idx", F.col("sequence").alias("__guide"))), "spacer_idx")  # as the search sends them
    h = h.withColumn("__seed", score.seed_mismatches(F.col("__guide"), F.col("aligned_seq"), F.col("cigar")))  # a column, or each sum counts anew
    near = (F.col("__seed") >= 0) & (F.col("__seed") <= 1) & (F.col("cfd_score") >= 0)
    d = F.col("distance")
    sums = [F.count("*").alias("total_hits"), F.count_if(d == 0).alias("n_d0"), F.count_if(d == 1).alias("n_d1"), F.count_if(d == 2).alias("n_d2"), F.count_if(d >= 3).alias("n_d3p"), F.count_if(near).alias("n_sdr1_sites"), F.sum(F.when(near, F.col("cfd_score"))).alias("__sum")]
    sums += [F.count_if(F.array_contains("labels", x)).alias(f"n_{x}_overlaps") for x in labels]
    out = guides.select("spacer_idx", "spacer", "sequence").join(h.groupBy("spacer_idx").agg(*sums), "spacer_idx", "left")
    out = out.na.fill(0, [c for c in out.columns if c.startswith("n_") or c == "total_hits"])
    available = F.length("sequence") == 20
    out = out.withColumn("aggregate_cfd", F.when(available, F.coalesce("__sum", F.lit(0.0)))).withColumn("n_sdr1_sites", F.when(available, F.col("n_sdr1_sites")).otherwise(0))
    return out.withColumn("promiscuous", F.coalesce(F.col("aggregate_cfd") > threshold, F.lit(False))).drop("__sum")


def guide_summary_tsv(rows: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """The text columns of a summary of guides; without an aggregate (guides not of 20 bases) three columns are a dot."""
    known = F.col("aggregate_cfd").isNotNull()
    text = lambda c: F.when(known, c).otherwise(".")
    return rows.select(
        "spacer", "sequence", *[F.col(c).cast("string").alias(c) for c in ("n_d0", "n_d1", "n_d2", "n_d3p")], text(F.col("n_sdr1_sites").cast("string")).alias("n_sdr1_sites"),
        text(six_digits(F.col("aggregate_cfd"))).alias("aggregate_cfd"), text(F.col("promiscuous").cast("string")).alias("is_promiscuous"), *[F.col(f"n_{x}_overlaps").cast("string").alias(f"n_{x}_overlaps") for x in labels],
    )


TSV = ["chrom", "start", "end", "pattern", "distance", "strand", "aligned_seq", "cigar", "pam_seq", "alignment_ambiguous", "n_ambiguous_cells", "cfd_score"]


def six_digits(c: Column) -> Column:
    """A number with six significant digits and no trailing zeros, as %g writes it."""
    plain = F.format_string("%.6g", c)
    return F.when(c == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", ""))


def bed_rows(hits: DataFrame, *, batch: bool = True) -> DataFrame:
    """BED6 with the pattern as name, the score being its length less the distance; of many guides a seventh column has the guide's name."""
    rows = hits.select("chrom", "start", "end", F.col("pattern").alias("name"), (F.length("pattern") - F.col("distance")).alias("score"), "strand", "spacer")
    return rows if batch else rows.drop("spacer")


def filled(hits: DataFrame) -> DataFrame:
    """hits with the values that stand for absent alignments: not ambiguous, no ambiguous cells."""
    return hits.withColumn("alignment_ambiguous", F.coalesce("alignment_ambiguous", F.lit(False))).withColumn("n_ambiguous_cells", F.coalesce("n_ambiguous_cells", F.lit(0)))


def tsv_rows(hits: DataFrame, *, batch: bool = True) -> DataFrame:
    """Text columns for a tab-separated file: absent values are a dot, scores have six significant digits."""
    cols = ["spacer"] * batch + TSV
    text = lambda c: six_digits(F.col(c)) if c == "cfd_score" else F.col(c).cast("string")
    return filled(hits).select(*[F.coalesce(text(c), F.lit(".")).alias(c) for c in cols])


def json_rows(hits: DataFrame, *, batch: bool = True) -> DataFrame:
    """One JSON object for each hit: null for absent values, scores as numbers with six decimals."""
    ahead = [F.col("spacer"), F.col("pattern").alias("spacer_sequence")] if batch else []
    cols = [F.col(c).cast("decimal(20,6)").alias(c) if c == "cfd_score" else F.col(c) for c in TSV]
    return filled(hits).select(F.to_json(F.struct(*ahead, *cols), {"ignoreNullFields": "false"}).alias("json"))


def lines(hits: DataFrame, form: str, *, batch: bool = True, totals: dict | None = None) -> Iterator[str]:
    """The lines of one output file, in the order of hits, a part at a time: tsv with a header, bed, or json as one array.

    totals, if given, has the number of hits so far.
    """

    def counted(rows: DataFrame) -> Iterator[Row]:
        for r in rows.toLocalIterator():
            if totals is not None:
                totals["hits"] = totals.get("hits", 0) + 1
            yield r

    if form == "tsv":
        rows = tsv_rows(hits, batch=batch)
        yield "\t".join(rows.columns)
        yield from ("\t".join(r) for r in counted(rows))
    elif form == "bed":
        yield from ("\t".join(map(str, r)) for r in counted(bed_rows(hits, batch=batch)))
    elif form == "json":
        last = None
        for r in counted(json_rows(hits, batch=batch)):
            yield "[" if last is None else f"  {last},"
            last = r[0]
        yield from ("[]",) if last is None else (f"  {last}", "]")
    else:
        raise ValueError(f"no such format: {form}")


def write(hits: DataFrame, path: str, form: str) -> None:
    """For large results, a folder of part files: tsv with a header, bed or json (one object a line)."""
    if form == "json":
        json_rows(hits).write.mode("overwrite").text(path)
    elif form == "bed":
        bed_rows(hits).write.mode("overwrite").option("sep", "\t").csv(path)
    elif form == "tsv":
        tsv_rows(hits).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    else:
        raise ValueError(f"no such format: {form}")


def summary_lines(by_distance: DataFrame, k: int, skipped: int, form: str) -> Iterator[str]:
    """The summary by distance (spacer_idx, spacer, sequence, total_hits, by_distance), one row for each guide, as lines of tsv or json."""
    rows = by_distance.orderBy("spacer_idx").collect()  # as many as guides
    if form == "tsv":
        yield "\t".join(["spacer", "sequence", "total_hits", *(f"d{d}" for d in range(k + 1))])
        for r in rows:
            yield "\t".join(map(str, [r["spacer"], r["sequence"], r["total_hits"], *(r["by_distance"].get(d, 0) for d in range(k + 1))]))
        return
    spacers = [{"name": r["spacer"], "sequence": r["sequence"], "total_hits": r["total_hits"], "hits_by_distance": {str(d): n for d, n in sorted(r["by_distance"].items())}} for r in rows]
    yield json.dumps({"threshold": k, "total_spacers_processed": len(rows), "spacers_skipped": skipped, "spacers": spacers}, indent=2)
