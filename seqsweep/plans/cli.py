"""Command line: python -m seqsweep.plans.cli --genome FILE (--pattern P | --spacer-file F) [options]."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from seqsweep import ship
from seqsweep.functions import score
from seqsweep.operators import post, report
from seqsweep.plans import engine
from seqsweep.sources import readers

VERSION = "0.1.0"
# A small self-test: two sites with a motif and one without.
SAMPLE_GUIDE = "CATTGACCAGTACGATCCTA"
SAMPLE_GENOME = f"{SAMPLE_GUIDE}AGG{'T' * 20}{SAMPLE_GUIDE[:11]}A{SAMPLE_GUIDE[12:]}TGG{'C' * 20}{SAMPLE_GUIDE}AAA{'T' * 20}"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqsweep")
    p.add_argument("--version", "-v", action="version", version=VERSION)
    p.add_argument("--quickstart", action="store_true")
    for name in ("pattern", "spacer-file", "genome", "index-genome", "output", "region", "cfd-table"):
        p.add_argument(f"--{name}")
    p.add_argument("--threshold", type=int, default=3)
    p.add_argument("--max-hits", type=int, default=0)
    p.add_argument("--max-total-hits", type=int, default=0)
    p.add_argument("--threads", "-t", type=int, default=0)
    p.add_argument("--format", choices=("tsv", "bed", "json"), default="tsv")
    p.add_argument("--summary-format", choices=("tsv", "json"), default="json")
    p.add_argument("--distance-mode", choices=("hamming", "levenshtein"), default="levenshtein")
    p.add_argument("--pam", default="")
    p.add_argument("--pam-position", choices=("3", "5", "3prime", "5prime"), default="3")
    p.add_argument("--pam-extract-length", type=int, default=0)
    p.add_argument("--strand", choices=("both", "plus", "minus"), default="both")
    for name in ("cpu-only", "verbose", "quiet", "summary", "no-deduplicate", "no-scores"):
        p.add_argument(f"--{name}", action="store_true")
    for name in ("compute-mismatches", "compute-scores", "treat-u-as-t"):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--spacer-summary")
    p.add_argument("--intersect-bed", action="append", default=[], metavar="LABEL:FILE")
    p.add_argument("--acfd-threshold", type=float, default=4.8)
    return p


def quickstart(spark: SparkSession) -> bool:
    genome = spark.createDataFrame([(0, "sample", SAMPLE_GENOME)], "chrom_idx int, chrom string, seq string")
    guides = readers.guides_table(spark, [readers.Guide("sample", SAMPLE_GUIDE)])
    good = True
    for mode in ("hamming", "levenshtein"):
        for pam, expected in (("NGG", 2), ("", 3)):
            n = engine.search(readers.tile(genome), guides, engine.Search(distance_mode=mode, pam=pam)).count()
            good &= n == expected
            print(f"{mode} {pam or 'any'}: {n} hits, {expected} expected")
    return good


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if not a.quickstart and not a.index_genome and (not a.genome or bool(a.pattern) == bool(a.spacer_file)):
        print("give --genome and one of --pattern and --spacer-file", file=sys.stderr)
        return 2
    if a.index_genome and (a.pattern or a.spacer_file or a.genome or not a.output):
        print("--index-genome goes with --output only", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    ship.ship(spark)
    if a.quickstart:
        return 0 if quickstart(spark) else 1
    if a.index_genome:
        readers.write_index(readers.tile(readers.read_fasta(spark, a.index_genome)), a.output)
        return 0
    began = time.time()

    def say(text: str, *, detail: bool = False) -> None:
        if not a.quiet and (a.verbose or not detail):
            print(text, file=sys.stderr)

    found = [readers.Guide("query", a.pattern)] if a.pattern else readers.read_guides(a.spacer_file)
    valid, rest = readers.split_valid(readers.guides_table(spark, found), uracil=a.treat_u_as_t)
    skipped = rest.collect()
    for r in skipped:
        say(f"skipped {r['spacer']} ({r['source_file']}:{r['source_line']})")
        if a.pattern:
            return 1
    options = engine.Search(
        threshold=a.threshold, distance_mode=a.distance_mode, strand=a.strand, region=a.region, pam=a.pam.upper(), pam_position=a.pam_position[0], pam_extract_length=a.pam_extract_length,
        compute_mismatches=a.compute_mismatches, compute_scores=a.compute_scores and not a.no_scores, deduplicate=not a.no_deduplicate, treat_u_as_t=a.treat_u_as_t, max_hits=a.max_hits,
        max_total_hits=a.max_total_hits, penalties=score.load_penalties(spark, a.cfd_table) if a.cfd_table else {},
    )
    try:
        options.check(summaries=a.summary or bool(a.spacer_summary))
        longest = max((len(g.sequence) for g in found), default=1)
        hits = engine.search(readers.load(spark, a.genome, margin=max(512, engine.margin(longest, options))), valid, options)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if a.spacer_summary:
        beds = [readers.read_bed(spark, path, label) for label, _, path in (x.partition(":") for x in a.intersect_bed)]
        every = None
        for b in beds:
            every = b if every is None else every.union(b)
        labels = tuple(x.partition(":")[0] for x in a.intersect_bed)
        rows = report.guide_summary_tsv(engine.summarise(hits, valid, options, every, labels, a.acfd_threshold).orderBy("spacer_idx"), labels)
        put(a.spacer_summary, ["\t".join(rows.columns), *("\t".join(r) for r in rows.collect())])
    if a.summary:
        put(a.output, report.summary_lines(report.by_distance(hits, valid), a.threshold, len(skipped), a.summary_format))
        say(f"{len(found) - len(skipped)} guides, {len(skipped)} skipped, {time.time() - began:.1f} s", detail=True)
        return 0
    # sorted rows come part by part, so a result of any size passes through the driver in bounded memory
    ordered = hits.orderBy(*post.order_columns(options.deduplicate and options.distance_mode == "levenshtein"))
    totals = {"hits": 0}
    put(a.output, report.lines(ordered, a.format, batch=not a.pattern, totals=totals))
    say(f"{totals['hits']} hits of {len(found) - len(skipped)} guides, {len(skipped)} skipped, {time.time() - began:.1f} s", detail=True)
    return 0


def put(path: str | None, lines: Iterable[str]) -> None:
    """Lines to one file, or to standard output without a path."""
    if not path:
        for x in lines:
            print(x)
        return
    with open(path, "w") as f:
        f.writelines(f"{x}\n" for x in lines)


if __name__ == "__main__":
    sys.exit(main())
