"""Sequences, patterns and intervals from files, and the tiled form of a genome.

A genome is a table (chrom_idx, chrom, seq); tiles are its pieces with margins, so that a search reads each tile by
itself: `core_start` and `core_len` are the positions a tile answers for, `text` begins at `text_start`.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqsweep.arrow import letters, portions, texts, through
from seqsweep.functions import seq as S

#: Bytes of text that a Python worker cuts into tiles at once.
MOST_BYTES = 1 << 21
TILES = "chrom_idx int, chrom string, seq_len bigint, core_start bigint, core_len int, text_start bigint, text string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom_idx, chrom, seq of a FASTA file, also gzipped (any number of members): names end at white space, lines that
    begin with ; and blank lines are skipped, text before the first header is ignored, bases are upper-cased and checked.

    Records are numbered by the counts of each task's records, so no sequence is moved.
    """
    pieces = spark.read.option("lineSep", "\n>").text(path).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "value")
    counts = sorted(pieces.groupBy("part").agg(F.count("*").alias("n"), F.min_by(F.col("value").startswith(">"), "at").alias("headed")).collect())
    before, total = {}, -1 if counts and not counts[0]["headed"] else 0
    for r in counts:
        before[r["part"]] = total
        total += r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    numbered = pieces.select((offset + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("chrom_idx"), F.split(F.regexp_replace("value", "^>", ""), "\r?\n").alias("lines"))
    body = F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: ~x.startswith(";") & (F.trim(x) != ""))
    records = numbered.where("chrom_idx >= 0").select("chrom_idx", F.regexp_extract(F.element_at("lines", 1), r"^[^ \t\r]*", 0).alias("chrom"), F.upper(F.array_join(F.transform(body, lambda x: F.rtrim(x)), "")).alias("seq"))
    return records.withColumn("seq", F.when(F.col("seq").rlike("[^ACGTN]"), F.raise_error(F.concat(F.lit("not a base in "), "chrom"))).otherwise(F.col("seq")))


def check_bases(genome: DataFrame) -> DataFrame:
    return genome.withColumn("seq", F.when(F.upper("seq").rlike("[^ACGTN]"), F.raise_error(F.concat(F.lit("not a base in "), "chrom"))).otherwise(F.upper("seq")))


def dictionary(genome: DataFrame) -> DataFrame:
    """chrom_idx, chrom, length and start, the offset of each sequence in their concatenation (one small row each)."""
    rows = genome.select("chrom_idx", "chrom", F.length("seq").cast("long").alias("length"))
    before = F.sum("length").over(Window.orderBy("chrom_idx").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def resolve(positions: DataFrame, genome: DataFrame, column: str = "position") -> DataFrame:
    """positions with chrom and offset: the sequence that holds a position of the concatenation, and the place in it; null beyond all."""
    size = 1 << 20  # sequences and positions meet in bins of the concatenation
    at = dictionary(genome).where("length > 0").select("chrom", F.col("start").alias("__start"), (F.col("start") + F.col("length")).alias("__end"))
    at = at.withColumn("__bin", F.explode(F.expr(f"sequence(__start div {size}, (__end - 1) div {size})")))
    met = positions.join(at, (F.floor(F.col(column) / size) == F.col("__bin")) & (F.col(column) >= F.col("__start")) & (F.col(column) < F.col("__end")), "left").drop("__bin")
    return met.withColumn("offset", F.col(column) - F.col("__start")).drop("__start", "__end")


def tile(genome: DataFrame, *, core: int = 1 << 14, margin: int = 512) -> DataFrame:
    """The genome in tiles of `core` positions with `margin` bases to both sides; one pass over each sequence."""

    names, kinds = [f.split()[0] for f in TILES.split(", ")], (pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, "seq", MOST_BYTES)):
            data, at = letters(batch.column("seq"))
            rows, pieces, places, total = [], [], [], 0
            for r, (begin, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                size = end - begin
                for a in range(0, size, core):
                    first = max(0, a - margin)
                    rows.append(r)
                    pieces.append(data[begin + first : begin + min(size, a + core + margin)])
                    places.append((size, a, min(core, size - a), first))
                    total += len(pieces[-1])
                    if total >= MOST_BYTES:
                        yield tiles(batch, rows, pieces, places)
                        rows, pieces, places, total = [], [], [], 0
            if rows:
                yield tiles(batch, rows, pieces, places)

    def tiles(batch: pa.RecordBatch, rows: list[int], pieces: list[np.ndarray], places: list[tuple]) -> pa.RecordBatch:
        row = pa.array(rows, pa.int32())
        text = texts(np.concatenate(pieces), np.array([len(x) for x in pieces]))
        return pa.RecordBatch.from_arrays([batch.column("chrom_idx").take(row), batch.column("chrom").take(row), *(pa.array(c, t) for c, t in zip(zip(*places, strict=True), kinds, strict=True)), text], names=names)

    if not hasattr(genome, "_through"):
        genome = genome.select(F.col("chrom_idx").cast("int"), "chrom", "seq").where("seq is not null")
    return through(genome, cut, TILES)


def encoded(docs: DataFrame) -> DataFrame:
    """The genome of texts (doc_id, text), none of them null: `encode_text` byte by byte; for tables without sequences."""
    base = np.zeros(256, np.uint8)
    for i, c in enumerate(range(ord("a"), ord("z") + 1)):
        base[c] = base[c - 32] = ord("N" if c == ord("z") else "ACGT"[i % 4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, "text", MOST_BYTES)):
            data, at = letters(batch.column("text"))
            found = base[data[at[0] : at[-1]]]
            kept = np.concatenate([[0], np.cumsum(found != 0)])[at - at[0]]
            number = batch.column("doc_id")
            name = pc.binary_join_element_wise(pa.scalar("doc_"), number.cast(pa.string()), "")
            yield pa.RecordBatch.from_arrays([number.cast(pa.int32()), name, texts(found[found != 0], np.diff(kept))], names=["chrom_idx", "chrom", "seq"])

    return through(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "chrom_idx int, chrom string, seq string")


def write_index(tiles: DataFrame, path: str) -> None:
    """Tiles as a Parquet table, partitioned by sequence and sorted by place, so regions are pruned."""
    tiles.sortWithinPartitions("chrom_idx", "core_start").write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.split()[0] for f in TILES.split(", ")])


def load(spark: SparkSession, path: str, **tiling) -> DataFrame:
    """Tiles of an index (a path ending in .tiles) or of a FASTA file."""
    return read_index(spark, path) if path.rstrip("/").endswith(".tiles") else tile(read_fasta(spark, path), **tiling)


@dataclass(frozen=True)
class Guide:
    name: str
    sequence: str
    source_file: str = ""
    source_line: int = 0


def parse_guides(lines: list[str], source: str = "") -> list[Guide]:
    """Guides of a text file: `sequence` or `name sequence ...` a line, # comments in the first column, unnamed ones numbered."""
    out, unnamed = [], 0
    for n, line in enumerate(lines, 1):
        if line.startswith("#") or not line.split():
            continue
        fields = line.split()
        if len(fields) == 1:
            unnamed += 1
            fields = [f"spacer_{unnamed}", fields[0]]
        out.append(Guide(fields[0], fields[1], source, n))
    if not out:
        raise ValueError(f"no guides in {source or 'the input'}")
    return out


def read_guides(path: str) -> list[Guide]:
    """Guides of a file (order and line numbers matter, so it is read on the driver) or of standard input for -."""
    if path == "-":
        import sys

        return parse_guides(sys.stdin.read().splitlines(), "-")
    with (gzip.open(path, "rt") if path.endswith(".gz") else open(path)) as f:
        return parse_guides(f.read().splitlines(), path)


def guides_table(spark: SparkSession, guides: list[Guide]) -> DataFrame:
    rows = [(i, g.name, g.sequence, g.source_file, g.source_line) for i, g in enumerate(guides)]
    return spark.createDataFrame(rows, "spacer_idx int, spacer string, sequence string, source_file string, source_line long")


def split_valid(guides: DataFrame, *, uracil: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid guides upper-cased, the rest); with `uracil` U is read as T first, else it makes a guide invalid."""
    read = guides.withColumn("sequence", S.uracil_to_thymine(F.col("sequence")) if uracil else F.col("sequence"))
    ok = S.valid_pattern(F.col("sequence"))
    return read.where(ok).withColumn("sequence", F.upper("sequence")), read.where(~ok)


def read_bed(spark: SparkSession, path: str, label: str) -> DataFrame:
    """label, chrom, start, end; comments, track and browser lines and lines that cannot be read are skipped."""
    f = F.split("value", r"\s+")
    rows = spark.read.text(path).where("value <> '' and not value rlike '^(#|track|browser)'")
    rows = rows.select(F.lit(label).alias("label"), F.try_element_at(f, F.lit(1)).alias("chrom"), F.try_element_at(f, F.lit(2)).try_cast("bigint").alias("start"), F.try_element_at(f, F.lit(3)).try_cast("bigint").alias("end"))
    return rows.where("chrom is not null and start is not null and end is not null")
