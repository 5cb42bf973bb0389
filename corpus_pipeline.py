"""The corpus pipeline: quality filter, line dedup, near-dedup, benchmark decontamination, packing.

Every stage takes documents with null ids, null or empty texts, very long texts, repeated rows and further columns,
whatever their names, and empty tables; all but the last keep the columns that they were given. Ties are decided by
the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsweep.llm import decontam, linededup, neardup, packing, quality, queries, samples, store
from seqsweep.ship import ship

Stage = tuple[str, object]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more; learned from the labelled rows that are not held out.

    A null or empty text is scored like any other (usually it goes); without labels of both kinds every score is the
    share of label 1. An empty table stays empty.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(samples.crc_mod("doc_id", 4) != 2)
    model = quality.train(docs, labels)
    return quality.score(docs, model, score_col="__score").where(F.col("__score") >= 0.7).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with an earlier one; those of which nothing is left go. n_chars is counted anew.

    Null and empty texts and rows with a null id stay as they are; rows that repeat id and text are treated alike.
    """
    ship(spark)
    found = linededup.deduplicate(docs)
    left = found.where((F.col("n_deleted") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Documents without words and rows with a null id stay; rows that repeat an id are one document and stay or go together.
    """
    ship(spark)
    return neardup.deduplicate(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 13-word window of the benchmark, and covered to less than a twentieth by windows of shorter items.

    Null and empty texts stay; without items all documents stay.
    """
    ship(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids; a null or empty text is the end id alone."""
    ship(spark)
    return packing.pack(docs, **queries.tokenizer_files())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("neardup", neardup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL cannot express the classifier or the packing; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
