"""Bounded training samples."""

from __future__ import annotations

from itertools import groupby, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_mod(column: str, n: int):
    """crc32 of the column's text form, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string")) % n


def by_class(marks: DataFrame, key: str, label: str, most: int, most_values: int = 4096) -> list:
    """At most `most` rows (key, label) of each value of label, those whose hashed key is smallest.

    The order is that of a hash, so the sample is the same whatever the partitioning. A first pass counts each value's
    keys (sketches, so a frequent value is no task's own); a second one keeps the rows whose hash is below the share
    that is wanted, with some to spare, and the driver cuts what is over: it holds at most about 1.6 x most keys of
    at most `most_values` values. More values raise an error.
    """
    marks = marks.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null")
    counts = marks.groupBy("y").agg(F.approx_count_distinct("k").alias("n")).limit(most_values + 1).collect()
    if len(counts) > most_values:
        raise ValueError(f"more than {most_values} values of {label}: raise most_values")
    if not counts:
        return []
    kind = marks.schema["y"].dataType.simpleString()
    share = marks.sparkSession.createDataFrame([(r["y"], min(1.0, (1.3 * most + 20) / max(r["n"], 1))) for r in counts], f"y {kind}, share double")
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = marks.join(F.broadcast(share), "y").withColumn("place", place).where("place < share").select("y", "place", "k").distinct()
    rows = sorted((r["y"], r["place"], r["k"]) for r in near.collect())
    return [(k, y) for y, g in groupby(rows, key=lambda r: r[0]) for _, _, k in islice(g, most)]


def texts_of(docs: DataFrame, id_col: str, text_col: str, keys: list) -> dict:
    """{key: text} for a bounded list of keys, by one scan with a broadcast of the keys; a repeated key has its smallest text."""
    if not keys:
        return {}
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = spark.createDataFrame([(k,) for k in set(keys)], f"k {kind}")
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(wanted), "k", "left_semi")
    return {r[0]: r[1] or "" for r in rows.groupBy("k").agg(F.min("t")).collect()}
