"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes (16 bits, so each value depends on the last 16 bytes), and a chunk ends where the
value is the strict minimum of its surroundings, `reach` bytes to both sides; chunks are then at least reach + 1
bytes long, 2 x reach + 1 on average, and an insertion moves no boundary further away than its surroundings. A
stretch without a minimum is cut every `most` bytes from its last cut. Chunks are compared by a 64-bit digest over
all documents: a digest belongs to the document of smallest id that has it. Runs of chunks that belong to others
(or stand earlier in the same document), of `least_run` bytes or more, are deleted; shorter repeats stay, so common
phrases and a chance collision of one digest do no harm.

Only (digest, id) pairs are shuffled, once for each digest and document; a digest that a third of all documents
share is reduced before the shuffle. The few digests that are frequent (there are fewer than `FREQUENT`) go to all
tasks with their owners, so the join with the documents' chunks has no hot key either.

Defined cases: null texts stay null and empty ones empty; a text shorter than a chunk is one chunk; texts of any
length are cut whole; n_repeated counts the chunks of the deleted runs; rows that repeat an id count as one document for the owner and lose nothing to each other;
rows with a null id pass unchanged; columns named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, text

#: A digest is frequent if it makes up more than one in so many of the shared digests' occurrences.
FREQUENT = 10_000
GEAR = (text.BYTE_CODE >> np.uint64(17)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: the sum of GEAR[byte] shifted by its distance, modulo 2 ** 16."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has as many."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def chunk_ends(data: np.ndarray, offsets: np.ndarray, reach: int, most: int) -> np.ndarray:
    """Ascending ends of all rows' chunks; the hash starts afresh with each row."""
    parts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if a == b:
            continue
        h = gear(data[a:b])
        inner = np.zeros(0, np.int64)
        if b - a > 2 * reach + 1:
            low = sliding_min(h, reach)
            middle = h[reach:-reach]
            inner = np.flatnonzero((middle < low[: len(middle)]) & (middle < low[reach + 1 : reach + 1 + len(middle)])) + reach + 1
        ends = np.append(inner, b - a)
        wide = np.flatnonzero(np.diff(ends, prepend=0) > most)
        if len(wide):
            begin = np.concatenate([[0], ends[:-1]])
            ends = np.union1d(ends, np.concatenate([np.arange(begin[i] + most, ends[i], most) for i in wide]))
        parts.append(ends + a)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def digests(column: pa.Array, reach: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, chunk starts, ends, rows, digests)."""
    data, offsets = text.text_bytes(column)
    ends = chunk_ends(data, offsets, reach, most)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    filled = np.flatnonzero(np.diff(offsets))
    rows = filled[np.searchsorted(offsets[filled], starts, "right") - 1] if len(ends) else ends
    return data, starts, ends, rows, text.span_hashes(data, starts, ends, text.BYTE_CODE)


def without_runs(raw: bytes, starts: list[int], ends: list[int], again: list[bool], least_run: int) -> tuple[bytes, list[tuple[int, int]]]:
    """(raw without the runs of chunks marked again that have least_run bytes, the runs); a run is cut back to whole characters."""
    runs, i = [], 0
    while i < len(again):
        j = i
        while j < len(again) and again[j]:
            j += 1
        if j > i:
            a, b = starts[i], ends[j - 1]
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b < len(raw) and a < b and raw[b] & 0xC0 == 0x80:
                b -= 1
            if b - a >= least_run:
                runs.append((a, b))
        i = j + 1 if j == i else j
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), runs


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 16, most: int = 256, least_run: int = 128) -> DataFrame:
    """docs with text_col less the repeated runs, and n_chunks, n_repeated (chunks), deleted_bytes and sources (ids); other columns stay."""
    kind = docs.schema[id_col].dataType
    out = [T.StructField("n_chunks", T.LongType()), T.StructField("n_repeated", T.LongType()), T.StructField("deleted_bytes", T.LongType()), T.StructField("sources", T.ArrayType(kind))]
    kept = [c for c in docs.columns if c not in {f.name for f in out}]
    schema = T.StructType([docs.schema[c] for c in kept] + out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "t"):
                *_, rows, d = digests(part.column("t"), reach, most)
                values, per = text.distinct_by_row(d, text.counts_by_row(rows, part.num_rows))
                offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))], names=["k", "ds"])

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, text_col):
                yield one(part)

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        data, starts, ends, rows, d = digests(part.column(text_col), reach, most)
        per = text.counts_by_row(rows, part.num_rows)
        last = np.cumsum(per)
        texts, repeated, gone, sources = part.column(text_col).to_pylist(), [], [], []
        owners, taken = part.column("__owner"), part.column("__taken")
        for r in range(part.num_rows):
            a, b = int(last[r] - per[r]), int(last[r])
            mine = d[a:b].view(np.int64)
            _, firsts = np.unique(mine, return_index=True)
            again = np.ones(b - a, bool)
            again[firsts] = False
            theirs, owner = (taken[r].values.to_numpy(), owners[r].values) if taken[r].is_valid else (np.zeros(0, np.int64), None)
            other = np.isin(mine, theirs)
            again |= other
            runs: list = []
            if again.any():
                base = int(starts[a])
                raw = data[base : int(ends[b - 1])].tobytes()
                left, runs = without_runs(raw, (starts[a:b] - base).tolist(), (ends[a:b] - base).tolist(), again.tolist(), least_run)
                if runs:
                    texts[r] = left.decode()
            gone.append(sum(y - x for x, y in runs))
            within = np.zeros(b - a, bool)
            for x, y in runs:
                within |= (starts[a:b] - starts[a] >= x - 3) & (ends[a:b] - starts[a] <= y + 3)
            repeated.append(int(within.sum()))
            inside = set(mine[within].tolist())
            sources.append(sorted({o for v, o in zip(theirs.tolist(), owner.to_pylist(), strict=True) if v in inside}) if owner is not None else [])
        new = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in kept]
        return pa.RecordBatch.from_arrays([*new, pa.array(per), pa.array(repeated, pa.int64()), pa.array(gone, pa.int64()), pa.array(sources, part.column("__owner").type)], names=schema.names)

    base = docs.select(*kept)
    cuts = base.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(cut, T.StructType([T.StructField("k", kind), T.StructField("ds", T.ArrayType(T.LongType()))]))
    chunks = store.written(cuts, "chunks").select("k", F.explode("ds").alias("d"))
    shared = chunks.groupBy("d").agg(F.min("k").alias("o"), F.max("k").alias("z"), F.count("*").alias("n")).where("o < z").select("d", "o", "n")
    shared = store.written(shared, "shared")
    frequent = F.col("n") * FREQUENT > (shared.agg(F.sum("n")).first()[0] or 0)
    hot, rare = shared.where(frequent).select("d", "o"), shared.where(~frequent).select("d", "o")
    held = chunks.join(F.broadcast(hot), "d").union(chunks.join(F.broadcast(hot.select("d")), "d", "left_anti").join(rare, "d"))
    later = held.where("k > o").groupBy("k").agg(F.collect_set(F.struct("d", "o")).alias("m"))
    later = later.select(F.col("k").alias("__k"), F.col("m.d").alias("__taken"), F.col("m.o").alias("__owner"))
    return base.join(later, base[id_col] == F.col("__k"), "left").drop("__k").mapInArrow(delete, schema)
