"""Benchmark decontamination: a prefix-filtered containment join over item-sized windows.

A window is `n` consecutive words of an item (all its words if it has fewer); a document contains a window if the
window's words stand in it in a row. The words are ordered by rarity, measured over all documents. Containment asks
for every word of the window, so a prefix of one word, the rarest, is enough: each occurrence of that word at
document position i proposes one start, i minus the word's place in the window; the start must lie in the document
with the whole window (positional and length bounds), and then all words are compared.

The items' windows are taken in blocks of at most `block_windows`, which bounds what is sent to the tasks; each
block is one narrow pass over the documents that adds to a bitmap of hit words, so there is no shuffle of texts.

Defined cases: null texts have no words; items with a null id or without words are ignored; rows that repeat an id
count as one item; a document word covered by several windows counts once; repeated documents are each measured;
columns named like an output are replaced; without items nothing is hit; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, text

OUT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_words", T.BinaryType()), T.StructField("full_hit", T.BooleanType())]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row after row; number of words by row)."""
    data, offsets = text.text_bytes(column)
    s, e, rows = text.runs(data, offsets, text.ALNUM_OR_HIGH)
    return text.span_hashes(data, s, e), text.counts_by_row(rows, len(column))


def item_windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item, words): every distinct window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "t"):
                w, per = words_of(part.column("t"))
                names, found, at = part.column("i").to_pylist(), [], 0
                for name, c in zip(names, per.tolist(), strict=True):
                    row = w[at : at + c].view(np.int64)
                    found += [(name, row[j : j + n].tolist()) for j in range(max(c - n + 1, 1))] if c else []
                    at += c
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["item", "words"])

    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null")
    return rows.mapInArrow(run, "item string, words array<bigint>").distinct()


class Windows:
    """The windows of a block, by their rarest word."""

    def __init__(self, rows: list[tuple[str, list[int]]], frequency: dict[int, int]):
        distinct: dict[tuple, list[str]] = {}
        for item, words in rows:
            distinct.setdefault(tuple(words), []).append(item)
        keys = sorted(distinct, key=lambda w: (len(w), w))
        self.items = [sorted(distinct[k]) for k in keys]
        self.size = np.array([len(k) for k in keys], np.int64)
        self.words = np.zeros((len(keys), max(map(len, keys), default=1)), np.uint64)
        rare = np.zeros(len(keys), np.uint64)
        self.place = np.zeros(len(keys), np.int64)
        for i, k in enumerate(keys):
            self.words[i, : len(k)] = np.array(k, np.int64).view(np.uint64)
            place = min(range(len(k)), key=lambda j: (frequency.get(k[j], 0), k[j], j))
            self.place[i], rare[i] = place, self.words[i, place]
        self.token, inverse = np.unique(rare, return_inverse=True)
        self.by_token = np.argsort(inverse, kind="stable")
        self.count = np.bincount(inverse, minlength=len(self.token))
        self.first = np.cumsum(self.count) - self.count

    def occurrences(self, words: np.ndarray, per_row: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence; starts count the words of all rows."""
        at = matches(words, self.token)
        if not len(at[0]):
            return at
        place, token = at
        c = self.count[token]
        window = self.by_token[np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.first[token], c)]
        place = np.repeat(place, c)
        start = place - self.place[window]
        begin = np.cumsum(per_row) - per_row
        ok = (start >= begin[rows[place]]) & (start + self.size[window] <= (begin + per_row)[rows[place]])
        start, window = start[ok], window[ok]
        for j in range(self.words.shape[1]):
            more = self.size[window] > j
            same = np.ones(len(start), bool)
            same[more] = words[start[more] + j] == self.words[window[more], j]
            start, window = start[same], window[same]
        return start, window


def matches(words: np.ndarray, sorted_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of words that are tokens, index of the token); a bit table rules most words out first."""
    table = np.zeros(1 << 18, bool)
    table[(sorted_tokens & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(words & np.uint64((1 << 18) - 1)).astype(np.int64)])
    if not len(sorted_tokens) or not len(maybe):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.minimum(np.searchsorted(sorted_tokens, words[maybe]), len(sorted_tokens) - 1)
    ok = sorted_tokens[where] == words[maybe]
    return maybe[ok], where[ok]


def frequencies(docs: DataFrame, text_col: str, tokens: np.ndarray) -> dict[int, int]:
    """Occurrences of the tokens over all documents: one count for each token and task is shuffled."""
    tokens = np.sort(tokens.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for part in text.pieces(batch, "t"):
                w, _ = words_of(part.column("t"))
                total += np.bincount(matches(w, tokens)[1], minlength=len(tokens))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[seen].view(np.int64)), pa.array(total[seen])], names=["w", "n"])

    got = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in got.collect()}


def measure(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 13, block_windows: int = 200_000) -> DataFrame:
    """docs with n_words, n_hit, hit_items (sorted ids), hit_words (a bitmap over the words) and full_hit (whether a window of all n words stands in it); other columns stay."""
    outputs = {f.name for f in OUT}
    kept = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([docs.schema[c] for c in kept] + OUT)
    windows = store.written(item_windows(items, item_id_col, item_text_col, n), "windows")
    blocks = max(1, -(-2 * windows.count() // block_windows)) if windows.count() > block_windows else 1
    out = docs.select(*kept)
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()]
        tokens = np.unique(np.array([w for _, ws in rows for w in ws], np.int64))
        block = Windows(rows, frequencies(docs, text_col, tokens) if len(tokens) else {})

        def run(batches: Iterator[pa.RecordBatch], block: Windows = block, first: bool = b == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text.pieces(batch, text_col):
                    yield _mark(part, text_col, kept, block, first, n)

        out = out.mapInArrow(run, schema)
        if b % 4 == 3 and b + 1 < blocks:
            out = store.written(out, "hits")
    return out


def _mark(part: pa.RecordBatch, text_col: str, kept: list[str], block: Windows, first: bool, n: int) -> pa.RecordBatch:
    words, per_row = words_of(part.column(text_col))
    rows = np.repeat(np.arange(part.num_rows), per_row)
    start, window = block.occurrences(words, per_row, rows)
    change = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + block.size[window], minlength=len(words) + 1)
    hit = np.cumsum(change)[: len(words)] > 0
    items: list[set] = [set(x or ()) for x in part.column("hit_items").to_pylist()] if not first else [set() for _ in range(part.num_rows)]
    for r, w in {(int(r), int(w)) for r, w in zip(rows[start], window, strict=True)}:
        items[r].update(block.items[w])
    full = np.zeros(part.num_rows, bool) if first else part.column("full_hit").to_numpy(zero_copy_only=False).astype(bool)
    full[rows[start[block.size[window] == n]]] = True
    ends = np.cumsum(per_row)
    before = part.column("hit_words").to_pylist() if not first else None
    maps, n_hit = [], np.zeros(part.num_rows, np.int64)
    for r, (e, c) in enumerate(zip(ends.tolist(), per_row.tolist(), strict=True)):
        mine = hit[e - c : e]
        if before is not None and before[r]:
            mine = mine | np.unpackbits(np.frombuffer(before[r], np.uint8), count=c).astype(bool)
        n_hit[r] = mine.sum()
        maps.append(np.packbits(mine).tobytes() if n_hit[r] else b"")
    arrays = [pa.array(per_row), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(maps, pa.binary()), pa.array(full)]
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], names=[*kept, *(f.name for f in OUT)])


def decontaminate(docs: DataFrame, items: DataFrame, *, hits: int = 1, words: int = 20, **options) -> DataFrame:
    """The documents without benchmark passages, with their own columns.

    A document that contains a window of all n words goes, however long it is; windows of shorter items, which may be
    common phrases, count only where they cover hits / words of the document or more.
    """
    measured = measure(docs, items, **options)
    covered = (F.col("n_hit") > 0) & (words * F.col("n_hit") >= hits * F.col("n_words"))
    return measured.where(~(F.col("full_hit") | covered)).select(*[c for c in docs.columns if c in measured.columns])
