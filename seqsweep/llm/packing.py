"""Sequence packing by dynamic programming over cut positions, in document order.

The documents of an input partition, in their order, form one stream of ids. Cuts may stand at document ends, at
sentence ends (an id whose text ends a sentence or holds a line break) and, at a higher penalty, where a sequence that
begins at one of these is full and every `grid` ids in stretches without any. The best cuts minimise padding, penalties for cutting inside a document and a cost for each sequence (else many
short sequences, whose lengths are powers of two and so are not padded, would be cheapest): f(j) = penalty(j) + cost +
min over i of f(i) + padding(j - i). Padding is linear in the length, so the minimum over the window of the last
`length` ids is kept in a monotone queue of f(i) + i; lengths that are a power of two are tried by themselves. The
stream is cut a block of about `block_tokens` ids at a time; what stands behind the last cuts of a block goes on into
the next one. There is no shuffle, and a task holds one block (or one document, where that is longer).

Defined cases: a null text is empty; every document ends with `end_id`, so an empty one is that id alone; a document
longer than a sequence is cut; repeated rows are packed each by itself; other columns are not read; an empty table
gives an empty result. Texts with a special token's own string are encoded by the tokenizer itself.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

_b = np.arange(256)
LETTER, DIGIT, BLANK, SPACE, OTHER, STRANGE = range(6)
#: Classes of bytes for the split into words; the bytes of U+00C0 to U+00FF are letters but for the signs 0xC3 0x97 and 0xC3 0xB7.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122))] = LETTER
CLASS[(_b >= 48) & (_b <= 57)] = DIGIT
CLASS[32] = BLANK
CLASS[9:14] = SPACE
CLASS[_b >= 128] = STRANGE
CLASS[28:32] = STRANGE
CLASS[39] = STRANGE  # contractions


class Encoder:
    """Ids of many texts. Plain texts are split into words at once, and each new word is merged once; others go to the library."""

    SLOTS = 1 << 20

    def __init__(self, tokenizer_json: str, ranks_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer_json)
        ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, open(ranks_file, "rb"))}
        self.rank = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.full.get_vocab_size() + 1, bool)
        for piece, i in ranks.items():
            self.ends[i] = piece[-1:] in (b".", b"!", b"?") or b"\n" in piece
        self.clear()

    def clear(self) -> None:
        self.key, self.entry = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.n, self.entries = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _add(self, ids: list[int]) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if self.entries == len(self.at):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[self.entries], self.n[self.entries] = self.used, len(ids)
        self.used += len(ids)
        self.entries += 1
        return self.entries - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, number of ids by row)."""
        if self.used > 6_000_000:
            self.clear()
        rows = len(offsets) - 1
        cls = CLASS[data] if len(data) else np.zeros(0, np.uint8)
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)) if len(data) else np.zeros(0, np.int64)
        cls[lead] = LETTER
        cls[lead + 1] = LETTER
        filled = np.flatnonzero(np.diff(offsets))
        odd = np.zeros(rows, bool)
        if len(filled):
            odd[filled] = np.add.reduceat((cls == STRANGE).astype(np.int64), offsets[filled]) > 0
        starts = self._starts(cls, offsets)
        ends = np.append(starts[1:], len(data))
        row = filled[np.searchsorted(offsets[filled], starts, "right") - 1] if len(starts) else starts
        special = self._special_rows(data, offsets)
        odd |= special
        plain = ~odd[row] if len(row) else np.zeros(0, bool)
        h = text.span_hashes(data, starts, ends, text.BYTE_CODE)[plain]
        starts, ends, row = starts[plain], ends[plain], row[plain]
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        entry = np.where(self.key[slot] == h, self.entry[slot], -1)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            raw = data.tobytes()
            one = self.rank._encode_single_piece
            new = np.array([self._add(one(raw[starts[i] : ends[i]])) for i in missing[first]], np.int32)
            entry[missing] = new[inverse]
            self.key[slot[missing[first]]], self.entry[slot[missing[first]]] = h[missing[first]], new
        n = self.n[entry] if len(entry) else np.zeros(0, np.int64)
        src = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[entry], n)
        ids = self.pool[src]
        per_row = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
        if not odd.any():
            return ids, per_row
        parts, at = [], 0
        for r in range(rows):
            if odd[r]:
                t = data[offsets[r] : offsets[r + 1]].tobytes().decode()
                got = np.array(self.full.encode(t, add_special_tokens=False).ids if special[r] else self.rank.encode_ordinary(t), np.int32)
                parts.append(got)
                per_row[r] = len(got)
            else:
                parts.append(ids[at : at + per_row[r]])
                at += per_row[r]
        return np.concatenate(parts) if parts else ids, per_row

    def _special_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, bool)
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s.encode())
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s.encode(), at + 1)
        return out

    @staticmethod
    def _starts(cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words begin: a run of one class with the blank before it; the last of several blanks goes with the next word."""
        n = len(cls)
        if not n:
            return np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        white = (cls == BLANK) | (cls == SPACE)
        before = np.zeros(n, bool)
        before[1:] = white[:-1] & ~edge[1:n]
        kind = np.where(white, 99, cls)
        differs = np.ones(n, bool)
        differs[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
        blank_before = np.zeros(n, bool)
        blank_before[1:] = (cls[:-1] == BLANK) & ~edge[1:n]
        start = differs & ~(~white & blank_before)
        nxt = np.zeros(n, bool)
        nxt[:-1] = ~white[1:] & ~edge[1:n]
        start |= white & before & nxt
        return np.flatnonzero(start)


def cut_points(total: int, position: np.ndarray, penalty: np.ndarray, length: int, cost_each: float = 0.0) -> np.ndarray:
    """The cheapest cut positions among `position` (ascending, the last is total), each at most `length` apart."""
    pos = np.concatenate([[0], position])
    pen = np.concatenate([[0.0], penalty]).tolist()
    where = np.full(total + 1, -1, np.int64)
    where[pos] = np.arange(len(pos))
    ends, starts = [], []
    p = 1
    while p < length:  # a full sequence has no padding either way
        j = np.flatnonzero(pos >= p)
        i = where[pos[j] - p]
        ends.append(j[i >= 0])
        starts.append(i[i >= 0])
        p *= 2
    order = np.argsort(np.concatenate(ends), kind="stable")
    start = np.concatenate(starts)[order].tolist()
    upto = np.cumsum(np.bincount(np.concatenate(ends), minlength=len(pos))).tolist()
    at = pos.tolist()
    cost, back = [0.0] * len(at), [0] * len(at)
    value, index, head = [0.0], [0], 0  # the queue: f(i) + i, ascending, and i, from head on
    done = upto[0]
    for j in range(1, len(at)):
        here = at[j]
        far = here - length
        while at[index[head]] < far:
            head += 1
        best, arg = value[head] - far, index[head]
        if upto[j] > done:
            for i in start[done : upto[j]]:
                if cost[i] <= best:
                    best, arg = cost[i], i
            done = upto[j]
        best += pen[j] + cost_each
        cost[j], back[j] = best, arg
        best += here
        while len(value) > head and value[-1] >= best:
            value.pop()
            index.pop()
        value.append(best)
        index.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def plan(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, *, length: int, grid: int, sentence_penalty: float, other_penalty: float, sequence_cost: float) -> np.ndarray:
    """Cut positions for a stream of ids; sentence marks ids after which a sentence ends."""
    total = len(ids)
    mark = np.zeros(total + 1, np.uint8)
    mark[1:][sentence[ids]] = 2
    mark[doc_ends] = 3
    mark[0] = 3
    known = np.flatnonzero(mark)
    gap = np.diff(known)
    wide = np.flatnonzero(gap > 2 * grid)
    for a in wide.tolist():
        mark[known[a] + grid : known[a + 1] : grid] = 1
    full = known[known <= total - length] + length
    mark[full[mark[full] == 0]] = 1
    position = np.flatnonzero(mark)[1:]
    penalty = np.array([0.0, other_penalty, sentence_penalty, 0.0])[mark[position]]
    return cut_points(total, position, penalty, length, sequence_cost)


Waiting = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]  # ids of documents, their tokens end to end, by document those left and all


def pack(
    docs: DataFrame, *, tokenizer_json: str, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0,
    block_tokens: int = 1 << 19, grid: int = 32, sentence_penalty: float = 1.0, other_penalty: float = 6.0, sequence_cost: float = 64.0, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: its place in the document and in its sequence, and its ids if asked for."""
    long = T.LongType()
    fields = [T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *fields] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_json, ranks_file, pattern)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 32
        held: list[Waiting] = []
        size = 0
        for batch in batches:
            for part in text.pieces(batch, "t"):
                ids, n = encoder.encode(*text.text_bytes(part.column("t")))
                held.append((part.column("k"), np.insert(ids, np.cumsum(n), end_id), n + 1, n + 1))
                size += len(held[-1][1])
                if size >= block_tokens:
                    out, held, sequence = flush(held, encoder.ends, sequence, last=False)
                    yield out
                    size = sum(len(h[1]) for h in held)
        if held:
            yield flush(held, encoder.ends, sequence, last=True)[0]

    def flush(held: list[Waiting], sentence: np.ndarray, sequence: int, last: bool) -> tuple[pa.RecordBatch, list[Waiting], int]:
        """The pieces up to the last cut that the rest of the stream hardly moves; what is behind it."""
        keys = pa.concat_arrays([h[0] for h in held])
        ids, left, whole = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        doc_end = np.cumsum(left)
        cuts = plan(ids, doc_end, sentence, length=length, grid=grid, sentence_penalty=sentence_penalty, other_penalty=other_penalty, sequence_cost=sequence_cost)
        if not last:
            cuts = cuts[cuts <= len(ids) - 8 * length]
        stop = int(cuts[-1]) if len(cuts) else 0
        edges = np.union1d(cuts, doc_end[doc_end <= stop])
        begin = np.concatenate([[0], edges[:-1]])[: len(edges)].astype(np.int64)
        doc = np.searchsorted(doc_end, begin, "right")
        seq = np.searchsorted(cuts, begin, "right")
        seq_begin = np.concatenate([[0], cuts])[seq]
        little = ids.astype("<u4")
        crc = np.array([zlib.crc32(little[a:b]) for a, b in zip(begin.tolist(), edges.tolist(), strict=True)], np.int64)
        columns = [keys.take(pa.array(doc)), begin - doc_end[doc] + whole[doc], edges - begin, crc, whole[doc], seq + sequence, begin - seq_begin]
        arrays = [columns[0], *(pa.array(c, pa.int64()) for c in columns[1:])]
        if with_ids:
            arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, stop), pa.int32()), pa.array(ids, pa.int32())))
        after = np.searchsorted(doc_end, stop, "right")
        rest = [(keys.slice(after), ids[stop:], np.minimum(left, doc_end - stop)[after:], whole[after:])] if stop < len(ids) else []
        return pa.RecordBatch.from_arrays(arrays, names=schema.names), rest, sequence + len(cuts)

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)
