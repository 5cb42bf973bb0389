"""Alignment of hits: CIGAR, aligned bases, span and flanking motif, and the motif filter under bulges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsweep.arrow import gathered, through
from seqsweep.functions import seq as S
from seqsweep.operators.scan import CODE

ANNOTATED = [
    ("aligned_seq", "string"), ("cigar", "string"), ("pam_seq", "string"), ("target_len", "int"), ("alignment_ambiguous", "boolean"), ("n_ambiguous_cells", "int"),
]


def matrix(pattern: str, text: str, top: list[int]) -> list[list[int]]:
    rows = [top]
    for i, p in enumerate(pattern, 1):
        row, above = [i], rows[-1]
        for j, t in enumerate(text, 1):
            row.append(min(above[j - 1] + (p != "N" and (t == "N" or p != t)), row[-1] + 1, above[j] + 1))
        rows.append(row)
    return rows


def trace(rows: list[list[int]], pattern: str, text: str, j: int) -> tuple[str, int, int]:
    """(operations from the first on, cells with several best predecessors, text index where it stops); ties go to M, D, I."""
    i, ops, ambiguous = len(pattern), [], 0
    while i and j:
        p, t, here = pattern[i - 1], text[j - 1], rows[i][j]
        ways = [op for op, v in (("M", rows[i - 1][j - 1] + (p != "N" and (t == "N" or p != t))), ("D", rows[i][j - 1] + 1), ("I", rows[i - 1][j] + 1)) if v == here]
        ambiguous += len(ways) > 1
        ops.append(ways[0])
        i -= ways[0] != "D"
        j -= ways[0] != "I"
    return "".join(reversed(ops + ["I"] * i)), ambiguous, j


@lru_cache(maxsize=1 << 16)
def runs(ops: str) -> tuple[str, tuple[tuple[int, int], ...]]:
    """The CIGAR, and where in the text and how many bases of its own the pattern has. Few forms of alignments make up most hits."""
    out, own, at = [], [], 0
    for op, g in groupby(ops):
        n = len(list(g))
        out.append(f"{n}{op}")
        if op == "I":
            own.append((at, n))
        else:
            at += n
    return "".join(out), tuple(own)


def cigar(ops: str) -> str:
    return runs(ops)[0]


def gapped(ops: str, text: str) -> str:
    """The text's side of the alignment: a dash where the pattern has a base of its own."""
    out, before = [], 0
    for at, n in runs(ops)[1]:
        out += [text[before:at], "-" * n]
        before = at
    return "".join([*out, text[before:]]) if out else text


def canonical(pattern: str, text: str, plus: bool) -> tuple[str, str, int, int]:
    """(CIGAR, aligned bases, text consumed, ambiguous cells): a plus hit ends at the text's end with a free start, a
    minus hit (text in its orientation) starts at the text's start and ends where the distance is first least."""
    rows = matrix(pattern, text, [0] * (len(text) + 1) if plus else list(range(len(text) + 1)))
    j = len(text)
    if not plus:
        last = rows[-1]
        least = min(last[1:], default=last[0])
        j = last.index(least, 1) if len(text) and least < last[len(text)] else len(text)
    ops, ambiguous, _ = trace(rows, pattern, text, j)
    used = sum(op != "I" for op in ops)
    return cigar(ops), gapped(ops, text[j - used : j]), used, ambiguous


def canonical_many(pairs: list[tuple[str, str]], plus: bool, most: int = 1024) -> list[tuple[str, str, int, int]]:
    """`canonical` of many pairs of one pattern length and one text length, cell by cell for all of them at once."""
    if not pairs or not pairs[0][1]:
        return [canonical(p, t, plus) for p, t in pairs]
    if len(pairs) > most:
        return [x for a in range(0, len(pairs), most) for x in canonical_many(pairs[a : a + most], plus, most)]
    p, t = (np.frombuffer("".join(x).encode(), np.uint8).reshape(len(pairs), -1).T for x in zip(*pairs, strict=True))
    m, n, every = len(p), len(t), np.arange(len(pairs))
    wild, masked = ord("N"), t == ord("N")
    d = np.zeros((m + 1, n + 1, len(pairs)), np.int16)
    d[:, 0] = np.arange(m + 1)[:, None]
    if not plus:
        d[0] = np.arange(n + 1)[:, None]
    differs = (p[:, None, :] != wild) & (masked[None, :, :] | (p[:, None, :] != t[None, :, :]))
    for i in range(1, m + 1):
        over = np.minimum(d[i - 1, :-1] + differs[i - 1], d[i - 1, 1:] + 1)
        for j in range(1, n + 1):
            np.minimum(over[j - 1], d[i, j - 1] + 1, out=d[i, j])
    j = np.full(len(pairs), n)
    if not plus:
        first = d[m, 1:].argmin(0) + 1
        j = np.where(d[m, first, every] < d[m, n], first, n)
    end, i = j.copy(), np.full(len(pairs), m)
    steps, ambiguous = [], np.zeros(len(pairs), np.int64)
    while (open_ := (i > 0) & (j > 0)).any():
        u, v = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here = d[i, j, every]
        ways = np.stack([here == d[u, v, every] + differs[u, v, every], here == d[i, v, every] + 1, here == d[u, j, every] + 1])
        ambiguous += open_ & (ways.sum(0) > 1)
        way = ways.argmax(0)  # the first that holds: M, D, I
        steps.append(np.where(open_, np.array([77, 68, 73], np.uint8)[way], 32))
        i = i - (open_ & (way != 1))
        j = j - (open_ & (way != 2))
    rows = np.stack(steps[::-1], 1) if steps else np.zeros((len(pairs), 0), np.uint8)
    out = []
    for (_, text), row, left, stop, cells in zip(pairs, rows, i.tolist(), end.tolist(), ambiguous.tolist(), strict=True):
        ops = "I" * left + row.tobytes().decode().strip()
        used = len(ops) - ops.count("I")
        out.append((cigar(ops), gapped(ops, text[stop - used : stop]), used, cells))
    return out


def pinned(pattern: str, text: str, k: int) -> tuple[int, str, str, int] | None:
    """(distance, CIGAR, aligned bases, ambiguous cells) of the global alignment, or None beyond k."""
    rows = matrix(pattern, text, list(range(len(text) + 1)))
    if rows[-1][-1] > k:
        return None
    ops, ambiguous, j = trace(rows, pattern, text, len(text))
    ops = "D" * j + ops
    return rows[-1][-1], cigar(ops), gapped(ops, text), ambiguous


def prefix_distances(texts: np.ndarray, patterns: np.ndarray, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each length, the global distances (text, pattern) of whole patterns and the texts' first bases, by bit-parallel columns.

    Both are codes (texts 0-4, patterns 0-3) of one length each, patterns of at most 63 bases; a masked base costs 1.
    """
    m = patterns.shape[1]
    word = np.uint32 if m < 32 else np.uint64
    eq = np.zeros((5, len(patterns)), word)
    for j in range(m):
        eq[patterns[:, j], np.arange(len(patterns))] |= word(1 << j)
    shape = (len(texts), len(patterns))
    one, top = word(1), word(m - 1)
    pv, mv, score = np.full(shape, (1 << m) - 1, word), np.zeros(shape, word), np.full(shape, m, np.int16)
    for j in range(max(lengths)):
        e = eq[texts[:, j]]
        xh = e & pv
        xh += pv
        xh ^= pv
        xh |= e
        e |= mv
        mh = pv & xh
        np.bitwise_or(xh, pv, out=xh)
        np.invert(xh, out=xh)
        xh |= mv  # the row's increases
        score += ((xh >> top) & one).astype(np.int16)
        score -= ((mh >> top) & one).astype(np.int16)
        xh <<= one
        xh |= one  # nothing of the text is left out at its start
        mh <<= one
        mv = xh & e
        e |= xh
        np.invert(e, out=e)
        e |= mh
        pv = e
        if j + 1 in lengths:
            yield score.copy()


def exist_at(rows: DataFrame, guides: DataFrame, lengths: tuple[int, ...], k: int, block: int = 1024) -> DataFrame:
    """chrom, spacer and, for each length n, exists_at_n: whether the guide aligns with the first n bases of t at a distance of at most k.

    rows are (chrom, t) with t of the largest length at least, guides (spacer, sequence) without masked bases and of one
    length below 64. Distances are computed for blocks of guides, and a text's answers spread to rows only at the end.
    """
    found = sorted(map(tuple, guides.select("spacer", "sequence").collect()))
    if len({len(s) for _, s in found}) > 1:
        raise ValueError("the guides must have one length")
    n = max(lengths)
    schema = T.StructType([rows.schema["chrom"], T.StructField("block", T.IntegerType()), *(T.StructField(f"f{x}", T.ArrayType(T.BooleanType())) for x in lengths)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = np.array([list(s.encode()) for _, s in found], np.uint8).reshape(len(found), len(found[0][1]) if found else 0)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = CODE[np.array([list(t[:n].encode()) for t in part.column("t").to_pylist()], np.uint8).reshape(-1, n)]
                for b in range(0, len(found), block):
                    some = CODE[coded[b : b + block]]
                    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(some))
                    flags = [pa.ListArray.from_arrays(offsets, pa.array((d <= k).ravel())) for d in prefix_distances(texts, some, lengths)]
                    yield pa.RecordBatch.from_arrays([part.column("chrom"), pa.array(np.full(len(texts), b // block, np.int32)), *flags], names=schema.names)

    names = rows.sparkSession.createDataFrame([(i // block, i % block, spacer) for i, (spacer, _) in enumerate(found)], "block int, at int, spacer string")
    met = rows.select("chrom", "t").mapInArrow(run, schema).join(F.broadcast(names), "block")
    return met.select("chrom", "spacer", *[F.expr(f"f{x}[at]").alias(f"exists_at_{x}") for x in lengths])


class Motif:
    """The motif beside a hit: read from the hit's context, tested by pattern."""

    def __init__(self, pattern: str, side: str, extract: int):
        import re

        self.length, self.side = extract or len(pattern), side
        self.test = re.compile(S.motif_regex(pattern)) if pattern else None

    def after(self, plus: bool) -> bool:
        return plus == (self.side == "3")

    def read(self, context: str, end: int, plus: bool, span: int) -> str:
        if not self.length:
            return ""
        if self.after(plus):
            raw = context[end : end + self.length]
        else:
            begin = max(0, end - span)
            raw = context[max(0, begin - self.length) : begin]
        return raw if plus else S.reverse_complement_text(raw)

    def fits(self, bases: str) -> bool:
        return bool(self.test and self.test.match(bases))


def annotate(hits: DataFrame, guides: dict[int, str], *, k: int, mode: str, motif: str = "", side: str = "3", extract: int = 0, alignments: bool = True, ungapped: bool = False) -> DataFrame:
    """hits less their context, with alignment columns; with a motif, only hits that have it.

    On the side where an indel moves the motif (before a plus hit's start or a minus hit's), a Levenshtein hit may
    have it at another span: the spans of the pattern's length less k to more k are tried, and the alignment of that
    span (both ends fixed, the least distance, the shortest span of these) takes the place of the hit's own.

    With `ungapped` the bases that a Hamming hit covers stand for its alignment.
    """
    kept = [c for c in hits.columns if c not in ("context", "context_end")]
    schema = T.StructType([hits.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in ANNOTATED])
    flank = Motif(motif.upper(), side, extract)
    bulges = mode == "levenshtein" and k > 0

    def beside(guide: str, plus: bool, d: int, context: str, end: int) -> str:
        """The text that a hit is aligned with, in its orientation."""
        text = context[max(0, end - (len(guide) + d + 1)) : end]
        return text if plus else S.reverse_complement_text(text)

    def one(guide: str, plus: bool, d: int, context: str, end: int, aligned: dict) -> tuple | None:
        m = len(guide)
        spans = range(max(1, m - k), m + k + 1)
        pam = flank.read(context, end, plus, m)
        if flank.test and not flank.fits(pam):
            if not bulges or flank.after(plus):
                return None
            pam = next((x for x in (flank.read(context, end, plus, s) for s in spans) if flank.fits(x)), None)
            if pam is None:
                return None
        if ungapped:
            text = context[end - m : end]
            return d, text if plus else S.reverse_complement_text(text), f"{m}M", pam or None, None, None, None
        if not alignments:
            return d, None, None, pam or None, None, None, None
        text = beside(guide, plus, d, context, end)
        if d == 0:
            seq, ops, span, ambiguous = (text[-m:] if plus else text[:m]), f"{m}M", m, 0
        else:
            ops, seq, span, ambiguous = aligned[guide, text, plus]
        pam = flank.read(context, end, plus, span or m)
        if flank.test and mode == "levenshtein" and not flank.fits(pam):
            if not bulges or flank.after(plus):
                return None
            best = None
            for s in spans:
                other = flank.read(context, end, plus, s)
                if s > end or not flank.fits(other):
                    continue
                part = context[end - s : end]
                got = pinned(guide, part if plus else S.reverse_complement_text(part), k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], got[2], got[1], other, s, got[3] > 0, min(got[3], 65535))
            return best
        return d, seq, ops, pam or None, span, ambiguous > 0, min(ambiguous, 65535)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            rows = [(guides[g], s == "+", d, c, e) for g, s, d, c, e in zip(*(batch.column(c).to_pylist() for c in ("spacer_idx", "strand", "distance", "context", "context_end")), strict=True)]
            todo: dict[tuple[int, int, bool], set[tuple[str, str]]] = {}
            for g, plus, d, c, e in rows if alignments and not ungapped else ():
                if d:
                    text = beside(g, plus, d, c, e)
                    todo.setdefault((len(g), len(text), plus), set()).add((g, text))
            aligned = {}
            for (_, _, plus), pairs in todo.items():
                pairs = sorted(pairs)
                aligned.update(((g, t, plus), x) for (g, t), x in zip(pairs, canonical_many(pairs, plus), strict=True))
            got = [one(*row, aligned) for row in rows]
            part = batch.filter(pa.array([x is not None for x in got], pa.bool_()))
            cols = list(zip(*(x for x in got if x is not None), strict=True)) or [()] * 7
            same = [pa.array(cols[0], pa.int32()) if c == "distance" else part.column(c) for c in kept]
            new = [pa.array(c, t) for c, t in zip(cols[1:], (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*same, *new], names=schema.names)

    return through(hits, run, schema)
