"""The search itself: positions of a genome where a pattern ends within a distance.

`kernel` runs over tiles in numpy with the patterns sent to every task (their number is that of the query set, and
checked). Of k + 1 disjoint parts of a pattern at least one stands in the text unchanged (for an edit distance at most
k positions off its place), so the parts are looked up by their packed bases, and only their places are tested:
Hamming by the bits of packed windows, Levenshtein by bit-parallel columns, many places at once. Patterns with a masked
base, or with parts of fewer than `LEAST_SEED` bases, are tested at every position instead, with the same result.

A pattern's N matches every base at no cost; a masked base of the text costs 1 against every pattern, N included.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsweep.arrow import letters, strings, through
from seqsweep.functions import seq as S

CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i
MOST_PATTERNS = 100_000
LEAST_SEED, MOST_SEED = 4, 10
#: Patterns whose forms are held in one set of tables; positions that are searched at once; rows of a batch of hits.
BLOCK, AT_ONCE, MOST_ROWS = 1 << 14, 1 << 18, 1 << 14
BESIDE = 5

HITS = "spacer_idx int, strand string, chrom_idx int, chrom string, end bigint, distance int, context string, context_end int"


def oriented(guides: list[tuple[int, str]], strand: str) -> list[tuple[int, str, str]]:
    """(spacer_idx, strand, pattern over the forward text) for the wanted strands: both, plus or minus."""
    out = []
    for i, s in guides:
        if strand in ("both", "plus"):
            out.append((i, "+", s.upper()))
        if strand in ("both", "minus"):
            out.append((i, "-", S.reverse_complement_text(s.upper())))
    return out


def hamming(text: np.ndarray, pattern: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the last base, distance) of the windows within k."""
    m, n = len(pattern), len(text)
    if n < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = CODE[np.frombuffer(pattern.encode(), np.uint8)]
    wide = np.uint8 if m < 255 else np.uint16
    d = np.zeros(n - m + 1, wide)
    for j in range(m):
        part = text[j : j + n - m + 1]
        d += (part == 4) if codes[j] == 4 else (part != codes[j])
    at = np.flatnonzero(d <= k)
    return at + m - 1, d[at].astype(np.int64)


def levenshtein(lanes: np.ndarray, patterns: list[str]) -> np.ndarray:
    """Semi-global distances (pattern, lane, position) with a free start; lanes hold codes, 5 beyond a lane's end."""
    p, (rows, width) = len(patterns), lanes.shape
    m = np.array([len(x) for x in patterns])
    out = np.empty((p, rows, width), np.uint16)
    if m.max(initial=1) > 64:
        return _levenshtein_any(lanes, patterns)
    eq = np.zeros((p, 6), np.uint64)
    for i, x in enumerate(patterns):
        for j, c in enumerate(CODE[np.frombuffer(x.encode(), np.uint8)].tolist()):
            for b in range(4):
                if c in (b, 4):
                    eq[i, b] |= np.uint64(1 << j)
    one = np.uint64(1)
    pv = np.repeat(np.array([(1 << int(k)) - 1 for k in m], np.uint64)[:, None], rows, 1)
    full = pv.copy()
    mv = np.zeros_like(pv)
    top = (m - 1).astype(np.uint64)[:, None]
    score = np.repeat(m.astype(np.int32)[:, None], rows, 1)
    with np.errstate(over="ignore"):
        for j in range(width):
            e = eq[:, lanes[:, j]]
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = (mv | ~(xh | pv)) & full
            mh = pv & xh
            score += ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32)
            ph <<= one
            mh <<= one
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
            out[:, :, j] = score
    return out


def _levenshtein_any(lanes: np.ndarray, patterns: list[str]) -> np.ndarray:
    """The same for patterns of any length, a column of the matrix at a time."""
    rows, width = lanes.shape
    out = np.empty((len(patterns), rows, width), np.uint16)
    for i, x in enumerate(patterns):
        codes = CODE[np.frombuffer(x.encode(), np.uint8)]
        col = np.repeat(np.arange(len(codes) + 1)[:, None], rows, 1)
        for j in range(width):
            t = lanes[:, j]
            cost = np.where(codes[:, None] == 4, t >= 4, (t[None, :] >= 4) | (t[None, :] != codes[:, None])).astype(np.int64)
            new = np.zeros_like(col)
            new[1:] = np.minimum(col[:-1] + cost, col[1:] + 1)
            steps = np.arange(len(codes) + 1)[:, None]
            new = np.minimum.accumulate(new - steps, axis=0) + steps
            col = new
            out[i, :, j] = col[-1]
    return out


def allowances(m: int, k: int, edits: bool) -> list[int]:
    """The errors, 0 or 1, that each part of a pattern may have: of parts with k errors in all, one has no more than its own.

    Fewer parts are longer, so fewer places have them, but those with an error have many forms; the choice that leaves
    fewer places is taken.
    """

    def places(allowed: list[int]) -> float:
        size = min(m // len(allowed), MOST_SEED)
        return sum((9 if edits else 3) * size if a else 1 for a in allowed) / 4**size

    return min([0] * (k + 1), [0] * (1 - k % 2) + [1] * ((k + 1) // 2), key=places)


def forms(codes: np.ndarray, error: int, edits: bool, right: bool) -> np.ndarray:
    """(form, pattern): packed bases, as many as the part has, that end (right) or begin where the part does with at most `error` errors."""
    size = codes.shape[1]
    packed = lambda x: pack(x.T).astype(np.int64)
    out = [packed(codes)]
    for j in range(size if error else 0):
        other = codes.copy()
        for x in range(4):
            other[:, j] = x
            out.append(packed(other))
            if edits and j:
                out.append(packed(np.insert(codes, j, x, 1)[:, 1:] if right else np.insert(codes, j, x, 1)[:, :size]))
            if edits:
                out.append(packed(np.insert(np.delete(codes, j, 1), 0 if right else size - 1, x, 1)))
    return np.stack(out)


class Seeds:
    """Patterns of one length, and the forms of their parts by which their places are found."""

    def __init__(self, patterns: list[tuple[int, str]], k: int, edits: bool):
        self.number = np.array([i for i, _ in patterns])
        self.codes = codes = CODE[np.frombuffer("".join(p for _, p in patterns).encode(), np.uint8)].reshape(len(patterns), -1)
        self.length = m = codes.shape[1]
        self.k, self.edits = k, edits
        wide = codes.astype(np.uint64)
        allowed = allowances(m, k, edits)
        most = MOST_SEED if len(allowed) <= 8 else 8
        self.parts = []
        for i, error in enumerate(allowed):
            begin, end = i * m // len(allowed), (i + 1) * m // len(allowed)
            right = i < len(allowed) - 1 or len(allowed) == 1  # whether the text behind the part is looked at, or that ahead
            size = min(end - begin, most)
            at = end - size if right else begin
            key = forms(wide[:, at : at + size], error, edits, right)
            entry = np.arange(len(codes)) * 2 + (key == key[0])  # odd: the part has no error here
            rows = np.unique((key << 32) + entry)
            first = np.concatenate([[0], np.cumsum(np.bincount(rows >> 32, minlength=4**size))]).astype(np.int32)
            beside = wide[:, at + size : at + size + MOST_SEED][:, ::-1] if right else wide[:, max(0, at - MOST_SEED) : at]
            self.parts.append((at, size, error, right, first[1:] > first[:-1], first, (rows & 0xFFFFFFFF).astype(np.int32), beside.shape[1], pack(beside.T).astype(np.uint32) if beside.shape[1] else None))
        self.pieces = [(a, min(MOST_SEED, m - a), pack(wide[:, a : a + MOST_SEED].T).astype(np.uint32)) for a in range(0, m, MOST_SEED)]
        self.eq = np.zeros((len(codes), 6), np.uint64)
        for j in range(min(m, 64)):
            self.eq[np.arange(len(codes)), codes[:, j]] |= np.uint64(1 << j)

    def places(self, text: Text, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pattern, where it would begin) for the forms that stand in the text, in slices of about `most`.

        Masked bases are looked up as some base: forms with an error have them all.
        """
        for at, size, error, right, known, first, entries, beside, other in self.parts:
            key = text.ahead if size == MOST_SEED else text.ahead >> 2 * (MOST_SEED - size)
            here = np.flatnonzero(known[key])
            here = here[text.masked[here + size] - text.masked[here] <= error]
            low = first[key[here]]
            count = first[key[here] + 1] - low
            ends = np.cumsum(count)
            a = 0
            while a < len(here):
                b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")), a + 1)
                c = count[a:b]
                entry = entries[np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c - low[a:b], c)]
                pattern, spot = entry >> 1, np.repeat(here[a:b], c)
                if self.edits and self.k <= 3 and beside:
                    ok = self.goes_on(text, pattern, spot + size if right else spot, right, beside, other)
                    if self.k == 3:
                        ok |= (entry & 1).astype(bool)
                    pattern, spot = pattern[ok], spot[ok]
                yield pattern, spot - at
                a = b

    @staticmethod
    def goes_on(text: Text, pattern: np.ndarray, spot: np.ndarray, right: bool, size: int, other: np.ndarray) -> np.ndarray:
        """Whether the `size` bases beside a part go on in the text beside `spot` with at most two errors.

        For each diagonal a mask of unequal bases, two bits a base; by number of errors the farthest row of each. A
        masked base may count as equal, so all that do are among those that this finds.
        """
        mine, end = other[pattern], np.uint32(2 * size)
        two, odd, stop = np.uint32(2), np.uint32(0x55555555 & ((1 << 2 * size) - 1)), np.uint32(1 << 2 * size)

        def unequal(d: int) -> np.ndarray:
            x = (text.behind[spot + d] if right else text.ahead[spot - d - MOST_SEED].astype(np.uint32)) ^ mine
            return ((x | (x >> np.uint32(1))) & odd) | stop

        def along(mask: np.ndarray, row: np.ndarray) -> np.ndarray:
            row = np.minimum(row, end)
            rest = mask >> row
            return row + np.bitwise_count((rest & -rest) - np.uint32(1))

        here, more, less = unequal(0), unequal(1), unequal(-1)
        f = along(here, np.zeros(len(spot), np.uint32))
        a, p, m = along(here, f + two), along(more, f), along(less, f + two)
        best = along(here, np.maximum(np.maximum(a, p) + two, m))
        best = np.maximum(best, along(more, np.maximum(p + two, a)))
        best = np.maximum(best, along(less, np.maximum(m, a) + two))
        best = np.maximum(best, along(unequal(2), p))
        return np.maximum(best, along(unequal(-2), m + two)) >= end

    def found(self, text: Text) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pattern, exclusive end, distance), each end once; some are beyond a piece's own."""
        wide = len(text.codes)
        if self.edits:
            keys = [np.unique(pattern.astype(np.int64) * wide + start) for pattern, start in self.places(text)]
            yield from self.levenshtein(text, np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64))
        else:
            yield from self.hamming(text)

    def hamming(self, text: Text) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        odd, found = np.uint32(0x55555555), []
        for pattern, start in self.places(text):
            d = np.zeros(len(start), np.uint16)
            for a, size, mine in self.pieces:
                x = (text.ahead[start + a].astype(np.uint32) >> np.uint32(2 * (MOST_SEED - size))) ^ mine[pattern]
                d += np.bitwise_count((x | (x >> np.uint32(1))) & odd)
            ok = d <= self.k  # masked bases may count as equal so far
            pattern, start = pattern[ok], start[ok]
            for a in range(0, len(start), 1 << 14):
                p, s = pattern[a : a + (1 << 14)], start[a : a + (1 << 14)]
                bases = text.codes[s[:, None] + np.arange(self.length)]
                d = (bases != self.codes[p]).sum(1)
                ok = (d <= self.k) & ~(bases == BESIDE).any(1)
                found.append(np.stack([p[ok], s[ok] + self.length, d[ok]]))
        yield from once(found)

    def levenshtein(self, text: Text, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ends of up to k to both sides of each place (pattern * length of the text + start)."""
        m, k = self.length, self.k
        width = m + 3 * k
        found = []
        word = np.uint32 if m < 32 else np.uint64
        one, top, full = word(1), word(m - 1), word((1 << m) - 1)
        table = self.eq.astype(word).ravel()
        for a in range(0, len(keys), 1 << 13):
            pattern, start = np.divmod(keys[a : a + (1 << 13)], len(text.codes))
            at, row = start - 2 * k, pattern * 6
            pv, mv = np.full(len(pattern), full), np.zeros(len(pattern), word)
            score = np.full(len(pattern), m, np.int32)
            with np.errstate(over="ignore"):
                for j in range(width):
                    e = table[row + text.codes[at + j]]
                    xv = e | mv
                    xh = (((e & pv) + pv) ^ pv) | e
                    ph = (mv | ~(xh | pv)) & full
                    mh = pv & xh
                    score += ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32)
                    ph <<= one
                    mh <<= one
                    pv = (mh | ~(xv | ph)) & full
                    mv = ph & xv & full
                    if j >= width - 2 * k - 1:
                        ok = score <= k
                        found.append(np.stack([pattern[ok], at[ok] + j + 1, score[ok]]))
        yield from once(found)


@lru_cache(maxsize=16)
def seeds_of(patterns: tuple[tuple[int, str], ...], k: int, edits: bool) -> Seeds:
    """Kept from task to task of a worker."""
    return Seeds(list(patterns), k, edits)


class Text:
    """Pieces of text end to end, with `gap` positions that match nothing ahead of each and after the last."""

    def __init__(self, pieces: list[np.ndarray], gap: int):
        length = np.array([len(x) for x in pieces])
        self.at = np.cumsum(length + gap) - length
        self.end = self.at + length
        self.codes = np.full(int(self.end[-1]) + gap, BESIDE, np.uint8)
        for a, x in zip(self.at.tolist(), pieces, strict=True):
            self.codes[a : a + len(x)] = x
        self.masked = np.concatenate([[0], np.cumsum(self.codes > 3, dtype=np.int32)])
        one = (self.codes & 3).astype(np.uint32)
        two = one[:-1] << np.uint32(2) | one[1:]
        four = two[:-2] << np.uint32(4) | two[2:]
        eight = four[:-4] << np.uint32(8) | four[4:]
        #: The bases from each position on, packed with the first one highest, and with the first one lowest.
        self.ahead = (eight[:-2] << np.uint32(4) | two[8:]).astype(np.intp)
        two = one[:-1] | one[1:] << np.uint32(2)
        four = two[:-2] | two[2:] << np.uint32(4)
        eight = four[:-4] | four[4:] << np.uint32(8)
        self.behind = eight[:-2] | two[8:] << np.uint32(16)


def pack(columns) -> np.ndarray:
    """Two bits a base, the first base highest."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out << np.uint64(2)) | c
    return out


def once(found: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pattern, end, least distance), each place once."""
    if not found:
        return
    rows = np.concatenate(found, 1)
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    new = np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])] if rows.shape[1] else np.zeros(0, bool)
    yield rows[0, new], rows[1, new], rows[2, new]


def kernel(tiles: DataFrame, patterns: list[tuple[int, str, str]], *, k: int, mode: str, flank: int = 0, region: tuple[str, int, int] | None = None, lane: int = 512) -> DataFrame:
    """Raw hits: `end` is exclusive, on the forward strand for both strands; `context` are the bases around it.

    region is (sequence, start, end), 0-based and half-open; nothing before its start is read by the distance.
    """
    if not 0 <= k <= 255:
        raise ValueError("the threshold must be between 0 and 255")
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} oriented patterns: search in batches")
    longest = max((len(p) for _, _, p in patterns), default=1)
    reach = 2 * longest + 2 * k
    left = longest + 2 * k + 1 + flank
    by_length: dict[int, list[tuple[int, str]]] = {}
    rest = []
    for i, (_, _, p) in enumerate(patterns):
        seeded = "N" not in p and len(p) // (k + 1) >= LEAST_SEED and (len(p) <= 64 or mode == "hamming")
        (by_length.setdefault(len(p), []) if seeded else rest).append((i, p))
    blocks = [tuple(found[a : a + BLOCK]) for found in by_length.values() for a in range(0, len(found), BLOCK)]

    names = [f.split()[0] for f in HITS.split(", ")]
    Tile = tuple[int, int, int, np.ndarray]  # first and last position to answer for, first position of the text, the text's bytes
    Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # tile, pattern, exclusive end, distance

    def by_seeds(held: list[Tile]) -> Found:
        """The texts of all held tiles go through end to end."""
        first = np.array([max(start, low - reach, region[1] if region else 0) for low, _, start, _ in held])
        answer = np.array([low for low, *_ in held])
        text = Text([CODE[data[f - start : high - start]] for f, (_, high, start, data) in zip(first.tolist(), held, strict=True)], longest + 3 * k + MOST_SEED + 2)
        for block in blocks:
            seeds = seeds_of(block, k, mode != "hamming")
            for pattern, end, d in seeds.found(text):
                t = np.searchsorted(text.at, end - 1, "right") - 1
                place = end - text.at[t] + first[t]
                ok = (t >= 0) & (end <= text.end[t]) & (place > answer[t])
                yield t[ok], seeds.number[pattern[ok]], place[ok], d[ok]

    def by_shifts(held: list[Tile]) -> Found:
        """The same, every pattern at every position."""
        for t, (low, high, start, data) in enumerate(held):
            first = max(start, low - longest, region[1] if region else 0)
            codes = CODE[data[first - start : high - start]]
            for i, p in rest:
                at, d = hamming(codes, p, k)
                ok = at + first >= low
                yield np.full(int(ok.sum()), t), np.full(int(ok.sum()), i), at[ok] + first + 1, d[ok]

    def by_lanes(held: list[Tile]) -> Found:
        """The same by Levenshtein distance; the lanes of all held tiles go through the columns together."""
        width = lane + reach
        rows, meta = [], []
        for t, (low, high, start, data) in enumerate(held):
            first = max(start, low - reach, region[1] if region else 0)
            codes = CODE[data[first - start : high - start]]
            for b in range(low, high, lane):
                a = max(first, b - reach)
                row = np.full(width, 5, np.uint8)
                part = codes[a - first : b + lane - first]
                row[: len(part)] = part
                rows.append(row)
                meta.append((t, a, b, min(b + lane, high)))
        number = np.array([i for i, _ in rest])
        for a in range(0, len(rows), 192):
            block, where = np.stack(rows[a : a + 192]), np.array(meta[a : a + 192])
            for g in range(0, len(rest), 16):
                dist = levenshtein(block, [p for _, p in rest[g : g + 16]])
                i, r, j = np.nonzero(dist <= k)
                place = where[r, 1] + j
                ok = (place >= where[r, 2]) & (place < where[r, 3])
                i, r, j, place = i[ok], r[ok], j[ok], place[ok]
                yield where[r, 0], number[g + i], place + 1, dist[i, r, j]

    spacer = np.array([i for i, _, _ in patterns], np.int32)
    plus = np.array([s == "+" for _, s, _ in patterns], bool)

    def tiles_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[Tile]]]:
        """(rows, tiles) to search at once."""
        size, c0, n, t0 = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tolist() for c in ("seq_len", "core_start", "core_len", "text_start"))
        wanted = [not region or x == region[0] for x in batch.column("chrom").to_pylist()] if region else [True] * batch.num_rows
        data, at = letters(batch.column("text"))
        at = at.tolist()
        rows, held, total = [], [], 0
        for r in range(batch.num_rows):
            low, high = (max(c0[r], region[1]), min(c0[r] + n[r], region[2])) if region else (c0[r], c0[r] + n[r])
            if low < high and wanted[r]:
                text = data[at[r] : at[r + 1]]
                if low - t0[r] < min(max(reach, left), low) or t0[r] + len(text) < min(high + flank, size[r]):
                    raise ValueError(f"the tiles' margin is too small for these patterns: it must be {margin_for(longest, k, flank)} or more")
                rows.append(r)
                held.append((low, high, t0[r], text))
                total += len(text)
            if total >= AT_ONCE:
                yield np.array(rows), held
                rows, held, total = [], [], 0
        if held:
            yield np.array(rows), held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in tiles_of(batch):
                data = np.concatenate([x for *_, x in held])
                size = np.array([len(x) for *_, x in held])
                begin, start = np.cumsum(size) - size, np.array([x[2] for x in held])
                every = [by_seeds(held)] if blocks else []
                every += [(by_shifts if mode == "hamming" else by_lanes)(held)] if rest else []
                for t, i, e, d in (x for found in every for x in found):
                    for a in range(0, len(t), MOST_ROWS):
                        tile, pattern, end = t[a : a + MOST_ROWS], i[a : a + MOST_ROWS], e[a : a + MOST_ROWS]
                        first = np.maximum(start[tile], end - left)
                        at = begin[tile] - start[tile]
                        context = strings(data, at + first, np.minimum(at + end + flank, begin[tile] + size[tile]))
                        row = pa.array(rows[tile])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(spacer[pattern]), pa.array(["-", "+"]).take(pa.array(plus[pattern].astype(np.int8))), batch.column("chrom_idx").take(row), batch.column("chrom").take(row),
                            pa.array(end.astype(np.int64)), pa.array(d[a : a + MOST_ROWS].astype(np.int32)), context, pa.array((end - first).astype(np.int32)),
                        ], names=names)

    if region:
        tiles = tiles.where((F.col("chrom") == region[0]) & (F.col("core_start") < region[2]) & (F.col("core_start") + F.col("core_len") > region[1]))
    return through(tiles, run, HITS)


def margin_for(longest: int, k: int, flank: int) -> int:
    """The tile margin that a search needs; `kernel` raises an error where tiles have less."""
    return 2 * longest + 2 * k + 2 + flank
