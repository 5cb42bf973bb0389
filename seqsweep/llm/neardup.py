"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document is the set of its distinct k-word shingles. Documents of one and the same set are one class. Each class
gets `trees` labels of `depth` minima; a tree is the table sorted by its label, and candidates are neighbours in
that order with a long common prefix. How long is decided region by region: a region is taken at the shallowest
depth, `least_depth` or more, at which it holds at most `region` classes. Candidates are confirmed on the full sets.

The search takes three rounds, so that a large group of near copies does not give all of its pairs. In the first,
only direct neighbours of a few trees are confirmed, and components are formed. In the second, all trees are read,
and a region proposes every pair of classes that are not yet in one component; a region of more than `region` classes
is searched at larger depths only (and where it shares a whole label, among near neighbours). Such regions, and the
few that a task's end cuts, are reported as unfinished, and the third round searches them completely at the least
depth: every pair of classes that are still apart, in sub-tasks of two blocks of about `block` classes each. There, the
classes of a region's largest component are compared with the others only, so a large group of copies costs little.

Two sketches drop pairs before their sets are fetched: 256 bits of the minima those whose estimate is far below the
threshold (not in the third round), and parities, one for each bucket of shingle hashes, those that cannot be linked:
sets differ in at least as many shingles as parities differ, so that bound loses no link. They are 256, and 4096 in
the third round. With 32 trees and a least depth of 4 a link of similarity 0.8 is missed with a chance of
(1 - 0.8 ** 4) ** 32, 5e-8; the estimate drops fewer (see `least_bits`). Whatever the size of regions and groups,
no other pair is left out.

The sorted orders are dealt by ranges over (tree, label, document), so even one label that a third of all rows share
is spread over tasks. They hold only regions of the least depth with classes of two or more components, as others have
no pair to propose; these are found first, by numbers of regions and components alone, so that the labels and sketches
of most classes are not shuffled tree by tree.

Defined cases: a null or empty text has an empty set and is linked with nothing; one of fewer than k words is a
single shingle; equal sets are one class whatever their number; rows that repeat an id are linked with each other, each
with the size of its own set; a null id stays alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

#: Ids, regions or pairs (of at most two dozen bytes) that are sent to all tasks, so that only the texts and sets of
#: candidates move; beyond, all are shuffled.
MOST_SENT = 1_000_000
LEVEL_BITS = 16
SKETCH = 256
PARITIES = 256
WIDE_PARITIES = 4096


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = text.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (a.astype(np.uint32) | np.uint32(1)), (a >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, row after row; their number by row)."""
    data, offsets = text.text_bytes(column)
    s, e, rows = text.runs(data, offsets, text.NOT_SPACE)
    return text.distinct_by_row(*text.shingles(text.span_hashes(data, s, e), text.counts_by_row(rows, len(column)), k))


def minima(values: np.ndarray, per_row: np.ndarray, n: int) -> np.ndarray:
    """n MinHash minima for each non-empty row."""
    some = per_row[per_row > 0]
    starts = np.cumsum(some) - some
    x = (values >> np.uint64(32)).astype(np.uint32)
    a, b = _constants(n)
    out = np.empty((len(some), n), np.uint32)
    buffer = np.empty_like(x)
    for i in range(n if len(x) else 0):
        np.multiply(x, a[i], out=buffer)
        buffer ^= b[i]
        out[:, i] = np.minimum.reduceat(buffer, starts)
    out *= np.uint32(0x9E3779B1)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA77)
    return out


def parities(values: np.ndarray, per_row: np.ndarray, count: int = PARITIES) -> np.ndarray:
    """For each non-empty row `count` bits, packed: whether a bucket of the hashes holds an odd number of them."""
    some = per_row[per_row > 0]
    ends = np.cumsum(some)
    out = np.empty((len(some), count // 8), np.uint8)
    for a in range(0, len(some), 1024):
        n = some[a : a + 1024]
        mine = values[ends[a] - n[0] : ends[a + len(n) - 1]]
        cell = (mine % np.uint64(count)).astype(np.int64) + np.repeat(np.arange(len(n)) * count, n)
        odd = np.bincount(cell, minlength=len(n) * count) & 1
        out[a : a + len(n)] = np.packbits(odd.astype(np.uint8).reshape(len(n), count), axis=1)
    return out


def least_bits(part: int, whole: int) -> int:
    """The fewest equal sketch bits of a candidate: 6.5 deviations below the threshold, where half the bits agree by chance.

    At a similarity of 0.8 it drops about 3e-9 of the links at the very threshold, in all trees at once.
    """
    share = 0.5 + part / whole / 2
    return int(SKETCH * (share - 6.5 * np.sqrt(share * (1 - share) / SKETCH)))


def sums(values: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes that stand for each row's set, 0 for an empty one."""
    some = np.flatnonzero(per_row)
    out = np.zeros((2, len(per_row)), np.uint64)
    if len(some):
        starts = (np.cumsum(per_row) - per_row)[some]
        with np.errstate(over="ignore"):
            for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                out[i, some] = np.add.reduceat(text.mix(values ^ np.uint64(salt)), starts)
    return out[0].view(np.int64), out[1].view(np.int64)


SIGNED = "doc_id {id}, n_shingles bigint, s1 bigint, s2 bigint, labels array<bigint>, sketch binary"


def sign(docs: DataFrame, *, id_col: str, text_col: str, k: int, trees: int, depth: int) -> DataFrame:
    """doc_id, n_shingles, two sums that stand for the set, the trees' labels (two longs each) and both sketches, end to end."""
    n = trees * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "t"):
                values, per = shingle_sets(part.column("t"), k)
                some = np.flatnonzero(per)
                s1, s2 = sums(values, per)
                m = minima(values, per, n)
                level = (m >> np.uint32(32 - LEVEL_BITS)).astype(np.uint64).reshape(len(some), trees * 2, depth // 2)
                packed = np.zeros((len(some), trees * 2), np.uint64)
                for j in range(depth // 2):
                    packed = (packed << np.uint64(LEVEL_BITS)) | level[:, :, j]
                bits = np.packbits((m[:, np.arange(SKETCH) % n] & 1).astype(np.uint8), axis=1)
                bits = np.concatenate([bits, parities(values, per)], axis=1)
                labels, sketches = [None] * len(per), [None] * len(per)
                for i, row in enumerate(some.tolist()):
                    labels[row], sketches[row] = packed[i].view(np.int64).tolist(), bits[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(per), pa.array(s1), pa.array(s2), pa.array(labels, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "labels", "sketch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, SIGNED.format(id=kind))


def region_key(tree: str, least_depth: int, depth: int) -> Column:
    """A number of the region (tree, prefix of the least depth) of a class; regions that share one by chance are taken together."""
    return F.xxhash64(tree, F.shiftrightunsigned(F.element_at("labels", 2 * F.col(tree) + 1), LEVEL_BITS * (depth // 2 - least_depth)))


def mixed_regions(classes: DataFrame, trees: range, *, least_depth: int, depth: int) -> DataFrame:
    """The numbers of the regions that hold classes of several components, a written table; only numbers are shuffled."""
    rows = classes.select("component", "labels", F.explode(F.sequence(F.lit(trees[0]), F.lit(trees[-1]))).alias("tree"))
    each = rows.select("component", region_key("tree", least_depth, depth).alias("region")).groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return store.written(each.where("x < y").select("region"), "regions")


def forest(classes: DataFrame, trees: range, mixed: DataFrame, *, least_depth: int, depth: int) -> DataFrame:
    """A row for each class and tree whose region is one of mixed, sorted by tree and label within ranges.

    Regions of a single component have no pair to propose; so labels and sketches of most rows never move.
    """
    chosen = F.explode(F.sequence(F.lit(trees[0]), F.lit(trees[-1]))).alias("tree")
    rows, key = classes.select("rep", "component", "n_shingles", "sketch", "labels", chosen), region_key("tree", least_depth, depth).alias("region")
    if mixed.count() <= MOST_SENT:
        rows = rows.withColumn("region", key).join(F.broadcast(mixed), "region", "left_semi")
    else:
        rows = classes.join(rows.select("rep", "tree", key).join(mixed, "region", "left_semi").select("rep", "tree"), "rep")
    rows = rows.select("tree", F.element_at("labels", 2 * F.col("tree") + 1).alias("hi"), F.element_at("labels", 2 * F.col("tree") + 2).alias("lo"), "rep", "component", "n_shingles", "sketch")
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartitionByRange(parts, "tree", "hi", "lo", "rep").sortWithinPartitions("tree", "hi", "lo", "rep")


def _neighbours(batch: dict, *, least_depth: int, depth: int, region: int, near_only: bool, floor_bits: int, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (indices) of rows that are sorted by tree and label."""
    tree, hi, lo, comp = batch["tree"], batch["hi"].view(np.uint64), batch["lo"].view(np.uint64), batch["component"]
    n = len(tree)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = depth // 2
    common = np.zeros(n - 1, np.int64)
    open_ = tree[1:] == tree[:-1]
    for j in range(depth):
        word = hi if j < half else lo
        shift = np.uint64(LEVEL_BITS * (half - 1 - j % half))
        open_ &= (word[1:] >> shift) == (word[:-1] >> shift)
        common += open_
    found_a, found_b = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        ok = comp[a] != comp[b]
        a, b = a[ok], b[ok]
        if len(a):
            apart = np.bitwise_count(batch["sketch"][a] ^ batch["sketch"][b])
            same = SKETCH - apart[:, : SKETCH // 8].sum(1, dtype=np.int64)
            least = apart[:, SKETCH // 8 :].sum(1, dtype=np.int64)  # of the shingles that only one set has
            sizes = batch["n_shingles"][a] + batch["n_shingles"][b]
            least = np.maximum(least, np.abs(batch["n_shingles"][a] - batch["n_shingles"][b]))
            ok = (same >= floor_bits) & ((whole - part) * sizes >= (whole + part) * least)
            a, b = a[ok], b[ok]
        found_a.append(a)
        found_b.append(b)

    beside = np.flatnonzero(common >= least_depth)
    keep(beside, beside + 1)
    if near_only:
        return found_a[0], found_b[0]
    settled = np.zeros(n, bool)
    for d in range(least_depth, depth + 1):
        joined = common >= d
        start = np.flatnonzero(np.concatenate([[True], ~joined]))
        size = np.diff(np.append(start, n))
        small = (size <= region) & (size > 1)
        member = np.repeat(small, size) & ~settled
        settled |= np.repeat(size <= region, size)
        last = np.repeat(start + size, size)
        at = np.flatnonzero(member)
        # regions of a single component have nothing to add
        mixed = np.zeros(n, bool)
        mixed[:-1] = (comp[1:] != comp[:-1]) & joined
        begin = start[np.repeat(np.arange(len(start)), size)]
        some = np.add.reduceat(mixed, start) > 0
        at = at[some[np.searchsorted(start, begin[at])]]
        step = 2
        while len(at):
            at = at[at + step < last[at]]
            keep(at, at + step)
            step += 1
    deep = np.concatenate([[0], np.cumsum(common >= depth)])
    for step in (2, 3, 4):  # regions that stay large down to a whole label
        at = np.flatnonzero(~settled[: max(n - step, 0)])
        at = at[deep[at + step] - deep[at] == step]
        keep(at, at + step)
    return np.concatenate(found_a), np.concatenate(found_b)


def candidates(rows: DataFrame, **options) -> DataFrame:
    """Rows of two kinds: pairs (a, b), a < b, and unfinished regions (tree, prefix)."""
    least, depth, region = options["least_depth"], options["depth"], options["region"]
    shift = np.uint64(LEVEL_BITS * (depth // 2 - least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 15:
                continue
            got, cut = found(held, first, last=False)
            yield got
            first = False
            rest = pa.Table.from_batches(held).combine_chunks().to_batches()[0].slice(cut)
            held = [rest] if rest.num_rows else []
        if held:
            yield found(held, first, last=True)[0]

    def found(held: list[pa.RecordBatch], first: bool, last: bool) -> tuple[pa.RecordBatch, int]:
        t = pa.Table.from_batches(held)
        cols = {c: t.column(c).to_numpy() for c in ("tree", "hi", "lo", "component", "n_shingles", "rep")}
        sketch = t.column("sketch").combine_chunks()
        sketch = sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch
        raw = np.frombuffer(sketch.buffers()[2], np.uint8)
        begin = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset]
        width = (SKETCH + PARITIES) // 8
        cols["sketch"] = raw[begin : begin + len(sketch) * width].reshape(-1, width)
        n = len(cols["tree"])
        tree, prefix = cols["tree"], cols["hi"].view(np.uint64) >> shift
        start = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])])
        size = np.diff(np.append(start, n))
        open_ = size > region
        open_[0] |= first  # what stands before the first row and behind the last one is another task's
        open_[-1] |= last
        cut = upto = n
        if not last:  # the last region waits for the next rows, unless it is much by itself
            cut = int(start[-1])
            upto = cut
            if size[-1] > n - n // 4:
                cut, upto = n - 64, n
            else:
                open_[-1] = False
        a, b = _neighbours({c: v[:upto] for c, v in cols.items()}, **options)
        x, y = cols["rep"][a], cols["rep"][b]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        at = start[open_]
        kind = pa.from_numpy_dtype(pairs.dtype)
        none = pa.nulls(len(at), kind), pa.nulls(len(pairs), pa.int64())
        columns = [pa.concat_arrays([pa.array(pairs[:, i]), none[0]]) for i in (0, 1)]
        columns += [pa.concat_arrays([none[1], pa.array(v[at].astype(np.int64) if v is tree else v[at].view(np.int64))]) for v in (tree, prefix)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "tree", "prefix"]), cut

    return rows.mapInArrow(run, "a bigint, b bigint, tree bigint, prefix bigint").distinct()


def fetched(docs: DataFrame, ids: DataFrame, wanted: DataFrame, measure, field: str, *, id_col: str, text_col: str, k: int) -> DataFrame:
    """(rep, field): measure(sorted shingles, number by row) of the sets of the classes of wanted (rep); ids has a document of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text.pieces(batch, "t"):
                values, per = shingle_sets(piece.column("t"), k)
                s1, s2 = sums(values, per)
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), measure(values, per)], names=["s1", "s2", field.split()[0]])

    few = wanted.count() <= MOST_SENT
    docs_of = ids.join(F.broadcast(wanted) if few else wanted, "rep", "left_semi").select(F.col("doc").alias("k")).distinct()
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(docs_of) if few else docs_of, "k", "left_semi")
    sets = texts.mapInArrow(run, f"s1 bigint, s2 bigint, {field}").withColumn("rep", class_key())
    # a repeated id may have other texts too
    return sets.join(F.broadcast(wanted) if few else wanted, "rep", "left_semi").select("rep", field.split()[0]).dropDuplicates(["rep"])


def class_key() -> Column:
    """The number of a class of equal sets."""
    return F.xxhash64("s1", "s2")


def wide_parities(values: np.ndarray, per: np.ndarray) -> pa.Array:
    bits = iter(parities(values, per, WIDE_PARITIES))
    return pa.array([next(bits).tobytes() if n else None for n in per.tolist()], pa.binary())


def as_lists(values: np.ndarray, per: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(values.view(np.int64)))


def crowded(known: DataFrame, regions: DataFrame, docs: DataFrame, ids: DataFrame, *, trees: int, depth: int, least_depth: int, region: int, block: int, part: int, whole: int, **where) -> DataFrame:
    """Distinct pairs (a, b), a < b, of all classes apart that share one of the regions (tree, prefix), less those that parities prove unlinked."""
    level = F.shiftrightunsigned(F.element_at("labels", 2 * F.col("tree") + 1), LEVEL_BITS * (depth // 2 - least_depth))
    chosen = known.select("rep", "component", "n_shingles", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = chosen.select("rep", "component", "n_shingles", F.col("tree").cast("long").alias("tree"), level.alias("prefix"))
    rows = store.written(rows.join(F.broadcast(regions) if regions.count() <= MOST_SENT else regions, ["tree", "prefix"]), "crowded")
    each = rows.groupBy("tree", "prefix", "component").count()
    mixed = each.groupBy("tree", "prefix").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("component", F.struct("count", "component")).alias("largest")).where("n > most")
    mixed = store.written(mixed.select("tree", "prefix", "largest", F.ceil(F.col("n") / block).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / block).alias("minor_blocks")), "mixed")
    rows = rows.join(F.broadcast(mixed) if mixed.count() <= MOST_SENT else mixed, ["tree", "prefix"])
    reps = store.written(rows.select("rep").distinct(), "wanted")
    wide = store.written(fetched(docs, ids, reps, wide_parities, "wide binary", **where), "wide")
    store.discard(reps)
    mine = rows.join(wide, "rep").withColumn("minor", F.col("component") != F.col("largest"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    fields = ["tree", "prefix", "x", "y", "second", "minor", "rep", "component", "n_shingles", "wide"]
    left = mine.where("minor").withColumn("x", place("minor_blocks")).withColumn("second", F.lit(False)).withColumn("y", F.explode(every("blocks")))
    right = mine.withColumn("y", place("blocks")).withColumn("second", F.lit(True)).withColumn("x", F.explode(every("minor_blocks")))
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = left.select(*fields).union(right.select(*fields)).repartition(parts, "tree", "prefix", "x", "y").sortWithinPartitions("tree", "prefix", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("tree", "prefix", "x", "y")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and tuple(keys[:, a]) != key:
                    yield from searched(held)
                    held = []
                key = tuple(keys[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from searched(held)

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        rep, comp, n, minor, second = (t.column(c).to_numpy() for c in ("rep", "component", "n_shingles", "minor", "second"))
        wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE_PARITIES // 64)
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            apart = (comp[some][:, None] != comp[right][None, :]) & (whole * np.minimum(n[some][:, None], n[right][None, :]) >= part * np.maximum(n[some][:, None], n[right][None, :]))
            apart &= ~minor[right][None, :] | (rep[some][:, None] < rep[right][None, :])  # two minor ones meet twice
            i, j = np.nonzero(apart)
            a, b = some[i], right[j]
            ok = np.zeros(len(a), bool)
            for c in range(0, len(a), 1 << 14):
                u, v = a[c : c + (1 << 14)], b[c : c + (1 << 14)]
                different = np.bitwise_count(wide[u] ^ wide[v]).sum(1, dtype=np.int64)
                ok[c : c + (1 << 14)] = (whole - part) * (n[u] + n[v]) >= (whole + part) * different
            x, y = rep[a[ok]], rep[b[ok]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, ids: DataFrame, *, part: int, whole: int, **where) -> DataFrame:
    """The pairs (a written table) with whole x intersection >= part x union, on the full sets; a written table."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("sa"), batch.column("sb")
            ok = []
            for i in range(batch.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(whole * both >= part * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    wanted = store.written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "wanted")
    table = store.written(fetched(docs, ids, wanted, as_lists, "s array<bigint>", **where), "sets")
    store.discard(wanted)
    sent = F.broadcast(pairs) if pairs.count() <= MOST_SENT else pairs
    full = sent.join(table.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(table.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    links = store.written(full.select("a", "b", "sa", "sb").mapInArrow(test, "a bigint, b bigint"), "confirmed")
    store.discard(table)
    return links


def groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, part: int = 80, whole: int = 100,
    trees: int = 32, depth: int = 8, least_depth: int = 4, region: int = 256, first_trees: int = 6, block: int = 4096,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group) and kept, for every row of docs."""
    signed = store.written(sign(docs, id_col=id_col, text_col=text_col, k=k, trees=trees, depth=depth), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null").withColumn("rep", class_key())
    same = some.groupBy("rep").agg(F.min("doc_id").alias("doc"))
    classes = some.withColumnRenamed("doc_id", "doc").join(same, ["rep", "doc"]).dropDuplicates(["rep"]).select("rep", "doc", "n_shingles", "labels", "sketch")
    classes = store.written(classes, "classes")
    ids = classes.select("rep", "doc")
    options = {"least_depth": least_depth, "depth": depth, "region": region, "part": part, "whole": whole}
    where = {"id_col": id_col, "text_col": text_col, "k": k}
    floor_bits = least_bits(part, whole)
    depths = {"least_depth": least_depth, "depth": depth}

    def joined(labels: DataFrame) -> DataFrame:
        """classes with their components so far."""
        return classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def held(labels: DataFrame) -> DataFrame:
        return labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))

    alone = classes.withColumn("component", F.col("rep"))
    mixed = mixed_regions(alone, range(first_trees), **depths)
    near = store.written(candidates(forest(alone, range(first_trees), mixed, **depths), near_only=True, floor_bits=floor_bits, **options).where("a is not null").select("a", "b"), "pairs")
    links = confirmed(near, docs, ids, part=part, whole=whole, **where)
    # classes that share a repeated id belong together
    shared = some.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    first = store.components(links.union(some.select("doc_id", F.col("rep").alias("b")).join(shared, "doc_id").where("a <> b").select("a", "b")))
    known = store.written(joined(first), "known")
    store.discard(mixed)
    mixed = mixed_regions(known, range(trees), **depths)
    found = store.written(candidates(forest(known, range(trees), mixed, **depths), near_only=False, floor_bits=floor_bits, **options), "pairs")
    store.discard(known)
    store.discard(mixed)
    more, regions = found.where("a is not null").select("a", "b"), found.where("a is null").select("tree", "prefix")
    links2 = confirmed(more, docs, ids, part=part, whole=whole, **where)
    second = store.components(links2.union(held(first)))
    rest = crowded(joined(second), regions, docs, ids, trees=trees, block=block, **options, **where)
    rest = store.written(rest.join(near.union(more), ["a", "b"], "left_anti"), "pairs")
    links3 = confirmed(rest, docs, ids, part=part, whole=whole, **where)
    final = store.components(links3.union(held(second)))
    for used in (near, found, rest, links, links2, links3):
        store.discard(used)
    smallest = final.join(ids, final.node == ids.rep).groupBy("component").agg(F.min("doc").alias("component_id"))
    where_to = ids.join(final.join(smallest, "component").withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component_id", "doc").alias("component_id"))
    where_to = store.written(where_to, "groups")  # so that the join below is dealt anew and a class of many copies can be split
    store.discard(classes)
    out = signed.select("doc_id", "n_shingles", class_key().alias("rep")).join(where_to, "rep", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group, the one of smallest id, with its own columns; documents without words stay."""
    found = groups(docs, id_col=id_col, **options).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")
