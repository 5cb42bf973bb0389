"""Exact top-k inner product search by no-random-access aggregation.

The rows of a block give a sorted list for each dimension, read entry by entry from its top where the query's weight
is positive and from its bottom where it is negative. Reading goes on in rounds, in the lists whose last entries have
lowered the threshold most. The threshold, the sum of the weighted values at the cursors, bounds every row that no
list has shown yet; as soon as it is below the k-th best score known so far, only rows that have been read can
qualify. Those have a lower bound (the worst value of each list where they have not been read) and an upper bound (the
value at the cursor there); reading goes on, now for the rows alone whose upper bound is still able, until few are
left or the lists end, and these few are resolved to exact scores. A task takes its rows block after block and
carries the best scores along, so later blocks stop earlier; it starts from the best scores among the queries
themselves, which are rows too.

How much is read depends on the data: on vectors whose weight lies in a few dimensions a few hundredths of the
entries, on isotropic ones about half (`best` gives the number).

Queries go to the tasks in blocks of at most about `query_bytes`, one pass over the rows for each block; the rows are
never shuffled, and each task returns k + 1 rows for a query.

Defined cases: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part;
an empty vector has score 0 with every other one; vectors of another length are not compared; rows that repeat an id
are rows of their own: each is a candidate, and a query leaves out one row of its own id and vector; queries that
repeat both give their result as often; ties go to the smaller id; a query with fewer than k candidates gets all; no
queries or an empty table give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

LOCAL = "block int, place int, query_id bigint, copies bigint, vec_id bigint, score bigint, own boolean"


def exact_kind(rows: np.ndarray, queries: np.ndarray) -> type:
    """The float type in which all sums of products are exact."""
    span = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(rows.shape[1], 1)
    return np.float32 if span < 1 << 24 else np.float64


class Lists:
    """The sorted lists of a block of rows."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
        self.value = np.ascontiguousarray(np.sort(rows, axis=0).T)

    def cursor(self, weights: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The value last read in each list (query, dimension)."""
        at = np.where(weights > 0, len(self.rows) - depth, depth - 1)
        return self.value[np.arange(len(self.value)), at]

    def worst(self, weights: np.ndarray) -> np.ndarray:
        """The value at the end of each list."""
        return np.where(weights > 0, self.value[:, 0], self.value[:, -1])

    def shown(self, weights: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Rows that some list has shown."""
        n = len(self.rows)
        if depth.sum() >= 2 * n:
            return np.arange(n)
        seen = np.zeros(n, bool)
        for d in np.flatnonzero(depth):
            seen[self.order[d, n - depth[d] :] if weights[d] > 0 else self.order[d, : depth[d]]] = True
        return np.flatnonzero(seen)

    def read(self, weights: np.ndarray, known: np.ndarray, rounds: int = 64) -> np.ndarray:
        """Depths (query, dimension) at which no unread row can reach the known scores."""
        n, step = len(self.rows), max(1, len(self.rows) // rounds)
        size = np.abs(weights)
        used = size > 0
        depth = np.where(used, 1, 0)
        todo = np.arange(len(weights))
        at = self.cursor(weights, np.maximum(depth, 1))
        gain = np.where(used, np.inf, 0)
        while len(todo):
            w = weights[todo]
            able = (at[todo] * w).sum(1) >= known[todo]
            able &= (depth[todo] < n)[used[todo]].any() if len(todo) == 1 else ((depth[todo] < n) & used[todo]).any(1)
            todo = todo[able]
            if not len(todo):
                break
            g = np.where((depth[todo] < n) & used[todo], gain[todo], -1)
            finite = np.where(np.isfinite(g) & (g >= 0), g, 0)
            mean = finite.sum(1) / np.maximum(((g >= 0) & np.isfinite(g)).sum(1), 1)
            chosen = (g >= mean[:, None]) & (g >= 0)
            new = np.minimum(depth[todo] + step * chosen, n)
            there = self.cursor(weights[todo], np.maximum(new, 1))
            gain[todo] = np.where(chosen, np.abs(there - at[todo]) * size[todo], gain[todo])
            depth[todo], at[todo] = new, there
        return depth

    def able(self, weights: np.ndarray, depth: np.ndarray, known: float, most: int, few: int) -> tuple[np.ndarray, int]:
        """(rows that can be among the best `most`, entries read) for one query, reading on from depth."""
        n = len(self.rows)
        used = weights != 0
        alive = self.shown(weights, depth) if used.any() else np.arange(n)
        low = self.worst(weights) * weights
        while True:
            here = self.cursor(weights, np.maximum(depth, 1)) * weights
            y = self.rows[alive] * weights if len(alive) < n else self.rows * weights
            if not np.isfinite(known) and len(alive) >= most:
                lower = np.where(y > here, y, low).sum(1)
                known = float(np.partition(lower, len(lower) - most)[len(lower) - most])
            unread = float(here.sum()) >= known and not (depth[used] == n).all()
            if not unread:
                alive = alive[np.maximum(y, here).sum(1) >= known]
            if (not unread and len(alive) <= few) or (depth[used] == n).all():
                return alive, int(depth.sum())
            left = np.where(depth < n, here - low, -1)  # what a list can still take from the bounds
            depth = np.where(used & (2 * left >= left.mean(where=left >= 0)), np.minimum(depth + depth // 2 + 1, n), depth)
            if unread:
                alive = self.shown(weights, depth)


def best(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, most: int, known: np.ndarray, few: int = 64, batch: int = 1024) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """(rows by place, ids and scores of the `most` best rows of the block, best first, that can reach `known`, for each query; entries read)."""
    kind = exact_kind(rows, queries)
    lists, found, entries = Lists(rows.astype(kind)), [], 0
    for a in range(0, len(queries), batch):
        weights = queries[a : a + batch].astype(kind)
        depths = lists.read(weights, known[a : a + batch])
        for w, depth, floor in zip(weights, depths, known[a : a + batch], strict=True):
            alive, read = lists.able(w, depth, float(floor), most, few)
            entries += read
            score = (lists.rows[alive] @ w).astype(np.int64)
            order = np.lexsort((ids[alive], -score))[:most]
            found.append((alive[order], ids[alive][order], score[order]))
    return found, entries


class Best:
    """The best rows so far of every query of one length."""

    def __init__(self, places: np.ndarray, ids: np.ndarray, copies: np.ndarray, queries: np.ndarray, known: np.ndarray, most: int):
        self.places, self.ids, self.copies, self.queries, self.known, self.most = places, ids, copies, queries, known.copy(), most
        self.held: list[list[tuple[int, int, bool]]] = [[] for _ in ids]  # (-score, id, own)
        self.seen = len(ids)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> int:
        """Takes rows, at first a few at a time, so that the known scores rise before much is read; returns the entries read."""
        entries = at = 0
        while at < len(ids):
            to = at + max(self.seen, 256)
            entries += self._add(ids[at:to], rows[at:to])
            self.seen += to - at
            at = to
        return entries

    def _add(self, ids: np.ndarray, rows: np.ndarray) -> int:
        found, entries = best(ids, rows, self.queries, self.most, self.known)
        for q, (at, who, score) in enumerate(found):
            if not len(at):
                continue
            own = (who == self.ids[q]) & (rows[at] == self.queries[q]).all(1)
            mine = sorted(self.held[q] + list(zip((-score).tolist(), who.tolist(), own.tolist(), strict=True)))[: self.most]
            self.held[q] = mine
            if len(mine) == self.most:
                self.known[q] = max(self.known[q], -mine[-1][0])
        return entries


def best_among(queries: np.ndarray, most: int) -> np.ndarray:
    """The score of the `most`-th best row among the queries themselves, a lower bound for each of them."""
    if len(queries) < most:
        return np.full(len(queries), -np.inf)
    kind = exact_kind(queries, queries)
    q = queries.astype(kind)
    return np.concatenate([np.partition(q[a : a + 512] @ q.T, len(q) - most, axis=1)[:, len(q) - most] for a in range(0, len(q), 512)]).astype(np.float64)


def stacked(column: pa.ListArray, rows: np.ndarray, dims: int) -> np.ndarray:
    """The vectors of the chosen rows, all of length dims."""
    offsets = column.offsets.to_numpy()[rows]
    flat = column.values.to_numpy()
    return flat[offsets[:, None] + np.arange(dims)]


def search(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096, query_bytes: int = 8 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows of highest score."""
    most = k + 1  # a query finds itself
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    rows = good.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))
    asked = store.written(rows.where(F.col("id") % every == 0).groupBy("id", "v").agg(F.count("*").alias("copies")), "queries")
    size = asked.select(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    parts = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).collect()
        if not held:
            continue
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(held):
            by_length.setdefault(len(r["v"]), []).append(i)
        wanted = {}
        for dims, places in by_length.items():
            queries = np.array([held[i]["v"] for i in places], np.int64).reshape(len(places), dims)
            wanted[dims] = (np.array(places), np.array([held[i]["id"] for i in places]), np.array([held[i]["copies"] for i in places]), queries, best_among(queries, most))

        def run(batches: Iterator[pa.RecordBatch], wanted: dict = wanted, b: int = b) -> Iterator[pa.RecordBatch]:
            state = {dims: Best(*w, most) for dims, w in wanted.items()}
            waiting: dict[int, list] = {dims: [] for dims in wanted}
            for batch in batches:
                ids, column = batch.column("id").to_numpy(), batch.column("v")
                dims_of = np.diff(column.offsets.to_numpy())
                for dims in np.unique(dims_of).tolist():
                    if dims not in wanted:
                        continue
                    at = np.flatnonzero(dims_of == dims)
                    waiting[dims].append((ids[at], stacked(column, at, dims)))
                    if sum(len(x) for x, _ in waiting[dims]) >= block:
                        drain(state[dims], waiting[dims], whole=False)
            for dims, mine in waiting.items():
                drain(state[dims], mine, whole=True)
            for s in state.values():
                out = [(b, int(s.places[q]), int(s.ids[q]), int(s.copies[q]), i, -score, own) for q, mine in enumerate(s.held) for score, i, own in mine]
                for a in range(0, len(out), 10_000):
                    part = list(zip(*out[a : a + 10_000], strict=True))
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names=[f.split()[0] for f in LOCAL.split(", ")])

        def drain(state: Best, mine: list, whole: bool) -> None:
            if not mine:
                return
            ids, rows = np.concatenate([x for x, _ in mine]), np.concatenate([x for _, x in mine])
            at = 0
            while len(ids) - at >= block or (whole and at < len(ids)):
                state.add(ids[at : at + block], rows[at : at + block])
                at += block
            mine[:] = [(ids[at:], rows[at:])] if at < len(ids) else []

        local = rows.mapInArrow(run, LOCAL)
        parts.append(store.written(local, "best") if blocks > 1 else local)
    if not parts:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    local = parts[0]
    for p in parts[1:]:
        local = local.union(p)
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    every_one = Window.partitionBy("block", "place")
    ranked = local.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    ranked = ranked.withColumn("self", F.coalesce(F.min(F.when(F.col("own"), F.col("at"))).over(every_one), F.lit(most)))
    ranked = ranked.where(F.col("at") != F.col("self")).withColumn("rank", (F.col("at") - (F.col("at") > F.col("self")).cast("int")).cast("int"))
    copied = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copied.select("query_id", "rank", "vec_id", "score")
