"""Line dedup by pairwise alignment.

Documents are sequences of line hashes. A line that several documents share pairs each of them with the first of
them, whatever the number of documents, and so does each shortest run of lines of at least `least_words` words that
starts or ends at a line (a block's lines may have their first holders apart, none of which has the block). The number
of pairs is thus at most the number of shared lines and runs. Each pair is aligned with patience diff (lines that are
unique in both documents, in their longest common order, and so on between them), and the aligned common blocks of at
least `least_words` words are deleted from the later document. So a shared passage stays only where the alignment with
its first holder passes it over: it stands in another order there, or its lines are repeated in either document.
Deletion never loses a line's first copy: its document has no earlier partner.

Defined cases: lines are compared without surrounding white space; blank lines pair nothing; null and empty texts and
rows with a null id pass unchanged; rows that repeat id and text count as one document and are treated alike; rows
that repeat an id with another text are documents of their own; an empty table gives an empty result; columns named
like an output are replaced. Equal ids are ordered by the text's hash.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def line_hashes(t: str) -> tuple[list[int], list[int]]:
    """(hash of each line, 0 for a blank one; its number of words)."""
    hashes, words = [], []
    for line in t.split("\n"):
        line = line.strip()
        hashes.append((xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)) or 1 if line else 0)
        words.append(line.count(" ") + 1 if line else 0)
    return hashes, words


def run_hashes(hashes: list[int], words: list[int], least_words: int) -> list[int]:
    """Hashes of the shortest runs of several lines, of least_words words or more, that start or end at a line that is not blank."""
    runs: set[tuple[int, int]] = set()
    least_words = max(least_words, 1)
    full = [i for i, h in enumerate(hashes) if h]
    a = size = 0
    for z, end in enumerate(full):
        size += words[end]
        while size - words[full[a]] >= least_words:
            size -= words[full[a]]
            a += 1
        if size >= least_words and a < z:
            runs.add((full[a], end))
    z = len(full) - 1
    size = 0
    for a in range(len(full) - 1, -1, -1):
        size += words[full[a]]
        while size - words[full[z]] >= least_words:
            size -= words[full[z]]
            z -= 1
        if size >= least_words and a < z:
            runs.add((full[a], full[z]))
    return [(xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little", signed=True) for h in hashes[i : j + 1])) - (1 << 63)) or 1 for i, j in sorted(runs)]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), ascending in both, of equal lines."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen: dict[int, list[int]] = {}
        for side, (seq, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                e = seen.setdefault(seq[i], [0, 0, -1, -1])
                e[side] += 1
                e[2 + side] = i
        once = [(e[2], e[3]) for e in seen.values() if e[0] == 1 and e[1] == 1]
        if not once:
            continue
        once.sort()
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(once)
        for n, (_, j) in enumerate(once):
            k = bisect_left(tails, j)
            back[n] = ends[k - 1] if k else -1
            if k == len(tails):
                tails.append(j)
                ends.append(n)
            else:
                tails[k], ends[k] = j, n
        n, chain = ends[-1], []
        while n >= 0:
            chain.append(once[n])
            n = back[n]
        i0, j0 = a0, b0
        for i, j in reversed(chain):
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], least_words: int) -> list[int]:
    """Positions in b of the lines of aligned blocks that have least_words words or more."""
    found: list[int] = []
    block: list[int] = []
    size, last = 0, None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if size >= least_words:
                found += block
            block, size = [], 0
        if j >= 0:
            block.append(j)
            size += words[j]
        last = (i, j)
    return found


#: Rows that are sent to all tasks; beyond, both sides are shuffled.
MOST_SENT = 200_000
#: A line is frequent if it makes up more than one in so many of the shared lines' occurrences (so there are fewer frequent lines than this).
FREQUENT = 10_000


def first_holders(table: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): document b holds a line or run whose first holder is a.

    The few frequent lines are sent to all tasks, so none of them meets in one task.
    """
    each = table.select("k", F.explode(F.array_union("h", "r")).alias("line")).where("line <> 0")
    shared = each.groupBy("line").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n")).where("first < last").select("line", "first", "n")
    shared = store.written(shared, "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * FREQUENT > total
    hot = shared.where(frequent).select("line", "first")
    pairs = each.join(F.broadcast(hot), "line").union(each.join(F.broadcast(hot.select("line")), "line", "left_anti").join(shared.where(~frequent).select("line", "first"), "line").select("line", "k", "first"))
    pairs = store.written(pairs.where("first < k").select(F.col("first").alias("a"), F.col("k").alias("b")).distinct(), "pairs")
    store.discard(shared)
    return pairs


def deletions(docs: DataFrame, *, id_col: str, text_col: str, least_words: int, partners: int = 512) -> DataFrame:
    """(k, gone, partners): the lines to delete of document k = (id, text hash), by number, and the earlier documents' ids.

    A first holder's lines go once to each group of about `partners` of its partners, not to each of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = f"struct<id:{kind},th:bigint>"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [line_hashes(t) for t in batch.column("t").to_pylist()]
            runs = [run_hashes(h, w, least_words) for h, w in got]
            columns = [pa.array([h for h, _ in got], pa.list_(pa.int64())), pa.array([w for _, w in got], pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], names=["k", "h", "w", "r"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder, own = None, []  # the group's first holder and its lines, which come before its partners
        for batch in batches:
            at, gone = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "h", "w")), strict=True)
            for i, (a, b, h, w) in enumerate(rows):
                if b is None:
                    holder, own = a, h
                    continue
                assert a == holder
                found = common_blocks(own, h, w, least_words)
                if found:
                    at.append(i)
                    gone.append(found)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("b").take(rows), batch.column("a").take(rows), pa.array(gone, pa.list_(pa.int32()))], names=["k", "partner", "gone"])

    texts = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("k"), F.col(text_col).alias("t"))
    table = store.written(texts.mapInArrow(lines, f"k {key}, h array<bigint>, w array<int>, r array<bigint>"), "lines")
    pairs = first_holders(table)
    once = table.select("k", "h", "w").dropDuplicates(["k"])
    many = store.written(pairs.groupBy("a").count().where(F.col("count") > partners).select("a", F.ceil(F.col("count") / partners).alias("groups")), "many")
    dealt = pairs.join(F.broadcast(many) if many.limit(MOST_SENT + 1).count() <= MOST_SENT else many, "a", "left")
    dealt = store.written(dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1).cast("long"))).alias("group")), "dealt")
    holders = dealt.select("a", "group").distinct().join(once.select(F.col("k").alias("a"), "h"), "a").select("a", "group", F.lit(None).cast(key).alias("b"), "h", F.lit(None).cast("array<int>").alias("w"))
    others = dealt.join(once.withColumnRenamed("k", "b"), "b").select("a", "group", "b", "h", "w")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    full = holders.union(others).repartition(parts, "a", "group").sortWithinPartitions("a", "group", F.col("b").asc_nulls_first())
    gone = full.select("a", "b", "h", "w").mapInArrow(align, f"k {key}, partner {key}, gone array<int>")
    return gone.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.array_sort(F.collect_set("partner.id")).alias("partners"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5) -> DataFrame:
    """docs with text_col less the deleted lines, and n_lines, n_deleted and partners; other columns stay."""
    base = docs.drop("n_lines", "n_deleted", "partners")
    gone = deletions(base, id_col=id_col, text_col=text_col, least_words=least_words).select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th"), F.col("gone").alias("__gone"), F.col("partners").alias("__partners"))
    joined = base.join(gone, (base[id_col] == F.col("__id")) & (F.xxhash64(base[text_col]) == F.col("__th")), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    new = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(
        *[new.alias(c) if c == text_col else F.col(c) for c in base.columns], F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce("__partners", F.array()).alias("partners"),
    )
