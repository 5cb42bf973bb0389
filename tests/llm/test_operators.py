"""Brute-force versions, edge cases (nulls, empty and long texts, ties, repeated and clashing columns, empty tables)."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqsweep.llm import decontam, html, langid, linededup, neardup, packing, pii, quality, queries, samples, store, substrings, text, topk

SCHEMA = "doc_id long, text string, lang string, score string, k string, t string"


def words(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    base = words(r, 120)
    parts = base.split()
    near = " ".join([*parts[:60], "changed", *parts[61:]])
    rows = [(0, base), (1, base), (2, near), (3, words(r, 90)), (4, None), (5, ""), (6, "one two"), (7, words(r, 20000)), (8, words(r, 40)), (8, words(r, 40)), (None, "null id here"), (9, "\n \n"), (10, "one two")]
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in store.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_neardup_equals_brute_force(docs, empty):
    found = neardup.groups(docs, k=4).collect()
    sets = []
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        sets.append((r.doc_id, frozenset(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))) if w else frozenset()))
    assert Counter((r.doc_id, r.n_shingles) for r in found) == Counter((i, len(s)) for i, s in sets)
    comp = {r.doc_id: r.component_id for r in found}
    assert comp[1] == comp[2] == 0 and comp[10] == 6 and comp[3] == 3 and comp[4] == 4 and comp[None] is None
    assert not neardup.groups(empty).collect()
    assert len(neardup.deduplicate(docs).collect()) == len(found) - 3


def test_neardup_of_repeated_ids(spark):
    r = random.Random(24)
    a, b, c = words(r, 60), words(r, 60), words(r, 60)
    rows = [(5, a), (5, b), (7, f"{a} more"), (8, f"{b} more"), (9, c), (9, c), (9, None), (11, f"{c} end"), (3, words(r, 60))]
    got = Counter((x.doc_id, x.component_id, x.kept, x.n_shingles) for x in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect())
    assert got == Counter([(5, 5, True, 57), (5, 5, True, 57), (7, 5, False, 58), (8, 5, False, 58), (9, 9, True, 57), (9, 9, True, 57), (9, 9, True, 0), (11, 9, False, 58), (3, 3, True, 57)])


def test_line_dedup(spark, docs, empty):
    a = "first line of five words\nsecond line of five words\nthird line of five words"
    b = "new opening line of b\nsecond line of five words\nthird line of five words\nclosing line of b here"
    table = spark.createDataFrame([(1, a), (2, b), (3, a), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.deduplicate(table).collect()}
    assert got[1].text == a and got[2].text == "new opening line of b\nclosing line of b here" and got[3].text == "" and got[2].partners == [1]
    assert got[4].text is None and got[5].text == "" and got[2].n_deleted == 2
    assert not linededup.deduplicate(empty).collect()
    assert linededup.deduplicate(docs).count() == docs.count()
    r = random.Random(4)
    for _ in range(100):
        x, y = [r.randint(1, 9) for _ in range(r.randint(0, 12))], [r.randint(1, 9) for _ in range(r.randint(0, 12))]
        p = linededup.patience(x, y)
        assert all(x[i] == y[j] for i, j in p) and all(i < k and j < m for (i, j), (k, m) in zip(p, p[1:], strict=False))


def test_line_dedup_of_frequent_lines(spark):
    hot = "one line that very many documents hold"
    rows = [(0, f"opening words of the first holder\n{hot}")]
    for i in range(1, 101):  # a rarer line's first holder is without the hot one
        rows += [(2 * i - 1, f"rare line number {i} of two documents"), (2 * i, f"rare line number {i} of two documents\n{hot}\nown words of document {i} stay")]
    got = {r.doc_id: r for r in linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and all(got[2 * i].text == f"own words of document {i} stay" and got[2 * i].partners == [0, 2 * i - 1] for i in range(1, 101))


def test_line_dedup_of_large_groups(spark, monkeypatch):
    r = random.Random(22)
    stock = [words(r, 6) for _ in range(30)]
    rows = [(i, "\n".join(r.choice(stock) if r.random() < 0.7 else words(r, 4) for _ in range(r.randint(1, 12))), "clash") for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, partners string")
    want = {(x.k.id): (x.gone, x.partners) for x in linededup.deletions(table, id_col="doc_id", text_col="text", least_words=5).collect()}
    monkeypatch.setattr(linededup, "FREQUENT", 20)
    got = {(x.k.id): (x.gone, x.partners) for x in linededup.deletions(table, id_col="doc_id", text_col="text", least_words=5, partners=3).collect()}
    assert got == want and len(got) > 100


def test_line_dedup_of_blocks_of_short_lines(spark):
    table = spark.createDataFrame([(1, "aa\nx one"), (2, "bb bb\nx two"), (3, "cc\nx three"), (4, "x four\naa\n\nbb bb\ncc cc"), (5, "y five\naa\n\nbb bb\ncc cc\ny six")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.deduplicate(table).collect()}
    assert got[4] == "x four\naa\n\nbb bb\ncc cc" and got[5] == "y five\ny six"
    r = random.Random(11)
    for _ in range(300):
        h = [r.choice([0, 0, 1, 2, 3, 4]) for _ in range(r.randint(0, 12))]
        w = [r.randint(1, 6) if x else 0 for x in h]
        spans = [(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if h[i] and h[j] and sum(w[i : j + 1]) >= 5 and (sum(w[i:j]) < 5 or sum(w[i + 1 : j + 1]) < 5)]
        assert len(set(linededup.run_hashes(h, w, 5))) == len({tuple(h[i : j + 1]) for i, j in spans})


def test_substring_dedup(spark, docs, empty):
    r = random.Random(5)
    passage = words(r, 70)
    one, two, clean = words(r, 80) + " " + passage, words(r, 33) + " " + passage + " " + words(r, 50), words(r, 100)
    table = spark.createDataFrame([(1, one), (2, two), (3, clean), (4, None), (5, "é" * 900)], "doc_id long, text string")
    got = {x.doc_id: x for x in substrings.deduplicate(table).collect()}
    assert got[1].text == one and got[3].text == clean and got[3].deleted_bytes == 0 and got[4].text is None
    assert got[2].sources == [1] and got[2].deleted_bytes > len(passage) * 0.6 and passage not in got[2].text
    assert set(got[5].text) <= {"é"}
    assert not substrings.deduplicate(empty).collect() and substrings.deduplicate(docs).count() == docs.count()
    data = np.frombuffer(passage.encode(), np.uint8)
    h = substrings.gear(data)
    for i in (0, 5, 40, 200):
        want = sum(int(substrings.GEAR[data[i - j]]) << j for j in range(min(i + 1, 16))) & 0xFFFF
        assert int(h[i]) == want


def plain_chunks(raw, reach, most):
    h = [sum(int(substrings.GEAR[raw[i - j]]) << j for j in range(min(i + 1, 16))) & 0xFFFF for i in range(len(raw))]
    ends = [i + 1 for i in range(reach, len(raw) - reach) if len(raw) > 2 * reach + 1 and all(h[i] < h[j] for j in range(i - reach, i + reach + 1) if j != i)]
    out, at = [], 0
    for e in [*ends, len(raw)]:
        while e - at > most:
            out.append((at, at + most))
            at += most
        if e > at:
            out.append((at, e))
        at = e
    return out


def test_substrings_equal_brute_force(spark, monkeypatch):
    r = random.Random(23)
    stock = [words(r, 45) for _ in range(5)]
    rows = [(i, " ".join(r.choice([r.choice(stock), words(r, 20), "é" * 70, "z" * 600]) for _ in range(r.randint(0, 5)))) for i in range(60)] + [(3, words(r, 60) + stock[0]), (None, stock[0])]
    owner = {}
    for i, t in rows:
        for a, z in plain_chunks(t.encode(), 16, 256) if i is not None else ():
            owner[t.encode()[a:z]] = min(owner.get(t.encode()[a:z], i), i)
    monkeypatch.setattr(substrings, "FREQUENT", 30)
    table = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, sources int")
    got = Counter((x.doc_id, x.text, x.n_repeated, x.deleted_bytes, tuple(x.sources)) for x in substrings.deduplicate(table).collect())
    want = Counter()
    for i, t in rows:
        raw, seen, runs = t.encode(), set(), []
        for a, z in plain_chunks(raw, 16, 256) if i is not None else ():
            again = raw[a:z] in seen or owner[raw[a:z]] < i
            seen.add(raw[a:z])
            if again and runs and runs[-1][1] == a:
                runs[-1] = (runs[-1][0], z, runs[-1][2] + [(a, z)])
            elif again:
                runs.append((a, z, [(a, z)]))
        left, at, n, gone, sources = b"", 0, 0, 0, set()
        for a, z, mine in runs:
            while a < z and raw[a] & 0xC0 == 0x80:
                a += 1
            while z < len(raw) and z > a and raw[z] & 0xC0 == 0x80:
                z -= 1
            if z - a >= 128:
                left, at, n, gone = left + raw[at:a], z, n + len(mine), gone + z - a
                sources |= {owner[raw[x:y]] for x, y in mine if owner[raw[x:y]] < i}
        want[i, (left + raw[at:]).decode(), n, gone, tuple(sorted(sources))] += 1
    assert got == want and sum(x[3] > 0 for x in got) > 20


def best_of(ids, rows, query, most):
    score = rows @ query
    order = np.lexsort((ids, -score))[:most]
    return list(zip(ids[order].tolist(), score[order].tolist(), strict=True))


@pytest.mark.parametrize("n,dims,span", [(300, 8, 40), (50, 3, 2), (4, 5, 9), (1, 3, 3), (200, 1, 5), (20, 0, 3)])
def test_topk_equals_brute_force(n, dims, span):
    r = np.random.default_rng(n)
    ids, rows = r.permutation(n), r.integers(-span, span + 1, (n, dims))
    queries = rows[::7]
    for known in (topk.best_among(queries, 6), np.full(len(queries), -np.inf)):
        got, _ = topk.best(ids, rows, queries, 6, known, few=3)
        for (_, who, score), q, least in zip(got, queries, known, strict=True):
            want = [x for x in best_of(ids, rows, q, 6) if x[1] >= least]
            assert [x for x in zip(who.tolist(), score.tolist(), strict=True) if x[1] >= least] == want


def test_topk_stops_reading():
    r = np.random.default_rng(3)
    for spread, share in ((np.exp(-np.arange(32) / 3), 0.25), (np.ones(32), 0.9)):
        rows = np.floor(2560 * r.normal(size=(12000, 32)) * spread).astype(np.int64)
        ids, queries = np.arange(12000), rows[::50]
        state = topk.Best(np.arange(240), ids[::50], np.ones(240, int), queries, topk.best_among(queries, 6), 6)
        read = sum(state.add(ids[a : a + 4096], rows[a : a + 4096]) for a in range(0, 12000, 4096))
        assert read < share * rows.size * len(queries)
        for q in range(0, 240, 7):
            assert [(i, -s) for s, i, _ in state.held[q]] == best_of(ids, rows, queries[q], 6)


def test_topk_edges(spark):
    table = spark.createDataFrame([(0, [0.5, 1.0]), (50, [0.5, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (None, [1.0, 1.0]), (5, [0.25, 0.0]), (6, [])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.search(table).collect()))
    assert got == [(0, 1, 50, 128 * 128 + 256 * 256), (0, 2, 5, 128 * 64), (50, 1, 0, 128 * 128 + 256 * 256), (50, 2, 5, 128 * 64)]
    assert not topk.search(table.limit(0)).collect() and topk.search(table.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


def test_topk_of_repeated_ids_and_blocks(spark):
    r = random.Random(14)
    rows = [(i // 2 if i < 60 else i, [r.randint(-3, 3) / 4 for _ in range(3)], "clash") for i in range(160)] + [(0, [0.5, 0.5, 0.5], "x")] * 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v, _ in rows]
    want = []
    for a, (i, v) in enumerate(whole):
        if i % 50 == 0:
            others = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(whole) if a != b)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(others, 1)]
    for size in (8 << 20, 200):
        assert sorted(map(tuple, topk.search(table, query_bytes=size, block=32).collect())) == sorted(want)


def test_decontamination_in_blocks(spark, docs, empty):
    r = random.Random(6)
    item = words(r, 30)
    table = spark.createDataFrame([(1, words(r, 50) + " " + " ".join(item.split()[5:25]).upper() + " tail"), (2, words(r, 60)), (3, None), (4, "Short ITEM!")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "short item"), (9, None), (None, item), (10, "")], "item_id long, text string")
    for size in (200_000, 4):
        got = {x.doc_id: (x.n_words, x.n_hit, x.hit_items) for x in decontam.measure(table, items, block_windows=size).collect()}
        assert got == {1: (71, 20, ["7"]), 2: (60, 0, []), 3: (0, 0, []), 4: (2, 2, ["8"])}
    assert sorted(x.doc_id for x in decontam.decontaminate(table, items).collect()) == [2, 3]
    long = spark.createDataFrame([(1, f"{words(r, 900)} {' '.join(item.split()[3:16])} {words(r, 900)}"), (2, f"{words(r, 300)} short item {words(r, 300)}"), (3, f"{words(r, 9)} {' '.join(item.split()[3:15])}")], "doc_id long, text string")
    for size in (200_000, 4):
        assert [x.doc_id for x in decontam.decontaminate(long, items, block_windows=size).orderBy("doc_id").collect()] == [2, 3]
    assert not decontam.measure(empty, items).collect() and decontam.measure(docs, items.limit(0)).count() == docs.count()


def test_packing_in_blocks_and_partitions(spark):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    full = Tokenizer.from_file(files["tokenizer_json"])
    r = random.Random(17)
    texts = [". ".join(words(r, r.randint(4, 20)) for _ in range(r.randint(1, 40))) for _ in range(300)]
    texts[40:60] = [texts[40]] * 20  # repeated rows, with one id below
    table = spark.createDataFrame([(40 if 40 <= i < 60 else i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, offset string, length int")
    for parts, block in ((1, 20_000), (211, 1 << 19)):
        rows = packing.pack(table.repartition(parts), **files, with_ids=True, block_tokens=block).collect()
        want = Counter()
        for i, t in enumerate(texts):
            want.update((40 if 40 <= i < 60 else i, x) for x in [*full.encode(t, add_special_tokens=False).ids, 0])
        assert Counter((p.doc_id, x) for p in rows for x in p.ids) == want
        size, at = Counter(), {}
        for p in sorted(rows, key=lambda p: (p.sequence_id, p.offset)):
            assert p.offset == size[p.sequence_id] and p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
            size[p.sequence_id] += p.length
            at.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
        for i, mine in at.items():
            mine.sort()
            assert i == 40 or all(a + n == b for (a, n, _), (b, _, _) in zip(mine, mine[1:], strict=False)) and mine[0][0] == 0 and sum(mine[-1][:2]) == mine[-1][2]
        padding = sum(1024 - n for n in size.values() if n & (n - 1))
        assert max(size.values()) <= 1024
        if parts == 1:
            assert padding < 0.01 * size.total() and len(size) < 1.04 * size.total() / 1024 + 1


def test_packing_pads_little_in_many_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    size = [x.n for x in packing.pack(docs.repartition(211), **queries.tokenizer_files()).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(1024 - n for n in size if n & (n - 1)) < 0.01 * sum(size) and len(size) < 1.05 * sum(size) / 1024


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    full = Tokenizer.from_file(files["tokenizer_json"])
    rows = packing.pack(docs.where("doc_id is null or doc_id <> 8"), **files, with_ids=True).collect()
    assert max(sum(p.length for p in rows if p.sequence_id == s) for s in {p.sequence_id for p in rows}) <= 1024
    for d in docs.where("doc_id is null or doc_id <> 8").collect():
        want = [*full.encode(d.text or "", add_special_tokens=False).ids, 0]
        mine = sorted((p for p in rows if p.doc_id == d.doc_id), key=lambda p: p.start)
        assert [i for p in mine for i in p.ids] == want
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.doc_tokens == len(want) for p in mine)
    assert not packing.pack(empty, **files).collect()


def test_cut_points_are_optimal():
    r = random.Random(8)
    for _ in range(40):
        total = r.randint(1, 40)
        pos = sorted({total, *(r.randint(1, total) for _ in range(12)), *range(6, total, 6)})
        pen = [r.choice([0.0, 1.0, 3.0]) for _ in pos]
        pad = lambda n: 0 if n & (n - 1) == 0 else 8 - n
        each = r.choice([0.0, 2.0, 5.0])
        best = {0: 0.0}
        for p, x in zip(pos, pen, strict=True):
            best[p] = x + each + min((best[q] + pad(p - q) for q in best if p - q <= 8), default=float("inf"))
        cuts = packing.cut_points(total, np.array(pos), np.array(pen), 8, each).tolist()
        got = sum(pad(b - a) + each + pen[pos.index(b)] for a, b in zip([0, *cuts], cuts, strict=False))
        assert cuts[-1] == total and abs(got - best[total]) < 1e-9


def plain_quality(model, t):
    """The network on one text, filter by filter and chunk by chunk."""
    raw = [*t.encode(), *[0] * 16]
    n = -(-len(t.encode()) // 4)
    f = len(model["b"])
    w = np.concatenate([model["w"][:, :f], model["w"][:, f:]])
    r = [np.maximum(np.concatenate([quality.TABLE[b] for b in raw[4 * i : 4 * i + 8]]) @ w + model["b"], 0) for i in range(n)]
    starts = range(0, max(32 * (-(-(len(t.encode()) + 8) // 128) - 1), 1), 32) if n else ()
    top = np.zeros(len(model["b1"]))
    for a in starts:
        mine = r[a : a + 64]
        z = (np.mean(mine, 0) - model["mu"]) / model["sd"] * np.sqrt(len(mine) / 64)
        top = np.maximum(top, np.maximum(np.concatenate([z, z * z]) @ model["w1"] + model["b1"], 0))
    return 1 / (1 + np.exp(-(top @ model["w2"] + model["b2"] + model["shift"])))


def test_quality_equals_brute_force(monkeypatch):
    r = random.Random(15)
    texts = [words(r, r.randint(1, 90)) + "é" * (i % 5) for i in range(60)] + ["x", "", "é", "ab" * 61, "y" * 128, "z" * 121, words(r, 900)]
    model = quality.fit(texts, np.array([i % 2 for i in range(len(texts))]), epochs=2) | {"shift": 0.25}
    got = quality.predict(model, *text.text_bytes(pa.array(texts, pa.large_string())))
    assert np.allclose(got, [plain_quality(model, t) for t in texts], atol=2e-4)
    monkeypatch.setattr(quality, "SEGMENT", 3)  # a long text goes through in segments
    assert np.allclose(got, quality.predict(model, *text.text_bytes(pa.array(texts, pa.large_string()))), atol=1e-5)


def plain_language(model, t):
    """The decoding of one text, bit by bit."""
    folded = "".join(c.lower() if c.isalpha() and (c.isascii() or c.lower() != c and ord(c) < 256) else c if ord(c) > 127 else " " for c in t)
    raw = [32, *folded.encode(), 32, 32]
    seen = Counter()
    for a, b, c in list(zip(raw, raw[1:], raw[2:], strict=False))[: len(t.encode())]:
        if (a, b) != (32, 32):
            h = (a * 0x01000193 + b * 0x9E3779B1 + c * 0x85EBCA77) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            seen[h >> 19] += 1
    z = sum((n / seen.total() * model["table"][h] for h, n in seen.items()), np.zeros(model["table"].shape[1])) + model["bias"]
    z = np.clip(z, -8, 8)
    losses = [sum(w * np.log1p(np.exp(-s * bit)) for w, s, bit in zip(model["weight"], z, word, strict=True)) for word in model["code"]]
    return model["names"][int(np.argmin(losses))]


def test_language_equals_brute_force(spark):
    r = random.Random(16)
    alphabets = ["abcdefghij", "qrstuvwxyz", "kélmñnoüpß"]
    texts = [(i, " ".join("".join(r.choices(alphabets[i % 3], k=5)).capitalize() for _ in range(r.randint(1, 20))) + " 12!", f"l{i % 3}") for i in range(90)]
    table = spark.createDataFrame(texts + [(3, "zzz", "l0"), (91, "q" * 300_000, "l9")], "doc_id long, text string, lang string")
    model = langid.train(table, per_class=20)
    assert model["names"] == ["l0", "l1", "l2"]  # the long text is not learned from
    got = {(x.doc_id, x.text): x.lang_pred for x in langid.identify(table.withColumn("score", table.lang).withColumn("lang_pred", table.lang), model).collect()}
    assert len(got) == 92 and all(got[i, t] == plain_language(model, t) for i, t, _ in texts)
    with pytest.raises(ValueError):
        langid.train(table, most_langs=2)


def test_language_of_long_texts_in_segments(monkeypatch):
    r = random.Random(26)
    t = "".join(r.choices("abÀÉñçß XY12.é€", k=3000))
    data, offsets = text.text_bytes(pa.array([t], pa.large_string()))
    whole = next(langid.seen_grams(data, offsets))
    for size in (1, 2, 3, 7, 100, 999):
        monkeypatch.setattr(langid, "SEGMENT", size)
        assert (next(langid.seen_grams(data, offsets)) == whole).all()


def test_clashing_columns_and_repeated_ids(spark, docs):
    model = {"rate": 0.5}
    assert {x.score for x in quality.score(docs, model).collect()} == {0.5}
    pairs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (None, "c")], "doc_id long, text string")
    assert samples.texts_of(pairs, "doc_id", "text", [1, 2, 3]) == {1: "a", 2: ""}
    marks = spark.createDataFrame([(i % 7, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, y int")
    got = samples.by_class(marks, "doc_id", "y", 3)
    assert len(got) == 6 and Counter(y for _, y in got) == {0: 3, 1: 3}


def test_quality_and_language(spark, docs, empty):
    r = random.Random(9)
    rows = [(i, (words(r, 80) if i % 2 else words(r, 80).upper().replace(" ", "!! ")), i % 2) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(table, table.where("doc_id < 120"), per_class=50)
    scored = quality.score(table, model).where("doc_id >= 120").collect()
    assert np.mean([(x.score >= 0.5) == bool(x.quality) for x in scored]) > 0.95
    alone = quality.predict(model, *text.text_bytes(pa.array([rows[3][1]])))
    assert np.allclose(alone, quality.predict(model, *text.text_bytes(pa.array([rows[2][1], rows[3][1]])))[1:])
    assert all(0 <= x.score <= 1 for x in quality.score(docs, model).collect()) and not quality.score(empty, model).collect()
    assert quality.train(table, table.limit(0)) == {"rate": 0.5}
    two = spark.createDataFrame([(i, words(r, 30) if i % 2 else words(r, 30).translate(str.maketrans("abcdefghij", "qrstuvwxyz")), "l" + str(i % 2)) for i in range(80)], "doc_id long, text string, lang string")
    m = langid.train(two.where("doc_id < 50"))
    got = langid.identify(two, m).where("doc_id >= 50").collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.95
    und = {x.doc_id: x.lang_pred for x in langid.identify(docs, m).collect()}
    assert und[4] == und[5] == und[9] == "und" and und[0] != "und" and not langid.identify(empty, m).collect()


def one_page(page):
    return html.main_text(html.blocks_of(page), 12)


def test_html_blocks():
    page = "<html><head><title>T</title><script>a='</p>'</script></head><body><nav>menu</nav><article><h1>Title &amp; more</h1><p><b>One<br>two<p>Three&nbsp;\n four<div class='ad'>buy</div><form>f</form><section class=comments><p>bad</p></section></article><footer>foot</footer>"
    assert one_page(page) == "Title & more\n\nOne two\n\nThree four"
    inside = "<div class='page-header'><h1>Head</h1></div><p>text</p><div class='related-work'>kept too</div><div class='cookie-banner'>gone</div>"
    assert one_page(f"<main>{inside}</main>") == "Head\n\ntext\n\nkept too"
    teaser = "<article><h2><a href=x>Other</a></h2><a href=x>Read more</a></article>"
    main = f"<article><p>{'main words here. ' * 40}</p></article>"
    for page in (f"<div class='sidebar'>{teaser}</div>{main}", f"{main}{teaser}", f"<aside>{teaser}</aside>{main}<p>beside</p>"):
        assert one_page(page) == ("main words here. " * 40).strip()
    assert one_page(f"<nav><ul><li>unclosed{main}") == ("main words here. " * 40).strip()
    assert one_page("<div class='navlinks'><a href=a>One</a> <a href=b>Two</a></div><div>plain text <a href=c>with a link</a></div>") == "plain text with a link"
    assert one_page("<div><a href=a>only links</a></div>") == "only links"
    assert one_page("<p>cut off in a <a href='") == "cut off in a" and one_page("<!-- open") == "" and one_page("a < b & c &lt; d") == "a < b & c < d"


def test_html_boilerplate_of_hosts(spark):
    r = random.Random(19)
    same = " ".join(f"w{i}" for i in range(20))
    plea = "Please support our journal. It is made by readers like you. Thank you very much for that."
    shared = words(r, 30)
    rows = [(i, f"http://h.org/{i}", f"<div>{same}</div><div>{i} own text</div>") for i in range(3)]
    rows += [(10 + i, f"https://Art.org/{i}", f"<article><p>{words(r, 40)}</p><p>{plea}</p><p>{words(r, 40)}{'. ' + shared if i < 2 else ''}</p></article>") for i in range(12)]
    copy = f"<article><p>{words(r, 60)}</p><p>{words(r, 60)}</p></article>"
    rows += [(30 + i, f"http://copies.org/{i}", copy) for i in range(6)]
    rows += [(50, None, None), (51, "http://x.org", "plain"), (52, "not a url", f"<p>{same}</p>"), (53, "http://h.org/9", ""), (None, "http://h.org/8", f"<p>{same}</p>"), (54, "http://twice.org", f"<p>{same}</p>"), (54, "http://twice.org", f"<p>{same}</p>")]
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], "page_id long, url string, html string, text string, host int")
    got = {x.page_id: x.text for x in html.extract(table).collect()}
    assert html.extract(table).count() == len(rows) and all(got[i] == f"{i} own text" for i in range(3))
    assert not any(plea in got[10 + i] for i in range(12)) and all(len(got[10 + i].split()) == 80 + 30 * (i < 2) for i in range(12))
    assert got[10].endswith(shared) and got[11].endswith(shared)
    assert all(got[30 + i] == one_page(copy) for i in range(6))
    assert got[50] == "" and got[51] == "plain" and got[52] == same and got[53] == "" and got[54] == same and got[None] == same
    assert not html.extract(table.limit(0)).collect()


def test_html_of_a_large_host(spark):
    r = random.Random(13)
    block = words(r, 20)
    rows = [(i, f"http://big.org/{i}", f"<div>{block if i % 150 == 0 else ''}</div><div>{i} {words(r, 15)}</div>") for i in range(900)]
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 900 and not any(block in t for t in got.values()) and all(t.split()[0] == str(i) and len(t.split()) == 16 for i, t in got.items())


def test_html_equals_brute_force(spark):
    """Every repeat of sentences of 12 words or more, found by comparing all pages' sentence sequences."""
    r = random.Random(20)
    stock = [words(r, n) + "." for n in (2, 3, 5, 7, 9, 13, 16)]
    pages = [[r.choice(stock) if r.random() < 0.6 else words(r, r.randint(2, 9)) + "." for _ in range(r.randint(1, 9))] for _ in range(14)]
    rows = [(i, "http://a.org/", "".join(f"<p>{s}</p>" for s in p)) for i, p in enumerate(pages)]
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, p in enumerate(pages):
        gone = set()
        for a in range(len(p)):
            for b in range(a, len(p)):
                run = p[a : b + 1]
                if sum(len(s.split()) for s in run) >= 12 and any(q[j : j + len(run)] == run for k, q in enumerate(pages) if k != i for j in range(len(q))):
                    gone |= set(range(a, b + 1))
        assert got[i] == "\n\n".join(s for j, s in enumerate(p) if j not in gone) or len(gone) == len(p) and got[i] == "\n\n".join(p)


def luhn(d):
    t = [int(c) for c in reversed(d)]
    return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_list(t):
    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_spans(spark):
    r = random.Random(10)
    texts = ["".join(r.choices(["1", "4", "0", "255", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "é", "4111111111111111"], k=r.randint(0, 60))) for _ in range(150)] + [None, "", "9" * 30000, "a" * 30000, "10.0.5.7 at 0.0.0.0 and 00.000.0.255 or 1.0256.0.1", "256.1.1.1 1.2.3.4.5.6.7.8"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(table)
    for row in found.select("doc_id", F.expr(pii.listed(base=True)).alias("spans")).collect():
        assert row.spans == base_list(texts[row.doc_id]), texts[row.doc_id]
    assert not pii.find(table.limit(0)).collect()
    assert [x.text for x in pii.redact(spark.createDataFrame([(1, "mail é@ a@b.cd now")], "doc_id long, text string")).collect()] == ["mail é@ [email] now"]


def test_pii_adds_learned_spans(spark):
    rows = [(i, f"call +1 (0{i % 90 + 10}) 555-{1000 + i} today") for i in range(60)] + [(99, "call (017) 555-7713 today")]
    got = {r.doc_id: r.added for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(a.kind, a.s, a.e) for a in got[99]] == [("phone", 5, 19)]


def test_pii_added_spans_equal_brute_force(spark):
    r = random.Random(18)
    rows = []
    for i in range(120):
        own = f"user{i}@mail{i}.org" if i % 2 else f"+1 ({i + 100}) 555-{1000 + i}"
        own += f" {words(r, 3)} 10.0.{i}.7" if i % 3 else ""
        token = "".join(r.choices("0123456789abcdef", k=40))
        rows.append((i, f"{words(r, 30)} {own} {words(r, 4)} token = '{token}' {words(r, 5)} {'x'.join(r.choices('abcdefgh', k=12))}"))
    rows += [(200 + i, f"{words(r, 700)} {'y'.join(r.choices('abcdefgh', k=r.randint(10, 14)))} {words(r, 700)}") for i in range(200)]
    rows += [(None, "me(at)home(dot)org and 4111 1111/1111 1111"), (500, None), (500, ""), (1, rows[1][1]), (1, rows[1][1])]
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, email string, added string, size int")
    proposed = pii.candidates(pii.base_spans(table, "doc_id", "text"), 1000)
    models = pii.train(proposed.withColumn("size", F.length("text").cast("long")), 0.7, 1000)
    assert ("secret", "company") in models and ("secret", "told") in models
    got = Counter((x.doc_id, tuple((a.kind, a.s, a.e) for a in x.added)) for x in pii.find(table, with_text=False).collect())
    want = Counter()
    for x in proposed.select("doc_id", "candidates").collect():
        able = []
        for c in x.candidates:
            if c.free:
                cell = np.array([[c[f] for f in pii.FEATURES]])
                over = [sum(pii.values(t, cell)[0] for t in trees) - b for (k, _), (trees, b) in models.items() if k == c.kind]
                if over and max(over) >= 0:
                    able.append((-round(max(over), 6), c.s, -c.e, c.kind))
        kept = [a for a in able if not any(b < a and b[1] < -a[2] and a[1] < -b[2] for b in able)]
        want[x.doc_id, tuple((k, s, -e) for _, s, e, k in kept)] += 1
    assert got == want and sum(n for (i, spans), n in got.items() if i is not None and i < 120 and any(k == "secret" for k, _, _ in spans)) == 122
    assert not any(spans for (i, spans) in got if i is not None and 200 <= i < 400)
    secret = next(spans for (i, spans) in got if i == 7)
    assert rows[7][1][secret[0][1] : secret[0][2]].isalnum() and secret[0][2] - secret[0][1] == 40


def test_pii_told_secrets_without_company(spark):
    r = random.Random(25)
    token = lambda: "".join(r.choices("0123456789abcdef", k=40))
    rows = [(i, f"{words(r, 20)} token = '{token()}' {words(r, 20)}") for i in range(40)] + [(100 + i, f"{words(r, 20)} = '{token()}' {words(r, 20)}") for i in range(5)]
    rows += [(200 + i, f"{words(r, 30)} {'y'.join(r.choices('abcdefgh', k=r.randint(10, 14)))}") for i in range(60)]
    rows += [(300 + i, f"{words(r, 20)} AKIA{''.join(r.choices('ABCDEFGH234567', k=16))} {words(r, 9)}") for i in range(20)]
    rows += [(400 + i, f"{words(r, 20)} password={token()[: r.randint(18, 20)]} {words(r, 9)}") for i in range(20)]
    got = {x.doc_id: [(a.kind, a.e - a.s) for a in x.added] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == [("secret", 40)] for i in [*range(40), *range(100, 105)]) and not any(got[200 + i] for i in range(60))
    assert all(got[300 + i] == [("secret", 20)] and got[400 + i][0][0] == "secret" and got[400 + i][0][1] in (18, 19, 20) for i in range(20))


def test_digest_columns(spark):
    got = queries.op3_decontaminate(spark, "/root/testdata/sf0.001").where("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_neardup_parities_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 40, 300, 5000)]
    sets += [np.unique(np.concatenate([s[len(s) // 10 :], rng.integers(0, 1 << 63, 7, dtype=np.uint64)])) for s in sets]
    got = neardup.parities(np.concatenate(sets), np.array([len(s) for s in sets]))
    gaps = neardup.parities(np.concatenate(sets), np.array([n for s in sets for n in (0, len(s))]))
    assert (got == gaps).all()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(got[i] ^ got[j]).sum() <= len(np.setxor1d(a, b))
    many = np.arange(2500, dtype=np.uint64)
    assert neardup.parities(many, np.ones(2500, np.int64)).shape == (2500, neardup.PARITIES // 8)
    assert not neardup.parities(many[:0], np.zeros(3, np.int64)).size


def test_neardup_searches_large_regions_completely(spark):
    def copies(base, at, n):
        return [" ".join(w if j not in (at(i), at(i) + 5) else f"{w}{i}" for j, w in enumerate(base)) for i in range(n)]

    r = random.Random(12)
    base = words(r, 200).split()
    other = [f"o{j}" if j in (20, 60, 100, 140) else w for j, w in enumerate(base)]  # too far from base, but not from the bridge
    bridge = [f"o{j}" if j in (20, 60) else w for j, w in enumerate(base)]
    texts = copies(base, lambda i: i % 195, 60) + copies(other, lambda i: i * 7 % 195, 60) + [" ".join(bridge)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                top = [min(top[i], top[j]) if x in (top[i], top[j]) else x for x in top]
    for block in (4096, 16):
        got = {x.doc_id: x.component_id for x in neardup.groups(table, k=4, region=4, block=block, trees=8).collect()}
        assert [got[i] for i in range(len(texts))] == top
    alone = spark.createDataFrame([(i, i, len(s), [0] * 64) for i, s in enumerate(sets)], "rep long, component long, n_shingles long, labels array<long>")
    one = spark.createDataFrame([(0, 0)], "tree long, prefix long")
    signed = neardup.sign(table, id_col="doc_id", text_col="text", k=4, trees=1, depth=8).select("doc_id", neardup.class_key().alias("rep"))
    key = {x.doc_id: x.rep for x in signed.collect()}
    alone = spark.createDataFrame([(key[i], key[i], len(s), [0] * 64) for i, s in enumerate(sets)], alone.schema)
    ids, docs_by_class = signed.select("rep", F.col("doc_id").alias("doc")), table
    found = {(x.a, x.b) for x in neardup.crowded(alone, one, docs_by_class, ids, trees=1, depth=8, least_depth=4, region=4, block=16, part=80, whole=100, id_col="doc_id", text_col="text", k=4).collect()}
    links = {tuple(sorted((key[j], key[i]))) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert links and links <= found and all(a < b for a, b in found)


def test_neardup_keeps_single_links_of_large_groups(spark):
    r = random.Random(5)
    base = words(r, 200).split()

    def change(t, at, tag):
        return [f"{tag}x{i}" if i in at else w for i, w in enumerate(t)]

    cores = [change(base, (6 * (i % 16) + 3, 100 + 6 * (i // 16 % 16) + 3), f"c{i}") for i in range(700)]
    outer = [change(cores[i], r.sample(range(2, 198, 6), 5), f"o{i}") for i in range(40)]  # each linked to its core alone
    texts = cores + outer
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in texts]
    linked = [any(5 * len(sets[700 + i] & s) >= 4 * len(sets[700 + i] | s) for s in sets[:700]) for i in range(40)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    assert sum(linked) >= 38
    got = {x.doc_id: x.component_id for x in neardup.groups(table, k=4, region=64, block=256).collect()}
    assert [got[700 + i] == 0 for i in range(40)] == linked and all(got[i] == 0 for i in range(700))


def test_neardup_sorts_only_regions_of_several_components(spark, monkeypatch):
    r = random.Random(31)
    texts = [words(r, 80) for _ in range(60)]
    texts += [f"{t} more" for t in texts[:10]] + [f"{t} more still" for t in texts[:5]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sorted_, proposed = [], neardup.candidates

    def candidates(rows, **options):
        sorted_.append(rows.count())
        return proposed(rows, **options)

    monkeypatch.setattr(neardup, "candidates", candidates)
    for most in (neardup.MOST_SENT, 0):
        monkeypatch.setattr(neardup, "MOST_SENT", most)
        sorted_.clear()
        got = {x.doc_id: x.component_id for x in neardup.groups(table, k=4).collect()}
        assert [got[i] for i in range(75)] == [*range(60), *range(10), *range(5)]
        assert 0 < sorted_[0] <= 6 * 25 and sorted_[1] <= 32 * 25  # of 6 * 75 and 32 * 75: 50 texts are like no other


def test_span_hashes_do_not_depend_on_place():
    r = random.Random(27)
    data = np.frombuffer("".join(r.choices("abc ", k=3000)).encode(), np.uint8)
    s, e, _ = text.runs(data, np.array([0, len(data)]), text.NOT_SPACE)
    whole = text.span_hashes(data, s, e)
    assert all((text.span_hashes(data, s, e, most=n) == whole).all() for n in (1, 5, 64, 999))
    by_word = {}
    for a, b, h in zip(s.tolist(), e.tolist(), whole.tolist(), strict=True):
        assert by_word.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_neardup_sketch_drops_few_links():
    from math import comb

    assert sum(comb(256, i) * 0.9**i * 0.1 ** (256 - i) for i in range(neardup.least_bits(80, 100))) < 5e-9
