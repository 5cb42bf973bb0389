"""The stages of the corpus pipeline against brute-force versions, each on the rows it was given."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from seqsweep.llm import queries, store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
JUNK, CLEAN = range(0, 60), range(100, 160)


def words(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def lines_of(r, n):
    return "\n".join(words(r, r.randint(6, 15)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    item = words(r, 40)
    texts = {i: words(r, 70).upper().replace(" ", "!! ") for i in JUNK} | {i: lines_of(r, 6) for i in CLEAN}
    block = lines_of(r, 3)
    for i in (120, 121, 122):
        texts[i] = f"{lines_of(r, 2)}\n{block}\n{lines_of(r, 2)}"
    texts[123] = texts[124] = lines_of(r, 5)
    base = words(r, 120).split()
    for n, i in enumerate((130, 131, 132, 133)):  # each a few words from the one before
        texts[i] = " ".join(w if j not in (20 * n, 20 * n + 3) else f"new{n}" for j, w in enumerate(base))
        base = texts[i].split()
    texts[140] = f"{words(r, 30)} {' '.join(item.split()[4:30]).upper()} {words(r, 30)}"
    texts[141] = f"{words(r, 600)} {' '.join(item.split()[:13])} {words(r, 600)}"
    texts[142] = words(r, 5000)
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i in CLEAN), 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, words(r, 9))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, item


@pytest.fixture(scope="module")
def stages(spark, folder):
    """(rows before, rows after) of every stage; after the first, null and empty texts join the rows."""
    out, docs = [], spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = store.written(stage(spark, docs, folder[0]), name)
        out.append((docs.collect(), after.collect()))
        docs = after.union(spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "web", 0)], SCHEMA)) if name == "quality" else after
    return out


def test_quality_keeps_clean_documents(stages):
    before, after = stages[0]
    assert sorted(after) == sorted(x for x in before if x.doc_id in CLEAN)


def common_lines(a, b):
    """Positions in b of the lines of a longest common subsequence, in blocks that are contiguous on both sides."""
    n = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            n[i, j] = n[i + 1, j + 1] + 1 if a[i] == b[j] and a[i] else max(n[i + 1, j], n[i, j + 1])
    blocks, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and a[i]:
            if blocks and blocks[-1][-1] == (i - 1, j - 1):
                blocks[-1].append((i, j))
            else:
                blocks.append([(i, j)])
            i, j = i + 1, j + 1
        elif n[i + 1, j] >= n[i, j + 1]:
            i += 1
        else:
            j += 1
    return [j for x in blocks if sum(len(b[j].split()) for _, j in x) >= 5 for _, j in x]


def test_lines_equal_brute_force(stages):
    before, after = stages[1]
    want = {}
    for x in before:
        mine = (x.text or "").split("\n")
        gone = {j for y in before if y.doc_id < x.doc_id and y.text for j in common_lines(y.text.split("\n"), mine)} if x.text else set()
        left = "\n".join(t for j, t in enumerate(mine) if j not in gone)
        if not gone:
            want[x.doc_id] = tuple(x)
        elif left.strip():
            want[x.doc_id] = (x.doc_id, left, x.lang, x.source, len(left))
    assert {x.doc_id: tuple(x) for x in after} == want
    assert 124 not in want and len(want[121][1]) < len(next(x for x in before if x.doc_id == 121).text)


def test_neardup_equals_brute_force(stages):
    before, after = stages[2]
    sets = {}
    for x in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x.text or "").lower())
        sets[x.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    top = {i: i for i in sets}
    linked = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in top:
        for a, b in linked:
            top[a] = top[b] = min(top[a], top[b])
    assert len(linked) > 2 and sorted(x.doc_id for x in after) == sorted(i for i in top if top[i] == i)
    assert {tuple(x) for x in after} <= {tuple(x) for x in before}


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def test_decontamination_equals_brute_force(stages, folder):
    before, after = stages[3]
    item = plain_words(folder[1])
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    want = []
    for x in before:
        w = plain_words(x.text)
        hit = {i + k for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for k in range(13)}
        if not hit:  # every window here has all 13 words
            want.append(x.doc_id)
    assert sorted(x.doc_id for x in after) == sorted(want) and 140 not in want and 141 not in want and 142 in want


def test_packing_round_trip(spark, stages, folder):
    from tokenizers import Tokenizer

    before, after = stages[4]
    full = Tokenizer.from_file(queries.tokenizer_files()["tokenizer_json"])
    pieces = {}
    for p in after:
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == {x.doc_id for x in before} and {900, 901} <= set(pieces)
    for x in before:
        ids = np.array([*full.encode(x.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces[x.doc_id], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    used = {}
    for p in sorted(after, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
    assert max(used.values()) <= 1024


def test_run_applies_all_stages(spark, stages, folder):
    got = corpus_pipeline.run(spark, folder[0]).select("doc_id", "start", "length", "ids_crc32").collect()
    assert {x.doc_id for x in got} == {x.doc_id for x in stages[3][1]} - {900, 901}


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert not stage(spark, docs.limit(0), folder[0]).collect(), name
    extra = "score string, partners int, n_words string, component_id string, kept int, start string, k int, t string"
    rows = [(i, f"{words(random.Random(i), 80)}\n{words(random.Random(i + 1), 9)}", "en", "web", i, "s", 1, "w", "c", 0, "x", 2, "y") for i in (1, 1, 5)] + [(None, None, None, None, None, *[None] * 8), (7, "", None, None, 0, *[None] * 8)]
    wide = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, folder[0])
        assert got.columns == wide.columns, name
        assert all(x.component_id == "c" and x.t == "y" for x in got.collect() if x.doc_id in (1, 5)), name
    assert {x.doc_id for x in corpus_pipeline.STAGES[-1][1](spark, wide, folder[0]).collect()} == {1, 5, 7, None}
