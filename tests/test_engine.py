import gzip
import io
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqsweep import arrow
from seqsweep.functions import score
from seqsweep.functions import seq as S
from seqsweep.operators import align, post, report, scan
from seqsweep.plans import cli, engine, registry
from seqsweep.sources import readers
from tests import brute


def genome_of(spark, seqs):
    return spark.createDataFrame([(i, f"c{i}", s) for i, s in enumerate(seqs)], "chrom_idx int, chrom string, seq string")


def guides_of(spark, seqs):
    return readers.guides_table(spark, [readers.Guide(f"g{i}", s) for i, s in enumerate(seqs)])


def random_case(seed, n=3):
    r = random.Random(seed)
    seqs = ["".join(r.choices("ACGTN", [24, 24, 24, 24, 4], k=r.randint(1, 900))) for _ in range(n)]
    long = max(seqs, key=len)
    at = r.randint(0, max(0, len(long) - 24))
    guide = long[at : at + 20].replace("N", "A") or "ACGT"
    return seqs, [guide, "".join(r.choices("ACGT", k=9)) + "N"]


@pytest.mark.parametrize("mode,k,seed", [("hamming", 3, 1), ("hamming", 0, 2), ("levenshtein", 2, 3), ("levenshtein", 0, 4), ("levenshtein", 4, 5)])
def test_kernel_equals_brute_force(spark, mode, k, seed):
    seqs, guides = random_case(seed)
    pats = scan.oriented(list(enumerate(guides)), "both")
    tiles = readers.tile(genome_of(spark, seqs), core=128, margin=scan.margin_for(20, k, 0))
    got = {(r.spacer_idx, r.strand, r.chrom_idx, r.end): r.distance for r in scan.kernel(tiles, pats, k=k, mode=mode, lane=64).collect()}
    plain = brute.hamming_ends if mode == "hamming" else brute.levenshtein_ends
    want = {(g, s, c, e): d for g, s, p in pats for c, q in enumerate(seqs) for e, d in plain(q, p, k).items()}
    assert got == want


def test_long_pattern_equals_brute_force():
    r = random.Random(7)
    text = "".join(r.choices("ACGT", k=300))
    pattern = text[100:180]
    lanes = scan.CODE[np.frombuffer(text.encode(), np.uint8)][None, :]
    got = scan.levenshtein(lanes, [pattern])[0, 0]
    want = brute.levenshtein_ends(text, pattern, 999)
    assert got.tolist() == [want[e] for e in range(1, len(text) + 1)]


@pytest.mark.parametrize("mode,k,length", [("hamming", 3, 20), ("hamming", 3, 40), ("hamming", 7, 64), ("hamming", 1, 33), ("levenshtein", 3, 20), ("levenshtein", 4, 30), ("levenshtein", 2, 64), ("levenshtein", 1, 8), ("levenshtein", 0, 12)])
def test_seeds_equal_brute_force(spark, mode, k, length):
    r = random.Random(length * 10 + k)
    seqs = ["".join(r.choices("ACGTN", [24, 24, 24, 24, 1], k=r.randint(1, 700))) for _ in range(5)] + ["ACG", "ACGT" * 60]
    guides = []
    for q in seqs * 2:
        if len(q) > length + 4:
            at = r.randint(0, len(q) - length - 4)
            g = list(q[at : at + length + 2].replace("N", "A"))
            for _ in range(r.randint(0, k)):
                where = r.randint(0, len(g) - 1)
                g[where] = r.choice(["A", "C", "", "GT"]) if mode == "levenshtein" else r.choice("ACGT")
            guides.append(("".join(g) + "ACGT" * 9)[:length])
    pats = scan.oriented(list(enumerate(guides)), "both")
    tiles = readers.tile(genome_of(spark, seqs), core=150, margin=scan.margin_for(length, k, 0))
    got = {(x.spacer_idx, x.strand, x.chrom_idx, x.end): x.distance for x in scan.kernel(tiles, pats, k=k, mode=mode).collect()}
    plain = brute.hamming_ends if mode == "hamming" else brute.levenshtein_ends
    want = {(g, s, c, e): d for g, s, p in pats for c, q in enumerate(seqs) for e, d in plain(q, p, k).items()}
    assert got == want and len(want) > 10


@pytest.mark.parametrize("mode,k,length", [("hamming", 2, 20), ("hamming", 3, 18), ("hamming", 5, 31), ("levenshtein", 2, 20), ("levenshtein", 3, 20), ("levenshtein", 3, 17), ("levenshtein", 3, 23), ("levenshtein", 4, 24)])
def test_seeds_beside_ends_and_masked_bases(spark, monkeypatch, mode, k, length):
    r = random.Random(length * 100 + k)
    guides = ["".join(r.choices("ACGT", k=length)) for _ in range(12)] + ["A" * length, "CA" * length]
    guides = [g[:length] for g in guides]
    seqs = []
    for g in guides * 6:
        t = list(g)
        for _ in range(r.randint(0, k)):
            t[r.randint(0, len(t) - 1)] = r.choice("ACGTN") if mode == "hamming" else r.choice(["", "N", "A", "GC", "NT"])
            t = t or ["A"]
        seqs.append("".join(r.choices("ACGTN", k=r.choice([0, 0, 1, 9]))) + "".join(t)[r.choice([0, 0, 1, 2]) :] + "".join(r.choices("ACGTN", k=r.choice([0, 0, 1, 9]))))
    monkeypatch.setattr(scan, "BLOCK", 5)
    monkeypatch.setattr(scan, "AT_ONCE", 100)
    pats = scan.oriented(list(enumerate(guides)), "both")
    tiles = readers.tile(genome_of(spark, seqs), core=150, margin=scan.margin_for(length, k, 0))
    got = [((x.spacer_idx, x.strand, x.chrom_idx, x.end), x.distance) for x in scan.kernel(tiles, pats, k=k, mode=mode).collect()]
    plain = brute.hamming_ends if mode == "hamming" else brute.levenshtein_ends
    want = {(g, s, c, e): d for g, s, p in pats for c, q in enumerate(seqs) for e, d in plain(q, p, k).items()}
    assert dict(got) == want and len(got) == len(want) > 20


@pytest.mark.parametrize("edits", [False, True])
def test_seeds_leave_few_places(edits):
    r = np.random.default_rng(5)
    patterns = tuple((i, "".join(x)) for i, x in enumerate(r.choice(list("ACGT"), (3000, 20))))
    text = scan.Text([r.integers(0, 4, 50_000).astype(np.uint8)], 60)
    assert sum(len(p) for p, _ in scan.seeds_of(patterns, 3, edits).places(text)) < (0.05 if edits else 0.3) * len(text.codes)


@pytest.mark.parametrize("length", [300, 600, 700])
def test_long_guides_at_tile_borders(spark, length):
    r = random.Random(length)
    seq = "".join(r.choices("ACGT", k=3000))
    guide = seq[1010 - length + 600 : 1610]  # ends ten bases after a border
    pats = [(0, "+", guide)]
    need = scan.margin_for(length, 3, 0)
    tiles = readers.tile(genome_of(spark, [seq]), core=800, margin=need)
    assert [(x.end, x.distance) for x in scan.kernel(tiles, pats, k=3, mode="levenshtein").orderBy("distance").limit(1).collect()] == [(1610, 0)]
    with pytest.raises(Exception, match="margin is too small"):
        scan.kernel(readers.tile(genome_of(spark, [seq]), core=800, margin=length), pats, k=3, mode="levenshtein").collect()


def test_masked_bases_and_wildcards():
    assert scan.hamming(scan.CODE[np.frombuffer(b"ACNT", np.uint8)], "ACNT", 1)[1].tolist() == [1]
    assert scan.hamming(scan.CODE[np.frombuffer(b"ACGT", np.uint8)], "NNNN", 0)[1].tolist() == [0]


def test_alignment_forms():
    assert align.canonical("ACGT", "TTACGT", True)[:3] == ("4M", "ACGT", 4)
    assert align.canonical("ACGGT", "TTACGT", True)[0] in ("3M1I1M", "2M1I2M")
    d, cig, seq, _ = align.pinned("ACGT", "ACAGT", 2)
    assert (d, cig, seq) == (1, "2M1D2M", "ACAGT")
    assert align.pinned("AAAA", "TTTT", 2) is None
    rng = random.Random(3)
    for _ in range(60):
        p, t = "".join(rng.choices("ACGT", k=12)), "".join(rng.choices("ACGT", k=rng.randint(6, 16)))
        d, cig, seq, _ = align.pinned(p, t, 99)
        assert seq.replace("-", "") == t
        whole = align.matrix(p, t, list(range(len(t) + 1)))
        assert whole[-1][-1] == d


def test_alignments_equal_brute_force():
    r = random.Random(30)
    for _ in range(400):
        pattern = "".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=r.randint(1, 12)))
        text = list(pattern.replace("N", "C"))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(text) - 1)
            text[at] = r.choice(["A", "G", "N", "", "TC", text[at] * 2])
        text = "".join(r.choices("ACGT", k=r.randint(0, 3))) + "".join(text) + "".join(r.choices("ACGT", k=r.randint(0, 2)))
        for plus in (True, False):
            ops, used, ambiguous, end = brute.alignment(pattern, text, plus)
            cig, seq, span, cells = align.canonical(pattern, text, plus)
            assert (cig, span, cells) == (align.cigar(ops), used, ambiguous)
            assert seq.replace("-", "") == text[end - used : end] and len(seq) == len(ops)
            others = [(pattern, "".join(r.choices("ACGTN", k=len(text)))) for _ in range(3)]
            assert align.canonical_many([(pattern, text), *others], plus, most=3) == [align.canonical(p, t, plus) for p, t in [(pattern, text), *others]]


def test_distances_at_lengths_equal_brute_force(spark):
    r = random.Random(41)
    texts = ["".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=r.randint(22, 26))) for _ in range(300)] + ["ACGT" * 6, "A" * 22]
    guides = ["".join(r.choices("ACGT", k=20)) for _ in range(6)] + [texts[0][1:21].replace("N", "A")]
    rows = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chrom string, t string")
    asked = spark.createDataFrame([(f"g{i}", g) for i, g in enumerate(guides)], "spacer string, sequence string")
    got = {(x.chrom, x.spacer): (x.exists_at_20, x.exists_at_22) for x in align.exist_at(rows, asked, (20, 22), 10, block=3).collect()}
    assert got == {(f"c{i}", f"g{j}"): (brute.distance(g, t[:20]) <= 10, brute.distance(g, t[:22]) <= 10) for i, t in enumerate(texts) for j, g in enumerate(guides)}
    assert {x for pair in got.values() for x in pair} == {True, False}
    assert align.exist_at(rows, asked.limit(0), (20, 22), 10).count() == 0


def test_minus_strand_leaves_out_text_before_the_pattern():
    # a hit one base further than the best: the plus strand shows the base, the minus strand (text in its orientation) does not
    assert align.canonical("ACGTACGT", "TACGTACGTA", True)[0] == "8M1D"
    assert align.canonical("ACGTACGT", "TACGTACGT", False)[0] == "8M"


def test_published_scores(spark):
    """Published values for a few pairs, with the entries of the published table that they need."""
    table = {(3, "C", "A"): 0.866667, (17, "C", "A"): 0.466667, (6, "C", "A"): 0.928571}
    cases = [("GTCACCAATCCTGTCCCTAG", "GTCACCAATCCTGTCCCTAG", "AGG", 1.0), ("GTCACCAATCCTGTCCCTAG", "GTAACCAATCCTGTCCATAG", "TGG", 0.4044444), ("GAGTCCGAGCAGAAGAAGAA", "GAGTCCGAGCAGAAGAAGAA", "AGG", 1.0), ("GAGTCCGAGCAGAAGAAGAA", "GAGTCAGAGCAGAAGAAGAA", "AGG", 0.9285714)]
    rows = spark.createDataFrame([(*c, "20M") for c in cases], "g string, t string, m string, want double, c string")
    for r in rows.select(score.activity(rows.g, rows.t, rows.c, rows.m, table).alias("a"), "want").collect():
        assert abs(r.a - r.want) < 1e-3
    kinds = spark.createDataFrame([(k,) for k in ("NGG", "NAG", "OTHER", "INCOMPLETE", None)], "k string")
    assert [r.f for r in kinds.select(score.class_penalty(kinds.k).alias("f")).collect()] == [1.0, 0.259, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("ends,best", [([(98, 2), (99, 1), (100, 0), (101, 1), (102, 2)], [100]), ([(100, 2), (101, 1), (102, 1), (103, 2)], [102]), ([(100, 1), (200, 1)], [100, 200])])
def test_halo(spark, ends, best):
    hits = spark.createDataFrame([(0, "+", 0, e, d) for e, d in ends], "spacer_idx int, strand string, chrom_idx int, end long, distance int")
    assert sorted(r.end for r in post.deduplicate(hits, k=3).collect()) == best


def test_quickstart(spark):
    assert cli.quickstart(spark)


def test_scores(spark):
    row = spark.sql("select 'AAAAAAAAAAAAAAAAAAAA' as g, 'AAAAAAAAAAAAAAAAAAAT' as t, '20M' as c, 'TGG' as m")
    p = score.linear_penalties()
    got = row.select(score.activity(*map(row.__getitem__, "gtcm"), p).alias("a"), score.seed_mismatches(row.g, row.t, row.c).alias("s"), score.motif_penalty(row.m).alias("f")).first()
    assert abs(got.a - 0.2) < 1e-12 and got.s == 1 and got.f == 1.0
    none = spark.sql("select 'AAAA' as g, cast(null as string) as t, cast(null as string) as c, cast(null as string) as m")
    assert none.select(score.activity(*map(none.__getitem__, "gtcm"), p).alias("a")).first().a == 0


def test_gaps_in_scores(spark):
    rows = spark.createDataFrame([("ACGTACGTACGTACGTACGT", t, c, "TGG") for t, c in (("ACGTACGTACGTACGTACGT", "20M"), ("ACGTACGT-CGTACGTACGT", "8M1I11M"), ("ACGTACGTACGTACGTACGTA", "20M1D"), ("ACGNACGTACGTACGTACGA", "20M"), ("", None))], "g string, t string, c string, m string")
    got = [tuple(r) for r in rows.select(score.activity(rows.g, rows.t, rows.c, rows.m, score.linear_penalties()).alias("a"), score.seed_mismatches(rows.g, rows.t, rows.c).alias("s"), S.has_indel(rows.c).alias("i")).collect()]
    assert [(round(a, 9), n, i) for a, n, i in got] == [(1.0, 0, False), (0.0, -1, True), (0.0, -1, True), (0.2, 1, False), (0.0, 0, False)]


def test_guides_from_standard_input(monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO("a ACGT\nGGGG\n"))
    assert [(g.name, g.sequence) for g in readers.read_guides("-")] == [("a", "ACGT"), ("spacer_1", "GGGG")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text("ignored\n>c1 words\nACGT\nac;gt\n".replace("ac;gt", "acgt") + ";note\n\n>c2\tx\r\nNNAA\r\n")
    rows = readers.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("chrom_idx").collect()
    assert [(r.chrom, r.seq) for r in rows] == [("c1", "ACGTACGT"), ("c2", "NNAA")]
    guides = readers.parse_guides(["# c", "ACGT", "n1 ACGU extra", "", "ACXT"])
    assert [g.name for g in guides] == ["spacer_1", "n1", "spacer_2"]
    valid, rest = readers.split_valid(readers.guides_table(spark, guides))
    assert [r.sequence for r in valid.orderBy("spacer_idx").collect()] == ["ACGT", "ACGT"] and rest.count() == 1
    (tmp_path / "b.bed").write_text("track x\n#c\nc1\t1\t5\tq\nbad\nc1 x y\n")
    assert [tuple(r) for r in readers.read_bed(spark, str(tmp_path / "b.bed"), "L").collect()] == [("L", "c1", 1, 5)]
    with pytest.raises(Exception, match="not a base"):
        (tmp_path / "c.fa").write_text(">c\nAXT\n")
        readers.read_fasta(spark, str(tmp_path / "c.fa")).collect()


def test_encoded_texts_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(readers, "MOST_BYTES", 50)
    texts = ["", "Zebra, zOO!", "İstanbul ﬁ K\u212a é\u0130", "123 \n", "abc" * 70, "x" * 33, "The quick brown fox"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = docs.select(F.col("doc_id").cast("int").alias("chrom_idx"), F.concat(F.lit("doc_"), "doc_id").alias("chrom"), S.encode_text(F.col("text")).alias("seq"))
    assert sorted(map(tuple, readers.encoded(docs).collect())) == sorted(map(tuple, whole.collect()))
    tiles = readers.tile(readers.encoded(docs), core=20, margin=6)
    want = [(i, c, len(s), a, min(20, len(s) - a), max(0, a - 6), s[max(0, a - 6) : a + 26]) for i, c, s in map(tuple, whole.collect()) for a in range(0, len(s), 20)]
    assert sorted(map(tuple, tiles.collect())) == sorted(map(tuple, readers.tile(whole, core=20, margin=6).collect())) == sorted(want)


@pytest.mark.parametrize("mode", ["hamming", "levenshtein"])
def test_search_runs_in_one_python_worker(spark, mode):
    docs = spark.createDataFrame([(0, "some text")], "doc_id long, text string")
    hits = engine.search(readers.tile(readers.encoded(docs)), guides_of(spark, ["ACGTTGCAACGTTGCAAGTC"]), engine.Search(distance_mode=mode))
    assert hits._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_ungapped_hits(spark):
    guide = "ACGTTGCAACGTTGCAAGTC"
    other = guide[:4] + "A" + guide[5:18] + "N" + guide[19:]
    tiles = readers.tile(genome_of(spark, ["T" * 9 + other + "AGG" + "T" * 9 + S.reverse_complement_text(other) + "TT"]))
    options = engine.Search(distance_mode="hamming", ungapped=True, pam_extract_length=3, penalties=score.linear_penalties())
    hits = engine.search(tiles, guides_of(spark, [guide]), options).orderBy("strand").collect()
    assert [(h.strand, h.start, h.end, h.distance, h.aligned_seq, h.cigar, h.pam_seq, round(h.cfd_score, 6)) for h in hits] == [("+", 9, 29, 2, other, "20M", "AGG", 0.8), ("-", 41, 61, 2, other, "20M", "AAA", 0.0)]
    with pytest.raises(ValueError):
        engine.Search(ungapped=True).check()


def test_small_batches_are_aligned_together():
    parts = [pa.RecordBatch.from_arrays([pa.array(range(a, a + n))], names=["x"]) for a, n in ((0, 3), (3, 0), (3, 4), (7, 9), (16, 1))]
    assert [b.column(0).to_pylist() for b in arrow.gathered(iter(parts), 6)] == [list(range(7)), list(range(7, 16)), [16]]
    assert list(arrow.gathered(iter([]), 6)) == []


def test_index_round_trip(spark, tmp_path):
    tiles = readers.tile(genome_of(spark, ["ACGT" * 50, "TTTT"]), core=64, margin=8)
    path = str(tmp_path / "g.tiles")
    readers.write_index(tiles, path)
    assert sorted(map(tuple, readers.load(spark, path).collect())) == sorted(map(tuple, tiles.collect()))


def test_search_options(spark):
    guide = "ACGTTGCAACGTTGCAAGTC"
    tiles = readers.tile(genome_of(spark, ["T" * 30 + guide + "AGG" + "T" * 30 + S.reverse_complement_text(guide + "CGG") + "T" * 30]))
    guides = guides_of(spark, [guide])
    hits = engine.search(tiles, guides, engine.Search(pam="NGG", threshold=2)).orderBy("strand").collect()
    assert [(h.strand, h.start, h.end, h.distance, h.cigar, h.pam_seq) for h in hits] == [("+", 30, 50, 0, "20M", "AGG"), ("-", 86, 106, 0, "20M", "CGG")]
    assert engine.search(tiles, guides, engine.Search(region="c0:1-60", threshold=1)).count() == 1
    rows = report.tsv_rows(engine.search(tiles, guides, engine.Search(distance_mode="hamming"))).collect()
    assert all(r.pam_seq == "." for r in rows)
    for bad in (dict(threshold=256), dict(strand="up"), dict(pam="Z"), dict(pam="NGG", compute_mismatches=False)):
        with pytest.raises(ValueError):
            engine.Search(**bad).check()
    with pytest.raises(ValueError):
        engine.Search(max_hits=3).check(summaries=True)


def test_exact_hit_does_not_take_the_motif_of_another_length(spark):
    guide = "TATACTCACGACGCCAGT"
    tiles = readers.tile(genome_of(spark, ["GTCAGTAGGA" + guide + "GCCAATTTAAAG"]))
    hits = engine.search(tiles, guides_of(spark, [guide]), engine.Search(threshold=4, pam="NRG", pam_position="5", strand="plus")).collect()
    assert all(h.distance > 0 for h in hits) and [(h.distance, h.pam_seq) for h in hits if h.end == 28] == [(1, "AGG")]


def test_hits_with_gaps_span_their_targets(spark):
    guide = "GAGTCCGAGCAGAAGAAGAA"
    target = guide[:5] + guide[6:12] + guide[13:]
    r = random.Random(31)
    seq = "".join(r.choices("ACGT", k=300))
    seq = seq[:100] + S.reverse_complement_text(target) + seq[118:200] + target + seq[218:]
    hits = engine.search(readers.tile(genome_of(spark, [seq])), guides_of(spark, [guide]), engine.Search(threshold=2)).collect()
    assert {(h.strand, h.start, h.end, h.distance, h.target_len) for h in hits} == {("-", 100, 118, 2, 18), ("+", 200, 218, 2, 18)}


@pytest.mark.parametrize("motif,side", [("NGG", "3"), ("TTTV", "5"), ("NRG", "5"), ("NNGRRT", "3")])
def test_motif_hits_equal_brute_force(spark, motif, side):
    r = random.Random(motif + side)
    seqs, guides = [], []
    for _ in range(6):
        seq = "".join(r.choices("ACGTN", [24, 24, 24, 24, 1], k=r.randint(60, 260)))
        at = r.randint(0, len(seq) - 30)
        g = list(seq[at : at + 20].replace("N", "G"))
        for _ in range(r.randint(0, 3)):
            g[r.randint(0, 19)] = r.choice(["A", "G", "", "CT"])
        guides.append(("".join(g) + "ACGT" * 3)[: r.randint(18, 20)])
        some = "".join(r.choice("ACGT") if c == "N" else r.choice(S.IUPAC[c]) for c in motif)
        put = (lambda t: t + some) if side == "3" else (lambda t: some + t)
        wild = "".join(c for c in guides[-1] if r.random() > 0.06)
        seqs += [seq, "".join(r.choices("ACGT", k=40)) + put(guides[-1]) + "".join(r.choices("ACGT", k=9)) + put(wild) + "CA" + S.reverse_complement_text(put(wild)) + "".join(r.choices("ACGT", k=30))]
    tests = re.compile(S.motif_regex(motif))
    options = engine.Search(threshold=3, pam=motif, pam_position=side, deduplicate=False)
    got = {(h.spacer_idx, h.strand, h.chrom, h.end) for h in engine.search(readers.tile(genome_of(spark, seqs)), guides_of(spark, guides), options).collect()}
    fits = lambda b: bool(tests.match(b))
    want = {(i, "+" if plus else "-", f"c{c}", e) for i, g in enumerate(guides) for c, q in enumerate(seqs) for plus in (True, False) for e in brute.motif_ends(q, g, 3, fits, len(motif), side, plus)}
    assert got == want and len(want) > 10


def test_seeds_of_a_hit_are_counted_once(spark):
    names = "spacer_idx int, distance int, aligned_seq string, cigar string, cfd_score double"
    hits = spark.createDataFrame([(0, 1, "ACGTACGTACGTACGTACGA", "20M", 0.5), (0, 3, "AAAAAAGTACGTACGTACGT", "20M", 0.5)], names)
    rows = report.guide_summary(hits, guides_of(spark, ["ACGTACGTACGTACGTACGT"]))
    assert [(r.total_hits, r.n_sdr1_sites, r.aggregate_cfd) for r in rows.collect()] == [(2, 1, 0.5)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(sequence(") == 1


def test_overlap_counts(spark):
    hits = spark.createDataFrame([(0, "+", 0, 10 * i, "c0", 10 * i - 5) for i in range(1, 6)], "spacer_idx int, strand string, chrom_idx int, end long, chrom string, start long")
    beds = spark.createDataFrame([("a", "c0", 8, 22), ("a", "c0", 9, 10), ("b", "c0", 40000, 40010), ("a", "c1", 0, 99)], "label string, chrom string, start long, end long")
    assert [r.labels for r in report.overlaps(hits, beds).orderBy("end").collect()] == [["a"], ["a"], [], [], []]


def test_output_forms(spark, tmp_path):
    names = "chrom string, start long, end long, pattern string, distance int, strand string, aligned_seq string, cigar string, pam_seq string, alignment_ambiguous boolean, n_ambiguous_cells int, cfd_score double, spacer string, spacer_idx int"
    p = "ACGTACGTACGTACGTACGT"
    hits = spark.createDataFrame([("chr1", 80, 100, p, 1, "+", p, "20M", "AGG", False, 0, 0.0390005, "g\"1", 0), ("chr1", 180, 200, p, 0, "-", None, None, None, None, None, 0.0, "g\"1", 0), ("chr2", 0, 20, p, 2, "+", p, "19M1D", "TG", True, 3, 0.00001234, "g\"1", 0)], names)
    head = "chrom\tstart\tend\tpattern\tdistance\tstrand\taligned_seq\tcigar\tpam_seq\talignment_ambiguous\tn_ambiguous_cells\tcfd_score"
    tsv = list(report.lines(hits, "tsv", batch=False))
    assert tsv == [head, f"chr1\t80\t100\t{p}\t1\t+\t{p}\t20M\tAGG\tfalse\t0\t0.0390005", f"chr1\t180\t200\t{p}\t0\t-\t.\t.\t.\tfalse\t0\t0", f"chr2\t0\t20\t{p}\t2\t+\t{p}\t19M1D\tTG\ttrue\t3\t1.234e-05"]
    assert next(report.lines(hits, "tsv")) == f"spacer\t{head}"
    assert list(report.lines(hits, "bed", batch=False))[1] == f"chr1\t180\t200\t{p}\t20\t-" and list(report.lines(hits, "bed"))[0] == f'chr1\t80\t100\t{p}\t19\t+\tg"1'
    text = "\n".join(report.lines(hits, "json"))
    rows = json.loads(text)
    assert '"cfd_score":0.039001' in text or '"cfd_score":0.039000' in text
    assert rows[0]["spacer"] == 'g"1' and rows[0]["spacer_sequence"] == p and rows[1]["aligned_seq"] is None and rows[1]["n_ambiguous_cells"] == 0 and rows[2]["alignment_ambiguous"] is True
    assert list(rows[0])[2:] == head.split("\t") and list(report.lines(hits.limit(0), "json")) == ["[]"]
    guides = spark.createDataFrame([(0, 'g"1', p), (1, "none", "ACGT")], "spacer_idx int, spacer string, sequence string")
    found = json.loads("\n".join(report.summary_lines(report.by_distance(hits, guides), 2, 1, "json")))
    assert found == {"threshold": 2, "total_spacers_processed": 2, "spacers_skipped": 1, "spacers": [{"name": 'g"1', "sequence": p, "total_hits": 3, "hits_by_distance": {"0": 1, "1": 1, "2": 1}}, {"name": "none", "sequence": "ACGT", "total_hits": 0, "hits_by_distance": {}}]}
    assert list(report.summary_lines(report.by_distance(hits, guides), 2, 1, "tsv")) == ["spacer\tsequence\ttotal_hits\td0\td1\td2", f'g"1\t{p}\t3\t1\t1\t1', "none\tACGT\t0\t0\t0\t0"]
    rows = [tuple(r) for r in report.guide_summary_tsv(report.guide_summary(hits.withColumn("labels", F.array(F.lit("x"))), guides, labels=("x",)), ("x",)).orderBy("spacer").collect()]
    assert rows[1] == ("none", "ACGT", "0", "0", "0", "0", ".", ".", ".", "0") and rows[0][2:6] == ("1", "1", "1", "0") and rows[0][-1] == "3"
    seen, totals = engine.observed(hits)
    seen.collect()
    assert totals.get == {"total_hits": 3, "least_distance": 0, "largest_distance": 2}


def test_command_line(spark, tmp_path, capsys):
    guide = "ACGTTGCAACGTTGCAAGTC"
    (tmp_path / "g.fa").write_text(f">c1 x>y\n{'T' * 30}{guide}AGG{'T' * 30}\n>c2\n{'A' * 40}\n")
    (tmp_path / "s.txt").write_text(f"good {guide}\nbad ACXT\n")
    out = tmp_path / "hits.tsv"
    assert cli.main(["--genome", str(tmp_path / "g.fa"), "--spacer-file", str(tmp_path / "s.txt"), "--pam", "NGG", "--output", str(out), "--verbose", "--spacer-summary", str(tmp_path / "sum.tsv")]) == 0
    rows = [x.split("\t") for x in out.read_text().splitlines()]
    assert rows[0][0] == "spacer" and [r[:4] for r in rows[1:]] == [["good", "c1", "30", "50"]]
    assert "1 hits of 1 guides, 1 skipped" in capsys.readouterr().err
    assert (tmp_path / "sum.tsv").read_text().splitlines()[0].startswith("spacer\tsequence\tn_d0")
    assert cli.main(["--genome", str(tmp_path / "g.fa"), "--pattern", guide, "--summary", "--quiet"]) == 0
    assert json.loads(capsys.readouterr().out)["spacers"][0]["hits_by_distance"]["0"] == 1


def test_positions_and_many_records(spark, tmp_path):
    (tmp_path / "m.fa").write_text("; note\n" + "".join(f">s{i} some > sign\n{'ACGT' * (i % 7)}\n{'GG' * (i % 3)}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        genome = readers.read_fasta(spark, str(tmp_path / "m.fa"))
        rows = sorted(map(tuple, genome.collect()))
        assert rows == [(i, f"s{i}", "ACGT" * (i % 7) + "GG" * (i % 3)) for i in range(500)] and genome.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write(">a\nAC\n>b\nGT\n")
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "z.fa.gz")).collect())) == [(0, "a", "AC"), (1, "b", "GT")]
    places = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,)], "position long")
    pair = readers.read_fasta(spark, str(tmp_path / "z.fa.gz"))
    assert [tuple(r) for r in readers.resolve(places, pair).orderBy("position").select("position", "chrom", "offset").collect()] == [(0, "a", 0), (1, "a", 1), (2, "b", 0), (3, "b", 1), (4, None, None)]


def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
