"""The engine's registered queries and their SQL, over a genome derived from the test tables.

The tables hold no sequences: the letters of `documents` become bases (a document is a sequence), every benchmark item
is cut into guides of twenty bases (those without a masked base count), and labelled documents give intervals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsweep.functions import score
from seqsweep.functions import seq as S
from seqsweep.operators import align, post, report
from seqsweep.plans import engine
from seqsweep.sources import readers

K = 3


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").where("doc_id is not null and text is not null").select("doc_id", "text")
    return docs.repartition(partitions(spark))


def genome(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").cast("int").alias("chrom_idx"), F.concat(F.lit("doc_"), "doc_id").alias("chrom"), S.encode_text(F.col("text")).alias("seq"))


def prefixes(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """chrom and t, the first n bases of the sequences that have so many; only where few letters are ahead the whole text is encoded."""
    ahead, whole = S.encode_text(F.substring("text", 1, 4 * n)), S.encode_text(F.col("text"))
    docs = read(spark, sf, "documents").where("doc_id is not null and text is not null")
    rows = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("chrom"), F.substring(F.when(F.length(ahead) >= n, ahead).otherwise(whole), 1, n).alias("t"))
    return rows.where(F.length("t") >= n).repartition(partitions(spark))


def guides(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "benchmark").where("item_id is not null").select("item_id", S.encode_text(F.col("text")).alias("seq"))
    cut = items.where(F.length("seq") >= 20).select("item_id", F.posexplode(F.expr("transform(sequence(0, length(seq) div 20 - 1), i -> substring(seq, 20 * i + 1, 20))")).alias("i", "sequence"))
    rows = cut.select((F.col("item_id") * 10000 + F.col("i")).cast("int").alias("spacer_idx"), F.concat_ws("_", F.lit("sp"), "item_id", "i").alias("spacer"), "sequence")
    return rows.where(~F.contains("sequence", F.lit("N")))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    start = F.expr("(doc_id * 37) % 500")
    return read(spark, sf, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"), F.concat(F.lit("doc_"), "doc_id").alias("chrom"), start.alias("start"), (start + 400).alias("end"))


def found(spark: SparkSession, sf: str, **options) -> DataFrame:
    wanted = engine.Search(**{"threshold": K, "distance_mode": "hamming", "penalties": score.linear_penalties(), "pam_extract_length": 3} | options)
    return engine.search(readers.tile(readers.encoded(documents(spark, sf))), guides(spark, sf), wanted)


PLACE = ("spacer_idx", "strand", "chrom", "start", "end", "distance")

GENOME_SQL = """g as (select cast(doc_id as int) as chrom_idx, 'doc_' || doc_id as chrom, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAN') as seq
  from documents where doc_id is not null and text is not null),
sp as (select * from (select cast(item_id * 10000 + i as int) as spacer_idx, 'sp_' || item_id || '_' || i as spacer, substr(seq, 20 * i + 1, 20) as sequence
  from (select item_id, seq, unnest(range(0, len(seq) // 20)) as i from (select item_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAN') as seq from benchmark where item_id is not null)))
  where not contains(sequence, 'N'))"""
RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
HITS_SQL = GENOME_SQL + f""",
pat as (select spacer_idx, '+' as strand, sequence as p from sp union all select spacer_idx, '-', {RC.format('sequence')} from sp),
win as (select chrom_idx, chrom, seq, i, substr(seq, i, 20) as w from (select *, unnest(range(1, len(seq) - 18)) as i from g where len(seq) >= 20)),
h0 as (select distinct spacer_idx, strand, chrom_idx, chrom, i from (
  select * from win join pat on substr(w, 1, 5) = substr(p, 1, 5) union all select * from win join pat on substr(w, 6, 5) = substr(p, 6, 5)
  union all select * from win join pat on substr(w, 11, 5) = substr(p, 11, 5) union all select * from win join pat on substr(w, 16, 5) = substr(p, 16, 5)) where hamming(w, p) <= 3),
h as (select spacer_idx, strand, chrom_idx, h0.chrom, cast(i - 1 as bigint) as "start", cast(i + 19 as bigint) as "end", cast(hamming(substr(seq, i, 20), p) as int) as distance, spacer, sequence,
    case strand when '+' then substr(seq, i, 20) else {RC.format('substr(seq, i, 20)')} end as aligned,
    nullif(case strand when '+' then substr(seq, i + 20, 3) else reverse(translate(substr(seq, greatest(i - 3, 1), i - greatest(i - 3, 1)), 'ACGTN', 'TGCAN')) end, '') as pam3,
    nullif(case strand when '+' then substr(seq, greatest(i - 3, 1), i - greatest(i - 3, 1)) else reverse(translate(substr(seq, i + 20, 3), 'ACGTN', 'TGCAN')) end, '') as pam5
  from h0 join g using (chrom_idx) join pat using (spacer_idx, strand) join sp using (spacer_idx))"""


def place_sql(where: str = "true") -> str:
    return f'with {HITS_SQL} select spacer_idx, strand, chrom, "start", "end", distance from h where {where}'


SCORED_SQL = HITS_SQL + """,
f as (select *, case when strand = '+' then aligned else aligned end as a from h),
c as (select *, list_reduce([1.0::double] || list_transform(range(1, 21), lambda j: case when a[j] = sequence[j] or a[j] = 'N' then 1.0::double else (1 - j / 25.0)::double end), lambda x, y: x * y)
   * coalesce(map {'AG': 0.259, 'CG': 0.107, 'GA': 0.069, 'GC': 0.022, 'GG': 1.0, 'GT': 0.016, 'TG': 0.039}[case when len(pam3) >= 3 then substr(pam3, 2, 2) when len(pam3) = 2 then pam3 end], 0.0)::double as cfd,
   len(list_filter(range(4, 21), lambda j: a[j] <> sequence[j] and a[j] <> 'N')) as seed from f)"""

LEV_K = 1
LEV_SQL = GENOME_SQL + f""",
pat as (select spacer_idx, '+' as strand, sequence as p from sp union all select spacer_idx, '-', {RC.format('sequence')} from sp),
w10 as (select chrom_idx, i, substr(seq, i, 10) as w from (select chrom_idx, seq, unnest(range(1, len(seq) - 8)) as i from g where len(seq) >= 10)),
occ as (select chrom_idx, spacer_idx, strand, i + 19 as e from w10 join pat on w = substr(p, 1, 10) union select chrom_idx, spacer_idx, strand, i + 9 from w10 join pat on w = substr(p, 11, 10)),
cand as (select distinct chrom_idx, spacer_idx, strand, e + d as e from occ, (select unnest(range(-1, 2)) as d)),
lev as (select spacer_idx, strand, chrom_idx, chrom, cast(e as bigint) as "end",
    cast(list_min(list_transform(range(19, 22), lambda t: case when t <= e then levenshtein(p, substr(seq, e - t + 1, t)) else 99 end)) as int) as distance
  from cand join g using (chrom_idx) join pat using (spacer_idx, strand) where e between 1 and len(seq)),
raw as (select * from lev where distance <= 1)"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {GENOME_SQL} select chrom, cast(len(seq) as bigint) as n_bases, cast(len(seq) - len(replace(seq, 'N', '')) as bigint) as n_masked, cast(len(seq) - len(translate(seq, 'GC', '')) as bigint) as n_gc from g")
def genome_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("seq").cast("long")
    return genome(spark, sf).select("chrom", n.alias("n_bases"), (n - F.length(F.replace("seq", F.lit("N")))).cast("long").alias("n_masked"), (n - F.length(F.translate("seq", "GC", ""))).cast("long").alias("n_gc"))


@query(f"with {GENOME_SQL} select chrom, cast(len(seq) as bigint) as length, cast(coalesce(sum(len(seq)) over (order by chrom_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as start from g")
def chrom_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return readers.dictionary(genome(spark, sf)).select("chrom", "length", "start")


@query(f"with {GENOME_SQL} select chrom, cast(a as bigint) as core_start, cast(least(1000, len(seq) - a) as int) as core_len, cast(greatest(0, a - 50) as bigint) as text_start, substr(seq, greatest(0, a - 50) + 1, least(len(seq), a + 1050) - greatest(0, a - 50)) as text from (select *, unnest(range(0, len(seq), 1000)) as a from g)")
def tile_table(spark: SparkSession, sf: str) -> DataFrame:
    return readers.tile(genome(spark, sf), core=1000, margin=50).select("chrom", "core_start", "core_len", "text_start", "text")


@query(f"with {GENOME_SQL} select chrom, substr(seq, 101, 60) as slice from g where len(seq) > 100")
def region_slice(spark: SparkSession, sf: str) -> DataFrame:
    return genome(spark, sf).where(F.length("seq") > 100).select("chrom", F.substring("seq", 101, 60).alias("slice"))


@query(f"with {GENOME_SQL} select spacer, reverse(translate(sequence, 'ACGTN', 'TGCAN')) as rc from sp")
def reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    return guides(spark, sf).select("spacer", S.reverse_complement(F.col("sequence")).alias("rc"))


@query("select item_id, translate(text, 'Uu', 'Tt') as text from benchmark")
def uracil(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", S.uracil_to_thymine(F.col("text")).alias("text"))


@query("""with t as (select item_id, text, regexp_replace(text, '[^ACGTNacgtn]', '', 'g') as bases from benchmark)
select item_id, coalesce(regexp_full_match(text, '[ACGTNacgtn]+'), false) as valid_text, coalesce(regexp_full_match(bases, '[ACGTNacgtn]+'), false) as valid_bases, upper(bases) as bases from t""")
def pattern_validity(spark: SparkSession, sf: str) -> DataFrame:
    bases = F.regexp_replace("text", "[^ACGTNacgtn]", "")
    return read(spark, sf, "benchmark").select("item_id", S.valid_pattern(F.col("text")).alias("valid_text"), S.valid_pattern(bases).alias("valid_bases"), F.upper(bases).alias("bases"))


@query(f"with {GENOME_SQL} select chrom, coalesce(regexp_matches(seq, '^[ACGTN][AG]G'), false) as nrg, coalesce(regexp_matches(seq, '^TTT[ACG]'), false) as tttv from g")
def motif_match(spark: SparkSession, sf: str) -> DataFrame:
    return genome(spark, sf).select("chrom", S.motif_matches(F.col("seq"), "NRG").alias("nrg"), S.motif_matches(F.col("seq"), "TTTV").alias("tttv"))


@query(place_sql())
def hamming_both(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, compute_mismatches=False).select(*PLACE)


@query(place_sql("strand = '+'"))
def hamming_plus(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, strand="plus", compute_mismatches=False).select(*PLACE)


@query(place_sql("strand = '-'"))
def hamming_minus(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, strand="minus", compute_mismatches=False).select(*PLACE)


@query(place_sql("distance = 0"))
def hamming_exact(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, threshold=0, compute_mismatches=False).select(*PLACE)


@query(place_sql("regexp_matches(pam3, '^[ACGTN]GG')"))
def hamming_pam_ngg(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, pam="NGG", compute_mismatches=False).select(*PLACE)


@query(place_sql("regexp_matches(pam5, '^[ACGTN][AG]')"))
def hamming_pam_5prime(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, pam="NR", pam_position="5", compute_mismatches=False).select(*PLACE)


@query(place_sql("chrom = 'doc_39' and \"start\" >= 250 and \"end\" <= 400"))
def hamming_region(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, region="doc_39:251-401", compute_mismatches=False).select(*PLACE)


@query(f'with {HITS_SQL} select spacer_idx, strand, chrom, "end", pam3 as pam_seq, case when pam3 is null or len(pam3) < 3 then \'INCOMPLETE\' when substr(pam3, 2, 2) = \'GG\' then \'NGG\' when substr(pam3, 2, 2) = \'AG\' then \'NAG\' else \'OTHER\' end as pam_class from h')
def motif_3prime(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, compute_mismatches=False).select("spacer_idx", "strand", "chrom", "end", "pam_seq", S.motif_class(F.col("pam_seq")).alias("pam_class"))


@query(f'with {HITS_SQL} select spacer_idx, strand, chrom, "end", pam5 as pam_seq from h')
def motif_5prime(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, pam_position="5", compute_mismatches=False).select("spacer_idx", "strand", "chrom", "end", "pam_seq")


@query(f"with {HITS_SQL} select spacer, cast(sum(count(*)) over (partition by spacer) as bigint) as total_hits, distance, count(*) as n from h group by spacer, distance")
def summary_by_distance(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.by_distance(found(spark, sf, compute_mismatches=False), guides(spark, sf))
    return rows.select("spacer", "total_hits", F.explode("by_distance").alias("distance", "n"))


@query(f"with {HITS_SQL} select sp.spacer, cast(count(distance) as bigint) as total_hits, " + ", ".join(f"cast(count(*) filter (distance = {d}) as bigint) as d{d}" for d in range(K + 1)) + " from sp left join h using (spacer_idx) group by sp.spacer")
def summary_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return report.pivot(found(spark, sf, compute_mismatches=False), guides(spark, sf), K).drop("spacer_idx", "sequence")


@query(f'with {HITS_SQL} select spacer_idx, strand, chrom, "start", "end", distance from h qualify row_number() over (partition by spacer_idx order by chrom_idx, "end", strand) <= 2')
def max_hits(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, max_hits=2, compute_mismatches=False).select(*PLACE)


@query(f'with {HITS_SQL} select spacer_idx, strand, chrom, "start", "end", distance from h order by spacer_idx, chrom_idx, "end", strand limit 25')
def max_total_hits(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, max_total_hits=25, compute_mismatches=False).select(*PLACE)


def ungapped(spark: SparkSession, sf: str) -> DataFrame:
    """Hamming hits with the bases that they cover as aligned_seq, without gaps, and the scores of these."""
    return found(spark, sf, ungapped=True)


@query(f'with {SCORED_SQL} select spacer_idx, strand, chrom, "end", distance, round(cfd, 6) as cfd_score from c')
def cfd_score(spark: SparkSession, sf: str) -> DataFrame:
    return ungapped(spark, sf).select("spacer_idx", "strand", "chrom", "end", "distance", F.round("cfd_score", 6).alias("cfd_score"))


@query(f'with {SCORED_SQL} select spacer_idx, strand, chrom, "end", distance, cast(seed as int) as seed_mismatches from c')
def seed_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return ungapped(spark, sf).select("spacer_idx", "strand", "chrom", "end", "distance", score.seed_mismatches(F.col("pattern"), F.col("aligned_seq"), F.col("cigar")).alias("seed_mismatches"))


@query()
def hit_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Activity and seed mismatches of Hamming hits by their alignments, which may have gaps (SQL has no traceback)."""
    rows = found(spark, sf)
    return rows.select("spacer_idx", "strand", "chrom", "end", "distance", "aligned_seq", "cigar", F.round("cfd_score", 6).alias("cfd_score"), score.seed_mismatches(F.col("pattern"), F.col("aligned_seq"), F.col("cigar")).alias("seed_mismatches"))


@query(f"""with {HITS_SQL}, k as (select *, case when pam3 is null or len(pam3) < 3 then 'INCOMPLETE' when substr(pam3, 2, 2) = 'GG' then 'NGG' when substr(pam3, 2, 2) = 'AG' then 'NAG' else 'OTHER' end as pam_class from h)
select spacer_idx, strand, chrom, "end", pam_class, case pam_class when 'NGG' then 1.0::double when 'NAG' then 0.259::double else 0.0::double end as factor from k""")
def motif_class_penalty(spark: SparkSession, sf: str) -> DataFrame:
    kind = S.motif_class(F.col("pam_seq"))
    return found(spark, sf, compute_mismatches=False).select("spacer_idx", "strand", "chrom", "end", kind.alias("pam_class"), score.class_penalty(kind).alias("factor"))


@query(f"""with {GENOME_SQL} select g.chrom, sp.spacer, levenshtein(sequence, substr(seq, 1, 20)) <= 12 as exists_at_20, levenshtein(sequence, substr(seq, 1, 22)) <= 12 as exists_at_22
from g join sp on true where spacer_idx % 10000 = 0 and len(seq) >= 22""")
def alignment_at_length(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each item's first guide aligns with the first 20, and 22, bases of a sequence at a distance of 12 or less."""
    firsts = guides(spark, sf).where("spacer_idx % 10000 = 0").select("spacer", "sequence")  # one a benchmark item
    return align.exist_at(prefixes(spark, sf, 22), firsts, (20, 22), 12)


@query(f"""with {GENOME_SQL}, d as (select chrom, chrom_idx, cast(coalesce(sum(len(seq)) over (order by chrom_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as s, len(seq) as n from g),
p as (select distinct (doc_id * 7919) % 4000000 as position from labels)
select position, chrom, cast(position - s as bigint) as "offset" from p left join d on position >= s and position < s + n""")
def resolve_position(spark: SparkSession, sf: str) -> DataFrame:
    places = read(spark, sf, "labels").select(((F.col("doc_id") * 7919) % 4000000).alias("position")).distinct()
    return readers.resolve(places, genome(spark, sf)).select("position", "chrom", "offset")


@query(f'with {HITS_SQL} select h.spacer_idx, h.strand, h.chrom, h."end", exists(select 1 from labels l where l.quality = 1 and \'doc_\' || l.doc_id = h.chrom and (l.doc_id * 37) % 500 < h."end" and (l.doc_id * 37) % 500 + 400 > h."start") as good from h')
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    marked = report.overlaps(found(spark, sf, threshold=K, compute_mismatches=False), intervals(spark, sf))
    return marked.select("spacer_idx", "strand", "chrom", "end", F.array_contains("labels", "good").alias("good"))


@query(f'with {HITS_SQL} select chrom, "start", "end", sequence as name, cast(20 - distance as int) as score, strand, spacer from h')
def bed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.bed_rows(found(spark, sf, compute_mismatches=False))


@query(f'with {LEV_SQL} select spacer_idx, strand, chrom, "end", distance from raw')
def levenshtein_raw(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, distance_mode="levenshtein", threshold=LEV_K, deduplicate=False, compute_mismatches=False).select("spacer_idx", "strand", "chrom", "end", "distance")


@query(f'''with {LEV_SQL},
i as (select *, sum(new) over (partition by spacer_idx, strand, chrom_idx order by "end" rows unbounded preceding) as island from (
  select *, case when "end" - lag("end") over (partition by spacer_idx, strand, chrom_idx order by "end") >= {LEV_K + 1} then 1 else 0 end as new from raw))
select spacer_idx, strand, chrom, "end", distance from i qualify row_number() over (partition by spacer_idx, strand, chrom_idx, island order by distance, "end" desc) = 1''')
def levenshtein_dedup(spark: SparkSession, sf: str) -> DataFrame:
    raw = found(spark, sf, distance_mode="levenshtein", threshold=LEV_K, deduplicate=False, compute_mismatches=False)
    return post.deduplicate(raw.drop("pam_seq"), k=LEV_K).select("spacer_idx", "strand", "chrom", "end", "distance")


@query()
def levenshtein_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments, motifs and scores of deduplicated hits (tie rules of the traceback are tested against brute force)."""
    return found(spark, sf, distance_mode="levenshtein", threshold=LEV_K).select(*PLACE, "aligned_seq", "cigar", "pam_seq", "target_len", "alignment_ambiguous", "n_ambiguous_cells", "cfd_score")


@query()
def levenshtein_pam(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplicated hits with the motif NGG, re-aligned where an indel moves it."""
    return found(spark, sf, distance_mode="levenshtein", threshold=2, pam="NGG").select(*PLACE, "cigar", "pam_seq")


def found_raw(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, distance_mode="levenshtein", deduplicate=False, compute_mismatches=False)


@query()
def levenshtein_default(spark: SparkSession, sf: str) -> DataFrame:
    """Every end within the default distance of 3 (SQL would compare every end with every guide; tested by brute force)."""
    return found_raw(spark, sf).select("spacer_idx", "strand", "chrom", "end", "distance")


SUMMARY_SQL = SCORED_SQL + """,
o as (select c.*, exists(select 1 from labels l where l.quality = 1 and 'doc_' || l.doc_id = c.chrom and (l.doc_id * 37) % 500 < c."end" and (l.doc_id * 37) % 500 + 400 > c."start") as good,
  exists(select 1 from labels l where l.quality <> 1 and 'doc_' || l.doc_id = c.chrom and (l.doc_id * 37) % 500 < c."end" and (l.doc_id * 37) % 500 + 400 > c."start") as poor from c)
select sp.spacer_idx, sp.spacer, sp.sequence, cast(count(distance) as bigint) as total_hits, cast(count(*) filter (distance = 0) as bigint) as n_d0, cast(count(*) filter (distance = 1) as bigint) as n_d1,
  cast(count(*) filter (distance = 2) as bigint) as n_d2, cast(count(*) filter (distance >= 3) as bigint) as n_d3p, cast(count(*) filter (seed <= 1) as bigint) as n_sdr1_sites,
  round(coalesce(sum(cfd) filter (seed <= 1), 0.0), 6) as aggregate_cfd, coalesce(sum(cfd) filter (seed <= 1), 0.0) > 4.8 as promiscuous,
  cast(count(*) filter (good) as bigint) as n_good_overlaps, cast(count(*) filter (poor) as bigint) as n_poor_overlaps
from sp left join o using (spacer_idx) group by sp.spacer_idx, sp.spacer, sp.sequence"""


def summary(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    options = engine.Search(threshold=K, distance_mode="hamming", penalties=score.linear_penalties(), pam_extract_length=3)
    return engine.summarise(hits, guides(spark, sf), options, intervals(spark, sf), ("good", "poor")).withColumn("aggregate_cfd", F.round("aggregate_cfd", 6))


@query(f"with {SUMMARY_SQL}")
def guide_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets, seed sites, aggregate activity, promiscuity and overlaps of every guide, by the bases that hits cover."""
    return summary(spark, sf, ungapped(spark, sf))


@query()
def guide_summary_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the hits' alignments, which may have gaps (SQL has no traceback)."""
    return summary(spark, sf, found(spark, sf))


@query(f"""with {SCORED_SQL} select '{{"spacer":"' || spacer || '","spacer_sequence":"' || sequence || '","chrom":"' || chrom || '","start":' || "start" || ',"end":' || "end" || ',"pattern":"' || sequence || '","distance":' || distance
  || ',"strand":"' || strand || '","aligned_seq":"' || aligned || '","cigar":"20M","pam_seq":' || coalesce('"' || pam3 || '"', 'null') || ',"alignment_ambiguous":false,"n_ambiguous_cells":0,"cfd_score":' || format('{{:.6f}}', cfd) || '}}' as json from c where distance = 0""")
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.json_rows(found(spark, sf, threshold=0))


@query(f"""with {SCORED_SQL} select spacer, chrom, cast("start" as varchar) as "start", cast("end" as varchar) as "end", sequence as pattern, cast(distance as varchar) as distance, strand, aligned as aligned_seq, '20M' as cigar,
  coalesce(pam3, '.') as pam_seq, 'false' as alignment_ambiguous, '0' as n_ambiguous_cells, format('{{:.6g}}', cfd) as cfd_score from c where distance = 0""")
def tsv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.tsv_rows(found(spark, sf, threshold=0))


@query()
def tsv_rows_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a file of default Levenshtein hits (their alignments are tested against brute force)."""
    return report.tsv_rows(found(spark, sf, distance_mode="levenshtein"))
