"""The operators' registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, linededup, neardup, packing, pii, quality, samples, substrings, topk


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality").where(samples.crc_mod("doc_id", 4) != 2)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", F.coalesce(samples.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.where((samples.crc_mod("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = langid.identify(docs.select("doc_id", "text"), langid.train(learn))
    return found.select("doc_id", F.coalesce(samples.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return html.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans and the number of all spans for every document."""
    found = pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(pii.listed(base=True)), 256).alias("base_sha256"), F.expr(pii.listed(base=False)).alias("spans"), F.expr(" + ".join(f"size({k})" for k in (*pii.KINDS, "added"))).cast("long").alias("n_spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    docs, items = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")
    m = decontam.measure(docs, items)
    return m.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP3_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where item_id is not null),
g as (
  select distinct item, k, array_to_string(ws[i:i + k - 1], ' ') as gram
  from (select item, ws, least(13, len(ws)) as k, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
d as (
  select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as gram
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select distinct k from g) where len(ws) >= k)),
h as (select d.doc_id, d.i, d.k, g.item from d join g on d.k = g.k and d.gram = g.gram),
p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + k)) as pos from (select distinct doc_id, i, k from h)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join p using (doc_id) left join t using (doc_id)"""


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chunks, n_repeated, deleted_bytes, sources, text for every document."""
    found = substrings.deduplicate(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chunks", "n_repeated", "deleted_bytes", "sources", "text")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: five rows for each query."""
    return topk.search(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP6_SQL = """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.row, q.vec_id as query_id, x.vec_id, cast(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])), 0) as bigint) as score
  from v q join v x on q.row <> x.row and len(q.v) = len(x.v) where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s) where rank <= 5"""


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, partners, text for every document."""
    found = linededup.deduplicate(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", "partners", "text")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return neardup.groups(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


def neardup_sql(table: str, k: int) -> str:
    """Exact groups: shared shingles are counted for every pair, and labels spread along links."""
    return rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from {table}),
s as (
  select distinct doc_id, hash(array_to_string(ws[i:i + {k - 1}], ' ')) as sh
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 1}, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
r as (select doc_id as a, doc_id as b from w union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id, w.doc_id = m.component_id as kept
from w left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by a) m using (doc_id)"""


def tokenizer_files() -> dict[str, str]:
    """The public byte-level vocabulary, as a file of the tokenizer and as ranks, and the split pattern."""
    import public_tokenizers

    return {"tokenizer_json": public_tokenizers.path("byte_bpe_50k.json"), "ranks_file": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), **tokenizer_files())


QUERIES = {"op1_quality": op1_quality, "op2_html": op2_html, "op3_decontaminate": op3_decontaminate, "op4_language": op4_language, "op5_substrings": op5_substrings, "op6_topk": op6_topk, "op7_neardup": op7_neardup, "op8_pack": op8_pack, "op9_lines": op9_lines, "op10_pii": op10_pii}
SQL: dict[str, str] = {"op6_topk": OP6_SQL, "op7_neardup": neardup_sql("documents", 4), "op3_decontaminate": OP3_SQL}
