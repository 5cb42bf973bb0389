"""Main text of web pages by a suffix array over the pages of each host.

A page becomes a sequence of blocks, and its blocks' sentences the tokens of a stream. The streams of a host's pages,
end to end, have a suffix array; it is held as a table of runs, sorted and grouped by host: of every suffix the shortest
run of sentences with `least_words` words or more, and the same backwards, so that suffixes which begin (or prefixes
which end) alike stand together. A run on distinct pages is repeated, and frequent if it stands on at least `frequent`
of the host's pages and four of them; a sentence is covered if it lies in such a run.

Three voices decide about a block. Elements, roles and class names of menus, headers, footers, sidebars, notices,
adverts, forms and comments exclude it, as the task asks. An article or main element speaks for it, all that are links
speaks against it. The suffix array removes covered sentences: repeated ones outside of articles, frequent ones inside
(a passage that a few articles share belongs to them). A page that would lose half of its article or more is a copy
of others rather than boilerplate, and keeps it. So the result is

- on pages with an article or main element, their unexcluded blocks less frequent sentences (short articles of links
  beside a longer one are teasers; an article in an excluded element counts if there is no other),
- on other pages the unexcluded blocks that are not links, less repeated sentences (or, if nothing is left, with them).

Only hashes of runs are shuffled, dealt by host and run, so no task holds a host; html is read twice, and joined with a
page's repeated runs, which are sent to all tasks if they are few enough.

Defined cases: null html is empty; a null or unreadable url is a host of its own without boilerplate; unclosed and
truncated markup ends with the page; script and style text is never read; rows that repeat an id are one page for the
test of distinct pages, and each gives its row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

#: Bytes of repeated runs, or rows of hosts, that are sent to all tasks; beyond, both sides are shuffled.
MOST_SENT, MOST_HOSTS = 32 << 20, 200_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</?[A-Za-z][^<]*\Z", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
EXCLUDED = frozenset("nav footer aside form button select dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent "
    "notice notices gdpr popup modal comment comments commentlist disqus reply replies respond share sharing social related newsletter subscribe subscription signup login toolbar widget pager pagination".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
SENTENCE = re.compile(r"(?<=[.!?]) ")

Block = tuple[str, bool, int, bool]  # text, excluded, number of its article or 0, all links


def telling(names: set[str]) -> bool:
    """Whether a class name or id is made of telling words only (so neither `related-work` nor `page-header`)."""
    return any(n in WORDS or (parts := re.split(r"[_-]+", n)) and all(p in WORDS for p in parts) for n in names)


def blocks_of(html: str) -> list[Block]:
    """The page's blocks, in order, white space folded and character references decoded."""
    out: list[Block] = []
    words: list[str] = []
    skip: tuple[str, int, bool] | None = None  # element, its depth, whether it holds comments
    sure = article = 0
    links = linked = 0  # open links; characters inside of links

    def close() -> None:
        nonlocal linked
        raw = "".join(words)
        t = " ".join(unescape(raw).split())
        if t:
            out.append((t, skip is not None, article if sure else 0, linked >= 0.9 * (len(raw) - raw.count(" ") - raw.count("\n"))))
        words.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        words.append(part)
        if links:
            linked += len(part) - part.count(" ") - part.count("\n")

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            words.append(" ")
            continue
        if name == "a":
            links = max(0, links + (-1 if m[2] else 1))
        if name not in BLOCK and name not in EXCLUDED and "=" not in m[4]:
            continue
        closing = bool(m[2])
        attributes = {} if closing or "=" not in m[4] else {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(m[4])}
        names = {w for k in ("class", "id") for w in attributes.get(k, "").split()}
        comments = bool(names & COMMENTS)
        begins = not closing and name not in VOID and name not in ("body", "html", "article", "main") and bool(name in EXCLUDED or (name == "header" and not sure) or attributes.get("role") in ROLES or telling(names))
        begins |= not closing and name == "article" and comments
        if name in BLOCK or begins or (closing and skip and name == skip[0]):
            close()
            links = 0 if name in BLOCK and name not in ("div", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6") else links
        if skip:
            if closing and name == skip[0]:
                skip = (skip[0], skip[1] - 1, skip[2]) if skip[1] > 1 else None
            elif not closing and name == skip[0] and name not in ("p", "li"):
                skip = (skip[0], skip[1] + 1, skip[2])
            elif not closing and skip[0] == "p" and name in BLOCK:
                skip = (name, 1, comments) if begins else None
        elif begins:
            skip = (name, 1, comments)
        if name in ("article", "main") and not (skip and skip[2]):
            article += not closing and not sure
            sure = max(0, sure + (-1 if closing else 1))
    if at < len(html):
        add(html[at:])
    close()
    return out


def chosen(blocks: list[Block]) -> tuple[list[tuple[str, bool]], list[Block]]:
    """((text, in an article) of the blocks that structure leaves, the blocks to fall back on)."""
    open_ = [b for b in blocks if not b[1]]
    sure = [b for b in open_ if b[2]] or [b for b in blocks if b[2]]
    if sure:
        size: dict[int, int] = {}
        link: dict[int, int] = {}
        for t, _, a, linked in sure:
            size[a] = size.get(a, 0) + t.count(" ") + 1
            link[a] = link.get(a, 0) + (t.count(" ") + 1) * linked
        longest = max(size.values())
        teaser = {a for a, n in size.items() if 4 * n < longest and (n < 25 or 5 * link[a] >= n)}
        return [(t, True) for t, _, a, _ in sure if a not in teaser], sure
    plain = [b for b in open_ if not b[3]]
    return [(b[0], False) for b in plain or open_], open_


def run_hashes(sentences: list[str], least: int) -> list[tuple[int, int, int]]:
    """(first, last, hash) of the shortest runs of sentences that have `least` words, from every sentence on and up to every sentence."""
    size = [s.count(" ") + 1 for s in sentences]
    each = [xxhash.xxh3_64_digest(s.encode("utf-8", "surrogatepass")) for s in sentences]
    runs: set[tuple[int, int]] = set()
    end = total = 0
    for i, n in enumerate(size):
        while end < len(size) and total < least:
            total += size[end]
            end += 1
        if total < least:
            break
        runs.add((i, end - 1))
        total -= n
    begin, total = len(size), 0
    for j in range(len(size) - 1, -1, -1):
        while begin > 0 and total < least:
            begin -= 1
            total += size[begin]
        if total < least:
            break
        runs.add((begin, j))
        total -= size[j]
    return [(i, j, xxhash.xxh3_64_intdigest(b"".join(each[i : j + 1])) - (1 << 63)) for i, j in sorted(runs)]


def main_text(blocks: list[Block], least: int, repeated: set[int] = frozenset(), frequent: set[int] = frozenset()) -> str:
    """The text of a page, given its runs that are repeated, and frequent, on its host."""
    kept, fallback = chosen(blocks)
    if not repeated:
        return "\n\n".join(t for t, _ in kept)
    parts = [(b, s) for b, (t, _) in enumerate(kept) for s in SENTENCE.split(t)]
    sure = bool(kept) and kept[0][1]
    wanted = frequent if sure else repeated
    gone = [False] * len(parts)
    for i, j, h in run_hashes([s for _, s in parts], least):
        if h in wanted:
            gone[i : j + 1] = [True] * (j + 1 - i)
    words = [s.count(" ") + 1 for _, s in parts]
    if sure and 2 * sum(n for n, g in zip(words, gone, strict=True) if g) >= sum(words):
        return "\n\n".join(t for t, _ in kept)
    left: dict[int, list[str]] = {}
    for (b, s), g in zip(parts, gone, strict=True):
        if not g:
            left.setdefault(b, []).append(s)
    return "\n\n".join(" ".join(x) for x in left.values()) or "\n\n".join(b[0] for b in fallback)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_words: int = 12, frequent: float = 0.25) -> DataFrame:
    """page_id, url, text for every page."""
    kind = pages.schema[id_col].dataType
    host = F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.coalesce(host, F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.when(host != "", F.xxhash64(host)).alias("host"), F.col(html_col).alias("html"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = []
                for h in part.column("html").to_pylist():
                    kept = chosen(blocks_of(h))[0] if h else []
                    found.append(sorted({x for _, _, x in run_hashes([s for t, _ in kept for s in SENTENCE.split(t)], least_words)}))
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column("host").take(at), part.column("id").take(at), pa.array([x for f in found for x in f], pa.int64())], names=["host", "id", "run"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = zip(*(part.column(c).to_pylist() for c in ("html", "runs", "often")), strict=True)
                texts = [main_text(blocks_of(h), least_words, set(r or ()), set(o or ())) if h else "" for h, r, o in rows]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    each = base.where("host is not null and id is not null").select("host", "id", "html").mapInArrow(runs, T.StructType([T.StructField("host", T.LongType()), T.StructField("id", kind), T.StructField("run", T.LongType())]))
    each = store.written(each, "runs")
    several = each.groupBy("host", "run").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").select("host", "run", "n")
    several = store.written(several, "repeated")
    totals = base.where("host is not null").groupBy("host").agg(F.count("*").alias("pages"))
    hosts = several.where("n >= 4").select("host").distinct()
    few = hosts.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS
    totals = totals.join(F.broadcast(hosts), "host", "left_semi") if few else totals
    several = several.join(F.broadcast(totals) if few else totals, "host", "left").select("host", "run", F.coalesce((F.col("n") >= 4) & (F.col("n") >= frequent * F.col("pages")), F.lit(False)).alias("often"))
    several = F.broadcast(several) if 24 * several.limit(MOST_SENT // 24 + 1).count() <= MOST_SENT else several
    marks = each.join(several, ["host", "run"]).groupBy("host", "id").agg(F.collect_set("run").alias("runs"), F.collect_set(F.when(F.col("often"), F.col("run"))).alias("often"))
    marks = store.written(marks.select(F.col("host").alias("__host"), F.col("id").alias("__id"), "runs", "often"), "marks")
    size = marks.select(F.sum(32 + 8 * (F.size("runs") + F.size("often")))).first()[0] or 0
    marked = base.join(F.broadcast(marks) if size <= MOST_SENT else marks, (F.col("host") == F.col("__host")) & (F.col("id") == F.col("__id")), "left").select("id", "url", "html", "runs", "often")
    return marked.mapInArrow(clean, T.StructType([T.StructField("page_id", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]))
