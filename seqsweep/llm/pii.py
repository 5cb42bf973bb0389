"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Base spans are found by fixed patterns and their checks and always stay. Beside them, looser generators propose
candidates of each kind, which may overlap: numbers in national formats or with unusual separators, addresses with a
spelled "at" or bracketed dots, addresses of version 6, and long runs of letters and digits as secrets, a kind that has
no base pattern. A candidate's features describe its format (digits, marks, groups, length, mixture) and its context
(the characters around it, a telling word before it), but not what makes a span a base one. The corpus has no labels,
so three weak ones are learned, each by boosted trees over all candidates:

- format: whether the candidate lies in a base span of its kind (of secrets: has the public form of a well-known key);
- company: whether a base span stands within `reach` characters beside it. Personal data come together, so the share
  of candidates in company, less the share that chance gives (from the number of base spans and of characters), and
  relative to that share among known ones, estimates the share of true ones, also of kinds without a base pattern;
- told: whether a telling word (token, key, mail, phone ...) stands right before it, learned without that feature: what
  looks like what is mostly introduced so is added, with the word or without.

Candidates are counted by their binned features (a table of bounded size), each distinct string once, so that copies of
a document do not count as evidence, and apart in two folds by the string's hash. The trees are fitted to the counts and become SQL CASE expressions. Thresholds are calibrated on the fold that a model
has not seen: the lowest score at which the estimated share of true candidates is at least `precision`. Candidates at
or above one of the thresholds that touch no base span are added; of those that overlap, the one of highest score.

Defined cases: a null text is empty; spans count code points, the end exclusive; a match that fails its check is
dropped and not tried again; texts of any length are read whole; repeated rows are each measured; null ids are kept;
columns other than id and text are not read; without base spans of a kind, or in company, nothing is learned from that
label; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

KINDS = ("email", "ip", "card", "phone")

# Base patterns, rewritten where the plain form would recurse or backtrack without bound; they match the same spans.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]*[ ().0-9-][0-9]",
}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"  # of one digit or more, as the pattern asks
CHECK = {
    "email": "true",
    "ip": rf"m rlike r'^{PART}(?:\.{PART}){{3}}$'",
    "card": "length(regexp_replace(m, '[^0-9]', '')) between 16 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 8 and 15",
}
#: A quick test that rules most texts out.
NEEDS = {"email": "contains(t, '@')", "ip": "t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9]'", "phone": "contains(t, '+')"}

ALL_KINDS = (*KINDS, "secret")
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}+){1,4}+| at [A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}+){1,4}+)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}+(?![0-9.])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){4,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[ ._/-]{1,3}+[0-9]{2,6}+){2,4}+(?![0-9])|(?<![0-9])[0-9]{13,19}+(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9]{2,4}+\)?[ ./-]{1,2}[0-9]{2,4}+[ ./-]{1,2}[0-9]{3,4}+(?:[ ./-]{1,2}[0-9]{2,4}+)?(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,200}+={0,2}",
}
#: Public forms of keys, for which the secrets' format is learned as that of the other kinds is from base spans.
KEYS = "^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z_-]{20,})$"
LOOSE_CHECK = {"card": "length(regexp_replace(m, '[^0-9]', '')) between 13 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))"}
LOOSE_NEEDS = {"email": "(contains(t, '@') or contains(t, '(at)') or contains(t, '[at]') or contains(t, ' at ') and contains(t, 'dot'))", "ip": "t rlike '[0-9]'", "card": "t rlike '[0-9]'", "phone": "t rlike '[0-9]'", "secret": "t <> ''"}
TOLD = {"email": "(?i)mail|contact", "ip": "(?i)ip|host|addr", "card": "(?i)card|visa|pay", "phone": "(?i)tel|phone|call|mobile|fax|[+][0-9]", "secret": "(?i)token|key|secret|passw|auth|bearer|credential"}

#: No pattern above matches in a text without one of these.
ANY = "(text rlike '[0-9@]|[A-Za-z_+/-]{16}' or contains(text, '(at)') or contains(text, '[at]') or contains(text, ' dot ') or contains(text, '(dot)') or contains(text, '[dot]'))"

SPANS = "array<struct<s:int,e:int,m:string>>"


def spans_sql(pattern: str, needs: str, check: str = "true") -> str:
    """Spans of the matches in column t that pass the check: between the pieces that splitting leaves stand the matches."""
    step = (
        "case when x.m is null then acc else named_struct('at', acc.at + x.g + length(x.m), 'out', concat(acc.out, "
        "array(named_struct('s', acc.at + x.g, 'e', acc.at + x.g + length(x.m), 'm', x.m)))) end"
    )
    zipped = f"zip_with(split(t, r'{pattern}', -1), regexp_extract_all(t, r'{pattern}', 0), (p, m) -> named_struct('g', length(p), 'm', m))"
    folded = f"aggregate({zipped}, named_struct('at', 0, 'out', cast(array() as {SPANS})), (acc, x) -> {step}, acc -> acc.out)"
    kept = folded if check == "true" else f"filter({folded}, y -> {check.replace('m rlike', 'y.m rlike').replace('(m,', '(y.m,')})"
    return f"case when {needs} then {kept} else cast(array() as {SPANS}) end"


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, t (the text where it can hold a candidate of any kind, else empty) and a column of spans for each kind."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumn("t", F.expr(f"case when {ANY} then text else '' end"))
    return out.select("doc_id", "text", "t", *[F.expr(spans_sql(BASE[k], NEEDS[k], CHECK[k])).alias(k) for k in KINDS])


FEATURES = ("digits", "marks", "tail", "size", "mixed", "bracket", "before", "after", "told")


def candidates(spans: DataFrame, reach: int) -> DataFrame:
    """spans with a column of candidates: kind, place, features, whether it lies in a base span of its kind (known), touches none (free) and has one beside it (company)."""
    around = "substring(t, greatest(y.s - 15, 1), least(y.s, 16))"
    place = "case when {c} = '' then 0 when {c} rlike '\\\\s' then 1 when {c} rlike '[A-Za-z0-9]' then 2 else 3 end"
    parts = []
    for k in ALL_KINDS:
        inside = f"exists({k}, b -> b.s <= y.s and y.e <= b.e)" if k in KINDS else f"y.m rlike '{KEYS}'"
        free = " and ".join(f"not exists({o}, b -> b.s < y.e and y.s < b.e)" for o in KINDS)
        company = " or ".join(f"exists({o}, b -> b.e <= y.s and b.e > y.s - {reach} or b.s >= y.e and b.s < y.e + {reach})" for o in KINDS)
        parts.append(f"""transform({spans_sql(LOOSE[k], LOOSE_NEEDS[k], LOOSE_CHECK.get(k, "true"))}, y -> named_struct('kind', '{k}', 's', y.s, 'e', y.e,
          'digits', least(length(regexp_replace(y.m, '[^0-9]', '')), 20), 'marks', least(length(regexp_replace(y.m, '[A-Za-z0-9]', '')), 8),
          'tail', least(length(regexp_extract(y.m, '[A-Za-z0-9]*$', 0)), 6), 'size', cast(least(floor(2 * log2(length(y.m))), 14) as int),
          'mixed', cast(y.m rlike '[0-9]' as int) + 2 * cast(y.m rlike '[a-z]' as int) + 4 * cast(y.m rlike '[A-Z]' as int), 'bracket', cast(y.m rlike '[(\\\\[]' as int),
          'before', {place.format(c="substring(t, y.s, cast(y.s > 0 as int))")}, 'after', {place.format(c="substring(t, y.e + 1, 1)")},
          'hash', xxhash64(y.m), 'told', cast({around} rlike '{TOLD[k]}' as int), 'known', {inside}, 'free', {free}, 'company', {company}))""")
    return spans.withColumn("candidates", F.expr(f"concat({', '.join(parts)})"))


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray, *, rounds: int = 16, depth: int = 3, rate: float = 0.4, least: int = 5) -> list:
    """Boosted trees on counted cells (features, with and without the label) under the log loss; a tree is nested (feature, bound, low, high).

    Either side of a split has `least` candidates or more.
    """
    base = math.log((yes.sum() + 0.5) / (no.sum() + 0.5))
    score = np.full(len(x), base)
    trees: list = [base]
    weight = yes + no

    def grow(rows: np.ndarray, left: int):
        g, h = slope[rows].sum(), curve[rows].sum()
        best = None
        for f in range(x.shape[1]) if left else ():
            v = x[rows, f]
            lg = np.cumsum(np.bincount(v, slope[rows]))[:-1]
            lh = np.cumsum(np.bincount(v, curve[rows]))[:-1]
            if not len(lg):
                continue
            n = np.cumsum(np.bincount(v, weight[rows]))
            gain = np.where((n[:-1] >= least) & (n[-1] - n[:-1] >= least), lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1), 0)
            i = int(gain.argmax())
            if best is None or gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), f, i + 1)
        if best is None or best[0] <= g * g / (h + 1) + 1e-6:
            return float(np.clip(rate * g / (h + 1), -4, 4))
        _, f, bound = best
        return (f, bound, grow(rows[x[rows, f] < bound], left - 1), grow(rows[x[rows, f] >= bound], left - 1))

    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = yes - (yes + no) * chance, (yes + no) * chance * (1 - chance)
        tree = grow(np.arange(len(x)), depth)
        trees.append(tree)
        score += values(tree, x)
    return trees


def values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = values(tree[2], x[low]), values(tree[3], x[~low])
    return out


def tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.9f}D"
    return f"case when c.{FEATURES[tree[0]]} < {tree[1]} then {tree_sql(tree[2])} else {tree_sql(tree[3])} end"


def calibrated(x: np.ndarray, yes: np.ndarray, total: np.ndarray, share, precision: float, least: int = 5) -> tuple[list, float] | None:
    """Trees and threshold for one label, from counts (fold, cell); share turns counts (with the label, all) into the estimated share of true ones.

    Every cell is scored by the trees of the other fold. Down from the highest score, candidates are taken in groups of equal
    scores, of `least` or more, as long as each group's share is at least precision; the threshold is the last one's score.
    """
    if yes.sum() < 8:
        return None
    ranked = []
    for fold in (0, 1):
        trees = boost(x, yes[1 - fold], (total - yes)[1 - fold])
        score = sum(values(t, x) for t in trees)
        ranked += [(float(s), float(p), float(n)) for s, p, n in zip(score, yes[fold], total[fold], strict=True) if n]
    ranked.sort(reverse=True)
    threshold, good, every = math.inf, 0.0, 0.0
    for i, (s, p, n) in enumerate(ranked):
        good, every = good + p, every + n
        if every >= least and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
            if share(good, every) < precision:
                break
            threshold, good, every = s, 0.0, 0.0
    if threshold == math.inf:
        return None
    return boost(x, yes.sum(0), (total - yes).sum(0)), threshold - 1e-6


def train(proposed: DataFrame, precision: float, reach: int) -> dict[tuple[str, str], tuple[list, float]]:
    """Trees and threshold by kind and label, where there is enough to learn from."""
    # explode() would have its emptiness test pushed below all projections, which would evaluate them once more each
    rows = proposed.select(F.explode_outer("candidates").alias("c")).where("c.kind is not null")
    marks = ["c.kind", *[f"c.{f}" for f in FEATURES]]
    strings = rows.groupBy(*marks, "c.hash").agg(F.avg(F.expr("cast(c.known as int)")).alias("known"), F.avg(F.expr("cast(c.company as int)")).alias("company"), F.avg(F.expr("cast(c.known and c.company as int)")).alias("both"))
    counted = strings.groupBy(F.pmod("hash", F.lit(2)).alias("fold"), "kind", *FEATURES).agg(F.count("*").alias("n"), F.sum("known").alias("known"), F.sum("company").alias("company"), F.sum("both").alias("both"))
    cells: dict[str, dict] = {k: {} for k in ALL_KINDS}
    for r in counted.collect():  # at most the product of the bins
        mine = cells[r["kind"]].setdefault(tuple(r[f] for f in FEATURES), np.zeros((2, 4)))
        mine[r["fold"]] += (r["n"], r["known"], r["company"], r["both"])
    every = sum((c for k in KINDS for c in cells[k].values()), np.zeros((2, 4))).sum(0)
    total = proposed.select(F.sum("size").alias("chars"), F.sum(F.expr(" + ".join(f"size({k})" for k in KINDS))).alias("spans")).first()
    chance = 1 - math.exp(-2 * reach * (total["spans"] or 0) / max(total["chars"] or 0, 1))
    known = every[3] / every[1] if every[1] else 0.0
    models = {}
    for k, mine in cells.items():
        if not mine:
            continue
        keys = sorted(mine)
        x, counts = np.array(keys, np.int64), np.stack([mine[c] for c in keys], 1)
        got = calibrated(x, counts[:, :, 1], counts[:, :, 0], lambda p, n: p / n, precision)
        if got:
            models[k, "format"] = got
        word = FEATURES.index("told")
        blind = np.where(np.arange(len(FEATURES)) == word, 0, x)
        got = calibrated(blind, counts[:, :, 0] * x[:, word], counts[:, :, 0], lambda p, n: p / n, precision)
        if got:
            models[k, "told"] = got
        if every[1] >= 16 and known > chance + 0.1:
            got = calibrated(x, counts[:, :, 2], counts[:, :, 0], lambda p, n: (p / n - chance) / (known - chance), precision)
            if got:
                models[k, "company"] = got
    return models


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.7, reach: int = 1000, with_text: bool = True) -> DataFrame:
    """doc_id, base spans of each kind, and added: kind, s, e, score of the spans that the trees add; with text and t unless with_text is off.

    Without the text the spans are written once and the patterns run once; with it they run again.
    """
    proposed = candidates(base_spans(docs, id_col, text_col), reach).withColumn("size", F.length("text").cast("long"))
    if not with_text:
        proposed = store.written(proposed.drop("text", "t"), "candidates")
    models = train(proposed, precision, reach)
    over = "array(" + (", ".join(f"case when c.kind = '{k}' then {' + '.join(tree_sql(t) for t in trees)} - {b:.9f}D end" for (k, _), (trees, b) in models.items()) or "cast(null as double)") + ")"
    scored = f"transform(filter(candidates, c -> c.free), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'score', coalesce(array_max({over}), -1D)))"
    able = f"filter({scored}, z -> z.score >= 0)"
    out = proposed.withColumn("able", F.expr(able))
    added = "filter(able, z -> not exists(able, o -> o.s < z.e and z.s < o.e and (o.score > z.score or o.score = z.score and (o.s < z.s or o.s = z.s and (o.e > z.e or o.e = z.e and o.kind < z.kind)))))"
    return out.select("doc_id", *(("text", "t") if with_text else ()), *KINDS, F.expr(added).alias("added"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets, overlapping spans as one."""
    found = find(docs, **options)
    every = "concat(" + ", ".join(f"transform({k}, y -> named_struct('s', y.s, 'e', y.e, 'kind', '{k}'))" for k in KINDS) + ", transform(added, y -> named_struct('s', y.s, 'e', y.e, 'kind', y.kind)))"
    step = "case when y.s < acc.at then named_struct('at', greatest(acc.at, y.e), 'out', acc.out) else named_struct('at', y.e, 'out', concat(acc.out, substring(text, acc.at + 1, y.s - acc.at), '[', y.kind, ']')) end"
    text = f"aggregate(array_sort({every}), named_struct('at', 0, 'out', ''), (acc, y) -> {step}, acc -> concat(acc.out, substring(text, acc.at + 1)))"
    return found.select("doc_id", F.expr(text).alias("text"))


def listed(base: bool) -> str:
    """SQL for kind:start:end, comma-joined, by kind as listed and then start."""
    parts = []
    for k in KINDS if base else ALL_KINDS:
        mine = f"transform({k}, y -> named_struct('s', y.s, 'e', y.e))" if k in KINDS else "cast(array() as array<struct<s:int,e:int>>)"
        if not base:
            mine = f"array_sort(concat({mine}, transform(filter(added, z -> z.kind = '{k}'), y -> named_struct('s', y.s, 'e', y.e))))"
        parts.append(f"transform({mine}, y -> concat('{k}:', y.s, ':', y.e))")
    return f"array_join(concat({', '.join(parts)}), ',')"
