"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; for each bit a linear classifier over hashed byte trigrams predicts it from
the whole text, and the language whose codeword has the least weighted loss wins. The weights are the bits' measured
reliability on the training rows. The score is the softmax of the negative losses; `ambiguous` marks texts whose two
nearest codewords are closer than a margin. Training takes a bounded sample: `per_class` rows of each language, fewer
where that would be more than `most_rows` in all, of texts of at most `most_chars` characters. Every language of the
rows is learned; more than `most_langs` are an error.

Defined cases: null texts and texts without a letter are `und` with score 0; texts of any length are read whole;
repeated rows get the same answer; of a repeated id the text that is smallest in order is learned; columns named like an output are replaced; an empty table gives an empty result;
with a single language to learn every text with a letter gets it; with none, all are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import samples, text

BUCKETS = 1 << 13
SEGMENT = 1 << 20  # bytes of a long text that are read at once
LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n codewords of -1/+1 bits, chosen among random ones so that the least distance is large."""
    bits = max(15, 4 * int(np.ceil(np.log2(max(n, 2)))) + 7)
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        balanced = n == 1 or (np.abs(code.sum(0)) < n).all()
        if balanced and apart.min() > far:
            best, far = code, apart.min()
    return best if best is not None else code


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every byte trigram, first and number of each row's trigrams); letters are lower-cased, other ASCII is a space."""
    folded = data.copy()
    upper = (data >= 65) & (data <= 90)
    folded[upper] += 32
    if len(data) > 1:
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
        folded[lead + 1] += 32
    folded[(folded < 97) | ((folded > 122) & (folded < 128))] = 32
    sizes = np.diff(offsets)
    room = sizes + 3
    at = np.cumsum(room) - room + 1
    flat = np.full(int(room.sum()) + 2, 32, np.uint32)
    for to, a, n in zip(at.tolist(), offsets[:-1].tolist(), sizes.tolist(), strict=True):
        flat[to : to + n] = folded[a : a + n]
    h = flat[:-2] * np.uint32(0x01000193) + flat[1:-1] * np.uint32(0x9E3779B1) + flat[2:] * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(19)
    blank = (flat[:-2] == 32) & (flat[1:-1] == 32)
    h[blank] = BUCKETS  # a row of zeros
    return h, at - 1, sizes


def seen_grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """How often each bucket occurs in each row; a long row goes through in segments, which read two bytes more to both sides."""
    if len(offsets) == 2 and len(data) > 2 * SEGMENT:
        total = np.zeros(BUCKETS + 1, np.int64)
        for a in range(0, len(data), SEGMENT):
            begin, size = max(a - 2, 0), min(SEGMENT, len(data) - a)
            part = data[begin : a + size + 2]
            h, first, _ = grams(part, np.array([0, len(part)]))
            total += np.bincount(h[first[0] + a - begin : first[0] + a - begin + size], minlength=BUCKETS + 1)
        yield total
        return
    h, first, n = grams(data, offsets)
    for a, c in zip(first.tolist(), n.tolist(), strict=True):
        yield np.bincount(h[a : a + c], minlength=BUCKETS + 1)


def features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        c = next(seen_grams(*text.text_bytes(pa.array([t], pa.large_string()))))[:BUCKETS]
        out[i] = c / max(c.sum(), 1)
    return out


def fit(texts: list[str], langs: list[str], *, rounds: int = 150, rate: float = 0.05) -> dict:
    names = sorted(set(langs))
    code = codewords(len(names))
    x = features(texts)
    scale = 1 / (np.sqrt((x * x).mean(0)) + 1e-3)
    x *= scale
    which = np.searchsorted(names, langs)
    target = ((code[which] + 1) / 2).astype(np.float32)
    balance = (len(which) / np.bincount(which, minlength=len(names)))[which].astype(np.float32)
    balance /= balance.sum()
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target) * balance[:, None]
        g = x.T @ d + 1e-6 * w
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        w -= rate * (1 - step / (rounds + 1)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * d.sum(0)
    right = ((x @ w + b > 0) == (target > 0.5)).mean(0)
    weight = np.log((right + 1e-3) / (1 - right + 1e-3)).clip(0.05, None)
    table = np.concatenate([w * scale[:, None], np.zeros((1, w.shape[1]), np.float32)]).astype(np.float32)
    return {"names": names, "code": code, "table": table, "bias": b, "weight": weight / weight.sum()}


def predict(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score, ambiguous) of each row."""
    z = np.zeros((len(offsets) - 1, model["table"].shape[1]), np.float32)
    for i, seen in enumerate(seen_grams(data, offsets)):
        at = np.flatnonzero(seen[:BUCKETS])
        if len(at):
            z[i] = (seen[at] / seen[at].sum()).astype(np.float32) @ model["table"][at]
    z = np.clip(z + model["bias"], -8, 8)
    loss = np.stack([(np.log1p(np.exp(-z * row)) * model["weight"]).sum(1) for row in model["code"]], 1)
    order = np.sort(loss, 1)
    p = np.exp(-6 * (loss - order[:, :1]))
    p /= p.sum(1, keepdims=True)
    close = order[:, 1] - order[:, 0] < 0.1 if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return loss.argmin(1), p.max(1).astype(np.float64), close


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 350, most_rows: int = 8192, most_chars: int = 1 << 17, most_langs: int = 512) -> dict | None:
    """Fits the bit classifiers on at most per_class rows of each language; docs holds only rows to learn from."""
    docs = docs.where((F.length(text_col) <= most_chars) & F.col(text_col).rlike(r"\p{L}"))
    chosen = samples.by_class(docs, id_col, lang_col, per_class, most_langs)
    each = max(1, min(per_class, most_rows // max(len({v for _, v in chosen}), 1)))
    chosen = [x for _, g in groupby(chosen, key=lambda x: x[1]) for x in islice(g, each)]
    texts = samples.texts_of(docs, id_col, text_col, [k for k, _ in chosen])
    rows = [(texts[k], v) for k, v in chosen if k in texts]
    return fit([t for t, _ in rows], [v for _, v in rows]) if rows else None


def identify(docs: DataFrame, model: dict | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous; all other columns stay."""
    out = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    kept = [c for c in docs.columns if c not in {f.name for f in out}]
    schema = T.StructType([docs.schema[c] for c in kept] + out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, text_col):
                column = part.column(text_col)
                lettered = np.array([bool(t and LETTER.search(t)) for t in column.to_pylist()], bool)
                if model is None:
                    lettered[:] = False
                    which, p, close = np.zeros(len(lettered), int), np.zeros(len(lettered)), lettered
                else:
                    which, p, close = predict(model, *text.text_bytes(column))
                names = [model["names"][i] if ok else "und" for i, ok in zip(which, lettered, strict=True)]
                arrays = [pa.array(names, pa.string()), pa.array(np.where(lettered, p, 0.0)), pa.array(close & lettered)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)
