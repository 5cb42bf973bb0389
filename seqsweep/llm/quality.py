"""Quality classifier: a byte-level convolutional network in numpy.

Every byte becomes a small fixed vector (its class and a few hashed coordinates). Learned filters of 8 bytes, 4 bytes
apart, are averaged over chunks of 256 bytes that overlap by half and cover the whole document; a learned layer
combines the averages and their squares (a chunk that says the same again and again lies far from the usual average)
into a few responses for each chunk, which are max-pooled over the document and combined into one probability. All
layers are trained together, now and then on a random part of a text instead of the whole. Training takes a bounded sample of labelled rows: `per_class` of each label, those of
smallest hashed id, and of these the texts of at most `most_chars` characters. Scoring is one pass over the table
without a shuffle; a long text is read in segments, so a task holds the byte vectors of one segment only.

Defined cases: a null or empty text is scored as a document without chunks; texts of any length are read whole;
repeated rows get the same score; a repeated id with several texts is learned from with the text that is smallest in
order; a column named like an output column is replaced; an empty table gives an empty result; without labelled rows
of both classes the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import samples, text

STRIDE, BLOCK = 4, 32  # bytes from filter to filter; filters in half a chunk
BYTES = STRIDE * BLOCK
SEGMENT = 4096  # blocks whose byte vectors are held at once


def _byte_table() -> np.ndarray:
    b = np.arange(256)
    c = np.array([chr(i) for i in range(128)] + [""] * 128)
    flags = [
        (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), b == 32, (b == 10) | (b == 13) | (b == 9),
        np.isin(c, list("!?")), np.isin(c, list("|<>{}[]\\/=_")), np.isin(c, list("#$%&*@~^+")), np.isin(c, list(".,;:'\"()-")), b >= 128,
    ]
    hashed = np.random.default_rng(5).normal(0, 0.5, (256, 6))
    out = np.concatenate([np.stack(flags, 1).astype(np.float32), hashed.astype(np.float32)], 1)
    out[0] = 0
    return out


TABLE = _byte_table()
E = TABLE.shape[1]


class Layout:
    """Documents of a batch, each at the start of a block and apart by zero bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.blocks = np.where(sizes > 0, -(-(sizes + 2 * STRIDE) // BYTES), 0)
        self.first = np.cumsum(self.blocks) - self.blocks
        total = int(self.blocks.sum())
        self.padded = np.zeros(total * BYTES + 2 * STRIDE, np.uint8)
        for at, a, n in zip((self.first * BYTES).tolist(), offsets[:-1].tolist(), sizes.tolist(), strict=True):
            self.padded[at : at + n] = data[a : a + n]
        windows = -(-sizes // STRIDE)
        inside = np.arange(total) - np.repeat(self.first, self.blocks)
        self.count = np.clip(np.repeat(windows, self.blocks) - inside * BLOCK, 0, BLOCK)  # filters of each block that begin in the document
        pairs = np.maximum(self.blocks - 1, (self.blocks > 0).astype(np.int64))
        self.chunk_doc = np.repeat(np.arange(len(sizes)), pairs)
        at = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        self.left = np.repeat(self.first, pairs) + at
        self.right = np.where(np.repeat(self.blocks, pairs) > 1, self.left + 1, -1)
        self.size = (self.count[self.left] + np.where(self.right >= 0, self.count[self.right], 0)).astype(np.float32)

    def vectors(self, a: int, b: int) -> np.ndarray:
        """The byte vectors of blocks a to b, STRIDE bytes a row, and the row behind."""
        return TABLE[self.padded[a * BYTES : b * BYTES + STRIDE]].reshape(-1, STRIDE * E)

    def responses(self, a: int, b: int, model: dict, x: np.ndarray) -> np.ndarray:
        f = model["b"].shape[0]
        y = x @ model["w"]
        out = y[:-1, :f] + y[1:, f:] + model["b"]
        np.maximum(out, 0, out=out)
        out.reshape(b - a, BLOCK, f)[np.arange(BLOCK)[None, :] >= self.count[a:b, None]] = 0
        return out

    def sums(self, model: dict) -> np.ndarray:
        """The filters' responses, summed by block."""
        f, total = model["b"].shape[0], len(self.count)
        out = np.zeros((total, f), np.float32)
        for a in range(0, total, SEGMENT):
            b = min(a + SEGMENT, total)
            out[a:b] = self.responses(a, b, model, self.vectors(a, b)).reshape(b - a, BLOCK, f).sum(1)
        return out

    def means(self, sums: np.ndarray) -> np.ndarray:
        both = sums[self.left] + np.where((self.right >= 0)[:, None], sums[self.right], 0)
        return both / np.maximum(self.size, 1)[:, None]


def head(layout: Layout, means: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scaled averages, responses of the chunks, their maxima by document, logits)."""
    z = (means - model["mu"]) / model["sd"] * np.sqrt(layout.size / (2 * BLOCK))[:, None]
    u = np.maximum(np.concatenate([z, z * z], 1) @ model["w1"] + model["b1"], 0)
    top = np.zeros((len(layout.blocks), u.shape[1]), np.float32)
    docs, starts = np.unique(layout.chunk_doc, return_index=True)
    if len(docs):
        top[docs] = np.maximum.reduceat(u, starts, axis=0)
    return z, u, top, top @ model["w2"] + model["b2"]


def predict(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if "rate" in model:
        return np.full(len(offsets) - 1, model["rate"])
    layout = Layout(data, offsets)
    z = head(layout, layout.means(layout.sums(model)), model)[3]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64) + model["shift"], -40, 40)))


def fit(texts: list[str], labels: np.ndarray, *, filters: int = 24, hidden: int = 24, epochs: int = 10, least_steps: int = 300, crops: float = 0.25, batch: int = 32, rate: float = 4e-3, seed: int = 0) -> dict:
    """Trains all layers together with Adam on the log loss; few texts are gone through more often, for least_steps steps."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    m = {
        "w": rng.normal(0, 1 / np.sqrt(STRIDE * E), (STRIDE * E, 2 * filters)).astype(np.float32), "b": np.zeros(filters, np.float32),
        "w1": rng.normal(0, 1 / np.sqrt(4 * filters), (2 * filters, hidden)).astype(np.float32), "b1": np.zeros(hidden, np.float32),
        "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32), "b2": np.zeros((), np.float32),
    }
    m["w1"][filters:] /= 4
    keep = [i for i, t in enumerate(texts) if t]

    def laid(docs: list[int], crop: bool = False) -> Layout:
        return Layout(*text.text_bytes(pa.array([piece(texts[i]) if crop else texts[i] for i in docs], pa.large_string())))

    def piece(t: str) -> str:
        """Some texts are cut to a random part, as short texts are rare among labels."""
        n = int(rng.integers(20, 400))
        if rng.random() >= crops or len(t) <= n:
            return t
        at = int(rng.integers(0, len(t) - n))
        return t[at : at + n]

    some = [keep[i] for i in rng.permutation(len(keep))[:256]]
    start = np.concatenate([(g := laid(some[a : a + batch])).means(g.sums(m)) for a in range(0, len(some), batch)])
    m["mu"], m["sd"] = start.mean(0), start.std(0) + 0.02
    learned = ("w", "b", "w1", "b1", "w2", "b2")
    moment = {k: (np.zeros_like(m[k]), np.zeros_like(m[k])) for k in learned}
    each = -(-len(keep) // batch)
    epochs = max(epochs, -(-least_steps // max(each, 1)))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(keep))
        for a in range(0, len(order), batch):
            docs = [keep[i] for i in order[a : a + batch]]
            g = laid(docs, crop=True)
            total = len(g.count)
            x = g.vectors(0, total)
            r = g.responses(0, total, m, x)
            means = g.means(r.reshape(total, BLOCK, filters).sum(1))
            m["mu"] += 0.05 * (means.mean(0) - m["mu"])
            m["sd"] += 0.05 * (means.std(0) + 0.02 - m["sd"])
            z, u, top, logit = head(g, means, m)
            d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[docs]).astype(np.float32) / len(docs)
            grad = {"w2": top.T @ d, "b2": d.sum()}
            back = np.outer(d, m["w2"]) * (top > 0)
            du = np.where(u == top[g.chunk_doc], back[g.chunk_doc], 0)
            du /= np.maximum(np.add.reduceat(u == top[g.chunk_doc], np.unique(g.chunk_doc, return_index=True)[1], axis=0), 1)[g.chunk_doc]
            features = np.concatenate([z, z * z], 1)
            grad["w1"], grad["b1"] = features.T @ du, du.sum(0)
            df = du @ m["w1"].T
            dz = df[:, :filters] + 2 * z * df[:, filters:]
            ds = dz / m["sd"] * (np.sqrt(g.size / (2 * BLOCK)) / np.maximum(g.size, 1))[:, None]
            db = np.zeros((total + 1, filters), np.float32)
            np.add.at(db, g.left, ds)
            np.add.at(db, np.where(g.right >= 0, g.right, total), ds)
            dr = np.repeat(db[:total], BLOCK, axis=0) * (r > 0)
            grad["w"], grad["b"] = np.concatenate([x[:-1].T @ dr, x[1:].T @ dr], 1), dr.sum(0)
            step += 1
            lr = rate * (1 - 0.95 * step / steps)
            for k in learned:
                m1, m2 = moment[k]
                m1 += 0.1 * (grad[k] - m1)
                m2 += 0.01 * (grad[k] ** 2 - m2)
                m[k] = (m[k] - lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1200, most_chars: int = 1 << 17) -> dict:
    """Fits the network on at most per_class rows of each label, of texts of at most most_chars; labels holds only rows to learn from."""
    marks = labels.where(F.col(label_col).isin(0, 1))
    counts = {r[0]: r[1] for r in marks.groupBy(F.col(label_col)).count().collect()}
    if len(counts) < 2:
        return {"rate": float(max(counts, key=counts.get)) if counts else 0.5}
    chosen = samples.by_class(marks, id_col, label_col, per_class)
    texts = samples.texts_of(docs.where(F.length(text_col) <= most_chars), id_col, text_col, [k for k, _ in chosen])
    rows = [(texts[k], v) for k, v in chosen if k in texts]
    y = np.array([v for _, v in rows])
    if len(set(y.tolist())) < 2 or not any(t for t, _ in rows):
        return {"rate": counts[1] / (counts[0] + counts[1])}
    m = fit([t for t, _ in rows], y)
    m["shift"] = float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum()))
    return m


def score(docs: DataFrame, model: dict, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, the probability of label 1; all other columns stay."""
    kept = [c for c in docs.columns if c != score_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, text_col):
                got = predict(model, *text.text_bytes(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*kept, score_col])

    return docs.select(*kept).mapInArrow(run, schema)
