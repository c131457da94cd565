"""A quality classifier: a byte-level convolutional network in numpy.

Input planes: the byte itself, and how often the byte's word repeats the word before it (0, 1, 2 or
more).  Learned filters with near and far taps slide over every byte of the whole text; their
responses are max-pooled over chunks of 512 bytes that overlap by half; a hidden layer reads each
chunk, and the means and maxima of its units over all chunks give one probability.

Since inputs are one-hot, a filter's tap is a table, and a response is a sum of looked-up rows.
Trained by backpropagation on at most ``per_class`` labelled texts a class, weighted to the classes'
true shares.  Null and empty texts are one chunk of padding and get a score as any other; an empty table
gives none.  With one class only, or none, the score is the (smoothed) share of good labels.
Rows are judged one by one, so repeated rows and rows without an id get their text's score; a score at the query's
threshold counts as 1.  A long text passes the filters in parts, so it costs two bytes a byte and its words'
hashes.  Other columns pass through ``score``, but for the text; quality_score replaces a column of this name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CODE, LONGEST_SAMPLE, NOT_BLANK, flat, in_small_batches, labelled_sample, share, slices, spans, word_hashes

HALF = 256
TAPS = (0, 1, 2, 3, 4, 12, 20, 28)
PLANES = 3
#: bytes of text that pass the filters at a time
PART = 1 << 18


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input symbols, each text padded to whole half chunks, and the texts' offsets in half chunks."""
    size = np.diff(off)
    halves = -(-(size + TAPS[-1]) // HALF)
    at = np.zeros(len(halves) + 1, np.int64)
    at[1:] = np.cumsum(halves)
    starts, ends, bounds = spans(data, off, NOT_BLANK)
    hashes = word_hashes(data, starts, ends, CODE)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[bounds[:-1][bounds[:-1] < len(same)]] = False
    more = same.copy()
    more[1:] &= same[:-1]
    level = same.astype(np.int8) + more
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, starts[same], level[same])
    np.add.at(step, ends[same], -level[same])
    x = np.zeros(int(at[-1]) * HALF + TAPS[-1], np.int16)
    symbol = np.cumsum(step[: len(data)], dtype=np.int16)
    symbol *= 256
    symbol += data
    for a, lo, n in zip((at[:-1] * HALF).tolist(), off[:-1].tolist(), size.tolist()):
        x[a : a + n] = symbol[lo : lo + n]
    return x, at


class Network:
    def __init__(self, filters: int = 16, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {"taps": f32(len(TAPS), 256 * PLANES, filters, by=0.15), "bias": np.zeros(filters, np.float32), "into": f32(filters, hidden, by=0.3), "hid": np.full(hidden, 0.1, np.float32), "out": f32(2 * hidden, by=0.3), "end": np.zeros(1, np.float32)}

    def responses(self, x: np.ndarray) -> np.ndarray:
        n, taps = len(x) - TAPS[-1], self.p["taps"]
        out = taps[0].take(x[:n], 0)
        for table, t in zip(taps[1:], TAPS[1:]):
            out += table.take(x[t : t + n], 0)
        return out

    def halves(self, x: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Responses of half chunks lo to hi; in a text's padding, where taps would reach the next text, there is none."""
        r = self.responses(x[lo * HALF : hi * HALF + TAPS[-1]])
        last = at[1:][(at[1:] > lo) & (at[1:] <= hi)] - lo
        r[(last[:, None] * HALF - np.arange(1, TAPS[-1] + 1)).ravel()] = -1e9
        return r.reshape(hi - lo, HALF, -1)

    def _chunks(self, pooled: np.ndarray, at: np.ndarray):
        """Per chunk: the first half's row; a text of one half is one chunk."""
        n = np.maximum(np.diff(at) - 1, 1)
        text = np.repeat(np.arange(len(n)), n)
        first = np.zeros(len(n) + 1, np.int64)
        first[1:] = np.cumsum(n)
        a = np.arange(first[-1]) - first[text] + at[text]
        b = np.minimum(a + 1, at[text + 1] - 1)
        return text, first, a, b

    def head(self, pooled: np.ndarray, at: np.ndarray) -> dict:
        p = self.p
        text, first, a, b = self._chunks(pooled, at)
        two = np.maximum(pooled[a], pooled[b])
        act = np.maximum(two + p["bias"], 0)
        hid = np.maximum(act @ p["into"] + p["hid"], 0)
        n = np.diff(first)[:, None]
        mean, top = np.add.reduceat(hid, first[:-1]) / n, np.maximum.reduceat(hid, first[:-1])
        both = np.concatenate([mean, top], 1)
        return {"text": text, "first": first, "a": a, "b": b, "act": act, "hid": hid, "both": both, "z": both @ p["out"] + p["end"][0], "n": n}

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, at = encode(data, off)
        pooled = []
        for lo in range(0, int(at[-1]), PART // HALF):
            hi = min(int(at[-1]), lo + PART // HALF)
            r = self.halves(x, at, lo, hi)
            while r.shape[1] > 1:
                half = r.shape[1] // 2
                r = np.maximum(r[:, :half], r[:, half:])
            pooled.append(r[:, 0])
        return 1 / (1 + np.exp(-np.clip(self.head(np.concatenate(pooled), at)["z"].astype(float), -30, 30)))

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        r = self.halves(x, at, 0, int(at[-1]))
        where = r.argmax(1)
        pooled = np.take_along_axis(r, where[:, None], 1)[:, 0]
        h = self.head(pooled, at)
        dz = (weight * (1 / (1 + np.exp(-h["z"])) - y) / len(y)).astype(np.float32)
        g = {"out": h["both"].T @ dz, "end": np.array([dz.sum()], np.float32)}
        width = h["hid"].shape[1]
        d_both = dz[:, None] * p["out"]
        d_hid = (d_both[:, :width] / h["n"])[h["text"]]
        best = h["hid"] == h["both"][:, width:][h["text"]]
        ties = np.add.reduceat(best.astype(np.float32), h["first"][:-1])
        d_hid = d_hid + best * (d_both[:, width:] / ties)[h["text"]]
        d_hid *= h["hid"] > 0
        g["into"], g["hid"] = h["act"].T @ d_hid, d_hid.sum(0)
        d_act = (d_hid @ p["into"].T) * (h["act"] > 0)
        g["bias"] = d_act.sum(0)
        d_pool = np.zeros_like(pooled)
        left = pooled[h["a"]] >= pooled[h["b"]]
        for f in range(pooled.shape[1]):
            d_pool[:, f] = np.bincount(np.where(left[:, f], h["a"], h["b"]), d_act[:, f], len(pooled))
        at_byte = where + (np.arange(len(pooled)) * HALF)[:, None]
        g["taps"] = np.zeros_like(p["taps"])
        for k, t in enumerate(TAPS):
            symbol = x[at_byte + t]
            for f in range(pooled.shape[1]):
                g["taps"][k, :, f] = np.bincount(symbol[:, f], d_pool[:, f], 256 * PLANES)
        return g

    def train(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        turn = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                ids, turn = order[lo : lo + batch], turn + 1
                off = np.zeros(len(ids) + 1, np.int64)
                off[1:] = np.cumsum([len(texts[i]) for i in ids])
                x, at = encode(np.frombuffer(b"".join(texts[i] for i in ids), np.uint8), off)
                g = self.gradients(x, at, y[ids], weight[ids])
                step = rate * (1 - epoch / epochs)
                for k, w in self.p.items():
                    d = g[k] + 1e-4 * w
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    w -= step * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.99**turn)) + 1e-8)
        return self


class QualityModel:
    def __init__(self, network: Network | None, share: float):
        self.network, self.share = network, share

    @classmethod
    def train(cls, rows: list[tuple[str, int]], counts: list[int], **parameters) -> QualityModel:
        y = np.array([v for _, v in rows], float)
        share = (counts[1] + 0.5) / (sum(counts) + 1)
        if not len(y) or y.min() == y.max():
            return cls(None, share)
        weight = np.array([counts[int(v)] / max(1, int((y == v).sum())) for v in y])
        return cls(Network().train([t.encode("utf-8", "surrogatepass") for t, _ in rows], y, weight / weight.mean(), **parameters), share)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.score(*flat(texts)) if len(texts) else np.zeros(0)


def learn(documents: DataFrame, labels: DataFrame, per_class: int = 1000, folds: int = 5, held_out: int = 0, longest: int = LONGEST_SAMPLE, **parameters) -> QualityModel:
    return QualityModel.train(*labelled_sample(documents, labels, "quality", held_out, folds, per_class, longest), **parameters)


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """``documents`` without text, with quality_score."""
    shared = share(documents.sparkSession, model)
    kept = documents.drop("quality_score")
    rest = [f for f in kept.schema.fields if f.name != "text"]
    names = [f.name for f in rest]

    def run(batches):
        model_ = shared()
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(model_.score(part.column("text")))], names=[*names, "quality_score"])

    return in_small_batches(kept).mapInArrow(run, T.StructType([*rest, T.StructField("quality_score", T.DoubleType())]))
