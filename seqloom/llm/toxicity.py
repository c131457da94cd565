"""Toxic spans by a linear-chain conditional random field; documents by what their words add up to.

Labels are of documents, so labelled tokens are found first: of the words of the labelled texts,
those that best explain toxic documents and hardly occur in clean ones, chosen one after another so
that each explains documents that none before it did (a rare word of a document that an insult
explains is never chosen).  Their occurrences in toxic documents are toxic tokens, all others clean.
The field learns words, affixes, n-grams and transitions from these tokens.  Marginals of
forward-backward give spans; their sum and maximum give the score, calibrated on the labelled texts.

Learned from at most ``per_class`` labelled rows a class.  Null and empty texts have no toxic token and get
the score of a text without evidence; an empty table gives none, and where one class or no label is known, all
texts get the (smoothed) share of toxic labels.  Rows are judged one by one, so repeated rows and rows without an id
get their text's score, and a score of exactly 0.5 counts as toxic.  Long texts are labelled in windows.  Other columns
pass through ``score``, but for the text; its own columns replace columns of the same names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import flat, in_small_batches, labelled_sample, share, slices
from .word_crf import Model, Words, fit, words_of

CLEAN, TOXIC = 0, 1


def explaining_words(hashes: list[np.ndarray], toxic: np.ndarray, least_docs: int = 3, purity: float = 0.9, most: int = 500) -> np.ndarray:
    """Hashes of the words chosen; ``hashes`` are each document's distinct words."""
    vocabulary, inverse = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
    doc = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    bad = np.bincount(inverse, toxic[doc], len(vocabulary))
    all_ = np.bincount(inverse, minlength=len(vocabulary))
    able = (bad >= least_docs) & (bad >= purity * all_)
    inside = able[inverse] & (toxic[doc] > 0)
    inverse, doc = inverse[inside], doc[inside]
    open_, out = np.ones(len(hashes), bool), []
    while len(out) < most:
        gain = np.bincount(inverse[open_[doc]], minlength=len(vocabulary))
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] < least_docs:
            break
        out.append(vocabulary[best])
        open_[doc[inverse == best]] = False
    # words as frequent as those chosen are as good, if they occur in toxic documents only
    if out:
        strong = np.median(bad[np.searchsorted(vocabulary, np.sort(np.array(out, np.uint64)))])
        out += [v for v, b, a, ok in zip(vocabulary, bad, all_, able) if ok and b >= max(10 * least_docs, strong) and a == b]
    return np.unique(np.array(out, np.uint64))


def gather(p: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the sum of marginals and the greatest one."""
    total = np.concatenate([[0.0], np.cumsum(p)])
    top = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        top[some] = np.maximum.reduceat(p, bounds[some])
    return total[bounds[1:]] - total[bounds[:-1]], top


def evidence(sums: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Per document: a constant, the log of the sum of marginals, and of the greatest one's odds."""
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(sums)), np.log(np.maximum(sums, 0) + 0.05), np.log(top / (1 - top))], 1)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's steps; slopes are not negative."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    if (b[1:] < 0).any():  # the one that helps alone
        keep = 1 + int(np.argmax(b[1:]))
        if x.shape[1] > 2:
            two = calibrate(x[:, [0, keep]], y, weight, l2)
            b = np.zeros(x.shape[1])
            b[[0, keep]] = two
        else:
            b[1:] = np.maximum(b[1:], 0)
    return b


class ToxicModel:
    def __init__(self, model: Model | None, calibration: np.ndarray):
        self.model, self.calibration = model, calibration

    @classmethod
    def train(cls, rows: list[tuple[str, int]], counts: list[int], epochs: int = 3) -> ToxicModel:
        """``counts``: of the clean and toxic rows that the sample stands for."""
        prior = np.log((counts[1] + 0.5) / (counts[0] + 0.5)) if sum(counts) else -3.0
        texts, y = [t.encode("utf-8", "surrogatepass") for t, _ in rows], np.array([v for _, v in rows])
        if not len(y) or y.min() == y.max():
            return cls(None, np.array([prior, 0.0, 0.0]))
        seen: list[np.ndarray] = []
        for i in range(0, len(texts), 64):
            w = _words(texts[i : i + 64])
            seen += [np.unique(w.hashes[w.kind[a:b]]) for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        chosen = explaining_words(seen, y.astype(float))

        def tags(w: Words, ids) -> np.ndarray:
            hit = np.isin(w.hashes, chosen)[w.kind] & np.repeat(y[ids] > 0, np.diff(w.bounds))
            return hit.astype(np.int64)

        model = fit(texts, tags, 2, epochs)
        x = []
        for i in range(0, len(texts), 64):
            w = _words(texts[i : i + 64])
            x.append(evidence(*gather(model.posterior(w)[:, TOXIC], w.bounds)))
        share = np.array([counts[v] / max(1, int((y == v).sum())) for v in y])
        return cls(model, calibrate(np.concatenate(x), y.astype(float), share / share.mean()))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and spans at the usual bound."""
        return self.spans(texts)

    def spans(self, texts: pa.Array, at: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and per text the character offsets of runs of toxic words, ends exclusive."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        if self.model is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.calibration[0]))), out
        data, off = flat(texts)
        sums, top = np.zeros(len(texts)), np.zeros(len(texts))
        chars, running_on = 0, False  # characters before the window; whether its first word goes on a run
        for lo, hi, w, p in self.model.labelled(data, off):
            p = p[:, TOXIC]
            more, best = gather(p, w.bounds)
            sums, top = sums + more, np.maximum(top, best)
            hit = np.flatnonzero(p >= at)
            if len(hit):
                whole = np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)])
                row = np.searchsorted(w.bounds, hit, "right") - 1
                begins = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row) > 0)]))
                for a, b in zip(begins, [*begins[1:], len(hit)]):
                    r = int(row[a])
                    base = -chars if lo else int(whole[off[r]])
                    begin, end = int(whole[w.starts[hit[a]]]) - base, int(whole[w.ends[hit[b - 1]]]) - base
                    if hit[a] == 0 and running_on:
                        begin = out[r].pop()[0]
                    out[r].append((begin, end))
            if hi < len(data):
                chars += int(((data[lo:hi] & 0xC0) != 0x80).sum())
                running_on = bool(len(hit) and hit[-1] == len(p) - 1) if len(p) else running_on
        return 1 / (1 + np.exp(-np.clip(evidence(sums, top) @ self.calibration, -30, 30))), out


def _words(texts: list[bytes]) -> Words:
    off = np.zeros(len(texts) + 1, np.int64)
    off[1:] = np.cumsum([len(t) for t in texts])
    return words_of(np.frombuffer(b"".join(texts), np.uint8), off)


def learn(documents: DataFrame, labels: DataFrame, per_class: int = 1500, folds: int = 5, held_out: int = 0) -> ToxicModel:
    return ToxicModel.train(*labelled_sample(documents, labels, "toxic", held_out, folds, per_class))


def score(documents: DataFrame, model: ToxicModel) -> DataFrame:
    """``documents`` without text, with toxic_score and toxic_spans."""
    shared = share(documents.sparkSession, model)
    kept = documents.drop("toxic_score", "toxic_spans")
    rest = [f for f in kept.schema.fields if f.name != "text"]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*rest, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(span))])
    names = [f.name for f in rest]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        model_ = shared()
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                scores, found = model_.spans(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores), pa.array([[{"start": a, "end": b} for a, b in f] for f in found], kind)], names=[*names, "toxic_score", "toxic_spans"])

    return in_small_batches(kept).mapInArrow(run, schema)
