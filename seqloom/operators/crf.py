"""Chain models over DataFrames of sequences: scores, objective, L-BFGS training, decoding.

Sequence rows: ``seq_id, tags array<int>, obs array<array<int>>, nodes array<long>, is_labeled boolean``.
``obs`` lists each token's observation features (words, affixes, lit pixels); a tag's score at a position
sums the weights of the previous, the current and the next token's observations.  An optional column
``allowed array<array<int>>`` prunes the states of each token (null or empty: all are allowed).

One evaluation is one job: parameters are broadcast, every partition adds up its sequences and hands
on one row, sparse where few features occur in it; rows are added in a tree of bounded fan-in, in a fixed
order.  Sequences of like length go through the lattice together.
"""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import lattice

#: transition templates of a second-order and of a first-order model: axes of (s, sp, spp)
_TEMPLATES = {2: ((2,), (1,), (0,), (1, 0), (2, 0), (2, 1), (2, 1, 0)), 1: ((1,), (0,), (1, 0))}


@dataclass(frozen=True)
class Design:
    """Sizes of a model; ``scale`` divides emission values, ``backoff`` is added to every log score."""

    states: int
    observations: int
    order: int = 1
    scale: float = 1.0
    backoff: float = 0.0

    @property
    def all_states(self) -> int:
        return self.states + 3

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        return [(self.all_states,) * len(t) for t in _TEMPLATES[self.order]] + [(3, self.observations, self.states + 1)]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes)

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            out.append(theta[at : at + n].reshape(shape))
            at += n
        return out

    def edges(self, theta: np.ndarray) -> np.ndarray:
        """Scores [s, sp(, spp)]: the sum of the templates' weights."""
        edge = np.full((self.all_states,) * (self.order + 1), self.backoff)
        for axes, w in zip(_TEMPLATES[self.order], self.split(theta)):
            # w's axes are (oldest .. current); put them where edge has them
            shape = [1] * (self.order + 1)
            for a in axes:
                shape[a] = self.all_states
            edge += np.transpose(w, np.argsort(axes)).reshape(shape)
        return edge

    def edge_gradient(self, counts: np.ndarray) -> list[np.ndarray]:
        out = []
        for axes in _TEMPLATES[self.order]:
            rest = tuple(a for a in range(self.order + 1) if a not in axes)
            kept = counts.sum(rest)
            out.append(np.transpose(kept, np.argsort(np.argsort(axes))) if len(axes) > 1 else kept)
        return out

    def chunks(self, batch: pa.RecordBatch, emission: np.ndarray | None = None, most: int = 1 << 17) -> Iterator[Chunk]:
        """The batch's sequences in chunks of like length, with their scores if ``emission`` weights are given.

        ``most`` bounds positions times states to the order, and emission features times states, of a chunk.
        """
        whole = Ragged.of(batch.column("obs"))
        size = np.diff(whole.cuts)
        if (size == 0).any():
            raise ValueError("a sequence has at least one token")
        width = np.diff(whole.inner.cuts)
        features = np.add.reduceat(width, whole.cuts[:-1]) if len(size) else size
        allowed = Ragged.of(batch.column("allowed")) if "allowed" in batch.schema.names else None
        order, lo, k = np.argsort(-size, kind="stable"), 0, self.states
        while lo < len(order):
            per, hi = int(size[order[lo]]) * k**self.order, lo + 1
            total = int(features[order[lo]])
            while hi < len(order) and (hi - lo + 1) * per <= most and (total + int(features[order[hi]])) * k <= most:
                total += int(features[order[hi]])
                hi += 1
            chunk = Chunk(order[lo:hi], size[order[lo:hi]], *whole.tokens(order[lo:hi]))
            if emission is not None:
                chunk.score(self, emission, allowed)
            yield chunk
            lo = hi

    def join_counts(self, transitions: np.ndarray, emission: np.ndarray) -> np.ndarray:
        return np.concatenate([*(g.ravel() for g in self.edge_gradient(transitions)), emission.ravel()])


@dataclass
class Ragged:
    """A list column of lists: ``cuts`` of the rows in the inner lists, whose own cuts are in ``inner``."""

    cuts: np.ndarray
    values: np.ndarray
    inner: Ragged | None = None

    @classmethod
    def of(cls, column) -> Ragged:
        cuts = column.offsets.to_numpy().astype(np.int64)
        values = column.values.slice(cuts[0], cuts[-1] - cuts[0]) if len(cuts) else column.values
        below = cls.of(values) if pa.types.is_list(values.type) else None
        flat = below.values if below else values.to_numpy(zero_copy_only=False)
        return cls(cuts - cuts[0] if len(cuts) else np.zeros(1, np.int64), flat, below)

    def tokens(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inner lists of these rows: values, and the number of the list that each is in."""
        lists = _ranges(self.cuts[rows], self.cuts[rows + 1])
        lo, hi = self.inner.cuts[lists], self.inner.cuts[lists + 1]
        return self.values[_ranges(lo, hi)].astype(np.int64), np.repeat(np.arange(len(lists)), hi - lo)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)


@dataclass
class Chunk:
    """Some sequences of a batch: ``rows`` in it, sizes, and their tokens' features with the token's number."""

    rows: np.ndarray
    size: np.ndarray
    feature: np.ndarray
    token: np.ndarray
    node: np.ndarray | None = None
    end: np.ndarray | None = None

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        first = np.cumsum(self.size) - self.size
        self.pos = np.arange(len(self.row)) - first[self.row]
        self.last = first + self.size - 1

    @property
    def valid(self) -> np.ndarray:
        return np.arange(int(self.size.max())) < self.size[:, None]

    def padded(self, per_token: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.size), int(self.size.max()), *per_token.shape[1:]))
        out[self.row, self.pos] = per_token
        return out

    def score(self, design: Design, emission: np.ndarray, allowed: Ragged | None) -> None:
        """Scores (B, L, K), -inf where not allowed, and that of the end state, which sees the last token as its previous one."""
        k, n = design.states, len(self.row)
        per = np.zeros((3, n, k + 1))
        if len(self.feature):
            heads = np.flatnonzero(np.concatenate([[True], self.token[1:] != self.token[:-1]]))
            for o in range(3):
                per[o, self.token[heads]] = np.add.reduceat(emission[o, self.feature], heads, axis=0)
        per /= design.scale
        node = per[1, :, :k] + design.backoff
        later = np.flatnonzero(self.pos > 0)
        node[later] += per[0, later - 1, :k]
        node[later - 1] += per[2, later, :k]
        if allowed is not None:
            states, token = allowed.tokens(self.rows) if len(allowed.values) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(states):
                lists = np.diff(allowed.cuts)[self.rows]
                # a row without a list of lists allows everything
                place = np.repeat(np.cumsum(self.size) - self.size, lists)[token] + token - np.repeat(np.cumsum(lists) - lists, lists)[token]
                ok = np.ones((n, k), bool)
                ok[place] = False
                ok[place, states] = True
                node[~ok] = -np.inf
        self.node, self.end = self.padded(node), per[0, self.last, k] + design.backoff

    def emissions(self, design: Design, p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected emission counts of marginals ``p`` (B, L, K): the features that occur, and their counts (3, features, K + 1)."""
        k = design.states
        own = p[self.row, self.pos] * weight[self.row, None] / design.scale
        per = np.zeros((3, len(self.row), k + 1))
        per[1, :, :k] = own
        later = np.flatnonzero(self.pos > 0)
        per[0, later - 1, :k] = own[later]
        per[0, self.last, k] = weight / design.scale
        per[2, later, :k] = own[later - 1]
        some, at = np.unique(self.feature, return_inverse=True)
        out = np.zeros((3, len(some), k + 1))
        for o in range(3):
            for s in range(k + 1):
                out[o, :, s] = np.bincount(at, per[o, self.token, s], len(some))
        return some, out


def one_hot(tags, states: int) -> np.ndarray:
    return np.eye(states)[np.asarray(tags, np.int64)]


#: rows of partial sums that one task adds up
FAN_IN = 16


def _packed(part: int, loss: float, total: np.ndarray) -> pa.RecordBatch:
    """One row; of a sparse vector, places and values of what is not 0."""
    at = np.flatnonzero(total)
    sparse = 2 * len(at) < len(total)
    values = total[at] if sparse else total
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([loss]), pa.array([at.tobytes() if sparse else None], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["part", "loss", "at", "grad"])


def _add(into: np.ndarray, at: bytes | None, values: bytes) -> None:
    if at is None:
        into += np.frombuffer(values)
    else:
        into[np.frombuffer(at, np.int64)] += np.frombuffer(values)


_PARTIAL = "part long, loss double, at binary, grad binary"


def _sum_rows(parts: DataFrame, size: int, n: int) -> tuple[float, np.ndarray]:
    """Adds the partial sums of ``n`` partitions, ``FAN_IN`` at a time, until as few are left for the driver."""

    def add(batches):
        part, loss, into = None, 0.0, np.zeros(size)
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"] if part is None else part
                loss += row["loss"]
                _add(into, row["at"], row["grad"])
        if part is not None:
            yield _packed(part, loss, into)

    step = 1
    while n > FAN_IN:
        n, step = -(-n // FAN_IN), step * FAN_IN
        parts = parts.repartition(n, F.expr(f"part div {step}"))
        parts = parts.sortWithinPartitions("part").mapInArrow(add, _PARTIAL)
    loss, into = 0.0, np.zeros(size)
    for row in sorted(parts.collect(), key=lambda r: r["part"]):
        loss += row["loss"]
        _add(into, row["at"], row["grad"])
    return loss, into


def partitions_of(settled: DataFrame) -> int:
    return settled._jdf.queryExecution().toRdd().getNumPartitions()


def _partials(sequences: DataFrame, body, design: Design, parts: int) -> tuple[float, np.ndarray]:
    """Sum over batches of what ``body(batch, transitions, emission)`` returns and adds to both."""

    def run(batches):
        from pyspark import TaskContext

        loss, some = 0.0, False
        transitions, emission = np.zeros((design.all_states,) * (design.order + 1)), np.zeros(design.shapes[-1])
        for batch in batches:
            if batch.num_rows:
                loss, some = loss + body(batch, transitions, emission), True
        if some:
            yield _packed(TaskContext.get().partitionId(), loss, design.join_counts(transitions, emission))

    return _sum_rows(sequences.mapInArrow(run, _PARTIAL), design.size, parts)


def gold_counts(sequences: DataFrame, design: Design) -> np.ndarray:
    """Empirical feature counts of the labelled sequences."""

    def body(batch, transitions, emission):
        tags = Ragged.of(batch.column("tags"))
        for chunk in design.chunks(batch):
            mine = tags.values[_ranges(tags.cuts[chunk.rows], tags.cuts[chunk.rows + 1])].astype(np.int64)
            some, counts = chunk.emissions(design, chunk.padded(one_hot(mine, design.states)), np.ones(len(chunk.size)))
            emission[:, some] += counts
            for lo, hi in zip(chunk.last - chunk.size + 1, chunk.last + 1):
                transitions += lattice.path_counts(mine[lo:hi], design.states, design.order)
        return 0.0

    return _partials(sequences.where("is_labeled"), body, design, partitions_of(sequences))[1]


def log_partition(sequences: DataFrame, design: Design, theta: np.ndarray, labelled: float = 1.0, other: float = 1.0) -> tuple[float, np.ndarray]:
    """Sum of logZ over the sequences, and the expected feature counts; labelled ones and others have a weight each."""
    sent = sequences.sparkSession.sparkContext.broadcast(theta)

    def body(batch, transitions, emission, cache={}):  # noqa: B006
        if not cache:
            cache["edge"], cache["emission"] = design.edges(sent.value), design.split(sent.value)[-1]
        weights = np.where(batch.column("is_labeled").to_numpy(zero_copy_only=False).astype(bool), labelled, other)
        loss = 0.0
        for chunk in design.chunks(batch, cache["emission"]):
            log_z, p, counts = lattice.batch_marginals(chunk.node, chunk.size, chunk.end, cache["edge"])
            w = weights[chunk.rows]
            loss += float(log_z @ w)
            transitions += np.tensordot(w, counts, 1)
            some, expected = chunk.emissions(design, p, w)
            emission[:, some] += expected
        return loss

    rows = sequences if labelled and other else sequences.where("is_labeled" if labelled else "not is_labeled")
    out = _partials(rows, body, design, partitions_of(sequences))
    sent.unpersist()
    return out


class Objective:
    """|theta|^2 / 2 sigma^2 + lambda (sum of labelled logZ - theta emp) + [soft] (sum of other logZ - theta soft).

    One job an evaluation, of labelled and other sequences alike; sequences are settled.
    """

    def __init__(self, sequences: DataFrame, design: Design, prior: float = 100.0, label_strength: float = 1.0, empirical: np.ndarray | None = None, soft: np.ndarray | None = None):
        self.sequences, self.design, self.prior, self.strength, self.soft = sequences, design, prior, label_strength, soft
        self.empirical = gold_counts(sequences, design) if empirical is None else empirical
        self.fixed = -label_strength * self.empirical - (soft if soft is not None else 0.0)

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = log_partition(self.sequences, self.design, theta, self.strength, 0.0 if self.soft is None else 1.0)
        var = self.prior**2
        return value + float(theta @ self.fixed) + float(theta @ theta) / (2 * var), grad + self.fixed + theta / var


def lbfgs(f, x: np.ndarray, iterations: int = 50, memory: int = 10, tol: float = 1e-5, c1: float = 1e-4, c2: float = 0.9, tries: int = 10):
    """Minimises ``f(x) -> (value, gradient)``; returns x and the history of (value, gradient norm).

    A step must satisfy the Wolfe conditions, found by bracketing; stops at a small relative decrease.
    """
    value, grad = f(x)
    history, pairs = [(value, float(np.linalg.norm(grad)))], []
    for it in range(iterations):
        d = grad.copy()
        alphas = []
        for s, y in reversed(pairs):
            a = (s @ d) / (y @ s)
            alphas.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            d += (a - (y @ d) / (y @ s)) * s
        d = -d
        slope = float(grad @ d)
        if slope >= 0:
            break
        step = 1.0 if it else min(1.0, 1.0 / max(1e-12, float(np.linalg.norm(grad))))
        low, high, best = 0.0, np.inf, None
        for _ in range(tries):
            new, new_grad = f(x + step * d)
            if new > value + c1 * step * slope:
                high = step
            elif float(new_grad @ d) < c2 * slope:
                low, best = step, (step, new, new_grad)
            else:
                best = (step, new, new_grad)
                break
            step = 2 * low if np.isinf(high) else (low + high) / 2
        if best is None:
            break
        step, new, new_grad = best
        s, y = step * d, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        change = abs(value - new) / max(abs(value), 1e-12)
        x, value, grad = x + s, new, new_grad
        history.append((value, float(np.linalg.norm(grad))))
        if change < tol:
            break
    return x, history


def infer(sequences: DataFrame, design: Design, theta: np.ndarray) -> DataFrame:
    """(seq_id, logz, entropy, p array of L * K, pred array<int>): posterior decoding, the first state wins ties."""
    sent = sequences.sparkSession.sparkContext.broadcast(theta)

    def run(batches):
        edge, emission = design.edges(sent.value), design.split(sent.value)[-1]
        for batch in batches:
            for chunk in design.chunks(batch, emission):
                log_z, p, counts = lattice.batch_marginals(chunk.node, chunk.size, chunk.end, edge)
                h = lattice.batch_entropy(log_z, p, counts, chunk.node, chunk.end, edge)
                cuts = np.concatenate([[0], np.cumsum(chunk.size)]).astype(np.int32)
                own = p[chunk.row, chunk.pos]
                yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(chunk.rows)), pa.array(log_z), pa.array(h), _lists(cuts * design.states, own.ravel()), _lists(cuts, own.argmax(1).astype(np.int32))], names=["seq_id", "logz", "entropy", "p", "pred"])

    kept = [c for c in ("allowed",) if c in sequences.columns]
    return sequences.select("seq_id", "obs", *kept).mapInArrow(run, "seq_id long, logz double, entropy double, p array<double>, pred array<int>")


def _lists(cuts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def accuracy(sequences: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: token_acc, seq_acc of ``predictions(seq_id, pred)``."""
    both = sequences.select("seq_id", "tags").join(predictions.select("seq_id", "pred"), "seq_id")
    hits = F.aggregate(F.zip_with("tags", "pred", lambda a, b: (a == b).cast("int")), F.lit(0), lambda t, x: t + x)
    return both.select(hits.alias("hits"), F.size("tags").alias("n")).agg((F.sum("hits") / F.sum("n")).alias("token_acc"), F.avg((F.col("hits") == F.col("n")).cast("double")).alias("seq_acc"))


def train(sequences: DataFrame, design: Design, theta: np.ndarray | None = None, iterations: int = 50, tol: float = 1e-5, **objective):
    """Supervised training on the labelled sequences: (theta, history)."""
    start = np.zeros(design.size) if theta is None else theta
    return lbfgs(Objective(settle(sequences), design, **objective), start, iterations, tol=tol)
