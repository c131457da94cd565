"""Exact inference on first- and second-order chains, in numpy and log space.

A chain has K tags and three boundary states: start ``S0 = K``, the one before it ``S00 = K + 1``, and the
end ``SN = K + 2``.  ``node`` (L, K) are scores of tags, ``node_end`` that of the end.  Transition scores are
``edge[s, sp]`` or ``edge[s, sp, spp]``, current state first.  Disallowed tags have score -inf.
"""

from __future__ import annotations

import itertools

import numpy as np


def lse(x: np.ndarray, axis=None) -> np.ndarray:
    """log-sum-exp; all -inf stays -inf."""
    m = np.max(x, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - safe), axis=axis, keepdims=True)) + safe
    return np.squeeze(out, axis=axis) if axis is not None else out.reshape(())[()]


def first_order(node: np.ndarray, node_end: float, edge: np.ndarray):
    """logZ, marginals (L, K), and expected transition counts (S, S)."""
    n, k = node.shape
    s0, sn, counts = k, k + 2, np.zeros_like(edge)
    if not n:
        raise ValueError("a sequence has at least one token")
    trans, end = edge[:k, :k], edge[sn, :k]
    a, b = np.empty((n, k)), np.empty((n, k))
    a[0] = edge[:k, s0] + node[0]
    for i in range(1, n):
        a[i] = lse(a[i - 1][None] + trans, 1) + node[i]
    log_z = lse(a[-1] + end) + node_end
    b[-1] = end + node_end
    for i in range(n - 1, 0, -1):
        b[i - 1] = lse((b[i] + node[i])[:, None] + trans, 0)
    p = np.exp(a + b - log_z)
    counts[:k, s0] = p[0]
    counts[sn, :k] = p[-1]
    if n > 1:
        counts[:k, :k] = np.exp(a[:-1][:, None, :] + trans[None] + (node[1:] + b[1:])[:, :, None] - log_z).sum(0)
    return log_z, p, counts


def second_order(node: np.ndarray, node_end: float, edge: np.ndarray):
    """logZ, marginals (L, K), and expected transition counts (S, S, S)."""
    n, k = node.shape
    s0, s00, sn, counts = k, k + 1, k + 2, np.zeros_like(edge)
    if not n:
        raise ValueError("a sequence has at least one token")
    trans, first = edge[:k, :k, :k], edge[:k, s0, s00] + node[0]
    if n == 1:
        last = first + edge[sn, :k, s0] + node_end
        log_z = lse(last)
        p = np.exp(last - log_z)[None]
        counts[:k, s0, s00] = p[0]
        counts[sn, :k, s0] = p[0]
        return log_z, p, counts
    a, b = np.empty((n, k, k)), np.empty((n, k, k))  # [i, s, sp], for i > 0
    a[1] = first[None] + edge[:k, :k, s0] + node[1][:, None]
    for i in range(2, n):
        a[i] = lse(a[i - 1][None] + trans, 2) + node[i][:, None]
    end = edge[sn, :k, :k]
    log_z = lse(a[-1] + end) + node_end
    b[-1] = end + node_end
    for i in range(n - 1, 1, -1):
        b[i - 1] = lse((b[i] + node[i][:, None])[:, :, None] + trans, 0)
    pair = np.exp(a[1:] + b[1:] - log_z)
    p = np.concatenate([pair[0].sum(0)[None], pair.sum(2)])
    counts[:k, s0, s00], counts[:k, :k, s0], counts[sn, :k, :k] = p[0], pair[0], pair[-1]
    if n > 2:
        counts[:k, :k, :k] = np.exp(a[1:-1][:, None] + trans[None] + (b[2:] + node[2:][:, :, None])[..., None] - log_z).sum(0)
    return log_z, p, counts


def marginals(node: np.ndarray, node_end: float, edge: np.ndarray):
    return (first_order if edge.ndim == 2 else second_order)(node, node_end, edge)


def _carried(i: int, size: np.ndarray, new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """``new`` of the sequences that reach position ``i``, ``old`` of the shorter ones."""
    return np.where((i < size).reshape(-1, *[1] * (new.ndim - 1)), new, old)


def first_order_batch(node: np.ndarray, size: np.ndarray, node_end: np.ndarray, edge: np.ndarray):
    """Of sequences padded to one length: logZ (B), marginals (B, L, K), transition counts (B, S, S).

    ``node`` (B, L, K) may hold anything behind a sequence's ``size``.
    """
    b_, n, k = node.shape
    s0, sn, counts = k, k + 2, np.zeros((b_, *edge.shape))
    trans, end = edge[:k, :k], edge[sn, :k]
    a, b = np.empty((b_, n, k)), np.empty((b_, n, k))
    a[:, 0] = edge[:k, s0] + node[:, 0]
    for i in range(1, n):
        a[:, i] = _carried(i, size, lse(a[:, i - 1, None] + trans, 2) + node[:, i], a[:, i - 1])
    log_z = lse(a[:, -1] + end, 1) + node_end
    b[:, -1] = end + node_end[:, None]
    for i in range(n - 1, 0, -1):
        b[:, i - 1] = _carried(i, size, lse((b[:, i] + node[:, i])[:, :, None] + trans, 1), b[:, i])
    z = log_z[:, None, None]
    p = np.where((np.arange(n) < size[:, None])[:, :, None], np.exp(a + b - z), 0.0)
    counts[:, :k, s0] = p[:, 0]
    counts[:, sn, :k] = p[np.arange(b_), size - 1]
    for i in range(1, n):
        step = np.exp(a[:, i - 1, None] + trans + (node[:, i] + b[:, i])[:, :, None] - z)
        counts[:, :k, :k] += _carried(i, size, step, np.zeros_like(step))
    return log_z, p, counts


def second_order_batch(node: np.ndarray, size: np.ndarray, node_end: np.ndarray, edge: np.ndarray):
    """As :func:`first_order_batch`, with transition counts (B, S, S, S); sequences of one token are solved by themselves."""
    b_, n, k = node.shape
    s0, s00, sn, counts = k, k + 1, k + 2, np.zeros((b_, *edge.shape))
    log_z, p = np.empty(b_), np.zeros((b_, n, k))
    for i in np.flatnonzero(size == 1):
        log_z[i], p[i, :1], counts[i] = second_order(node[i, :1], float(node_end[i]), edge)
    some = np.flatnonzero(size > 1)
    if not len(some):
        return log_z, p, counts
    node, size, node_end = node[some], size[some], node_end[some]
    trans, end = edge[:k, :k, :k], edge[sn, :k, :k]
    a, b = np.empty((len(some), n, k, k)), np.empty((len(some), n, k, k))  # [i, s, sp], for i > 0
    a[:, 1] = (edge[:k, s0, s00] + node[:, 0])[:, None, :] + edge[:k, :k, s0] + node[:, 1, :, None]
    for i in range(2, n):
        a[:, i] = _carried(i, size, lse(a[:, i - 1, None] + trans, 3) + node[:, i, :, None], a[:, i - 1])
    z = lse((a[:, -1] + end).reshape(len(some), -1), 1) + node_end
    b[:, -1] = end + node_end[:, None, None]
    for i in range(n - 1, 1, -1):
        b[:, i - 1] = _carried(i, size, lse((b[:, i] + node[:, i, :, None])[..., None] + trans, 1), b[:, i])
    valid = np.arange(1, n) < size[:, None]
    pair = np.where(valid[:, :, None, None], np.exp(a[:, 1:] + b[:, 1:] - z[:, None, None, None]), 0.0)
    own, inner = np.concatenate([pair[:, :1].sum(2), pair.sum(3)], 1), np.zeros((len(some), k, k, k))
    for i in range(2, n):
        step = np.exp(a[:, i - 1, None] + trans + (b[:, i] + node[:, i, :, None])[..., None] - z[:, None, None, None])
        inner += _carried(i, size, step, np.zeros_like(step))
    part = np.zeros((len(some), *edge.shape))
    part[:, :k, s0, s00], part[:, :k, :k, s0], part[:, sn, :k, :k], part[:, :k, :k, :k] = own[:, 0], pair[:, 0], pair[np.arange(len(some)), size - 2], inner
    log_z[some], p[some], counts[some] = z, own, part
    return log_z, p, counts


def batch_marginals(node: np.ndarray, size: np.ndarray, node_end: np.ndarray, edge: np.ndarray):
    return (first_order_batch if edge.ndim == 2 else second_order_batch)(node, size, node_end, edge)


def batch_entropy(log_z: np.ndarray, p: np.ndarray, counts: np.ndarray, node: np.ndarray, node_end: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Per sequence: logZ less the expected score; ``p`` is 0 behind a sequence's end."""
    finite = lambda x: np.where(np.isfinite(x), x, 0.0)
    return log_z - (p * finite(node)).sum((1, 2)) - node_end - (counts * finite(edge)).reshape(len(log_z), -1).sum(1)


def uniform_scores(n: int, k: int, order: int, score: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Node scores, end score and edges that all are ``log(score)``."""
    value = float(np.log(score)) if score > 0 else -np.inf
    return np.full((n, k), value), value, np.full((k + 3,) * (order + 1), value)


def smoothed(scores: np.ndarray, backoff: float) -> np.ndarray:
    """``log(backoff + exp(score))`` of finite scores; what is not finite counts as missing and becomes ``log(backoff)``."""
    return np.where(np.isfinite(scores), np.logaddexp(np.log(backoff), np.where(np.isfinite(scores), scores, 0.0)), np.log(backoff))


def path_counts(tags: np.ndarray, k: int, order: int) -> np.ndarray:
    """Transition counts of one path, boundaries included."""
    counts = np.zeros((k + 3,) * (order + 1))
    path = [k + 1, k, *map(int, tags), k + 2]
    for i in range(2, len(path)):
        counts[tuple(path[i - j] for j in range(order + 1))] += 1
    return counts


def path_score(tags, node: np.ndarray, node_end: float, edge: np.ndarray) -> float:
    k = node.shape[1]
    return float((path_counts(np.asarray(tags), k, edge.ndim - 1) * np.where(np.isfinite(edge), edge, 0)).sum() + node[np.arange(len(tags)), tags].sum() + node_end)


def brute_force(node: np.ndarray, node_end: float, edge: np.ndarray):
    """logZ and marginals over all paths, for tests."""
    n, k = node.shape
    paths = list(itertools.product(range(k), repeat=n))
    scores = np.array([path_score(p, node, node_end, edge) for p in paths])
    log_z = lse(scores)
    p = np.zeros((n, k))
    for path, w in zip(paths, np.exp(scores - log_z)):
        p[np.arange(n), list(path)] += w
    return log_z, p


def entropy(log_z: float, p: np.ndarray, counts: np.ndarray, node: np.ndarray, node_end: float, edge: np.ndarray) -> float:
    """logZ less the expected score."""
    finite = lambda x: np.where(np.isfinite(x), x, 0.0)
    return float(log_z - (p * finite(node)).sum() - node_end - (counts * finite(edge)).sum())
