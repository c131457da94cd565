"""Linear-chain conditional random field on long token sequences, in numpy.

All documents of a batch form one chain: at a document's first token the step
matrix is the same for every previous state, so nothing passes the border.
The chain is cut into about sqrt(N) chunks.  Chunk products, then the states
that enter each chunk, then the states inside are computed for all chunks at
once; the result is the exact forward-backward, in about 4 sqrt(N) array steps.
"""

from __future__ import annotations

import numpy as np


def _steps(emit: np.ndarray, begin: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The step matrices, padded to whole chunks: (chunks, tokens of a chunk, K, K)."""
    n, k = emit.shape
    long = max(1, int(np.sqrt(n)))
    chunks = -(-n // long)
    e = np.exp(emit - emit.max(1, keepdims=True), dtype=np.float64)
    step = np.exp(trans - trans.max())[None] * e[:, None, :]
    step[begin] = (np.exp(start - start.max())[None] * e[begin])[:, None, :]
    step /= step.sum((1, 2), keepdims=True)
    if chunks * long > n:
        step = np.concatenate([step, np.broadcast_to(np.eye(k), (chunks * long - n, k, k))])
    return step.reshape(chunks, long, k, k)


def _products(step: np.ndarray) -> np.ndarray:
    whole = step[:, 0].copy()
    for i in range(1, step.shape[1]):
        whole = whole @ step[:, i]
        whole /= whole.sum((1, 2), keepdims=True)
    return whole


def transfer(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The product of all step matrices, but for a factor: what a window of a longer chain does to the states."""
    out = np.eye(emit.shape[1])
    for whole in _products(_steps(emit, np.asarray(first, bool), trans, start)) if len(emit) else ():
        out = out @ whole
        out /= out.sum()
    return out


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False, into: np.ndarray | None = None, back: np.ndarray | None = None):
    """Posterior of each token's state (N, K); with ``pairs`` also the expected transition counts (K, K).

    ``emit`` (N, K) are log scores, ``first`` (N) marks first tokens, ``trans`` (K, K) goes from
    the row's state to the column's, ``start`` (K) holds for first tokens.  In a window of a longer chain,
    ``into`` are the forward weights of the states before it, ``back`` the backward ones behind it.
    """
    n, k = emit.shape
    if not n:
        return (np.zeros((0, k)), np.zeros((k, k))) if pairs else np.zeros((0, k))
    begin = np.asarray(first, bool).copy()
    begin[0] |= into is None
    step = _steps(emit, begin, trans, start)
    chunks, long = step.shape[:2]
    whole = _products(step)
    ahead, behind = np.full((chunks, k), 1.0 / k), np.full((chunks, k), 1.0 / k)
    if into is not None:
        ahead[0] = into / into.sum()
    if back is not None:
        behind[-1] = back / back.sum()
    for c in range(1, chunks):
        v = ahead[c - 1] @ whole[c - 1]
        ahead[c] = v / v.sum()
    for c in range(chunks - 1, 0, -1):
        v = whole[c] @ behind[c]
        behind[c - 1] = v / v.sum()
    alpha, beta = np.empty((chunks, long, k)), np.empty((chunks, long, k))
    v = ahead
    for i in range(long):
        v = (v[:, None, :] @ step[:, i])[:, 0]
        v /= v.sum(1, keepdims=True)
        alpha[:, i] = v
    v = behind
    for i in range(long - 1, -1, -1):
        beta[:, i] = v
        v = (step[:, i] @ v[:, :, None])[..., 0]
        v /= v.sum(1, keepdims=True)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    if not pairs:
        return p
    inner = ~begin
    inner[0] = False
    at = np.flatnonzero(inner)
    xi = alpha[at - 1][:, :, None] * step.reshape(-1, k, k)[at] * beta[at][:, None, :]
    xi /= xi.sum((1, 2), keepdims=True)
    return p, xi.sum(0)
