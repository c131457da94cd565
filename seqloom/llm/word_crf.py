"""A linear-chain conditional random field over the words of texts.

A word's emission scores are sums of learned weights: of the word itself (the lexicon), and of its
byte 2-, 3- and 4-grams with both word ends marked (so affixes are among them).  Weights live in one
hashed table; transitions between the states of neighbouring words are learned with them, by
gradient steps on the conditional likelihood, whose expectations come from forward-backward.
Words are letters of ASCII and bytes of other characters, in lower case where bytes keep their length.

A long text is labelled in windows of about ``SLICE_BYTES``: one pass takes each window's effect on the
states, a second one its marginals with what stands before and behind, which gives the marginals of
the whole chain in the memory of a window.  There, a run of letters longer than a window is cut into
words of a window's length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .chain import marginals, transfer
from .common import CODE, LETTERS, LOWER, SLICE_BYTES, spans, word_hashes

_TWO, _THREE, _FOUR, _WORD = 0, 1 << 16, 1 << 17, 1 << 18
TABLE = (1 << 18) + (1 << 18) + 1  # the last row is the weight of what is not there
_NONE = TABLE - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters U+00C0 to U+00DE, byte for byte."""
    out = LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    out[lead] += 0x20
    return out


@dataclass
class Words:
    """The words of a batch of texts and what they share: ``kind[i]`` is word i's row in the distinct words."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    kind: np.ndarray
    grams: list = field(repr=False)
    at: np.ndarray
    own: np.ndarray
    hashes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        out = np.zeros(len(self.starts), bool)
        heads = self.bounds[:-1]
        out[heads[heads < len(out)]] = True
        return out


def words_of(data: np.ndarray, off: np.ndarray) -> Words:
    low = lowered(data)
    starts, ends, bounds = spans(low, off, LETTERS)
    hashes, one, kind = np.unique(word_hashes(low, starts, ends, CODE), return_index=True, return_inverse=True)
    s, size = starts[one], (ends - starts)[one] + 2
    at = np.zeros(len(s), np.int64)
    at[1:] = np.cumsum(size)[:-1]
    total = int(size.sum())
    pos = np.arange(total) - np.repeat(at, size)
    inner = (pos > 0) & (pos < np.repeat(size, size) - 1)
    framed = np.full(total + 3, 32, np.int64)
    framed[:total][inner] = low[(np.repeat(s, size) + pos - 1)[inner]]
    room = np.repeat(size, size) - pos
    b0, b1, b2, b3 = (framed[i : total + i] for i in range(4))
    two = b0 | b1 << 8
    three = two * 40503 + b2 * 2654435
    four = (three * 31 + b3 * 7368787) >> 7
    grams = [np.where(room >= 2, two, _NONE), np.where(room >= 3, (three ^ three >> 15) & 0xFFFF | _THREE, _NONE), np.where(room >= 4, (four ^ four >> 19) & 0x1FFFF | _FOUR, _NONE)]
    own = (hashes >> np.uint64(46)).astype(np.int64) | _WORD
    return Words(starts, ends, bounds, kind.reshape(-1), grams, at, own, hashes)


def windows(data: np.ndarray, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Ranges of about ``most`` bytes, cut where no word is, or in a longer word between characters."""
    out, lo = [], 0
    while len(data) - lo > 2 * most:
        ahead = data[lo + most : lo + 2 * most]
        free = np.flatnonzero(~LETTERS[ahead])
        if not len(free):
            free = np.flatnonzero((ahead & 0xC0) != 0x80)[-1:]
        hi = lo + most + (int(free[0]) if len(free) else most)
        out.append((lo, hi))
        lo = hi
    return [*out, (lo, len(data))]


@dataclass
class Model:
    weights: np.ndarray  # (TABLE, K)
    trans: np.ndarray
    start: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """Of the distinct words."""
        if not len(w.own):
            return np.zeros((0, len(self.start)))
        out = self.weights[w.grams[0]]
        out += self.weights[w.grams[1]]
        out += self.weights[w.grams[2]]
        out = np.add.reduceat(out, w.at)
        out += self.weights[w.own]
        return out

    def posterior(self, w: Words, pairs: bool = False):
        return marginals(self.emissions(w)[w.kind].astype(np.float64), w.first, self.trans, self.start, pairs)

    def labelled(self, data: np.ndarray, off: np.ndarray, most: int = SLICE_BYTES):
        """(first byte, last byte, words, marginals) of the texts: all at once, or the windows of one long text."""
        cuts = windows(data, most) if len(off) == 2 else [(0, len(data))]
        if len(cuts) == 1:
            w = words_of(data, off)
            yield 0, len(data), w, self.posterior(w)
            return

        def part(i: int):
            lo, hi = cuts[i]
            w = words_of(data[lo:hi], np.array([0, hi - lo]))
            first = w.first
            first[:1] &= not seen[i]  # words stand before it
            return w, self.emissions(w)[w.kind].astype(np.float64), first

        seen, effect = [False], []
        for i in range(len(cuts)):
            w, emit, first = part(i)
            effect.append(transfer(emit, first, self.trans, self.start))
            seen.append(seen[-1] or len(w.starts) > 0)
        k = len(self.start)
        into, back = [np.full(k, 1.0 / k)], [np.full(k, 1.0 / k)]
        for i in range(len(cuts) - 1):
            v, b = into[-1] @ effect[i], effect[-1 - i] @ back[-1]
            into.append(v / v.sum())
            back.append(b / b.sum())
        for i, (lo, hi) in enumerate(cuts):
            w, emit, first = part(i)
            yield lo, hi, w, marginals(emit, first, self.trans, self.start, into=into[i] if seen[i] else None, back=back[-1 - i])


def fit(texts: list[bytes], tags, states: int, epochs: int = 3, rate: float = 0.15, batch: int = 40_000, seed: int = 11, together: int = 1, l2: float = 1e-6) -> Model:
    """Maximum conditional likelihood by adaptive gradient steps.

    ``tags(words, ids)`` gives the words' states.  ``together`` texts in a row form one chain, so
    that transitions see changes of language.  ``batch`` bytes make one step.
    """
    rng = np.random.default_rng(seed)
    model = Model(np.zeros((TABLE, states), np.float32), np.zeros((states, states)), np.zeros(states))
    grad2 = [np.full((TABLE, states), 1e-3, np.float32), np.full((states, states), 1e-3), np.full(states, 1e-3)]
    for epoch in range(epochs):
        order, lo = rng.permutation(len(texts)), 0
        while lo < len(order):
            size, hi = 0, lo
            while hi < len(order) and (size < batch or hi == lo):
                size += len(texts[order[hi]])
                hi += 1
            ids, lo = order[lo:hi], hi
            off = np.zeros(len(ids) + 1, np.int64)
            # a blank between texts keeps their words apart
            parts = [texts[i] + b" " for i in ids]
            off[1:] = np.cumsum([len(p) for p in parts])
            w = words_of(np.frombuffer(b"".join(parts), np.uint8), off)
            if not len(w.starts):
                continue
            gold = tags(w, ids)
            first = w.first
            heads = np.flatnonzero(first)
            first[heads[np.arange(len(heads)) % together != 0]] = False
            p, xi = marginals(model.emissions(w)[w.kind].astype(np.float64), first, model.trans, model.start, True)
            scale = 1.0 / np.sqrt(len(w.starts))
            diff = p.copy()
            diff[np.arange(len(gold)), gold] -= 1
            by_kind = np.stack([np.bincount(w.kind, diff[:, k], len(w.own)) for k in range(states)], 1) * scale
            spread = np.repeat(by_kind, np.diff(np.append(w.at, len(w.grams[0]))), axis=0)
            where = np.concatenate([*w.grams, w.own])
            g = np.stack([np.bincount(where, np.concatenate([spread[:, k]] * 3 + [by_kind[:, k]]), TABLE) for k in range(states)], 1).astype(np.float32)
            g[_NONE] = 0
            g += l2 * model.weights
            inner = np.flatnonzero(~first)
            seen = np.zeros((states, states))
            np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
            begin = np.flatnonzero(first)
            g_start = p[begin].sum(0) - np.bincount(gold[begin], minlength=states)
            for value, g2, step in ((model.weights, grad2[0], g), (model.trans, grad2[1], (xi - seen) * scale + 1e-3 * model.trans), (model.start, grad2[2], g_start * scale + 1e-3 * model.start)):
                g2 += step * step
                value -= rate * step / np.sqrt(g2)
    return model
