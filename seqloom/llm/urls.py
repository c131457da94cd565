"""URL filters: site rules first, then the ratio of two character language models.

Rules are ``host/path`` prefixes; a rule fits its host and all subdomains, if the url's path starts
with the rule's.  The longest fitting rule gives the verdict.  URLs without a rule are judged by
variable-order Markov models of all characters of the url, one of accepted and one of rejected
URLs: Witten-Bell smoothed from the longest context down to a uniform distribution.  The difference
of log-likelihoods, divided by the length, is held against a threshold calibrated on labelled URLs
that the models were not fitted on.

Models are fitted on all distinct URLs that rules decide, whatever their length.  Spark counts their bytes
with up to ``order`` bytes before them.  In the order of the hashes, each class's every fourth URL is held out: the
threshold is calibrated on all of these, by models of the rest, and the models that judge count all.  Counts reach workers in
parts of about ``PART_GRAMS``, by the two bytes before a byte, as contexts of two bytes or more meet no other part;
shorter ones are in every part.  A URL's score is the sum over the parts.  The driver holds one part at a time.  With
one class missing, the other's verdict is the default; with none, allow.

Null urls, and urls without ``://``, have an empty host and path, so no rule fits; the models judge
the url as it is, null as empty.  An empty table gives none.  Rows are judged one by one, so repeated rows
and rows without an id get their url's verdict; a score of exactly 0 is accepted, and of rules of equal length the
later one wins.  A long url is scored in windows.  Other columns pass through; host, path, rule, verdict and score
replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_small_batches, share

#: The site rules
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    after = f"if(instr({url}, '://') > 0, substr({url}, instr({url}, '://') + 3), '')"
    host = f"translate(coalesce(regexp_extract({after}, '^([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    path = f"coalesce(regexp_extract({after}, '^[^/?#]*([^?#]*)', 1), '')"
    return F.expr(host), F.expr(path)


def rule_of(rules) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: places of a key, over the bytes: how many are before the last, whether a rejected url's, whether a held out one's
_BEFORE, _REJECTED, _HELD = 56, 59, 60


def keys(data: np.ndarray, position: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the up to ``order`` bytes before it in its text, the nearest lowest, as a number."""
    if order > 6:
        raise ValueError("contexts are of at most 6 bytes")
    out = data | (np.minimum(position, order).astype(np.uint64) << np.uint64(_BEFORE))
    for k in range(1, order + 1):
        out[k:] |= np.where(position[k:] >= k, data[:-k], np.uint64(0)) << np.uint64(8 * k)
    return out


def shorter(key: np.ndarray, order: int) -> np.ndarray:
    """The keys with at most ``order`` bytes before the last."""
    before = np.minimum(key >> np.uint64(_BEFORE) & np.uint64(7), np.uint64(order))
    return key & np.uint64((1 << 8 * (order + 1)) - 1) | before << np.uint64(_BEFORE)


def contexts_of(key: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order: a hash of the k bytes before the last; 0 where the text has fewer."""
    out, h, before = [np.ones(len(key), np.uint64)], np.ones(len(key), np.uint64), key >> np.uint64(_BEFORE) & np.uint64(7)
    for k in range(1, order + 1):
        h = _mix(h * _K + (key >> np.uint64(8 * k) & np.uint64(255)) + np.uint64(k << 9))
        out.append(np.where(before >= np.uint64(k), h, np.uint64(0)))
    return out


@dataclass
class Markov:
    """Per order: sorted context hashes with their totals and followers, sorted (context, byte) hashes with counts."""

    order: int
    contexts: list
    pairs: list

    @classmethod
    def fit(cls, data: np.ndarray, position: np.ndarray, order: int) -> Markov:
        key, n = np.unique(keys(data, position, order), return_counts=True)
        return cls.of(key, n, order)

    @classmethod
    def of(cls, key: np.ndarray, n: np.ndarray, order: int, low: tuple | None = None) -> Markov:
        """From counted keys; contexts of less than two bytes from those of ``low``, where ``key`` is a part of all."""
        contexts, pairs = [], []
        for k in range(order + 1):
            key_k, n_k = low if low and k < 2 else (key, n)
            c = contexts_of(key_k, k)[k]
            ok = c != 0
            c, n_k = c[ok], n_k[ok]
            pair, first, at = np.unique(_mix(c * _K + (key_k[ok] & np.uint64(255))), return_index=True, return_inverse=True)
            ctx, of = np.unique(c, return_inverse=True)
            contexts.append((ctx, np.bincount(of, n_k, len(ctx)), np.bincount(of[first], minlength=len(ctx)).astype(float)))
            pairs.append((pair, np.bincount(at, n_k, len(pair))))
        return cls(order, contexts, pairs)

    def log_p(self, data: np.ndarray, position: np.ndarray) -> np.ndarray:
        return self.log_p_of(keys(data, position, self.order))

    def log_p_of(self, key: np.ndarray) -> np.ndarray:
        p, data = np.full(len(key), 1 / 256), key & np.uint64(255)
        for c, (ctx, total, kinds), (pair, count) in zip(contexts_of(key, self.order), self.contexts, self.pairs):
            if not len(ctx):
                continue
            i = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            seen = (ctx[i] == c) & (c != 0)
            g = _mix(c * _K + data)
            j = np.minimum(np.searchsorted(pair, g), len(pair) - 1)
            n = np.where(pair[j] == g, count[j], 0.0)
            p = np.where(seen, (n + kinds[i] * p) / (total[i] + kinds[i]), p)
        return np.log(p)


def bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text ended by byte 0, their positions in the text, and the texts' offsets."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\0" for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    off[1:] = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    return data, np.arange(len(data)) - np.repeat(off[:-1], np.diff(off)), off


def encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") + b"\0" for t in texts]


def windows(raw: list[bytes], order: int, most: int = 1 << 17):
    """Keys of all bytes and the text of each, ``most`` bytes at a time, with the context before them."""
    off = np.concatenate([[0], np.cumsum(np.array([len(r) for r in raw], np.int64))])
    whole = np.frombuffer(b"".join(raw), np.uint8)
    for lo in range(0, len(whole), most):
        before = max(0, lo - order)
        at = np.arange(before, min(lo + most, len(whole)))
        text = np.searchsorted(off, at, "right") - 1
        yield keys(whole[at].astype(np.uint64), at - off[text], order)[lo - before :], text[lo - before :]


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0

    def score(self, texts: list[str], most: int = 1 << 17) -> np.ndarray:
        """Above 0: likelier accepted.  ``most`` bytes are scored at a time, with the context before them."""
        raw = encoded(texts)
        return self.sums(raw, most=most) / np.array([len(r) for r in raw], np.int64) - self.threshold

    def sums(self, raw: list[bytes], first: int = 0, last: int = 0xFFFF, most: int = 1 << 17) -> np.ndarray:
        """Per text, over the bytes whose two bytes before them are from ``first`` to ``last``."""
        out = np.zeros(len(raw))
        for key, text in windows(raw, self.accepted.order, most):
            pair = key >> np.uint64(8) & np.uint64(0xFFFF)
            mine = (pair >= np.uint64(first)) & (pair <= np.uint64(last))
            some, at = np.unique(key[mine], return_inverse=True)
            out += np.bincount(text[mine], (self.accepted.log_p_of(some) - self.rejected.log_p_of(some))[at], len(raw))
        return out


def _fit(good: list[str], bad: list[str], order: int) -> Ratio:
    return Ratio(Markov.fit(*bytes_of(good)[:2], order), Markov.fit(*bytes_of(bad)[:2], order))


def train(good: list[str], bad: list[str], order: int = 5) -> Ratio:
    """Fitted on three quarters, the threshold calibrated for equal error on the last, then fitted on all."""
    part = _fit([t for i, t in enumerate(good) if i % 4] or good, [t for i, t in enumerate(bad) if i % 4] or bad, order)
    g, b = part.score(good[::4]), part.score(bad[::4])
    cuts = np.unique(np.concatenate([g, b]))
    error = [np.mean(g < c) + np.mean(b >= c) for c in cuts]
    best = np.flatnonzero(np.array(error) <= min(error) + 1e-12)
    at = best[len(best) // 2]
    out = _fit(good, bad, order)
    out.threshold = float((cuts[at] + cuts[at - 1]) / 2 if at else cuts[at])
    return out


#: keys of a part of the models; bytes of urls that a worker holds while it goes through several parts
PART_GRAMS, HELD_BYTES = 1 << 19, 16 << 20
#: urls, or scores, of a task that puts them in order
PLACED_ROWS = 50_000


@dataclass
class Part:
    """Counted keys whose two bytes before the last are from ``first`` to ``last``, and all keys' counts by one byte before."""

    order: int
    first: int
    last: int
    counted: tuple
    low: tuple

    def ratio(self, held_out: bool) -> Ratio:
        """Models of all urls, or of all but those held out; made once a worker."""
        if getattr(self, "made", (None,))[0] != held_out:
            self.made = held_out, Ratio(self._model(False, held_out), self._model(True, held_out))
        return self.made[1]

    def _model(self, rejected: bool, held_out: bool) -> Markov:
        def of(key, n):
            mine = (key >> np.uint64(_REJECTED) & np.uint64(1)) == np.uint64(rejected)
            if held_out:
                mine &= (key >> np.uint64(_HELD) & np.uint64(1)) == 0
            return shorter(key[mine], self.order), n[mine]

        return Markov.of(*of(*self.counted), self.order, of(*self.low))


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = rows.select("gram", "n").toArrow()
    return found["gram"].to_numpy().astype(np.uint64), found["n"].to_numpy()


def _starts(sizes: dict[int, int]) -> list[int]:
    """How many come before each partition's first."""
    out = [0]
    for part in range(max(sizes) + 1):
        out.append(out[-1] + sizes.get(part, 0))
    return out


def _at(values: list[int], place: Column) -> Column:
    """The value of a place; one literal, however many."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")[place.cast("int")]


def placed(ruled: DataFrame, counts: dict[str, int], scratch: Scratch) -> DataFrame:
    """(verdict, site, held): in the order of the hashes, each class's first and every fourth after it is held out."""
    order = ["verdict", F.xxhash64("site"), "site"]
    rows = ruled.repartitionByRange(sum(counts.values()) // PLACED_ROWS + 1, *order).sortWithinPartitions(*order)
    rows = scratch.table(rows.withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    starts = _starts({r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()})
    place = _at(starts, part) + F.col("place").bitwiseAND((1 << 33) - 1)
    place = F.when(F.col("verdict") == "block", place - counts["allow"]).otherwise(place)  # those allowed come first
    return rows.select("verdict", "site", (place % 4 == 0).alias("held"))


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(gram, n) of ``rows(site, kind)``: how often each key occurs, with the kind over it."""

    def run(batches):
        for batch in batches:
            kind = batch.column("kind").to_numpy().astype(np.uint64)
            for key, text in windows(encoded(batch.column("site").to_pylist()), order, 1 << 20):
                gram, n = np.unique(key | kind[text] << np.uint64(_REJECTED), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return rows.select("site", F.col("kind").cast("long").alias("kind")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def parted(grams: DataFrame, order: int) -> list:
    """Functions that give workers the parts of the models."""
    pair = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    ends, held = [], 0
    for r in grams.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).orderBy("pair").collect():
        if held and held + r["n"] > PART_GRAMS:
            ends, held = [*ends, r["pair"] - 1], 0
        held += r["n"]
    before = F.least(F.shiftright("gram", _BEFORE).bitwiseAND(7), F.lit(1))
    one = F.col("gram").bitwiseAND(3 << _REJECTED | 0xFFFF).bitwiseOR(F.shiftleft(before, _BEFORE))
    low, out = _counts(grams.groupBy(one.alias("gram")).agg(F.sum("n").alias("n"))), []
    for first, last in zip([0, *(e + 1 for e in ends)], [*ends, 0xFFFF]):
        out.append(share(grams.sparkSession, Part(order, first, last, _counts(grams.where(pair.between(first, last))), low)))
    return out


def scorer(parts: list, held_out: bool):
    """The mean of a url's log-ratios, null where it is null; urls are held while the parts take turns."""
    most = HELD_BYTES if len(parts) > 1 else 0

    def scored(held: list):
        there = [s.notna().to_numpy() for s in held]
        raw = encoded([t for s, some in zip(held, there) for t in s[some]])
        total = np.zeros(len(raw))
        for part in parts if raw else ():
            p = part()
            total += p.ratio(held_out).sums(raw, p.first, p.last)
        total /= np.array([len(r) for r in raw], np.int64)
        lo = 0
        for some in there:
            out = np.full(len(some), np.nan)
            out[some] = total[lo : lo + some.sum()]
            lo += some.sum()
            yield pd.Series(out)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, size = [], 0
        for s in batches:
            held, size = [*held, s], size + s.str.len().sum()
            if size >= most:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    return F.pandas_udf(run, "double")


def calibrated(scores: DataFrame, scratch: Scratch) -> float:
    """The threshold of least error on ``scores(verdict, score)``, the middle one of several: halfway to the next score below.

    An error is the share of allowed urls below the threshold and that of blocked ones from it on, in whole numbers.
    """
    g, b = F.count_if(F.col("verdict") == "allow"), F.count_if(F.col("verdict") == "block")
    cuts = scratch.table(scores.groupBy("score").agg(g.alias("g"), b.alias("b")), "cuts")
    cuts = cuts.repartitionByRange(cuts.count() // PLACED_ROWS + 1, "score").withColumn("part", F.spark_partition_id())
    cuts = scratch.table(cuts, "ordered")
    sizes = cuts.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect()
    good, bad = (_starts({r["part"]: r[c] for r in sizes}) for c in "gb")
    here = Window.partitionBy("part").orderBy("score")
    below = [_at(starts, F.col("part")) + F.sum(c).over(here) - F.col(c) for c, starts in (("g", good), ("b", bad))]
    error = (below[0] * bad[-1] + (bad[-1] - below[1]) * good[-1]).alias("error")
    cuts = scratch.table(cuts.select("part", "score", F.lag("score").over(here).alias("under"), error), "errors")
    best = cuts.join(F.broadcast(cuts.agg(F.min("error").alias("error"))), "error")
    sizes = {r["part"]: r["n"] for r in best.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts = _starts(sizes)
    at = starts[-1] // 2
    part = next(p for p in sorted(sizes) if starts[p] <= at < starts[p + 1])
    cut = best.where(F.col("part") == part).orderBy("score").offset(at - starts[part]).limit(1).first()
    under = cut["under"] if cut["under"] is not None else cuts.where(F.col("part") < part).agg(F.max("score")).first()[0]
    return cut["score"] if under is None else (cut["score"] + under) / 2


def learn(found: DataFrame, order: int) -> tuple[list, float] | str:
    """The parts of the models and the threshold, from all urls with a rule; the default verdict where a class is missing."""
    scratch = Scratch(found.sparkSession, "urls")
    ruled = scratch.table(found.where("rule is not null").select("verdict", F.col("url").alias("site")).distinct(), "ruled")
    counts = {r["verdict"]: r["n"] for r in ruled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return next(iter(counts), "allow")
    rows, alone = placed(ruled, counts, scratch), [w for w, n in counts.items() if n == 1]
    # a class of one url has none to hold out from the models
    out = F.col("held") & ~F.col("verdict").isin(alone) if alone else F.col("held")
    kind = (F.col("verdict") == "block").cast("long") + 2 * out.cast("long")
    parts = parted(scratch.table(count_grams(rows.withColumn("kind", kind), order), "grams"), order)
    scores = rows.where("held").select("verdict", scorer(parts, True)("site").alias("score"))
    return parts, calibrated(scores, scratch)


def judge(pages: DataFrame, rules=RULES, order: int = 5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (null where a rule decides)."""
    own = ("host", "path", "rule", "verdict", "score")
    host, path = host_and_path()
    found = in_small_batches(pages).drop(*own).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(rules)
    found = found.withColumns({"rule": rule, "verdict": verdict})
    learned = learn(found, order)
    if isinstance(learned, str):
        return found.withColumns({"verdict": F.coalesce("verdict", F.lit(learned)), "score": F.lit(None).cast("double")})
    parts, threshold = learned
    site = F.when(F.col("rule").isNull(), F.coalesce("url", F.lit("")))
    found = found.withColumn("score", F.nanvl(scorer(parts, False)(site) - threshold, F.lit(None).cast("double")))
    return found.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0, "allow").otherwise("block")))
