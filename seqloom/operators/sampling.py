"""Samples, folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Lcg:
    """The 48-bit linear congruential generator of ``java.util.Random``."""

    def __init__(self, seed: int):
        self.seed = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self, bits: int) -> int:
        self.seed = (self.seed * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.seed >> (48 - bits)

    def next_int(self, n: int) -> int:
        if n & (n - 1) == 0:
            return (n * self._next(31)) >> 31
        while True:
            b = self._next(31)
            v = b % n
            if b - v + (n - 1) < 1 << 31:
                return v


def draw_places(size: int, n: int, seed: int = 12345) -> list[int]:
    """``n`` different places below ``size`` in drawing order, by rejection; nothing of the pool itself is held."""
    if n > size:
        raise ValueError(f"{n} of {size} members")
    rng, out, seen = Lcg(seed), [], set()
    while len(out) < n:
        if (v := rng.next_int(size)) not in seen:
            seen.add(v)
            out.append(v)
    return out


def draw(pool: list[int], n: int, seed: int = 12345) -> list[int]:
    """``n`` different members in drawing order."""
    return [pool[i] for i in draw_places(len(pool), n, seed)]


def draw_fold(rows: DataFrame, labels: int, folds: int, fold: int, seed: int = 12345, key: str = "seq_id") -> DataFrame:
    """(key, is_labeled) of the drawn members: ``labels * folds`` places of ``rows``, the pool, in the key's order.

    The ``fold``-th ``labels`` of them are labelled.  Keys are gapless, so a place is a difference of keys.
    """
    pool = rows.agg(F.min(key).alias("lo"), F.count("*").alias("n")).first()
    places = draw_places(pool["n"], labels * folds, seed)
    mine = [(int(pool["lo"]) + p,) for p in places[fold * labels : (fold + 1) * labels]]
    return rows.sparkSession.createDataFrame(mine, f"{key} long").withColumn("is_labeled", F.lit(True))


def ordered_sample(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a seeded order: a top-n, not a sort of all rows."""
    return rows.orderBy(*order).limit(n)


def split(rows: DataFrame, sample: DataFrame, key: str = "seq_id") -> tuple[DataFrame, DataFrame]:
    """(drawn, the others)."""
    return rows.join(sample.select(key), key, "left_semi"), rows.join(sample.select(key), key, "left_anti")


def fold_split(rows: DataFrame, labels: int, folds: int, fold: int, *order: Column, key: str = "seq_id") -> DataFrame:
    """rows with ``split``: the ``fold``-th ``labels`` of a draw of ``labels * folds`` are train, all else test."""
    drawn = ordered_sample(rows.select(key, *order).distinct(), labels * folds, *order)
    rank = F.row_number().over(Window.orderBy(*order)) - 1  # over the drawn rows only
    part = drawn.withColumn("_fold", F.floor(rank / labels)).where(F.col("_fold") == fold).select(key, F.lit("train").alias("split"))
    return rows.join(F.broadcast(part), key, "left").withColumn("split", F.coalesce("split", F.lit("test")))


def round_robin(rows: DataFrame, stratum: str, *order: Column, key: str = "seq_id") -> DataFrame:
    """``round``: the member's turn within its stratum."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)) - 1)


def stratified_sample(rows: DataFrame, stratum: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` in turns over the strata."""
    return round_robin(rows, stratum, *order).orderBy("round", stratum).limit(n)
