"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Word counts per document; totals per source.  Targets: the weights' shares of all words, but at
   most ``most`` times a source's words; the excess is shared again by weight.
2. A source's documents fall by a hash into shards; a shard's documents, in a seeded order, are one
   stream of words, cut into blocks of nearly ``block_words``.  Sources whose target is less than
   200 such blocks are apportioned among themselves, in blocks of 8 words, and those of less than
   200 of these in blocks of a word: a small source is met as nearly, and changes no other's blocks.
3. Blocks go to sources by highest quotients ``target / (2 k + 1)``, the target counted in blocks of the
   source, which are a little more or less than ``block_words`` where shards are small; then from a source
   to its shards by the shards' blocks: integer quotas per shard, at most ``most`` times its blocks.
4. A quota of ``q`` of ``n`` blocks takes the whole stream ``q div n`` times and a seeded run of
   ``q mod n`` blocks, ``(j + c) mod n``, so no rank over blocks is needed.  A document takes the
   words that its span shares with the blocks chosen.  The stream's order is random, so a run is a
   random sample of documents; all but those at its two ends are whole in it or out of it, and
   rounding them to whole copies does not hang on their length or their source's share.

The driver sees one row a source and a shard, as Arrow columns, and loops over neither: a shard for
every ``shard_docs`` documents of a source, at most ``shards`` a source.  Shards are small, so a hot
source is many groups.  Rows of one id and size fall into one shard by their hash; a shard that they
crowd is dealt again by the number of the row among its equals, so that a hot id is many groups too.

Null texts have size 0 and take nothing; an empty table gives none.  A null source is a source.  Rows
that repeat a doc_id are documents of their own; equal ones are interchangeable, so reruns agree.
Weights are dealt to the sources by code point, null last.  Only the number of a text's words is
kept of it, so long texts cost one row.  ``mix`` passes extra columns through, but for the text and
those named like its own; ``remix`` passes all of them, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, Scratch, keep_small


def n_words(text: str = "text") -> Column:
    """Number of words; null texts have none."""
    parted = F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " +")
    return F.coalesce(F.size(F.filter(parted, lambda w: w != "")).cast("long"), F.lit(0))


def targets(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Shares of all words by weight; what is above ``most`` times a source's size is shared again."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, some = np.zeros(len(sizes)), np.flatnonzero(sizes > 0)
    # those with the fewest words for their weight reach their bound first
    some = some[np.argsort(sizes[some] / weights[some], kind="stable")]
    bound, weight = most * sizes[some], weights[some]
    left = sizes.sum() - np.concatenate([[0.0], np.cumsum(bound)])[: len(some)]
    open_ = np.cumsum(weight[::-1])[::-1]
    within = np.flatnonzero(left * weight <= bound * open_)
    k = int(within[0]) if len(within) else len(some)
    out[some[:k]] = bound[:k]
    if k < len(some):
        out[some[k:]] = left[k] * weight[k:] / open_[k]
    return out


def sainte_lague(votes: np.ndarray, caps: np.ndarray, seats, group: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients ``votes / (2 k + 1)``, ties to the first, with an upper bound each.

    With ``group``, every group deals its own ``seats`` among its members.  A multiplier found by
    bisection gives all but a few seats at once; those go to the highest quotients left.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    group = np.zeros(len(votes), np.int64) if group is None else group
    caps = np.where(votes > 0, caps, 0)
    sums = lambda x: np.bincount(group, x, len(seats)).astype(np.int64)
    seats = np.atleast_1d(np.asarray(seats, np.int64))
    seats = np.minimum(seats, sums(caps))
    at = lambda x: np.minimum(np.floor(votes * x[group] + 0.5).astype(np.int64), caps)
    lo, hi = np.zeros(len(seats)), np.ones(len(seats))
    while (short := sums(at(hi)) < seats).any():
        hi[short] *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        fits = sums(at(mid)) <= seats
        lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid)
    won = at(lo)
    while (rest := seats - sums(won)).any():
        quotient = np.where(won < caps, votes / (2 * won + 1), -1.0)
        order = np.lexsort((np.arange(len(votes)), -quotient, group))
        first = np.searchsorted(group[order], np.arange(len(seats)))
        ahead = np.arange(len(votes)) - first[group[order]] < rest[group[order]]
        won[order[ahead & (quotient[order] > 0)]] += 1
    return won


def _source_order(source):
    return (source is None, source.encode("utf-8") if source is not None else b"")


def _spread(crowded: DataFrame, seed: int) -> DataFrame:
    """Rows of crowded shards in new ones, by the row's number among those of its id and size."""
    key = ["source", "doc_id", "size"]
    per = crowded.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("before", F.coalesce(before, F.lit(0))).select(*[F.col(c).alias(f"k_{c}") for c in key], F.col("part").alias("k_part"), "before")
    own = F.row_number().over(Window.partitionBy(*key, "part").orderBy("place")) - 1
    rows = crowded.withColumn("own", own)
    same = [rows[c].eqNullSafe(per[f"k_{c}"]) for c in key]
    rows = rows.join(per, same[0] & same[1] & same[2] & (rows["part"] == per["k_part"]))
    return rows.withColumn("shard", F.expr(f"shard + parts * (1 + pmod(xxhash64({seed + 2}, doc_id, size, before + own), crowd))"))


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block_words: int = 256, shard_docs: int = 1000, shards: int = 1 << 18, seed: int = 7) -> DataFrame:
    """``documents`` without text, with size, source_size, target and taken."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "mix")
    rest = [c for c in documents.columns if c not in ("text", "size", "source_size", "target", "taken")]
    # the row's own columns travel in one, so that no name meets another
    sized = documents.select(F.struct(*rest).alias("row"), n_words().alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    sized = scratch.table(sized, "sizes").withColumns({"source": F.col("row.source"), "doc_id": F.col("row.doc_id")})
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).toArrow().to_pydict()
    order = sorted(range(len(totals["source"])), key=lambda i: _source_order(totals["source"][i]))
    names, sizes, docs = [totals["source"][i] for i in order], np.array(totals["n"], np.int64)[order], np.array(totals["docs"], np.int64)[order]
    cycle = np.resize(np.array(weights, float), len(names)) if names else np.zeros(0)
    goal = targets(sizes, cycle, most)
    parts = np.clip(-(-docs // shard_docs), 1, shards)

    of = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string()), "source_size": sizes, "target": goal, "parts": parts}))
    dealt = sized.join(keep_small(of, len(names)), sized["source"].eqNullSafe(of["name"])).drop("name")
    dealt = dealt.withColumn("shard", F.expr(f"pmod(xxhash64({seed}, doc_id, size), parts)"))
    sums = lambda rows: rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).toArrow()
    found = sums(dealt)
    crowd = -(-found["docs"].to_numpy() // shard_docs)
    if (full := crowd > 4).any():
        again = spark.createDataFrame(pa.table({"c_source": found["source"].filter(pa.array(full)), "c_shard": found["shard"].filter(pa.array(full)), "crowd": crowd[full]}))
        dealt = dealt.join(keep_small(again, int(full.sum())), dealt["source"].eqNullSafe(again["c_source"]) & (dealt["shard"] == again["c_shard"]), "left").drop("c_source", "c_shard")
        spread = scratch.table(_spread(dealt.where("crowd is not null"), seed).select("row", "size", "source", "doc_id", "source_size", "target", "shard"), "spread")
        dealt = dealt.where("crowd is null").select(*spread.columns).unionByName(spread)
        found = pa.concat_tables([found.filter(pa.array(~full)), sums(spread)])
    found = found.filter(pa.array(found["words"].to_numpy() > 0)) if len(found) else found

    place = {name: i for i, name in enumerate(names)}
    words, shard = found["words"].to_numpy().astype(np.int64), found["shard"].to_numpy().astype(np.int64)
    whose = np.array([place[s] for s in found["source"].to_pylist()], np.int64)
    by_shard = np.lexsort((shard, whose))
    words, shard, whose = words[by_shard], shard[by_shard], whose[by_shard]
    block = np.where(goal >= 200 * block_words, block_words, np.where(goal >= 200 * 8, min(8, block_words), 1))
    blocks = np.maximum(1, np.rint(words / block[whose])).astype(np.int64)
    in_source = np.bincount(whose, blocks, len(names)).astype(np.int64)
    kinds, kind = np.unique(block, return_inverse=True)
    wanted = goal * in_source / np.maximum(sizes, 1)
    seats = sainte_lague(wanted, most * in_source, np.rint(np.bincount(kind, wanted, len(kinds))), kind) if names else np.zeros(0, np.int64)
    quota = sainte_lague(blocks, most * blocks, seats, whose) if len(words) else np.zeros(0, np.int64)

    plan = spark.createDataFrame(pa.table({"p_source": pa.array([names[i] for i in whose], pa.string()), "p_shard": shard, "words": words, "n": blocks, "quota": quota, "c": (seed * 7919 + 31 * shard) % np.maximum(blocks, 1)}))
    stream = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    placed = placed.join(keep_small(plan, len(words)), placed["source"].eqNullSafe(plan["p_source"]) & (placed["shard"] == plan["p_shard"]), "left")
    part = """aggregate(sequence(((start + 1) * n - 1) div words, ((start + size) * n - 1) div words), 0L, (t, j) ->
      if(pmod(j + c, n) < quota % n, t + least(start + size, ((j + 1) * words) div n) - greatest(start, (j * words) div n), t))"""
    taken = F.expr(f"case when size = 0 or words is null then 0L when quota % n = 0 then size * (quota div n) else size * (quota div n) + {part} end")
    return placed.select("row.*", "size", "source_size", "target", taken.alias("taken"))


def remix(documents: DataFrame, **parameters) -> DataFrame:
    """Whole documents by what the mix takes of them: the nearest number of copies, none included.

    Rows of one id and text are one document on several rows, which get equally many.
    """
    scratch, text = Scratch(documents.sparkSession, "remix"), F.xxhash64("text")
    taken = mix(documents.select("doc_id", "source", "text", text.alias("h")), **parameters).groupBy("doc_id", "h").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    n = F.expr("if(s = 0, 0, cast(floor((2 * t + s) / (2 * s)) as int))")
    copies = scratch.table(taken.select("doc_id", "h", n.alias("n")).where("n > 0"), "copies")
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").alias("own_id"), text.alias("own_h"))
    out = rows.join(keep_small(copies, copies.count()), rows["own_id"].eqNullSafe(copies["doc_id"]) & (rows["own_h"] == copies["h"]))
    return out.select("row", F.explode(F.expr("sequence(1, n)"))).select("row.*")
