"""Connected components by alternating large-star and small-star (Kiveris et al., 2014).

Edges stay in the cluster; only their count and a checksum reach the driver.  Every round is a
pair of minima over neighbours, handed back to the edges, and ends in a scratch table, so a lost
executor costs one round.  Minima are made, and handed back, over the node and a salt of the
neighbour, so that a star's hot centre is spread over ``_SALTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


_SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with m, the least v of the u."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)))
    part = salted.groupBy("u", "salt").agg(F.min("v").alias("p"))
    whole = part.groupBy("u").agg(F.min("p").alias("m"))
    return salted.join(part.select("u", "salt").join(whole, "u"), ["u", "salt"]).select("u", "v", "m")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges point from the larger to the smaller node (u > v)."""
    if large:  # every neighbour; those larger than u move to the least
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:  # the smaller neighbours and u itself move to the least of them
        moved = _with_least(edges).select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links ``edges(a, b)``; the component is its least node."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = scratch.table(links, f"{name}0"), None
    for turn in range(1, most_rounds + 1):
        # the large star of round one starts from what was just written
        current = scratch.table(_star(_star(current, True), False), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
