"""Exact top-k search of binary codes by incremental multi-index hashing (Norouzi et al., 2012).

A code of ``bits`` bits is parted into segments.  If two codes differ in fewer than
``segments * (r + 1)`` bits, some segment differs in at most ``r``.  So round ``r`` looks up every
segment value at distance exactly ``r`` from the query's, verifies what it meets by the full Hamming
distance, keeps the best ``k``, and a query is done when its k-th distance is below
``segments * (r + 1)``: nothing nearer can be left.  Only queries not yet done go on.

Rows with equal codes are one entry with its ``k`` least ids, so a hot code is one row; equal
queries are one query.  A lookup hands on only what beats the query's k-th best so far.  Both sides of a lookup are shuffled on (segment, value) and merged,
whatever their estimated size: lookups are made from a small table, by a row a probe, and would reach the driver as a broadcast.  Hot segment values
are split by adaptive execution.  Where a round's lookups would outnumber the codes, the queries
left are held against all codes in blocks instead, which is exact as well.

Null vectors, null ids, and vectors of another length have no code and are neither found nor asked; an empty table
gives none.  Ties go to the smaller id.  Repeated rows of an id are one entry where their codes are equal.  Only the id
and the code of a row are kept, so extra columns of any name do not matter; there is no text in it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def codes(vectors: DataFrame, bits: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit ``i`` says that component ``i`` is positive; NaN and null are not."""
    v = F.col(vector_col)
    code = F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (c, i) -> if(v[i] > 0 and not isnan(v[i]), c | shiftleft(1L, i), c))")
    return vectors.where(F.col(id_col).isNotNull() & (F.size(v) == bits)).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).select("id", code.alias("code"))


def segments_of(n_codes: int, bits: int) -> int:
    """About log2(n) bits a segment, at most 16, which parts the codes evenly."""
    width = min(16, max(4, int(math.log2(max(2, n_codes)))))
    return -(-bits // width)


def flips(width: int, r: int) -> list[int]:
    out = [0]
    for _ in range(r):
        out = sorted({m | 1 << i for m in out for i in range(width) if not m >> i & 1})
    return out


def _merged(df: DataFrame) -> DataFrame:
    """To be shuffled and sorted where it is joined; Spark's estimate does not count what ``explode`` adds."""
    return df.hint("merge")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Per query the k best of (d, id), by a map-side combined minimum list."""
    kept = F.expr(f"slice(array_sort(collect_set(struct(d, id))), 1, {k})")
    # two steps: no task gathers all of a query's candidates
    part = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))).groupBy("query", "salt").agg(kept.alias("b"))
    return part.groupBy("query").agg(F.expr(f"slice(array_sort(flatten(collect_list(b))), 1, {k})").alias("best"))


def top_k(entries: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, segments: int | None = None) -> DataFrame:
    """(query, rank, id, distance) for ``queries(id, code)`` against ``entries(id, code)``; a query finds itself too."""
    scratch = Scratch(entries.sparkSession, "topk")
    ranked = entries.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    least = lambda c: f"slice(array_sort({c}), 1, {k})"
    index = ranked.groupBy("code", "salt").agg(F.expr(least("collect_set(id)")).alias("ids")).groupBy("code").agg(F.expr(least("flatten(collect_list(ids))")).alias("ids"))
    index = scratch.table(index, "index")
    asked = scratch.table(queries.select("code").distinct(), "asked")
    n_codes, n_asked = index.count(), asked.count()
    m = segments or segments_of(n_codes, bits)
    width = -(-bits // m)
    mask = (1 << width) - 1

    def parted(df: DataFrame, *more) -> DataFrame:
        seg = F.explode(F.expr(f"transform(sequence(0, {m - 1}), s -> struct(s as s, shiftrightunsigned(code, s * {width}) & {mask}L as value))")).alias("seg")
        return df.select("code", *more, seg).select("code", *more, "seg.s", "seg.value")

    table = scratch.table(parted(index, "ids"), "segments")
    # what is known of a query's k-th best: its distance and id
    none = {"bound": F.lit(bits + 1), "bound_id": F.lit(0).cast("long")}
    open_, best, done = asked.withColumns(none), None, []
    r = 0
    while n_asked:
        probes = flips(width, r) if r <= width else []
        if r > width or (len(probes) * m > n_codes and r > 0):
            done.append(scratch.table(scan(index, open_.select("code"), k), "scanned"))
            break
        masks = F.split(F.lit(",".join(map(str, probes))), ",").cast("array<long>")  # one literal, however many
        look = parted(open_, "bound", "bound_id").withColumnRenamed("code", "query").withColumn("value", F.explode(F.transform(masks, lambda x: F.col("value").bitwiseXOR(x))))
        d = F.bit_count(look["query"].bitwiseXOR(table["code"]))
        better = (d < look["bound"]) | ((d == look["bound"]) & (table["ids"][0] < look["bound_id"]))
        met = look.join(_merged(table), (look["s"] == table["s"]) & (look["value"] == table["value"]) & better).select("query", "code", "ids").dropDuplicates(["query", "code"])
        found = met.select("query", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("d"), F.explode("ids").alias("id"))
        if best is not None:
            found = found.unionByName(best.select("query", F.explode("best").alias("b")).select("query", "b.d", "b.id"))
        best = scratch.table(_best(found, k), f"best{r}")
        full, last = F.size("best") >= k, F.element_at("best", -1)
        proved = full & (last["d"] < m * (r + 1))
        done.append(scratch.table(best.where(proved), f"done{r}"))
        known = best.select(F.col("query").alias("code"), F.when(full, last["d"]).otherwise(bits + 1).alias("bound"), F.when(full, last["id"]).otherwise(0).alias("bound_id"), proved.alias("proved"))
        open_ = open_.select("code").join(_merged(known), "code", "left").where(~F.coalesce("proved", F.lit(False)))
        open_ = scratch.table(open_.select("code", F.coalesce("bound", none["bound"]).alias("bound"), F.coalesce("bound_id", none["bound_id"]).alias("bound_id")), f"open{r}")
        best = best.where(~proved)
        n_asked, r = open_.count(), r + 1
    if not done:
        return entries.sparkSession.createDataFrame([], "query long, rank int, id long, distance int")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = queries.select(F.col("id").alias("asked"), "code").distinct().join(_merged(out.withColumnRenamed("query", "code")), "code")
    out = out.select("asked", F.posexplode("best").alias("rank", "b"))
    return out.select(F.col("asked").alias("query"), (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("id"), F.col("b.d").cast("int").alias("distance"))


def scan(index: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query, best): the queries against all codes, in blocks of queries that the driver never holds together.

    A block is one job, whose result is written; the plan does not grow with the blocks.
    """
    spark, scratch = index.sparkSession, Scratch(index.sparkSession, "scan")
    parts = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts)))
    for part in range(parts):
        mine = np.array([row["code"] for row in dealt.where(F.col("part") == part).select("code").collect()], np.int64)
        shared = spark.sparkContext.broadcast(mine)

        def run(batches, shared=shared):
            asked = shared.value.view(np.uint64)
            for batch in batches:
                code = batch.column("code").to_numpy().view(np.uint64)
                ids = batch.column("ids").to_pylist()
                take = min(k, len(code))
                if not take:
                    continue
                least = np.array([i[0] for i in ids], np.int64)
                for lo in range(0, len(asked), 256):
                    d = np.bitwise_count(asked[lo : lo + 256, None] ^ code[None])
                    for q, row in zip(asked[lo : lo + 256].view(np.int64).tolist(), d):
                        near = np.lexsort((least, row))[:take]
                        pairs = [(q, int(row[j]), i) for j in near.tolist() for i in ids[j]]
                        yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in range(3)], names=["query", "d", "id"])

        found = _best(index.mapInArrow(run, "query long, d long, id long").withColumn("d", F.col("d").cast("int")), k)
        scratch.table(found, f"part={part}")
        shared.unpersist()
    return spark.read.schema(found.schema).parquet(f"{scratch.root}/*")


def search(vectors: DataFrame, every: int = 100, k: int = 10, bits: int = 64) -> DataFrame:
    """Every row whose id is divisible by ``every``, against all rows."""
    own = codes(vectors, bits)
    return top_k(own, own.where(F.col("id") % every == 0), k, bits)


ORACLE = """
with c as (select distinct vec_id id, list_transform(embedding, lambda x: case when x > 0 and not isnan(x) then 1 else 0 end) b from embeddings where len(embedding) = 64 and vec_id is not null),
d as (select q.id query, c.id, list_aggregate(list_transform(list_zip(q.b, c.b), lambda z: (z[1] <> z[2])::int), 'sum')::int distance from c q, c where q.id % 100 = 0)
select query, row_number() over (partition by query order by distance, id)::int as rank, id, distance from d qualify rank <= 10"""
