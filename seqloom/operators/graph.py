"""Similarity graphs: exact nearest neighbours in blocks, their closures, statistics and label propagation.

Graphs are directed edges ``(src, dst, weight)``; distributions are ``(node, p array)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import release, settle

_DIGITS = 9  # similarities are compared after rounding, so that ranks do not hang on the last bit


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(node, vector) of length 1, in double; null and zero vectors have no direction and go."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    out = vectors.select(F.col(id_col).cast("long").alias("node"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("_n", norm).where("_n > 0").select("node", F.transform("v", lambda x: x / F.col("_n")).alias("vector"))


class _Rows:
    """Vectors in the order of their ids: a matrix, or with ``cuts`` features and values of each row, one row behind the other."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, feature: np.ndarray | None = None, cuts: np.ndarray | None = None):
        self.ids, self.values, self.feature, self.cuts = ids, values, feature, cuts

    @classmethod
    def of(cls, table: pa.Table) -> _Rows:
        table = table.sort_by("node").combine_chunks()
        ids = table["node"].to_numpy()
        flat = lambda c: pc.list_flatten(table[c].combine_chunks()).to_numpy()
        if "vector" in table.column_names:
            return cls(ids, flat("vector").reshape(len(ids), -1) if len(ids) else np.zeros((0, 1)))
        size = pc.list_value_length(table["feature"]).to_numpy().astype(np.int64)
        return cls(ids, flat("value"), flat("feature"), np.concatenate([[0], np.cumsum(size)]))

    def __len__(self) -> int:
        return len(self.ids)

    def tiles(self, block: int) -> list[tuple[int, _Rows]]:
        out = []
        for lo in range(0, len(self), block):
            ids = self.ids[lo : lo + block]
            if self.cuts is None:
                out.append((lo, _Rows(ids, self.values[lo : lo + block])))
            else:
                cuts = self.cuts[lo : lo + len(ids) + 1]
                at = slice(cuts[0], cuts[-1])
                out.append((lo, _Rows(ids, self.values[at], self.feature[at], cuts - cuts[0])))
        return out


def _dense(a: _Rows, b: _Rows) -> np.ndarray:
    return a.values @ b.values.T


def _sparse(a: _Rows, b: _Rows) -> np.ndarray:
    """Products over shared features only, a bounded number at a time."""

    def long(rows):
        return np.repeat(np.arange(len(rows)), np.diff(rows.cuts)), rows.feature, rows.values

    (ra, fa, va), (rb, fb, vb) = long(a), long(b)
    order = np.argsort(fb, kind="stable")
    rb, fb, vb = rb[order], fb[order], vb[order]
    lo, hi = np.searchsorted(fb, fa, "left"), np.searchsorted(fb, fa, "right")
    n, out = hi - lo, np.zeros(len(a) * len(b))
    total = np.cumsum(n)
    start = 0
    while start < len(n):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + (1 << 21), "right")))
        m = n[start:end]
        left = np.repeat(np.arange(start, end), m)
        right = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[start:end], m)
        out += np.bincount(ra[left] * len(b) + rb[right], va[left] * vb[right], len(out))
        start = end
    return out.reshape(len(a), len(b))


class _Best:
    """The k most similar others of each row so far, ties to the smaller id.  Others are offered in the order of their ids."""

    def __init__(self, rows: int, k: int, least: float):
        self.k, self.least = k, least
        self.sim, self.dst = np.full((rows, k), -np.inf), np.zeros((rows, k), np.int64)
        self.cut = np.full(rows, least - 10.0**-_DIGITS)  # no similarity up to here gets in

    def offer(self, at: int, rows: np.ndarray, others: np.ndarray, sim: np.ndarray, axis: int) -> None:
        """``sim`` has the rows along ``axis``; ``at`` is the first one's place."""
        n, m, own = len(rows), len(others), slice(at, at + len(rows))
        cut = self.cut[own]
        take = self.k + 1  # a node may meet itself
        if m > take and not np.isfinite(self.sim[own, -1]).all():
            floor = np.partition(sim, m - take, axis=1 - axis).take(m - take, axis=1 - axis)
            cut = np.maximum(cut, floor - 2 * 10.0**-_DIGITS)
        found = np.flatnonzero(sim > (cut[:, None] if axis == 0 else cut[None, :]))
        r, c = np.divmod(found, sim.shape[1])
        value = np.round(sim[r, c], _DIGITS)
        if axis:
            r, c = c, r
        r = r + at
        keep = (value > self.least) & (value > self.sim[r, -1]) & (rows[r - at] != others[c])
        r, c, value = r[keep], c[keep], value[keep]
        if not len(r):
            return
        some = np.unique(r)
        row = np.concatenate([np.repeat(some, self.k), r])
        value = np.concatenate([self.sim[some].ravel(), value])
        dst = np.concatenate([self.dst[some].ravel(), others[c]])
        order = np.lexsort((dst, -value, row))
        row, value, dst = row[order], value[order], dst[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        self.sim[row[keep], nth[keep]], self.dst[row[keep], nth[keep]] = value[keep], dst[keep]
        last = self.sim[some, -1]
        half = 10.0**-_DIGITS / 2 - 1e-12 * np.maximum(1, np.abs(last))  # what rounds to the last one or less stays out
        self.cut[some] = np.where(np.isfinite(last), last + half, self.cut[some])

    def edges(self, rows: np.ndarray) -> pa.RecordBatch:
        r, nth = np.nonzero(np.isfinite(self.sim))
        return pa.RecordBatch.from_arrays([pa.array(rows[r]), pa.array(self.dst[r, nth]), pa.array(self.sim[r, nth])], names=["src", "dst", "sim"])


def block_pairs(nodes: DataFrame, parts: int) -> DataFrame:
    """``nodes`` with b, their block, once for each pair of blocks (p, q), p <= q, that the block is in."""
    dealt = nodes.withColumn("b", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.struct(F.least("b", j).alias("p"), F.greatest("b", j).alias("q")))
    return dealt.withColumn("g", F.explode(pair)).select("*", "g.p", "g.q").drop("g")


#: nodes and bytes of vectors of a part at most; parts go in pairs, about so many to each core
HELD_NODES, HELD_BYTES, PAIRS_A_CORE = 1 << 16, 64 << 20, 3


def _parts(nodes: int, values: int, cores: int, block: int) -> int:
    """Parts of the nodes: as few as give every core some pairs, for each node is copied once a part, and none beyond what is held."""
    pairs = PAIRS_A_CORE * cores
    enough = int(np.ceil((np.sqrt(8 * pairs + 1) - 1) / 2))
    return max(1, -(-nodes // HELD_NODES), -(-8 * values // HELD_BYTES), min(enough, -(-nodes // block)))


def nearest(nodes: DataFrame, k: int, least: float = 0.0, block: int = 2048, sparse: bool = False) -> DataFrame:
    """(src, dst, sim, rank): each node's k most similar ones above ``least``, exactly.

    ``nodes``: ``(node, vector)``, or with ``sparse`` ``(node, feature array<long>, value array<double>)``.
    Nodes are dealt to parts; every pair of parts is one task, which compares ``block`` nodes with as many at a
    time and hands on k rows a node, never pairs.  The work grows with the square of the nodes, as exact search
    does; a node is copied once for each part, and the number of parts follows the cores, up to
    ``HELD_NODES`` nodes a part, so copies grow as the nodes do until a part is full.
    """
    columns = ["node", "feature", "value"] if sparse else ["node", "vector"]
    nodes = settle(nodes.select(*columns))
    n = nodes.agg(F.count("*").alias("n"), F.sum(F.size(columns[-1]).cast("long")).alias("values")).first()
    parts = _parts(n["n"], (n["values"] or 0) * (2 if sparse else 1), nodes.sparkSession.sparkContext.defaultParallelism, block)
    product = _sparse if sparse else _dense

    def solve(batches):
        got = [b for b in batches if b.num_rows]
        whole = pa.Table.from_batches(got) if got else None
        pairs = whole.group_by(["p", "q"]).aggregate([]).to_pylist() if got else []
        del got
        for pair in pairs:
            here = whole if len(pairs) == 1 else whole.filter((pc.field("p") == pair["p"]) & (pc.field("q") == pair["q"]))
            a, b = (_Rows.of(here.filter(pc.field("b") == pair[x]).select(columns)) for x in "pq")
            same = pair["p"] == pair["q"]
            of_a, of_b = _Best(len(a), k, least), None if same else _Best(len(b), k, least)
            others = b.tiles(block)
            for i, x in a.tiles(block):
                for j, y in others:
                    sim = product(x, y)
                    of_a.offer(i, x.ids, y.ids, sim, 0)
                    if not same:
                        of_b.offer(j, y.ids, x.ids, sim, 1)
            yield of_a.edges(a.ids)
            if not same:
                yield of_b.edges(b.ids)

    pair = (F.col("p") * parts - F.expr("p * (p - 1) div 2") + F.col("q") - F.col("p")).cast("int")
    found = block_pairs(nodes, parts).repartitionById(parts * (parts + 1) // 2, pair).mapInArrow(solve, "src long, dst long, sim double")
    w = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_nodes(vectors: DataFrame) -> DataFrame:
    """(ngram, feature, value) rows as one row a node; the node's key is a hash of its n-gram."""
    some = vectors.where("value is not null and value <> 0")
    return some.groupBy("ngram").agg(F.collect_list(F.struct(F.xxhash64("feature").alias("f"), "value")).alias("v")).select(F.xxhash64("ngram").alias("node"), "ngram", F.col("v.f").alias("feature"), F.col("v.value").alias("value"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that are there in both directions."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").where("weight > 0")


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(back).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("n"), F.sum("weight").alias("degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, weight, average, most and least neighbours, nodes without any and their percentage."""
    per = nodes.select("node").join(degrees(edges).withColumnRenamed("src", "node"), "node", "left")
    n = F.coalesce("n", F.lit(0))
    return per.agg(F.sum(n).alias("n_edges"), F.sum(F.coalesce("degree", F.lit(0.0))).alias("weight"), F.avg(n).alias("avg_degree"), F.max(n).alias("max_degree"), F.min(n).alias("min_degree"), F.sum((n == 0).cast("long")).alias("n_empty"), (F.sum((n == 0).cast("long")) * 100.0 / F.count("*")).alias("empty_percent"))


def _weighted(edges: DataFrame, q: DataFrame, states: int) -> DataFrame:
    """Per src: degree, weighted sums of the neighbours' distributions and of their squares, map-side combined."""
    joined = edges.where("weight > 0").join(q.select(F.col("node").alias("dst"), "p"), "dst")
    sums = [F.sum(F.col("weight") * F.col("p")[k]).alias(f"s{k}") for k in range(states)]
    square = F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x)
    out = joined.groupBy("src").agg(F.sum("weight").alias("degree"), F.sum(F.col("weight") * square).alias("square"), *sums)
    return out.select(F.col("src").alias("node"), "degree", "square", F.array(*[f"s{k}" for k in range(states)]).alias("pull"))


def violation(edges: DataFrame, q: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """One row: sum over edges w q_n (q_n - q_e), over nodes with a frequency where given."""
    a = q.select(F.col("node").alias("src"), F.col("p").alias("a"))
    b = q.select(F.col("node").alias("dst"), F.col("p").alias("b"))
    rows = edges if frequencies is None else edges.join(frequencies.where("freq > 0").select(F.col("node").alias("src")), "src", "left_semi")
    term = F.aggregate(F.zip_with("a", "b", lambda x, y: x * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return rows.join(a, "src").join(b, "dst").agg(F.sum(F.col("weight") * term).alias("violation"))


def gold_violation(edges: DataFrame, q: DataFrame) -> DataFrame:
    """One row: half the weighted squared differences along edges."""
    a = q.select(F.col("node").alias("src"), F.col("p").alias("a"))
    b = q.select(F.col("node").alias("dst"), F.col("p").alias("b"))
    term = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return edges.join(a, "src").join(b, "dst").agg((F.sum(F.col("weight") * term) / 2).alias("violation"))


def gradient(edges: DataFrame, q: DataFrame, frequencies: DataFrame, states: int) -> DataFrame:
    """(node, grad array): (degree q_n - sum w q_e) / freq, once a node instead of once a token."""
    pull = _weighted(edges, q, states)
    out = pull.join(q, "node").join(frequencies.where("freq > 0"), "node")
    return out.select("node", F.zip_with("p", "pull", lambda p, s: p * F.col("degree") - s).alias("g"), "freq").select("node", F.transform("g", lambda x: x / F.col("freq")).alias("grad"))


def norms(rows: DataFrame, column: str) -> DataFrame:
    """One row: the squared norm of all entries of an array column, and the norm."""
    own = F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x * x)
    return rows.agg(F.sum(own).alias("squared")).select("squared", F.sqrt("squared").alias("norm"))


def seed_distribution(nodes: DataFrame, states: int) -> DataFrame:
    """(node, fixed, p) of ``nodes(node, label)``; a null label is uniform and free."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda k: (k == F.col("label")).cast("double"))
    uniform = F.array_repeat(F.lit(1.0 / states), states)
    return nodes.select("node", F.col("label").isNotNull().alias("fixed"), F.when(F.col("label").isNull(), uniform).otherwise(hot).alias("p"))


def propagate_once(edges: DataFrame, q: DataFrame, states: int, eta: float) -> DataFrame:
    """One Jacobi step of free nodes against all, clipped at 0 and normalised: (node, fixed, p, rough).

    ``rough`` is the node's part of the roughness before the step, from the same sums.
    """
    from ..functions.text import clip_normalize

    pull = _weighted(edges, q.select("node", "p"), states)
    moved = q.select("node", "fixed", "p").join(pull, "node", "left")
    step = F.when(F.col("fixed") | F.col("pull").isNull(), F.col("p")).otherwise(F.coalesce(clip_normalize(F.zip_with("p", "pull", lambda p, s: p - eta * (p * F.col("degree") - s))), F.col("p")))
    own = F.aggregate(F.zip_with("p", "pull", lambda p, s: p * (p * F.col("degree") - 2 * s)), F.lit(0.0), lambda a, x: a + x)
    return moved.select("node", "fixed", step.alias("p"), F.coalesce(own + F.col("square"), F.lit(0.0)).alias("rough"))


def roughness(edges: DataFrame, q: DataFrame) -> float:
    """Sum over edges of w |q_i - q_e|^2."""
    return float(gold_violation(edges.where("weight > 0"), q).first()[0] or 0.0) * 2


def propagate(edges: DataFrame, q: DataFrame, states: int, iterations: int = 3000, step: float = 0.05, stop: float = 1e-4) -> tuple[DataFrame, int, float]:
    """Label propagation until the relative change of roughness is small: (q, iterations, roughness).

    An iteration is one job that ends in a durable table, and a sum over it; the table before it is deleted.
    """
    edges, q, before, r = settle(edges), settle(q), 0.0, 0.0
    for t in range(iterations):
        moved = settle(propagate_once(edges, q, states, step / (1 + t**0.5)))
        r = float(moved.agg(F.sum("rough")).first()[0] or 0.0)
        if t and before and abs((r - before) / before) < stop:
            release(moved)
            return q, t, r
        release(q)
        before, q = r, moved
    return q.select("node", "fixed", "p"), iterations, r


def coverage(sequences: DataFrame, punctuation: int | None = None) -> DataFrame:
    """One row over ``sequences(tags, nodes, is_labeled)``: tokens, those on the graph of train and test, test punctuation off the graph, test tokens."""
    t = sequences.select("is_labeled", F.explode(F.arrays_zip("tags", "nodes")).alias("t")).select("is_labeled", "t.tags", "t.nodes")
    on, count = F.col("nodes").isNotNull(), lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    mark = ~on & (F.col("tags") == punctuation) if punctuation is not None else F.lit(False)
    other = ~F.col("is_labeled")
    return t.agg(F.count("*").alias("tokens"), count(on & F.col("is_labeled")).alias("train_covered"), count(on & other).alias("test_covered"), count(mark & other).alias("test_punct"), count(other).alias("test_all"))


def test_accuracy(sequences: DataFrame, labels: DataFrame, punctuation: int | None = None) -> DataFrame:
    """One row: acc, in percent of all test tokens: those whose node's label is their tag, and punctuation off the graph."""
    t = sequences.where("not is_labeled").select(F.explode(F.arrays_zip("tags", "nodes")).alias("t")).select("t.tags", F.col("t.nodes").alias("node"))
    # a node's tokens are counted once a tag, so that the join is one row a node and tag
    per = t.groupBy("node", "tags").agg(F.count("*").alias("n")).join(labels, "node", "left")
    right = F.col("label") == F.col("tags")
    if punctuation is not None:
        right = F.when(F.col("node").isNull(), F.col("tags") == punctuation).otherwise(right)
    return per.agg((100.0 * F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"))


test_accuracy.__test__ = False  # not a test, whatever its name


def hard_labels(q: DataFrame) -> DataFrame:
    from ..functions.text import argmax

    return q.select("node", argmax(F.col("p")).alias("label"))
