import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import graph, sampling


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def test_nearest_in_blocks_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, (60, 4)).astype(float)
    x[0] = 0  # no direction
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in graph.nearest(graph.unit_vectors(df, "id", "v"), 5, block=16).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    n = np.linalg.norm(x, axis=1)
    for i in range(60):
        if n[i] == 0:
            assert i not in got
            continue
        sims = [(-round(float(x[i] @ x[j] / (n[i] * n[j])), 9), j) for j in range(60) if j != i and n[j] > 0]
        want = [j for s, j in sorted(sims) if s < 0][:5]
        assert [j for _, j in sorted(got.get(i, []))] == want


def test_sparse_nearest_equals_dense(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((40, 12)) < 0.4, rng.random((40, 12)), 0.0)
    x[:, 0] = 1.0  # a feature that all share
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<double>")
    sparse = spark.createDataFrame([(i, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(x)], "node long, feature array<long>, value array<double>")
    a = sorted((r["src"], r["rank"], r["dst"]) for r in graph.nearest(dense, 4, block=16).collect())
    b = sorted((r["src"], r["rank"], r["dst"]) for r in graph.nearest(sparse, 4, block=16, sparse=True).collect())
    assert a == b


def test_mutual_and_symmetric(spark):
    top = edges_of(spark, [(1, 2, 0.9), (2, 1, 0.9), (3, 1, 0.8)])
    assert {(r["src"], r["dst"]) for r in graph.mutual(top).collect()} == {(1, 2), (2, 1)}
    assert {(r["src"], r["dst"]) for r in graph.symmetric(top).collect()} == {(1, 2), (2, 1), (3, 1), (1, 3)}


def test_violations(spark):
    e = edges_of(spark, [(1, 2, 0.8), (2, 1, 0.8)])
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "node long, p array<double>")
    assert graph.gold_violation(e, q).first()[0] == pytest.approx(0.4)
    assert graph.violation(e, q).first()[0] == pytest.approx(0.4)
    assert graph.roughness(e, q) == pytest.approx(0.8)


def test_propagation_steps(spark):
    e = edges_of(spark, [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 0.5), (3, 2, 0.5)])
    q = graph.seed_distribution(spark.createDataFrame([(1, 0), (2, None), (3, 1)], "node long, label int"), 2)
    one = graph.propagate_once(e, q, 2, 0.05)
    assert {r["node"]: [round(x, 8) for x in r["p"]] for r in one.collect()} == {1: [1, 0], 2: [0.5125, 0.4875], 3: [0, 1]}
    assert one.agg(F.sum("rough")).first()[0] == pytest.approx(graph.roughness(e, q))
    two = {r["node"]: [round(x, 8) for x in r["p"]] for r in graph.propagate_once(e, one, 2, 0.025).collect()}
    assert two[2] == [0.51828125, 0.48171875]
    out, n, _ = graph.propagate(e, q, 2, iterations=4)
    assert n == 4 and out.count() == 3


def test_statistics_of_a_graph_with_an_empty_node(spark):
    e = edges_of(spark, [(1, 2, 0.8), (2, 1, 0.8)])
    s = graph.statistics(spark.createDataFrame([(1,), (2,), (3,)], "node long"), e).first()
    assert (s["n_edges"], s["max_degree"], s["min_degree"], s["n_empty"]) == (2, 1, 0, 1)


def test_generator_of_the_samples():
    rng = sampling.Lcg(12345)
    assert [rng.next_int(100) for _ in range(6)] == [51, 80, 41, 28, 55, 84]
    assert len(set(sampling.draw(list(range(20)), 20))) == 20
    with pytest.raises(ValueError):
        sampling.draw([1, 2], 3)


def test_splits(spark):
    rows = spark.range(30).withColumnRenamed("id", "seq_id")
    a, b = sampling.split(rows, sampling.ordered_sample(rows, 7, F.col("seq_id")))
    assert (a.count(), b.count()) == (7, 23)
    folds = sampling.fold_split(rows, 3, 4, 2, F.col("seq_id"))
    assert sorted(r["seq_id"] for r in folds.where("split = 'train'").collect()) == [6, 7, 8]
    turns = sampling.stratified_sample(rows.withColumn("s", F.col("seq_id") % 3), "s", 4, F.col("seq_id"))
    assert [(r["s"], r["round"]) for r in turns.collect()] == [(0, 0), (1, 0), (2, 0), (0, 1)]


def test_a_vector_moves_once_for_each_block(spark):
    rows = spark.range(300).select(F.col("id").alias("node"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("vector"))
    assert graph.block_pairs(rows, 3).count() == 3 * 300 and graph.block_pairs(rows, 1).count() == 300
    pairs = {(r["p"], r["q"]) for r in graph.block_pairs(rows, 3).collect()}
    assert pairs == {(p, q) for p in range(3) for q in range(p, 3)}
    assert graph.nearest(rows, 3, block=100).count() == 900


def test_coverage_and_accuracy_of_tokens(spark):
    rows = spark.createDataFrame([(0, [0, 2], [5, None], True), (1, [1, 2, 0], [5, None, 6], False), (2, [0], [None], False)], "seq_id long, tags array<int>, nodes array<long>, is_labeled boolean")
    assert graph.coverage(rows, 2).first().asDict() == {"tokens": 6, "train_covered": 1, "test_covered": 2, "test_punct": 1, "test_all": 4}
    labels = spark.createDataFrame([(5, 1), (6, 1)], "node long, label int")
    assert graph.test_accuracy(rows, labels, 2).first()["acc"] == pytest.approx(50.0)
    assert graph.test_accuracy(rows, labels).first()["acc"] == pytest.approx(25.0)
    assert graph.norms(spark.createDataFrame([([3.0],), ([4.0],)], "g array<double>"), "g").first()["norm"] == pytest.approx(5)


def test_places_drawn_equal_members_drawn(spark):
    pool = spark.range(40, 60).withColumnRenamed("id", "seq_id")
    want = sampling.draw(list(range(40, 60)), 8)
    assert [r["seq_id"] for r in sampling.draw_fold(pool, 4, 2, 1).collect()] == want[4:]


def test_copies_of_a_node_do_not_grow_with_the_nodes():
    """A node is copied once a part: parts follow the cores until one holds what a task may, and the rest is a part each of that."""
    assert graph._parts(100_000, 6_400_000, 12, 2048) == graph._parts(500_000, 32_000_000, 12, 2048) == 8
    assert graph._parts(1_000, 64_000, 12, 2048) == 1
    assert graph._parts(10 * graph.HELD_NODES, 640 * graph.HELD_NODES, 12, 2048) == 10


def test_few_parts_are_compared_in_tiles(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties and copies
    x = x[np.abs(x).sum(1) > 0]
    df = spark.createDataFrame([(i * 3 % len(x), v.tolist()) for i, v in enumerate(x)] if len(x) % 3 else [(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    unit = graph.unit_vectors(df, "id", "v")
    held = {r["node"]: np.array(r["vector"]) for r in unit.collect()}
    tiles = graph.nearest(unit, 4, block=32)
    assert graph._parts(len(held), 3 * len(held), spark.sparkContext.defaultParallelism, 32) < len(held) / 32
    got = {}
    for r in tiles.collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for a, v in held.items():
        sims = sorted((-round(float(v @ w), 9), b) for b, w in held.items() if b != a)
        assert [d for _, d in sorted(got.get(a, []))] == [b for s, b in sims if s < 0][:4]
