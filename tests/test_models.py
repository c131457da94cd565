import math

import numpy as np
import pytest

from seqloom.operators import crf, em, lattice
from seqloom.session import settle


def random_edge(rng, k, order):
    return rng.normal(size=(k + 3,) * (order + 1))


@pytest.mark.parametrize("order", [1, 2])
@pytest.mark.parametrize("n, k", [(1, 3), (2, 3), (3, 2), (5, 3)])
def test_marginals_against_all_paths(order, n, k):
    rng = np.random.default_rng(n * 10 + k)
    node, edge = rng.normal(size=(n, k)), random_edge(rng, k, order)
    log_z, p, counts = lattice.marginals(node, 0.3, edge)
    want_z, want_p = lattice.brute_force(node, 0.3, edge)
    assert log_z == pytest.approx(want_z)
    assert np.allclose(p, want_p) and np.allclose(p.sum(1), 1)
    assert counts.sum() == pytest.approx(n + 1)


def test_known_chain():
    node = np.array([[0.1, 0.5], [0.3, -0.2], [0, 0.4]])
    edge = np.full((5, 5), -np.inf)
    edge[:2, :2] = [[0.2, -0.1], [0, 0.3]]
    edge[:2, 2], edge[4, :2] = [0, 0.1], [0.05, -0.05]
    log_z, p, _ = lattice.first_order(node, 0.0, edge)
    assert log_z == pytest.approx(2.960526142)
    assert np.allclose(p[:, 0], [0.389437938, 0.566662941, 0.412963226])
    assert lattice.first_order(np.zeros((4, 3)), 0.0, np.zeros((6, 6)))[0] == pytest.approx(4 * math.log(3))


def test_second_order_without_memory_is_first_order():
    rng = np.random.default_rng(3)
    node, edge = rng.normal(size=(6, 3)), random_edge(rng, 3, 1)
    a = lattice.first_order(node, 0.1, edge)
    b = lattice.second_order(node, 0.1, np.repeat(edge[:, :, None], 6, 2))
    assert a[0] == pytest.approx(b[0]) and np.allclose(a[1], b[1])


def test_pruned_states_get_no_mass():
    node = np.zeros((3, 3))
    node[1, [0, 2]] = -np.inf
    _, p, _ = lattice.first_order(node, 0.0, np.zeros((6, 6)))
    assert np.allclose(p[1], [0, 1, 0])
    with pytest.raises(ValueError):
        lattice.first_order(np.zeros((0, 2)), 0.0, np.zeros((5, 5)))


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(0), []
    for i in range(24):
        tags = rng.integers(0, 3, rng.integers(1, 6))
        out.append((i, tags.tolist(), [[int(t), 3] if rng.random() < 0.9 else [3] for t in tags], [int(t) if rng.random() < 0.9 else None for t in tags], i % 3 < 2))
    return settle(spark.createDataFrame(out, "seq_id long, tags array<int>, obs array<array<int>>, nodes array<long>, is_labeled boolean"))


@pytest.mark.parametrize("order", [1, 2])
def test_gradient_by_differences(rows, order):
    design = crf.Design(3, 4, order)
    rng = np.random.default_rng(4)
    theta = rng.normal(size=design.size) * 0.1
    f = crf.Objective(rows, design, prior=2.0, soft=rng.normal(size=design.size) * 0.01)
    _, grad = f(theta)
    for i in rng.choice(design.size, 4, replace=False):
        d = np.zeros(design.size)
        d[i] = 1e-4
        assert (f(theta + d)[0] - f(theta - d)[0]) / 2e-4 == pytest.approx(grad[i], abs=1e-4)


@pytest.mark.parametrize("order", [1, 2])
def test_edges_and_their_gradient_are_adjoint(order):
    design = crf.Design(3, 2, order)
    rng = np.random.default_rng(5)
    theta, counts = rng.normal(size=design.size), rng.normal(size=(6,) * (order + 1))
    parts = design.edge_gradient(counts)
    left = (design.edges(theta) * counts).sum()
    assert left == pytest.approx(sum((a * b).sum() for a, b in zip(design.split(theta), parts)))


def test_lbfgs_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x, history = crf.lbfgs(lambda v: (0.5 * v @ a @ v - v.sum(), a @ v - 1), np.zeros(3), 60, tol=1e-14)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4) and history[-1][0] < history[0][0]


def test_training_learns_the_tags(rows):
    theta, history = crf.train(rows, crf.Design(3, 4, 1), iterations=12)
    assert history[-1][0] < history[0][0]
    acc = crf.accuracy(rows, crf.infer(rows, crf.Design(3, 4, 1), theta)).first()
    assert acc["token_acc"] > 0.85


def test_pruning_of_sequences(rows):
    from pyspark.sql import functions as F

    design = crf.Design(3, 4, 2)
    pruned = rows.withColumn("allowed", F.transform("tags", lambda t: F.array(t)))
    got = crf.infer(pruned, design, np.zeros(design.size)).join(rows.select("seq_id", "tags"), "seq_id").collect()
    assert all(list(r["pred"]) == list(r["tags"]) and abs(r["logz"]) < 1e-9 for r in got)


def test_em_and_projection(spark, rows):
    edges = spark.createDataFrame([(0, 1, 0.2), (1, 0, 0.2), (1, 2, 0.1), (2, 1, 0.1)], "src long, dst long, weight double")
    design = crf.Design(3, 4, 1)
    theta, log = em.fit(rows, edges, design, em.Options(em_iterations=2, e_iterations=2, m_iterations=4))
    assert len(log) == 2 and log[-1][3] > 0.6
    p = em.Projection(rows, edges, design, theta, em.Options(e_iterations=2))
    for t, cross, h, g, objective in p.run(theta):
        assert objective == pytest.approx(cross - h + g / 2)
    assert all(abs(sum(r["p"]) - 1) < 1e-6 for r in p.q.collect())
    assert p.soft_counts().shape == (design.size,) and 0 < p.diagnostics()["average"] <= 1
    assert em.bootstrap(rows, edges, design, em.Options(m_iterations=3), propagation=2)[1][-1][2] > 0.5


@pytest.mark.parametrize("order", [1, 2])
def test_batches_equal_single_sequences(order):
    rng = np.random.default_rng(7)
    k, size = 3, np.array([5, 1, 2, 5, 3])
    node, end, edge = rng.normal(size=(5, 5, k)), rng.normal(size=5), random_edge(rng, k, order)
    node[0, 2, [0, 2]] = -np.inf
    node[1, 1:] = 99.0  # behind the end
    log_z, p, counts = lattice.batch_marginals(node, size, end, edge)
    h = lattice.batch_entropy(log_z, p, counts, node, end, edge)
    for i, n in enumerate(size):
        z, q, c = lattice.marginals(node[i, :n], float(end[i]), edge)
        assert log_z[i] == pytest.approx(z) and np.allclose(p[i, :n], q) and not p[i, n:].any() and np.allclose(counts[i], c)
        assert h[i] == pytest.approx(lattice.entropy(z, q, c, node[i, :n], float(end[i]), edge))


def test_backoff_shifts_the_partition_only(rows):
    a, b = crf.Design(3, 4, 2), crf.Design(3, 4, 2, backoff=0.25)
    theta = np.random.default_rng(1).normal(size=a.size) * 0.2
    x, y = ({r["seq_id"]: r for r in crf.infer(rows, d, theta).collect()} for d in (a, b))
    for r in rows.collect():
        n = len(r["tags"])
        assert y[r["seq_id"]]["logz"] == pytest.approx(x[r["seq_id"]]["logz"] + 0.25 * 2 * (n + 1))
        assert np.allclose(y[r["seq_id"]]["p"], x[r["seq_id"]]["p"])


def test_uniform_and_smoothed_scores():
    node, end, edge = lattice.uniform_scores(4, 3, 1, 1.0)
    assert lattice.first_order(node, end, edge)[0] == pytest.approx(4 * math.log(3))
    assert not np.isfinite(lattice.uniform_scores(1, 2, 1, 0.0)[0]).any()
    assert np.allclose(np.exp(lattice.smoothed(np.array([0.0, -np.inf]), 0.5)), [1.5, 0.5])


def test_partial_sums_in_a_tree(spark, rows):
    design = crf.Design(3, 4, 1)
    theta = np.random.default_rng(2).normal(size=design.size) * 0.1
    whole = crf.log_partition(rows, design, theta)
    many = settle(rows.repartition(40))
    assert crf.partitions_of(many) == 40
    parts = crf.log_partition(many, design, theta)
    assert parts[0] == pytest.approx(whole[0]) and np.allclose(parts[1], whole[1])
    labelled = crf.log_partition(rows, design, theta, 1.0, 0.0)
    other = crf.log_partition(rows, design, theta, labelled=0.0)
    assert labelled[0] + other[0] == pytest.approx(whole[0]) and np.allclose(labelled[1] + other[1], whole[1])


def test_settled_frames_can_be_released(spark):
    import os

    from seqloom.session import Timers, kept_in, release

    a = settle(spark.range(10))
    b = settle(a.where("id > 3"), instead_of=a)
    path = kept_in(b).removeprefix("file:")
    assert os.path.isdir(path) and b.count() == 6
    release(b)
    assert not os.path.isdir(path) and kept_in(spark.range(3)) is None
    ticks = iter([0.0, 2.0, 5.0, 9.0])
    t = Timers(lambda: next(ticks))
    assert [t.stamp("a"), t.stamp("b"), t.stamp("a"), t.stamp("b")] == [0.0, 0.0, 5.0, 7.0]
    assert t.intervals("a", "b") == [2.0, 4.0] and t.report("a", "b") == {"n": 2, "seconds": 6.0, "minutes": 0.1}
    t.clear("a")
    assert t.intervals("a", "b") == []


def test_diagnostics_of_the_projection(spark, rows):
    edges = spark.createDataFrame([(0, 1, 0.2), (1, 0, 0.2)], "src long, dst long, weight double")
    design = crf.Design(3, 4, 2)
    p = em.Projection(rows, edges, design, np.random.default_rng(3).normal(size=design.size) * 0.1, em.Options(e_iterations=1))
    d = p.diagnostics()
    other = rows.where("not is_labeled").collect()
    q = {r["seq_id"]: np.array(r["q"]).reshape(-1, 3) for r in p.state.collect()}
    best = np.concatenate([q[r["seq_id"]].argmax(1) for r in other])
    assert d["n"] == len(best) and d["correct"] == int((best == np.concatenate([r["tags"] for r in other])).sum())
    every = np.concatenate([q[r["seq_id"]] for r in other])
    assert d["deviation"] == pytest.approx(np.sqrt(((every - 1 / 3) ** 2).sum(1)).mean())
    assert d["least"] == pytest.approx(every.max(1).min()) and d["node_least"] < d["node_most"] and d["edge_least"] < d["edge_most"]
    assert em.token_diagnostics(spark.createDataFrame([([0.5, 0.5], 0)], "p array<double>, tag int")).first()["entropy_bits"] == pytest.approx(1)
