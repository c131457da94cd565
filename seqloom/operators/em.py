"""Graph-regularised training: an EM loop whose E-step projects posteriors under a graph penalty.

The E-step keeps a dual score for every tag of every unlabelled token and lowers cross-entropy minus
entropy plus half the graph's violation by exponentiated gradient.  The graph's gradient depends on a
token only through its node, so it is made once a node and joined to tokens.  Every round ends in a
durable table.  Also: self-training from propagated labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import crf, graph, lattice
from .crf import Design, Ragged


@dataclass(frozen=True)
class Options:
    """Defaults of the command line."""

    label_strength: float = 1.0
    graph_strength: float = 1.0
    prior: float = 100.0
    em_iterations: int = 1
    e_iterations: int = 50
    m_iterations: int = 50
    em_stop: float = 0.01
    e_stop: float = 0.01
    m_stop: float = 1e-5
    eta: float = 0.2


def node_frequency(sequences: DataFrame) -> DataFrame:
    """(node, freq) over all tokens that have a node."""
    return sequences.select(F.explode("nodes").alias("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("freq"))


def expected_distribution(sequences: DataFrame, posteriors: DataFrame, frequency: DataFrame, states: int) -> DataFrame:
    """(node, p): sums of posteriors, one-hot where labelled, over the node's frequency."""
    hot = F.transform("tags", lambda t: F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda k: (k == t).cast("double")))
    labelled = sequences.where("is_labeled").select(F.explode(F.arrays_zip(F.col("nodes").alias("node"), hot.alias("p"))).alias("t"))
    cut = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.slice("q", i * states + 1, states))
    other = sequences.where("not is_labeled").join(posteriors.select("seq_id", "q"), "seq_id").select(F.explode(F.arrays_zip(F.col("nodes").alias("node"), cut.alias("p"))).alias("t"))
    rows = labelled.select("t.*").toDF("node", "p").unionByName(other.select("t.*").toDF("node", "p")).where("node is not null")
    sums = rows.groupBy("node").agg(*[F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(states)])
    return sums.join(frequency, "node").select("node", F.array(*[F.col(f"s{k}") / F.col("freq") for k in range(states)]).alias("p"))


class Projection:
    """Persistent state of the E-step: duals, their transition parameters, posteriors and node distributions."""

    def __init__(self, sequences: DataFrame, edges: DataFrame, design: Design, theta: np.ndarray, options: Options):
        self.sequences, self.edges, self.design, self.o = sequences, settle(edges), design, options
        self.frequency = settle(node_frequency(sequences))
        self.theta_q, self.total, self.previous, self.log = theta.copy(), 0, np.inf, []
        # first duals are the model's node scores, so the state starts as the model's posterior
        self.state = settle(self._round(self.sequences.where("not is_labeled").withColumns({"nu": F.lit(None).cast("array<double>"), "pull": F.lit(None).cast("array<array<double>>")}), theta, 0.0))
        self.q = settle(expected_distribution(sequences, self.state, self.frequency, design.states))

    def _round(self, rows: DataFrame, theta: np.ndarray, eta: float) -> DataFrame:
        design, strength, k = self.design, self.o.graph_strength, self.design.states
        sent = rows.sparkSession.sparkContext.broadcast((theta, self.theta_q))

        def scores(chunk: crf.Chunk, nu: Ragged, pull: Ragged | None) -> tuple[np.ndarray, np.ndarray]:
            """The duals of the sequences after a step against the gradient."""
            lo, hi = nu.cuts[chunk.rows], nu.cuts[chunk.rows + 1]
            own, end = nu.values[crf._ranges(lo, hi - 1)].reshape(-1, k), nu.values[hi - 1]
            force = np.zeros_like(own)
            if pull is not None and len(pull.values):
                a, b = pull.cuts[chunk.rows], pull.cuts[chunk.rows + 1]
                lists = crf._ranges(a, b)
                full = pull.inner.cuts[lists + 1] > pull.inner.cuts[lists]
                per = b - a  # as many as tokens, or none
                place = np.repeat(np.cumsum(chunk.size) - chunk.size, per) + np.arange(len(lists)) - np.repeat(np.cumsum(per) - per, per)
                force[place[full]] = pull.values[crf._ranges(pull.inner.cuts[lists[full]], pull.inner.cuts[lists[full] + 1])].reshape(-1, k)
            model = chunk.node[chunk.row, chunk.pos]
            with np.errstate(invalid="ignore"):
                node = own - eta * ((own - model) + 2 * strength * force)
            node[~np.isfinite(model)] = -np.inf  # pruned states stay out
            return chunk.padded(node), end - eta * (end - chunk.end)

        def run(batches):
            model, own = sent.value
            edge_m, edge_q, emission = design.edges(model), design.edges(own), design.split(model)[-1]
            finite = lambda x: np.where(np.isfinite(x), x, 0.0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                known = batch.column("nu").null_count == 0
                nu = Ragged.of(batch.column("nu")) if known else None
                pull = Ragged.of(batch.column("pull")) if known else None
                for chunk in design.chunks(batch, emission):
                    node, end = scores(chunk, nu, pull) if known else (chunk.node, chunk.end)
                    log_z, q, c = lattice.batch_marginals(node, chunk.size, end, edge_q)
                    log_p, _, _ = lattice.batch_marginals(chunk.node, chunk.size, chunk.end, edge_m)
                    n = len(chunk.size)
                    cross = log_p - (q * finite(chunk.node)).sum((1, 2)) - chunk.end - (c * finite(edge_m)).reshape(n, -1).sum(1)
                    h = lattice.batch_entropy(log_z, q, c, node, end, edge_q)
                    cuts = np.concatenate([[0], np.cumsum(chunk.size * k)])
                    duals = np.insert(node[chunk.row, chunk.pos].ravel(), cuts[1:], end)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("seq_id").take(pa.array(chunk.rows)),
                            crf._lists(cuts + np.arange(n + 1), duals),
                            crf._lists(cuts, q[chunk.row, chunk.pos].ravel()),
                            crf._lists(np.arange(n + 1) * c[0].size, c.ravel()),
                            pa.array(cross),
                            pa.array(h),
                        ],
                        names=["seq_id", "nu", "q", "c", "cross", "entropy"],
                    )

        kept = [x for x in ("allowed",) if x in rows.columns]
        return rows.select("seq_id", "obs", "nu", "pull", *kept).mapInArrow(run, "seq_id long, nu array<double>, q array<double>, c array<double>, cross double, entropy double")

    def violation(self) -> float:
        return float(graph.violation(self.edges, self.q, self.frequency).first()[0] or 0.0)

    def run(self, theta: np.ndarray, soft_loss: float | None = None) -> list[tuple]:
        """Rounds until the objective worsens or changes little: (t, cross, entropy, graph, objective)."""
        o, log = self.o, []
        if soft_loss is not None:
            h = self.state.agg(F.sum("entropy")).first()[0] or 0.0
            self.previous = soft_loss - h + o.graph_strength / 2 * self.violation()
        unlabelled = self.sequences.where("not is_labeled")
        for t in range(o.e_iterations):
            eta = o.eta / (1 + t)
            grad = graph.gradient(self.edges, self.q, self.frequency, self.design.states)
            per_token = unlabelled.select("seq_id", F.posexplode("nodes").alias("pos", "node")).join(grad, "node", "left")
            pull = per_token.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "grad"))), lambda x: x["grad"]).alias("pull"))
            rows = unlabelled.join(self.state.select("seq_id", "nu"), "seq_id").join(pull, "seq_id", "left")
            self.theta_q = (1 - eta) * self.theta_q + eta * theta
            self.state = settle(self._round(rows, theta, eta), instead_of=self.state)
            self.q = settle(expected_distribution(self.sequences, self.state, self.frequency, self.design.states), instead_of=self.q)
            s = self.state.agg(F.sum("cross").alias("c"), F.sum("entropy").alias("h")).first()
            cross, h, g = s["c"] or 0.0, s["h"] or 0.0, self.violation()
            objective = cross - h + o.graph_strength / 2 * g
            log.append((t, cross, h, g, objective))
            change = abs(objective - self.previous) / self.previous if np.isfinite(self.previous) and self.previous else np.nan
            if (self.total > 0 and objective > self.previous) or (t > 0 and change < o.e_stop):
                break  # the worse state stays
            self.previous, self.total = objective, self.total + 1
        self.log += log
        return log

    def soft_counts(self) -> np.ndarray:
        """Expected feature counts of the unlabelled sequences under the projected posterior."""
        design = self.design

        def body(batch, transitions, emission):
            q, c = Ragged.of(batch.column("q")), Ragged.of(batch.column("c"))
            transitions += c.values.reshape(batch.num_rows, *transitions.shape).sum(0)
            for chunk in design.chunks(batch):
                own = q.values[crf._ranges(q.cuts[chunk.rows], q.cuts[chunk.rows + 1])].reshape(-1, design.states)
                some, counts = chunk.emissions(design, chunk.padded(own), np.ones(len(chunk.size)))
                emission[:, some] += counts
            return 0.0

        rows = self.sequences.where("not is_labeled").select("seq_id", "obs").join(self.state.select("seq_id", "q", "c"), "seq_id")
        most = max(crf.partitions_of(self.sequences), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return crf._partials(rows.select("obs", "q", "c"), body, design, most)[1]

    def diagnostics(self) -> dict[str, float]:
        """Over unlabelled tokens: see :func:`token_diagnostics`; and the ranges of node and edge scores."""
        k, edge = self.design.states, self.design.edges(self.theta_q)
        rows = self.state.join(self.sequences.select("seq_id", "tags"), "seq_id")
        cut = F.transform("tags", lambda t, i: F.struct(F.slice("q", i * k + 1, k).alias("p"), t.alias("tag")))
        out = token_diagnostics(rows.select(F.explode(cut).alias("t")).select("t.*")).first().asDict()
        own = F.filter(F.slice("nu", F.lit(1), F.size("nu") - 1), lambda x: F.abs(x) < float("inf"))
        out |= self.state.agg(F.min(F.array_min(own)).alias("node_least"), F.max(F.array_max(own)).alias("node_most")).first().asDict()
        met = edge[:k, : k + 1] if self.design.order == 1 else np.concatenate([edge[:k, :k, : k + 1].ravel(), edge[:k, k, k + 1]])
        return out | {"edge_least": float(met.min()), "edge_most": float(met.max())}


def token_diagnostics(tokens: DataFrame) -> DataFrame:
    """One row over ``tokens(p array, tag)``: tokens and correct ones; averages of the entropy in bits and of the
    root of squared deviations from the mean; least, average and largest confidence."""
    from ..functions.text import argmax, entropy_bits

    p, top = F.col("p"), F.array_max("p")
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")
    spread = F.sqrt(F.aggregate(F.transform("p", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x))
    return tokens.agg(F.count("*").alias("n"), F.sum((argmax(p) == F.col("tag")).cast("long")).alias("correct"), F.avg(entropy_bits(p)).alias("entropy_bits"), F.avg(spread).alias("deviation"), F.min(top).alias("least"), F.avg(top).alias("average"), F.max(top).alias("most"))


def _accuracies(sequences: DataFrame, design: Design, theta: np.ndarray) -> tuple[float, float]:
    found = settle(crf.infer(sequences, design, theta).select("seq_id", "pred"))
    train = crf.accuracy(sequences.where("is_labeled"), found).first()["token_acc"]
    test = crf.accuracy(sequences.where("not is_labeled"), found).first()["token_acc"]
    return float(train or 0.0), float(test or 0.0)


def fit(sequences: DataFrame, edges: DataFrame, design: Design, options: Options = Options()) -> tuple[np.ndarray, list[tuple]]:
    """EM: (theta, rows of (iter, objective, train_acc, test_acc)); iteration 0 is the supervised model."""
    o, theta, log, projection, before = options, np.zeros(design.size), [], None, np.inf
    sequences = settle(sequences)
    empirical = crf.gold_counts(sequences, design)
    soft, soft_loss = None, None
    for it in range(o.em_iterations):
        graph_term = h = 0.0
        if it:
            projection = projection or Projection(sequences, edges, design, theta, o)
            last = projection.run(theta, soft_loss)[-1]
            graph_term, h, soft = last[3], last[2], projection.soft_counts()
        objective = crf.Objective(sequences, design, o.prior, o.label_strength, empirical, soft)
        theta, history = crf.lbfgs(objective, theta, o.m_iterations, tol=o.m_stop)
        if soft is not None:
            soft_loss = crf.log_partition(sequences, design, theta, labelled=0.0)[0] - float(theta @ soft)
        value = history[-1][0] + o.graph_strength / 2 * graph_term - h
        log.append((it, float(value), *_accuracies(sequences, design, theta)))
        if it > 2 and abs(before - value) / before < o.em_stop:
            break
        before = value
    return theta, log


def bootstrap(sequences: DataFrame, edges: DataFrame, design: Design, options: Options = Options(), propagation: int = 50) -> tuple[np.ndarray, list[tuple]]:
    """Self-training on labels propagated over the graph: (theta, rows of (iter, objective, test_acc)).

    Nodes of labelled tokens are fixed to their tag distribution; a token off the graph gets the last tag.
    """
    k = design.states
    sequences = settle(sequences)
    frequency = node_frequency(sequences)
    gold = sequences.where("is_labeled").select(F.explode(F.arrays_zip("nodes", "tags")).alias("t")).select("t.nodes", "t.tags").where("nodes is not null")
    per = gold.groupBy(F.col("nodes").alias("node")).agg(*[F.avg((F.col("tags") == s).cast("double")).alias(f"p{s}") for s in range(k)])
    fixed = per.select("node", F.array(*[f"p{s}" for s in range(k)]).alias("d"))
    q = frequency.select("node").join(fixed, "node", "left").select("node", F.col("d").isNotNull().alias("fixed"), F.coalesce("d", F.array_repeat(F.lit(1.0 / k), k)).alias("p"))
    q, _, _ = graph.propagate(edges, q, k, iterations=propagation)
    labels = graph.hard_labels(q)
    tokens = sequences.where("not is_labeled").select("seq_id", F.posexplode("nodes").alias("pos", "node")).join(labels, "node", "left")
    guessed = tokens.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", F.lit(k - 1)).alias("label")))), lambda x: x["label"]).alias("guess"))
    trained = settle(sequences.join(guessed, "seq_id", "left").withColumn("tags", F.coalesce("guess", "tags")).withColumn("is_labeled", F.lit(True)).drop("guess"))
    theta, history = crf.train(trained, design, iterations=options.m_iterations, tol=options.m_stop, prior=options.prior)
    test = _accuracies(sequences, design, theta)[1]
    return theta, [(i, float(v), test if i == len(history) - 1 else None) for i, (v, _) in enumerate(history)]
