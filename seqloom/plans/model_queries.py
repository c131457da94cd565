"""Queries on sequence models: scores, lattices, training, projection, evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import entropy_bits
from ..operators import crf, em, features, graph, lattice
from .fixtures import EVENT_TAGS, EVSEQ, event_sequences, event_tokens, glyph_rows
from .graph_queries import r6, top_edges

QUERIES, ORACLES = {}, {}
K = len(EVENT_TAGS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def theta_of(name: str) -> float:
    """The fixed parameter of a feature in these queries."""
    return (len(name) % 7 - 3) / 10


def _theta_column(name):
    return (F.length(name) % 7 - 3) / 10.0


def _t(sql: str) -> str:
    return f"((length({sql}) % 7 - 3) / 10.0)"


def _token_score(offset: int, token: str, state: str) -> str:
    return f"({_t(f"'P{offset}LTk=' || lower({token}) || ' ' || {state}")} + case when upper(left({token}, 1)) = left({token}, 1) then {_t(f"'P{offset}Cap=' || {state}")} else 0 end)"


_TAGS = ", ".join(f"'{t}'" for t in EVENT_TAGS)
_SCORES = f"""near as (select seq_id, pos, token, tag, lag(token) over w pt, lead(token) over w nt, max(pos) over (partition by seq_id) top from evseq window w as (partition by seq_id order by pos)),
states as (select unnest([{_TAGS}]) state, generate_subscripts([{_TAGS}], 1) i),
scores as (select seq_id, pos, state, i, {_token_score(1, 'token', 'state')} + case when pt is not null then {_token_score(0, 'pt', 'state')} else 0 end
   + case when nt is not null then {_token_score(2, 'nt', 'state')} else 0 end score from near, states),
final as (select seq_id, pos + 1 pos, '</t0>' state, {_token_score(0, 'token', "'</t0>'")} score from near where pos = top)"""


@query(f"with {EVSEQ}, {_SCORES} select seq_id, pos, state, round(score, 6) + 0.0 score from scores union all select seq_id, pos, state, round(score, 6) + 0.0 from final")
def node_scores(spark, sf):
    return features.node_scores(event_tokens(spark, sf), EVENT_TAGS, _theta_column).select("seq_id", "pos", "state", r6("score", "score"))


def _edge(s: str, sp: str) -> float:
    return theta_of(f"S-1={sp}") + theta_of(f"S-0={s}") + theta_of(f"S-10={sp} {s}")


def fixed_edges() -> np.ndarray:
    names = [*EVENT_TAGS, features.START, features.START2, features.END]
    edge = np.full((K + 3, K + 3), -np.inf)
    for i in [*range(K), K + 2]:
        for j in [*range(K), K]:
            if not (i == K + 2 and j == K):
                edge[i, j] = _edge(names[i], names[j])
    return edge


def _lse(terms: list[str]) -> str:
    return f"list_reduce([{', '.join(terms)}], lambda x, y: greatest(x, y) + ln(1 + exp(-abs(x - y))))"


def _chain_sql(e: np.ndarray, lists: str) -> str:
    """Forward and backward lists of the five states, a row per sequence and position; ``lists`` and ``final`` have the node scores."""
    num = lambda x: f"({x!r}::double)"
    start = "[" + ", ".join(f"n[{s + 1}] + {num(float(e[s, K]))}" for s in range(K)) + "]"
    step = "[" + ", ".join(_lse([f"a[{p + 1}] + {num(float(e[s, p]))}" for p in range(K)]) + f" + l.n[{s + 1}]" for s in range(K)) + "]"
    end = "[" + ", ".join(f"f.score + {num(float(e[K + 2, p]))}" for p in range(K)) + "]"
    back = "[" + ", ".join(_lse([f"b[{s + 1}] + l.n[{s + 1}] + {num(float(e[s, p]))}" for s in range(K)]) for p in range(K)) + "]"
    return f"""lists as materialized ({lists}),
fwd as (select seq_id, pos, {start} a from lists where pos = 0 union all select l.seq_id, l.pos, {step} from fwd join lists l on l.seq_id = fwd.seq_id and l.pos = fwd.pos + 1),
bwd as (select f.seq_id, f.pos - 1 pos, {end} b from final f union all select l.seq_id, l.pos - 1, {back} from bwd join lists l on l.seq_id = bwd.seq_id and l.pos = bwd.pos where l.pos > 0),
z as (select f.seq_id, {_lse([f'a[{k + 1}] + b[{k + 1}]' for k in range(K)])} logz from fwd f join bwd using (seq_id, pos) where f.pos = 0),
marg as (select seq_id, pos, k, exp(a[k] + b[k] - logz) p from fwd join bwd using (seq_id, pos) join z using (seq_id), (select unnest(range(1, {K + 1})) k))"""


_CHAIN = f"with recursive {EVSEQ}, {_SCORES}, {_chain_sql(fixed_edges(), 'select seq_id, pos, list(score::double order by i) n from scores group by all')}"


def _inference(spark, sf):
    """(seq_id, logz, p array of L * K) of the first-order chain at the fixed parameters."""
    scored = features.node_scores(event_tokens(spark, sf), EVENT_TAGS, _theta_column)
    number = F.array_position(F.array(*map(F.lit, EVENT_TAGS)), F.col("state"))
    rows = scored.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", number.alias("s"), "score"))).alias("r")).select("seq_id", F.col("r.score").alias("scores"))
    edge = fixed_edges()

    def run(frames):
        for frame in frames:
            out = []
            for seq, scores in zip(frame["seq_id"], frame["scores"]):
                log_z, p, _ = lattice.first_order(np.asarray(scores[:-1]).reshape(-1, K), float(scores[-1]), edge)
                out.append((seq, float(log_z), p.ravel()))
            yield pd.DataFrame(out, columns=["seq_id", "logz", "p"])

    return rows.mapInPandas(run, "seq_id long, logz double, p array<double>")


def _positions(spark, sf):
    cut = F.transform(F.sequence(F.lit(0), (F.size("p") / K).cast("int") - 1), lambda i: F.slice("p", i * K + 1, K))
    return _inference(spark, sf).select("seq_id", F.posexplode(cut).alias("pos", "p"))


@query(f"{_CHAIN} select seq_id, round(logz, 6) + 0.0 logz from z")
def fo_forward_logz(spark, sf):
    return _inference(spark, sf).select("seq_id", r6("logz", "logz"))


@query(f"{_CHAIN} select seq_id, pos::int pos, (k - 1)::int state, round(p, 6) + 0.0 p from marg")
def fo_marginals(spark, sf):
    return _positions(spark, sf).select("seq_id", "pos", F.posexplode("p").alias("state", "p")).select("seq_id", "pos", "state", r6("p", "p"))


@query(f"{_CHAIN} select seq_id, pos::int pos, (arg_max(k, (round(p, 9), -k)) - 1)::int state from marg group by seq_id, pos")
def posterior_decode(spark, sf):
    from ..functions.text import argmax

    return _positions(spark, sf).select("seq_id", "pos", argmax(F.transform("p", lambda x: F.round(x, 9))).alias("state"))


@query(f"{_CHAIN}, h as (select seq_id, pos, -sum(p * log2(p)) h from marg where p > 0 group by all) select seq_id, round(avg(h), 6) + 0.0 avg_entropy_bits from h group by seq_id")
def state_entropy(spark, sf):
    return _positions(spark, sf).select("seq_id", entropy_bits(F.col("p")).alias("h")).groupBy("seq_id").agg(r6(F.avg("h"), "avg_entropy_bits"))


@query(f"""{_CHAIN}, per as (select seq_id, pos, arg_max(k, (round(p, 9), -k)) - 1 pred, list(round(p, 9) order by k) p from marg group by seq_id, pos),
d as (select list_position([{_TAGS}], tag) - 1 = pred hit, -list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * log2(x))) h,
  sqrt(list_sum(list_transform(p, lambda x: (x - list_sum(p) / len(p)) ** 2))) s, list_max(p) m from per join evseq using (seq_id, pos))
select count(*) n, count(*) filter (where hit) correct, round(avg(h), 6) + 0.0 entropy_bits, round(avg(s), 6) + 0.0 deviation, round(min(m), 6) + 0.0 least, round(avg(m), 6) + 0.0 average, round(max(m), 6) + 0.0 most from d""")
def decode_diagnostics(spark, sf):
    number = (F.array_position(F.array(*map(F.lit, EVENT_TAGS)), F.col("tag")) - 1).cast("int")
    gold = event_tokens(spark, sf).select("seq_id", "pos", number.alias("tag"))
    p = _positions(spark, sf).select("seq_id", "pos", F.transform("p", lambda x: F.round(x, 9)).alias("p"))
    found = em.token_diagnostics(p.join(gold, ["seq_id", "pos"]))
    return found.select("n", "correct", *[r6(c, c) for c in ("entropy_bits", "deviation", "least", "average", "most")])


_PREVIOUS = f"{EVSEQ}, guess as (select seq_id, pos, tag, coalesce(lag(tag) over (partition by seq_id order by pos), 'click') pred from evseq), per as (select seq_id, avg((tag = pred)::int) acc from guess group by 1)"


def _previous_tags(spark, sf):
    """Each tag guessed to be the one before."""
    tags = F.col("tags")
    return event_sequences(spark, sf).withColumn("pred", F.concat(F.array(F.lit(0)), F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0)))))


@query(f"with {_PREVIOUS} select round((select avg((tag = pred)::int) from guess), 6) + 0.0 token_acc, round(avg((acc = 1)::int), 6) + 0.0 seq_acc from per")
def accuracy(spark, sf):
    rows = _previous_tags(spark, sf)
    found = crf.accuracy(rows.select("seq_id", "tags"), rows.select("seq_id", "pred"))
    return found.select(r6("token_acc", "token_acc"), r6("seq_acc", "seq_acc"))


@query(f"with {_PREVIOUS} select seq_id, round(acc, 6) + 0.0 acc from per")
def prediction_scoring(spark, sf):
    """Predictions as a file has them, a row per token, against the gold tags."""
    rows = _previous_tags(spark, sf)
    pred = rows.select("seq_id", F.posexplode("pred").alias("pos", "pred"))
    gold = rows.select("seq_id", F.posexplode("tags").alias("pos", "tag"))
    return gold.join(pred, ["seq_id", "pos"]).groupBy("seq_id").agg(r6(F.avg((F.col("tag") == F.col("pred")).cast("double")), "acc"))


# ---------------------------------------------------------------- training (rows only: no SQL can say it)


def chain_rows(spark, sf):
    """Event sequences for the chain models: the value's bucket is the one observation; two in three are labelled."""
    seqs = event_sequences(spark, sf)
    obs = F.transform("tokens", lambda t: F.array(F.expr("1") * F.substring(t, 2, 4).cast("int")))
    nodes = F.transform("tokens", lambda t: F.substring(t, 2, 4).cast("long"))
    return seqs.select("seq_id", "tags", obs.alias("obs"), nodes.alias("nodes"), (F.col("seq_id") % 3 < 2).alias("is_labeled"))


def event_design(order: int) -> crf.Design:
    return crf.Design(states=K, observations=6, order=order)


def _theta(design: crf.Design) -> np.ndarray:
    return ((np.arange(design.size) * 37) % 7 - 3) / 10


def _emission_sql(design: crf.Design, offset: int, obs: str, state: int) -> str:
    at = design.size - 3 * design.observations * (K + 1)
    return f"((({at} + ({offset * design.observations} + {obs}) * {K + 1} + {state}) * 37) % 7 - 3) / 10.0"


def _observed_sql(design: crf.Design) -> str:
    """ob (seq_id, pos, t, o, n list of node scores, e score of the end) of the parameters that :func:`_theta` has."""
    n = ", ".join(f"{_emission_sql(design, 1, 'o', s)} + coalesce({_emission_sql(design, 0, 'po', s)}, 0) + coalesce({_emission_sql(design, 2, 'no', s)}, 0)" for s in range(K))
    return f"""raw as (select seq_id, pos, list_position([{_TAGS}], tag) - 1 t, substr(token, 2)::int o, max(pos) over (partition by seq_id) top from evseq),
near as (select *, lag(o) over w po, lead(o) over w no, lag(t) over w pt from raw window w as (partition by seq_id order by pos)),
ob as materialized (select seq_id, pos, top, t, pt, o, [{n}]::double[] n, {_emission_sql(design, 0, 'o', K)} e from near),
final as (select seq_id, pos + 1 pos, e::double score from ob where pos = top)"""


def _second_order_sql() -> str:
    design = event_design(2)
    e, s0, s00, sn = design.edges(_theta(design)), K, K + 1, K + 2
    num, pairs = lambda x: f"({float(x)!r}::double)", [(s, sp) for s in range(K) for sp in range(K)]
    begin = "[" + ", ".join(f"f.n[{sp + 1}] + {num(e[sp, s0, s00])} + {num(e[s, sp, s0])} + l.n[{s + 1}]" for s, sp in pairs) + "]"
    step = "[" + ", ".join(_lse([f"a[{sp * K + spp + 1}] + {num(e[s, sp, spp])}" for spp in range(K)]) + f" + l.n[{s + 1}]" for s, sp in pairs) + "]"
    return f"""with recursive {EVSEQ}, {_observed_sql(design)},
fwd as (select l.seq_id, l.pos, {begin} a from ob f join ob l using (seq_id) where f.pos = 0 and l.pos = 1
  union all select l.seq_id, l.pos, {step} from fwd join ob l on l.seq_id = fwd.seq_id and l.pos = fwd.pos + 1)
select f.seq_id, round({_lse([f"a[{i + 1}] + {num(e[sn, s, sp])}" for i, (s, sp) in enumerate(pairs)])} + score, 6) + 0.0 logz from fwd join final f on f.seq_id = fwd.seq_id and f.pos = fwd.pos + 1
union all select f.seq_id, round({_lse([f"n[{s + 1}] + {num(e[s, s0, s00] + e[sn, s, s0])}" for s in range(K)])} + score, 6) + 0.0 from ob join final f using (seq_id) where top = 0"""


def _objective_sql() -> str:
    design = event_design(1)
    theta = _theta(design)
    e = design.edges(theta)
    flat = "[" + ", ".join(f"{x!r}" for x in e.ravel().tolist()) + "]::double[]"
    return f"""with recursive {EVSEQ}, {_observed_sql(design)}, {_chain_sql(e, "select seq_id, pos, n from ob")}, tr as (select {flat} x),
gold as (select seq_id, sum(n[t + 1] + x[t * {K + 3} + coalesce(pt, {K}) + 1] + case when pos = top then x[{(K + 2) * (K + 3)} + t + 1] + e else 0 end) g from ob, tr group by seq_id)
select count(*) n, round(sum(logz - g) + {float(theta @ theta) / 2e4!r}, 4) + 0.0 value from z join gold using (seq_id) where seq_id % 3 < 2"""


def _expected_sql() -> str:
    design = event_design(1)
    e = design.edges(_theta(design))
    return f"""with recursive {EVSEQ}, {_observed_sql(design)}, {_chain_sql(e, "select seq_id, pos, n from ob")}
select o::bigint node, (k - 1)::int state, round(sum(case when seq_id % 3 < 2 then (t = k - 1)::int else p end) / count(*), 6) + 0.0 p from marg join ob using (seq_id, pos) group by o, k"""


@query(_second_order_sql())
def so_forward_logz(spark, sf):
    design = event_design(2)
    return crf.infer(chain_rows(spark, sf), design, _theta(design)).select("seq_id", r6("logz", "logz"))


@query(_objective_sql())
def crf_objective(spark, sf):
    """The objective of the labelled sequences at fixed parameters."""
    from ..session import settle

    design, rows = event_design(1), settle(chain_rows(spark, sf))
    value, _ = crf.Objective(rows, design)(_theta(design))
    return rows.where("is_labeled").agg(F.count("*").alias("n"), (F.round(F.lit(value), 4) + 0.0).alias("value"))


@query(_expected_sql())
def expected_node_distribution(spark, sf):
    """Labelled tokens with their tag and others with their posterior, by node."""
    design, rows = event_design(1), chain_rows(spark, sf)
    found = crf.infer(rows, design, _theta(design)).select("seq_id", F.col("p").alias("q"))
    p = em.expected_distribution(rows, found, em.node_frequency(rows), K)
    return p.select("node", F.posexplode("p").alias("state", "p")).select("node", "state", r6("p", "p"))


@query()
def so_marginals(spark, sf):
    """(seq_id, logz, entropy) of a second-order chain at fixed parameters."""
    design = event_design(2)
    return crf.infer(chain_rows(spark, sf), design, _theta(design)).select("seq_id", "logz", "entropy")


@query()
def crf_train(spark, sf):
    """(iter, objective, grad_norm) of supervised training of a first-order model."""
    from ..session import settle

    _, history = crf.train(settle(chain_rows(spark, sf)), event_design(1), iterations=8)
    return spark.createDataFrame([(i, float(v), float(g)) for i, (v, g) in enumerate(history)], "iter int, objective double, grad_norm double")


def _glyph_setting(spark, sf):
    return glyph_rows(spark, sf), graph.mutual(top_edges(spark, sf)), crf.Design(states=10, observations=64, order=1)


@query()
def eg_projection(spark, sf):
    """(iter, likelihood, entropy, graph, objective) of the E-step after a short supervised training."""
    from ..session import settle

    rows, edges, design = _glyph_setting(spark, sf)
    rows = settle(rows)
    theta, _ = crf.train(rows, design, iterations=4)
    log = em.Projection(rows, edges, design, theta, em.Options(e_iterations=3)).run(theta)
    return spark.createDataFrame([(t, *map(float, rest)) for t, *rest in log], "iter int, likelihood double, entropy double, graph double, objective double")


@query()
def em_train(spark, sf):
    """(iter, objective, train_acc, test_acc) of two EM rounds."""
    rows, edges, design = _glyph_setting(spark, sf)
    _, log = em.fit(rows, edges, design, em.Options(em_iterations=2, e_iterations=2, m_iterations=4))
    return spark.createDataFrame(log, "iter int, objective double, train_acc double, test_acc double")


@query()
def graph_bootstrap(spark, sf):
    """(iter, objective, test_acc) of self-training on propagated labels."""
    rows, edges, design = _glyph_setting(spark, sf)
    _, log = em.bootstrap(rows, edges, design, em.Options(m_iterations=4), propagation=5)
    return spark.createDataFrame(log, "iter int, objective double, test_acc double")
