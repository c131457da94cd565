"""Queries on similarity graphs over the embeddings, label propagation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import argmax
from ..operators import graph, sampling
from ..session import settle
from .fixtures import DIGITS, EVSEQ, SEEDS, TOPK, VECSEQ, VGRAPH, event_tokens, glyph_rows, glyphs, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return (F.round(c, 6) + 0.0).alias(name)


def top_edges(spark, sf):
    """(src, dst, weight, rank) of the ten nearest by cosine."""
    nodes = graph.unit_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return settle(graph.nearest(nodes, 10).withColumnRenamed("sim", "weight"))


def labels(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("node"), F.col("label"))


def seeds(spark, sf):
    """Every fifth node keeps its label; the rest is uniform."""
    seen = labels(spark, sf).select("node", F.when(F.col("node") % 5 == 0, F.col("label")).alias("label"))
    return graph.seed_distribution(seen, DIGITS)


@query(f"with {TOPK} select src, dst, round(sim, 6) + 0.0 sim, rank::int rank from topk")
def dense_cosine_knn(spark, sf):
    return top_edges(spark, sf).select("src", "dst", r6("weight", "sim"), "rank")


@query(f"with {VGRAPH} select src, dst, round(weight, 6) + 0.0 weight from edges")
def mutual_knn(spark, sf):
    return graph.mutual(top_edges(spark, sf)).select("src", "dst", r6("weight", "weight"))


@query(f"with {TOPK} select src, dst, round(max(w), 6) + 0.0 weight from (select src, dst, sim w from topk union all select dst, src, sim from topk) group by src, dst")
def symmetric_knn(spark, sf):
    return graph.symmetric(top_edges(spark, sf)).select("src", "dst", r6("weight", "weight"))


@query(f"with {VGRAPH} select src, count(*) n, round(sum(weight), 6) + 0.0 degree from edges group by src")
def graph_degrees(spark, sf):
    return graph.degrees(graph.mutual(top_edges(spark, sf))).select("src", "n", r6("degree", "degree"))


@query(f"""with {VGRAPH}, d as (select node, count(dst) n, coalesce(sum(weight), 0) w from v left join edges on node = src group by node)
select sum(n)::bigint n_edges, round(sum(w), 6) + 0.0 weight, round(avg(n), 6) + 0.0 avg_degree, max(n) max_degree, min(n) min_degree,
  count(*) filter (where n = 0) n_empty, round(100.0 * count(*) filter (where n = 0) / count(*), 6) + 0.0 empty_percent from d""")
def graph_stats(spark, sf):
    s = graph.statistics(labels(spark, sf), graph.mutual(top_edges(spark, sf)))
    return s.select("n_edges", r6("weight", "weight"), r6("avg_degree", "avg_degree"), "max_degree", "min_degree", "n_empty", r6("empty_percent", "empty_percent"))


@query(f"with {VGRAPH} select round(sum(weight * case when a.label = b.label then 0 else 2 end) / 2, 6) + 0.0 violation from edges join v a on a.node = src join v b on b.node = dst")
def gold_violation(spark, sf):
    gold = graph.seed_distribution(labels(spark, sf), DIGITS)
    return graph.gold_violation(graph.mutual(top_edges(spark, sf)), gold).select(r6("violation", "violation"))


@query(f"with {VGRAPH}, {SEEDS} select round(sum(weight * a.p * (a.p - b.p)), 6) + 0.0 violation from edges join q0 a on a.node = src join q0 b on b.node = dst and a.state = b.state")
def graph_violation(spark, sf):
    return graph.violation(graph.mutual(top_edges(spark, sf)), seeds(spark, sf)).select(r6("violation", "violation"))


@query(f"""with {VGRAPH}, {SEEDS} select src node, a.state::int state, round(sum(weight * (a.p - b.p)), 6) + 0.0 grad
from edges join q0 a on a.node = src join q0 b on b.node = dst and a.state = b.state group by src, a.state""")
def graph_gradient(spark, sf):
    once = labels(spark, sf).select("node", F.lit(1).alias("freq"))
    g = graph.gradient(graph.mutual(top_edges(spark, sf)), seeds(spark, sf), once, DIGITS)
    return g.select("node", F.posexplode("grad").alias("state", "g")).select("node", "state", r6("g", "grad"))


@query(f"""with {VGRAPH}, {SEEDS}, g as (select src, a.state, sum(weight * (a.p - b.p)) g from edges join q0 a on a.node = src join q0 b on b.node = dst and a.state = b.state group by src, a.state)
select round(sum(g * g), 6) + 0.0 squared, round(sqrt(sum(g * g)), 6) + 0.0 norm from g""")
def gradient_norm(spark, sf):
    once = labels(spark, sf).select("node", F.lit(1).alias("freq"))
    g = graph.gradient(graph.mutual(top_edges(spark, sf)), seeds(spark, sf), once, DIGITS)
    return graph.norms(g, "grad").select(r6("squared", "squared"), r6("norm", "norm"))


def _step_sql(before: str, after: str, eta: str) -> str:
    return f"""m{after} as (select a.node, a.state, a.fixed, a.p - {eta} * coalesce(sum(weight * (a.p - b.p)), 0) r, a.p from {before} a left join edges on src = a.node
  left join {before} b on b.node = dst and b.state = a.state group by a.node, a.state, a.fixed, a.p),
{after} as (select node, state, fixed, case when fixed then p else greatest(r, 0) / sum(greatest(r, 0)) over (partition by node) end p from m{after})"""


_PROP2 = f"{VGRAPH}, {SEEDS}, {_step_sql('q0', 'q1', '0.05')}, {_step_sql('q1', 'q2', '(0.05 / 2)')}"


def _two_steps(spark, sf):
    edges = settle(graph.mutual(top_edges(spark, sf)))
    q = graph.propagate_once(edges, seeds(spark, sf), DIGITS, 0.05)
    return edges, graph.propagate_once(edges, q, DIGITS, 0.05 / 2)


@query(f"with {_PROP2} select node, state::int as label, round(p, 6) + 0.0 p from q2")
def label_prop_k2(spark, sf):
    return _two_steps(spark, sf)[1].select("node", F.posexplode("p").alias("label", "p")).select("node", "label", r6("p", "p"))


@query(f"""with {_PROP2}, top as (select node, arg_max(state, (round(p, 9), -state)) pred from q2 where not fixed group by node)
select count(*) n_test, count(*) filter (where pred = label) n_correct, round(100.0 * count(*) filter (where pred = label) / count(*), 6) + 0.0 acc from top join v using (node)""")
def label_prop_acc(spark, sf):
    q = _two_steps(spark, sf)[1].where(~F.col("fixed"))
    found = q.select("node", argmax(F.transform("p", lambda x: F.round(x, 9))).alias("pred")).join(labels(spark, sf), "node")
    hit = (F.col("pred") == F.col("label")).cast("long")
    return found.agg(F.count("*").alias("n_test"), F.sum(hit).alias("n_correct"), r6(100.0 * F.sum(hit) / F.count("*"), "acc"))


#: glyphs as tokens: those of every seventh vector are off the graph, and tag 9 is punctuation
_TOKENS = f"""toks as (select tag, case when node % 7 = 0 then null else node end node, seq_id % 5 < 3 lab from vecseq)"""


def _covered(spark, sf):
    off = F.transform("nodes", lambda n: F.when(n % 7 != 0, n))
    return glyph_rows(spark, sf).select("seq_id", "tags", off.alias("nodes"), "is_labeled")


@query(f"""with {VECSEQ}, {_TOKENS} select count(*) tokens, count(*) filter (where lab and node is not null) train_covered, count(*) filter (where not lab and node is not null) test_covered,
  count(*) filter (where not lab and node is null and tag = 9) test_punct, count(*) filter (where not lab) test_all from toks""")
def coverage_counts(spark, sf):
    return graph.coverage(_covered(spark, sf), 9)


@query(f"""with {_PROP2}, {VECSEQ}, {_TOKENS}, best as (select node, arg_max(state, (round(p, 9), -state)) label from q2 group by node)
select round(100.0 * count(*) filter (where case when t.node is null then tag = 9 else label = tag end) / count(*), 6) + 0.0 acc from toks t left join best using (node) where not lab""")
def propagation_token_accuracy(spark, sf):
    q = _two_steps(spark, sf)[1]
    found = q.select("node", argmax(F.transform("p", lambda x: F.round(x, 9))).alias("label"))
    return graph.test_accuracy(_covered(spark, sf), found, 9).select(r6("acc", "acc"))


@query()
def label_prop_converged(spark, sf):
    """(iterations, non_smoothness, acc); stops at a relative change of 1e-3."""
    edges = graph.mutual(top_edges(spark, sf))
    q, n, rough = graph.propagate(edges, seeds(spark, sf), DIGITS, iterations=60, stop=1e-3)
    found = graph.hard_labels(q.where(~F.col("fixed"))).withColumnRenamed("label", "pred").join(labels(spark, sf), "node")
    return found.agg(F.lit(n).alias("iterations"), F.lit(rough).alias("non_smoothness"), (100.0 * F.avg((F.col("pred") == F.col("label")).cast("double"))).alias("acc"))


# ---------------------------------------------------------------- samples

_ORDER = "(seq_id * 7919) % 10007, seq_id"


def _order():
    return (F.col("seq_id") * 7919) % 10007, F.col("seq_id")


@query(f"""with recursive {EVSEQ}, s as (select seq_id, row_number() over (order by seq_id) - 1 place from (select distinct seq_id from evseq)), n as (select count(*) n from s),
g(i, x) as (select 0, xor(12345::bigint, 25214903917::bigint)::hugeint union all select i + 1, (x * 25214903917::hugeint + 11) % 281474976710656::hugeint from g where i < 400),
v as (select i, ((x // 131072) % n)::bigint place from g, n where i > 0), d as (select place, row_number() over (order by min(i)) - 1 turn from v group by place)
select seq_id, turn >= 4 is_labeled from d join s using (place) where turn < 8""")
def seeded_draw(spark, sf):
    """Eight places of the sequences by the generator's order; the second four are labelled."""
    from ..operators import tokens

    s = tokens.dense_ids(event_tokens(spark, sf).select("seq_id").distinct(), "seq_id", name="place")
    turns = [sampling.draw_fold(s.select("place"), 4, 2, fold, key="place").withColumn("is_labeled", F.lit(fold == 1)) for fold in (0, 1)]
    return turns[0].unionByName(turns[1]).join(s, "place").select("seq_id", "is_labeled")


@query(f"""with {EVSEQ}, s as (select distinct seq_id from evseq), d as (select seq_id, row_number() over (order by {_ORDER}) - 1 r from s),
f as (select seq_id, case when r // 10 = 1 and r < 50 then 'train' else 'test' end split from d) select split, count(*) n, sum(seq_id)::bigint sum_id from f group by split""")
def fold_split(spark, sf):
    found = sampling.fold_split(event_tokens(spark, sf).select("seq_id").distinct(), 10, 5, 1, *_order())
    return found.groupBy("split").agg(F.count("*").alias("n"), F.sum("seq_id").alias("sum_id"))


@query(f"""with {EVSEQ}, s as (select distinct seq_id from evseq), d as (select seq_id from s order by {_ORDER} limit 50) select seq_id from s anti join d using (seq_id)""")
def unlabelled_anti(spark, sf):
    rows = event_tokens(spark, sf).select("seq_id").distinct()
    return sampling.split(rows, sampling.ordered_sample(rows, 50, *_order()))[1]


@query(f"""with {VECSEQ}, w as (select seq_id, max(fold) fold, string_agg(chr((97 + tag // 3)::int), '' order by pos) word from vecseq group by seq_id),
k as (select seq_id, left(word, 1) word from w where fold = 0), r as (select seq_id, word, row_number() over (partition by word order by {_ORDER}) - 1 round from k)
select seq_id, word, round::int round from r""")
def stratified_sample(spark, sf):
    """Turns of every word of the training fold within its stratum (the first letter's third of the alphabet)."""
    r = F.array_sort(F.collect_list(F.struct("pos", "tag")))
    words = glyphs(spark, sf).groupBy("seq_id").agg(F.max("fold").alias("fold"), r.alias("r")).where("fold = 0")
    words = words.select("seq_id", F.char(F.expr("97 + r[0].tag div 3")).alias("word"))
    return sampling.round_robin(words, "word", *_order()).select("seq_id", "word", F.col("round").cast("int").alias("round"))
