"""Packing, near duplicates, mixing, top-k search and the pipeline, against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import mixing, near_dedup, packing, topk
from seqloom.llm.components import components
from seqloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# ---------------------------------------------------------------- packing


def check_pieces(rows, texts, length=1024):
    tok = packing.Encoder(*packing.default_tokenizer()).tok
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 0], np.uint32)
        pieces.sort(key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()]
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for seq in by_seq.values():
        seq.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in seq] == [0, *np.cumsum([r["length"] for r in seq])[:-1].tolist()]
        assert sum(r["length"] for r in seq) <= length
    return len(by_seq)


def test_packing_round_trip(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    rows = packing.pack(table).collect()
    n = check_pieces(rows, texts)
    assert n <= 1.1 * math.ceil(sum(r["length"] for r in rows) / 1024) + 1


def test_packing_odd_texts(spark):
    texts = {1: None, 2: "", 3: " ", 4: "<|endoftext|> a", 5: "a  b\n\n c ", 6: "x" * 5000, 7: "é ü 日本語 🙂" * 900, 8: "a b"}
    table = docs(spark, [(i, t, "s") for i, t in texts.items()]).withColumns({"sequence_id": F.lit(1), "start": F.lit("x")})
    check_pieces(packing.pack(table).collect(), texts)
    again = packing.pack(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")]))
    assert again.count() == 3 and again.select("sequence_id", "offset").distinct().count() == 3
    assert packing.pack(table.limit(0)).count() == 0


def test_first_fit_decreasing_is_what_it_says():
    rng = random.Random(0)
    for _ in range(20):
        sizes = np.array([rng.randint(1, 50) for _ in range(60)])
        bins, offsets = packing.first_fit_decreasing(sizes, 50)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
            if at == len(free):
                free.append(50)
            assert (bins[i], offsets[i]) == (at, 50 - free[at])
            free[at] -= sizes[i]


def test_packing_in_many_groups(spark):
    table = docs(spark, [(i, "word " * (i % 90), "s") for i in range(300)])
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    check_pieces(packing.pack(table, length=64, group_docs=50).collect(), texts, 64)


# ---------------------------------------------------------------- near duplicates


def brute_components(texts, percent=85):
    def shingles(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for blank in "\t\n\x0b\x0c\r":
            lower = lower.replace(blank, " ")
        w = [x for x in lower.split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    holders = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            holders[s].add(i)
    for i in ids:
        near = {j for s in sets[i] for j in holders[s] if j > i}
        for j in near:
            same = len(sets[i] & sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_near(found, texts):
    want = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_near_duplicates_of_the_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_near(near_dedup.near_duplicates(table), {r["doc_id"]: r["text"] for r in table.collect()})


def test_near_duplicates_in_blocks_and_chains(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts, now = {}, list(base)
    for i in range(60):  # a chain whose ends are far apart
        texts[i] = " ".join(now)
        now = now[1:] + [f"n{i}"]
    for i in range(60, 140):  # copies of one text, and near ones
        w = list(base)
        if i % 3:
            w[rng.randrange(120)] = f"z{i}"
        texts[i] = (" " if i % 2 else "\n").join(w).upper() if i % 5 == 0 else "\t".join(w)
    texts |= {200: None, 201: "", 202: "a b", 203: "A\nB", 204: "a b c d e", 205: "a b c d e", 206: "lone text of six words here"}
    check_near(near_dedup.near_duplicates(docs(spark, [(i, t, "s") for i, t in texts.items()]), block_docs=16), texts)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (2, None, "s"), (3, "", "s"), (4, "A B C D E F", "s")]
    table = docs(spark, rows).withColumns({"kept": F.lit(1), "component_id": F.lit("x"), "rep": F.lit(0)})
    got = near_dedup.near_duplicates(table)
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()) == Counter([(1, 1, True), (1, 1, True), (None, None, True), (2, 2, True), (3, 3, True), (4, 1, False)])
    stay = near_dedup.one_of_each(table)
    assert stay.columns == table.columns
    assert Counter(r["doc_id"] for r in stay.collect()) == Counter([1, None, 2, 3])
    assert near_dedup.near_duplicates(table.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


# ---------------------------------------------------------------- mixing


def highest_quotients(votes, caps, seats):
    won = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in zip(votes, caps) if v > 0))):
        q = [v / (2 * w + 1) if w < c and v > 0 else -1 for v, w, c in zip(votes, won, caps)]
        won[q.index(max(q))] += 1
    return won


def test_seats_go_to_the_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(1, 8)
        votes, caps, seats = rng.random(n) * 100, rng.integers(0, 30, n), int(rng.integers(0, 120))
        assert mixing.sainte_lague(votes, caps, seats).tolist() == highest_quotients(votes.tolist(), caps.tolist(), seats)
    assert mixing.sainte_lague(np.zeros(3), np.ones(3), 5).tolist() == [0, 0, 0]
    assert mixing.sainte_lague(np.ones(4), np.full(4, 9), 2).sum() == 2


def test_targets_stop_at_a_multiple_of_the_source():
    got = mixing.targets(np.array([10, 1000, 0, 500]), np.array([5.0, 2, 1, 5]), 3)
    assert got[0] == 30 and got[2] == 0 and got.sum() == pytest.approx(1510)
    assert got[1] / got[3] == pytest.approx(2 / 5)
    assert mixing.targets(np.array([5, 5]), np.array([5.0, 2]), 3).sum() == pytest.approx(10)


def test_mix_comes_near_its_targets(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(table, shard_docs=4).collect()
    source = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in table.collect()}
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        s, n = source[r["doc_id"]]
        assert r["size"] == n and 0 <= r["taken"] <= 3 * n
        taken[s] += r["taken"]
        size[s] += n
        target[s] = (r["target"], r["source_size"])
    assert len(rows) == len(source)
    for s in size:
        assert target[s][1] == size[s] and abs(taken[s] - target[s][0]) <= 0.02 * target[s][0] + 8
    order = sorted(size)
    want = mixing.targets(np.array([size[s] for s in order]), np.array([(5, 2, 1)[i % 3] for i in range(len(order))], float), 3)
    assert [target[s][0] for s in order] == pytest.approx(want.tolist())
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(table.repartition(7), shard_docs=4).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mix_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x " * 3000, None), (4, "y " * 3000, "Ä"), (4, "y " * 3000, "Ä"), (None, "z", "a"), (5, "only", "Z")]
    table = docs(spark, rows).withColumns({"taken": F.lit("t"), "words": F.lit(1), "n": F.lit(1), "shard": F.lit(2)})
    got = mixing.mix(table.select("doc_id", "text", "source", "taken", "words", "n"))
    assert got.count() == len(rows) and got.where("taken is null or taken > 3 * size or taken < 0").count() == 0
    assert {r["source_size"] for r in got.where("source is null").collect()} == {3000}
    assert got.where("size = 0 and taken <> 0").count() == 0
    assert mixing.mix(table.limit(0)).count() == 0
    out = mixing.remix(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns


def test_whole_copies_meet_the_targets_at_every_length(spark):
    rng, texts, at = random.Random(8), [], 0
    for source in ("a", "b", "c"):
        for i in range(600):
            texts.append((at, "w " * (rng.randint(1000, 3000) if i % 5 == 0 else rng.randint(20, 400)), source))
            at += 1
    table = docs(spark, texts)
    target = {r["source"]: r["target"] for r in mixing.mix(table).join(table.select("doc_id", "source").withColumnRenamed("source", "s"), "doc_id").select(F.col("s").alias("source"), "target").distinct().collect()}
    size, long_, got, got_long = Counter(), Counter(), Counter(), Counter()
    for _, t, s in texts:
        n = len(t) // 2
        size[s] += n
        long_[s] += n if n >= 1000 else 0
    for r in mixing.remix(table).collect():
        n = len(r["text"]) // 2
        got[r["source"]] += n
        got_long[r["source"]] += n if n >= 1000 else 0
    for s in size:
        assert abs(got[s] - target[s]) <= 0.02 * size[s]
        assert abs(got_long[s] / long_[s] - target[s] / size[s]) <= 0.15


# ---------------------------------------------------------------- top-k


def brute_top(codes, queries, k):
    out = {}
    for q, c in queries:
        out[q] = [(i, d) for d, i in sorted((bin((c ^ e) & (1 << 64) - 1).count("1"), i) for i, e in codes)[:k]]
    return out


@pytest.mark.parametrize("segments, k", [(None, 5), (4, 3), (32, 7)])
def test_top_k_is_exact(spark, segments, k):
    rng = np.random.default_rng(k)
    values = rng.integers(-(2**63), 2**63 - 1, 300)
    near = [int(v) ^ (1 << int(rng.integers(0, 63))) for v in values[:60]]
    codes = list(enumerate([*map(int, values), *near, *[int(values[0])] * 40]))
    queries = [(i, c) for i, c in codes if i % 25 == 0]
    df, q = (spark.createDataFrame(x, "id long, code long") for x in (codes, queries))
    got = defaultdict(list)
    for r in topk.top_k(df, q, k, segments=segments).orderBy("query", "rank").collect():
        got[r["query"]].append((r["id"], r["distance"]))
    assert got == brute_top(codes, queries, k)


def test_scan_is_exact_and_small_tables_are_whole(spark):
    codes = [(i, (i * 2654435761) % 2**40) for i in range(50)]
    df = spark.createDataFrame(codes, "id long, code long")
    index = df.groupBy("code").agg(F.collect_list("id").alias("ids"))
    got = {r["query"]: [(b["id"], b["d"]) for b in r["best"]] for r in topk.scan(index, df.select("code"), 4, block=7).collect()}
    want = brute_top(codes, codes, 4)
    assert got == {c: want[i] for i, c in codes}
    few = topk.top_k(df.where("id < 3"), df.where("id = 0"), 10).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in few] == brute_top(codes[:3], codes[:1], 10)[0]


def test_top_k_broadcasts_no_lookups(spark, monkeypatch):
    """The asked codes are a small table, but their probes are many rows: none may pass through the driver."""
    rng = np.random.default_rng(8)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(2**63), 2**63 - 1, 400))]
    df, plans, table = spark.createDataFrame(codes, "id long, code long"), [], topk.Scratch.table

    def planned(self, made, name):
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return table(self, made, name)

    monkeypatch.setattr(topk.Scratch, "table", planned)
    found = topk.top_k(df, df.where("id % 100 = 0"), 5)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert found.count() == 20


def test_top_k_odd_rows(spark):
    v = [0.5] * 64
    rows = [(0, v, 1), (0, v, 1), (1, None, 2), (None, v, 3), (2, [0.1], 4), (3, [float("nan")] * 64, 5), (4, [-x for x in v], 6), (5, [None] * 64, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int").withColumn("rank", F.lit("x"))
    got = [(r["query"], r["rank"], r["id"], r["distance"]) for r in topk.search(df).orderBy("rank").collect()]
    assert got == [(0, 1, 0, 0), (0, 2, 3, 64), (0, 3, 4, 64), (0, 4, 5, 64)]
    assert topk.search(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline
    from seqloom.llm import language_id, quality_rules

    scratch, table = Scratch(spark, "stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, inputs = table, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = out
        out = scratch.table(stage(spark, out, sf_dir), name)
        if name != "packed":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {n: [r.asDict() for r in df.collect()] for n, df in inputs.items()}
    # languages: texts of one language stay as they are
    assert len(kept["rules"]) > 0.95 * len(kept["languages"])
    # rules: what the operator keeps, by its verdict on this input
    verdict = {r["doc_id"]: r for r in quality_rules.judge(inputs["rules"]).collect()}
    assert {r["doc_id"]: r["text"] for r in kept["duplicates"]} == {i: r["clean_text"] for i, r in verdict.items() if r["kept"]}
    # duplicates: one of each brute-force component
    want = {c for _, c in brute_components({r["doc_id"]: r["text"] for r in kept["duplicates"]}).values()}
    assert {r["doc_id"] for r in kept["mixture"]} == want and len(kept["mixture"]) == len(want)
    # mixture: whole copies, near what the mix takes
    taken = {r["doc_id"]: round(r["taken"] / r["size"] + 1e-9) for r in mixing.mix(inputs["mixture"]).collect() if r["size"]}
    assert Counter(r["doc_id"] for r in kept["packed"]) == Counter({i: n for i, n in taken.items() if n})
    # packing: every copy's tokens lie in one piece each
    texts = {r["doc_id"]: r["text"] for r in kept["packed"]}
    tok = packing.Encoder(*packing.default_tokenizer()).tok
    tokens = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    total = Counter()
    for r in out.collect():
        total[r["doc_id"]] += r["length"]
    assert total == Counter({i: tokens[i] * taken[i] for i in texts})
    assert language_id.UNKNOWN == "und" and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    out = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        out = Scratch(spark, "empty").table(stage(spark, out, ""), "t")
    assert out.count() == 0
