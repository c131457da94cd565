"""Hot keys, names that clash, very long texts, and many sources."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import byte_cnn, language_id, licenses, mixing, near_dedup, packing, quality_rules, toxicity, urls
from seqloom.llm.chain import marginals
from seqloom.llm.common import CODE, NOT_BLANK, flat, running, span_hash, spans, word_hashes
from test_corpus_operators import DOCS, brute_components, check_pieces, docs


# ---------------------------------------------------------------- hot keys


def test_packing_spreads_one_id_and_text(spark):
    table = docs(spark, [(1, "a b c", "s")] * 6000 + [(None, None, "s")] * 4000)
    rows = packing.pack(table, group_docs=100).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 10_000 and len(groups) == 100 and max(groups.values()) < 200
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 10_000


def test_mixing_spreads_one_id_and_size(spark):
    rows = [(1, "a b c", "s")] * 5000 + [(None, "d e f", "s")] * 3000 + [(10 + i, "w " * (i % 50), "t") for i in range(2000)]
    table = docs(spark, rows)
    mixed = mixing.mix(table, shard_docs=50)
    got = mixed.collect()
    assert len(got) == len(rows)
    per = {s: sum(r["taken"] for r in got if r["source"] == s) for s in "st"}
    for s in "st":
        target = next(r["target"] for r in got if r["source"] == s)
        assert abs(per[s] - target) <= 0.02 * target
    again = mixing.mix(table.repartition(5), shard_docs=50)
    key = lambda x: Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in x)
    assert key(again.collect()) == key(got)
    plan = mixing._spread(spark.createDataFrame([(None, "s", 3, i % 4, i, 1, 40, 0) for i in range(2000)], "doc_id long, source string, size long, part int, place long, parts long, crowd long, shard long"), 7)
    crowd = Counter(r["shard"] for r in plan.collect())
    assert len(crowd) == 40 and max(crowd.values()) < 120


def test_a_tiny_source_changes_no_others_blocks(spark):
    rows = [(i, "w " * (i % 90 + 200), "ab"[i % 2]) for i in range(2000)]
    big = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, rows), weights=(1,)).collect()}
    with_one = {r["doc_id"]: r for r in mixing.mix(docs(spark, [*rows, (-1, "word", "zz")]), weights=(1,)).collect()}
    assert with_one[-1]["taken"] == 3
    moved = [abs(with_one[i]["taken"] - n) for i, n in big.items()]
    assert sum(moved) <= 4 * 256 and sum(m > 0 for m in moved) <= 8


def test_many_sources_without_a_loop(spark):
    rng = np.random.default_rng(0)
    votes, group = rng.integers(1, 500, 100_000).astype(float), np.sort(rng.integers(0, 60_000, 100_000))
    seats = np.bincount(group, votes / 7, 60_000).astype(np.int64)
    began = time.time()
    won = mixing.sainte_lague(votes, np.full(100_000, 1000), seats, group)
    goal = mixing.targets(rng.integers(1, 900, 100_000), np.resize([5.0, 2, 1], 100_000), 3)
    assert time.time() - began < 30 and (np.bincount(group, won, 60_000) == seats).all() and (goal > 0).all()
    for g in range(0, 60_000, 9000):
        mine = group == g
        assert won[mine].tolist() == mixing.sainte_lague(votes[mine], np.full(mine.sum(), 1000), seats[g]).tolist()
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("h"), "id").alias("source"))
    assert mixing.mix(table).agg(F.sum("taken")).first()[0] == pytest.approx(60_000, rel=0.02)


# ---------------------------------------------------------------- names that clash


@pytest.mark.parametrize("name", ["_copies", "row", "n", "h", "own_id", "place", "part", "shard", "taken", "size", "target", "words", "rep", "label", "salt", "band", "node", "component", "judged", "lang_pred", "_text", "_low", "grp"])
def test_extra_columns_pass_through_stages(spark, name):
    rows = [(i, f"the house of number {i} is on the hill and has a garden " * 8, "s") for i in range(6)]
    table = docs(spark, rows).withColumn(name, F.lit(7))
    for stage in (language_id.keep_identified, near_dedup.one_of_each, mixing.remix) if name in ("_copies", "row", "rep") else (mixing.remix,):
        out = stage(table)
        assert out.columns == table.columns
        assert out.count() > 0 and out.where(F.col(name) != 7).count() == 0


# ---------------------------------------------------------------- long texts


def test_hashes_of_words_do_not_hang_on_the_parts():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 9, 700]))) for _ in range(300))
    data, off = flat(pa.array([text]))
    starts, ends, _ = spans(data, off, NOT_BLANK)
    whole = span_hash(running(data, CODE), starts, ends)
    for most in (64, 500, 1 << 19):
        assert (word_hashes(data, starts, ends, CODE, most) == whole).all()


def test_windows_of_a_chain_give_its_marginals():
    rng = np.random.default_rng(1)
    rows = [(b"the house is on the hill", "en"), (b"la maison est dans la rue", "fr")] * 6
    model = language_id.LanguageModel.train(rows, epochs=4).model
    text = " ".join(rng.choice(["the", "la", "rue", "hill", "x1y", "3.5", "été"]) for _ in range(400))
    data, off = flat(pa.array([text]))
    (_, _, w, want), = model.labelled(data, off)
    got = [p for *_, p in model.labelled(data, off, most=50)]
    assert len(got) > 5 and np.allclose(np.concatenate(got), want)
    assert marginals(np.zeros((1, 2)), np.array([False]), np.zeros((2, 2)), np.zeros(2), into=np.array([1.0, 3.0])).shape == (1, 2)


def test_toxic_spans_across_windows(monkeypatch):
    from seqloom.llm import word_crf

    rows = [("good day to you all", 0)] * 20 + [("you idiot moron there", 1)] * 20
    m = toxicity.ToxicModel.train(rows, [20, 20])
    texts = ["é good idiot moron you " * 30]
    want = m.spans(pa.array(texts))
    whole = word_crf.Model.labelled
    monkeypatch.setattr(word_crf.Model, "labelled", lambda self, data, off: whole(self, data, off, most=17))
    got = m.spans(pa.array(texts))
    assert got[1] == want[1] and len(got[1][0]) == 30 and np.allclose(got[0], want[0])


def test_urls_are_scored_in_windows():
    model = urls.train(["good/garden"] * 8 + ["garden.org"] * 4, ["bad/casino"] * 8 + ["pills.biz"] * 4)
    texts = ["garden/" * 20, "", "casino", "pills" * 9]
    assert np.allclose(model.score(texts, most=13), model.score(texts))


LONG = 3 << 20


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(vocabulary) for _ in range(LONG // 7))
    return {1: text, 2: "x" * (1 << 20), 3: "a\n\n  b " * (1 << 16), 4: None}


def test_long_texts_pack(spark, long_texts):
    check_pieces(packing.pack(docs(spark, [(i, t, "s") for i, t in long_texts.items()])).collect(), long_texts)


def test_long_texts_pass_every_text_operator(spark, long_texts):
    table = docs(spark, [(i, t, "s") for i, t in long_texts.items()])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    en = [(b"the house is on the hill", "en"), (b"la maison est dans la rue", "fr")] * 4
    assert language_id.identify(table, language_id.LanguageModel.train(en)).where("lang_pred is null").count() == 0
    toxic = toxicity.ToxicModel.train([("good day", 0), ("you idiot", 1)] * 5, [5, 5])
    assert toxicity.score(table, toxic).where("toxic_score between 0 and 1").count() == 4
    assert byte_cnn.score(table, byte_cnn.learn(table, labels, longest=100, epochs=1)).where("quality_score between 0 and 1").count() == 4
    assert near_dedup.near_duplicates(table).where("kept").count() == 4
    assert licenses.digest(table).count() == 4 and quality_rules.judge(table).where("doc_id = 1 and n_words > 400000").count() == 1


# ---------------------------------------------------------------- similarity of a stage's own


def test_near_duplicates_at_another_threshold(spark):
    rng, texts = random.Random(6), {}
    for family in range(12):
        base = [f"w{family}x{i}" for i in range(160)]
        for i in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(160)] = f"z{family}y{i}"
            texts[family * 20 + i] = " ".join(w)
    table = docs(spark, [(i, t, "s") for i, t in texts.items()])
    for block_docs in (1024, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table, percent=80, bands=56, block_docs=block_docs).collect()}
        assert got == brute_components(texts, 80)


def test_empty_documents_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert language_id.identify(empty, keep_text=False).count() == 0 and mixing.remix(empty).count() == 0
