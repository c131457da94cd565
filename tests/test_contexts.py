import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import contexts, tokens
from seqloom.plans import text_queries

WORDS = ["The", "the", "cat", "nation", "12", "1,2", "eating", "ed", ".", ",", "!?", "<s0>", "ÉTÉ", "été", "\x0b7"]


@pytest.fixture
def corpus(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(contexts, "CHUNK", 40)  # so that features meet from many chunks
    rows = [(i, [WORDS[j] for j in rng.integers(0, len(WORDS), rng.integers(0, 30))]) for i in range(60)]
    return spark.createDataFrame([*rows, (60, [])], "seq_id long, tokens array<string>").repartition(3)


def test_kinds_of_features_as_their_strings_have_them(corpus):
    plain = tokens.context_features(corpus, text_queries.SUFFIXES).groupBy(F.substring_index("feature", "=", 1).alias("prefix")).agg(F.count("*").alias("n"), F.count_distinct("feature").alias("n_distinct"))
    assert sorted(map(tuple, contexts.feature_kinds(corpus, text_queries.SUFFIXES).collect())) == sorted(map(tuple, plain.collect()))


def test_no_row_a_feature_is_shuffled(spark, sf_dir):
    """A token's sixteen features stay where they are; what moves is a row for each chunk and bucket."""
    plan = text_queries.context_features(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" in plan


def test_templates_are_counted_where_all_their_words_are():
    assert set(contexts._COUNTED) == set(tokens.TEMPLATES)
    for name, (kind, place, columns) in contexts._COUNTED.items():
        words, ends = tokens.parse_template(name)
        if kind == 2:
            assert words == [0] and ends == {(0,): [], (0, 1): [1], (0, 2): [-1]}[columns]
        else:
            assert [contexts._PLACES[kind][c] - place for c in columns] == words and not ends and columns[:2] == (0, 1)


def test_sums_of_information_as_the_vectors_have_them(corpus):
    vectors = tokens.pmi_vectors(tokens.context_features(corpus, text_queries.SUFFIXES))
    per = vectors.groupBy(F.substring_index("feature", "=", 1).alias("prefix")).agg(F.count("*").alias("n"), F.avg("pmi").alias("avg_pmi"), F.sum(F.col("value") * F.col("value")).alias("mass"))
    want = {r["prefix"]: r for r in per.collect()}
    got = contexts.pmi_summary(corpus, text_queries.SUFFIXES).collect()
    assert {r["prefix"] for r in got} == set(want) == set(tokens.TEMPLATES)
    for r in got:
        assert r["n"] == want[r["prefix"]]["n"]
        assert (r["avg_pmi"], r["mass"]) == pytest.approx((want[r["prefix"]]["avg_pmi"], want[r["prefix"]]["mass"]), abs=1e-9)


def test_joint_counts_are_not_shuffled_by_row(spark, sf_dir):
    plan = text_queries.document_pmi(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_trigrams_and_their_coverage(corpus):
    index = tokens.ngrams(corpus).where("ngram is not null").groupBy("ngram").agg(F.count("*").alias("freq"))
    assert sorted(map(tuple, contexts.trigrams(corpus).collect())) == sorted(map(tuple, index.collect()))
    found = tokens.ngrams(corpus, lookup=True).join(index.where("freq >= 2"), "ngram", "left").agg(F.count("freq"), F.count("*") - F.count("freq"))
    assert tuple(contexts.trigram_coverage(corpus).first()) == tuple(found.first())


def test_trigrams_of_nothing(spark):
    none = spark.createDataFrame([], "seq_id long, tokens array<string>")
    assert contexts.trigrams(none).count() == contexts.feature_kinds(none, []).count() == contexts.vocabulary(none).count() == 0
    assert tuple(contexts.trigram_coverage(none).first()) == (0, 0)


def test_index_is_looked_up_without_a_join(spark, sf_dir):
    plan = text_queries.trigram_lookup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_reduce_tasks_follow_the_input_not_the_session(spark, sf_dir):
    """Of a larger table more buckets are made, each of as many bytes."""
    n = len(spark.read.parquet(f"{sf_dir}/documents.parquet").inputFiles())
    frame = text_queries.documents_as_sequences(spark, sf_dir)
    assert n and contexts._buckets(frame) == spark.sparkContext.defaultParallelism
    contexts.BUCKET, kept = 10_000, contexts.BUCKET
    try:
        assert contexts._buckets(frame) > spark.sparkContext.defaultParallelism
        assert text_queries.trigram_nodes(spark, sf_dir).rdd.getNumPartitions() == contexts._buckets(frame)
    finally:
        contexts.BUCKET = kept


def test_vocabulary_with_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(contexts, "CHUNK", 5)
    rows = [(7, ["a", "b", "c"]), (3, ["c", "c", "a"]), (3, ["x", "b"]), (None, ["c", "z"]), (9, []), (1, None), (3, ["q", "x", "x"])]
    seqs = spark.createDataFrame(rows, "seq_id long, tokens array<string>").coalesce(1)
    plain = tokens.vocabulary(seqs.select("seq_id", F.posexplode("tokens").alias("pos", "token")))
    assert sorted(map(str, contexts.vocabulary(seqs).collect())) == sorted(map(str, plain.collect()))
    plan = text_queries.tokens.vocabulary and contexts.vocabulary(seqs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row a token
