import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as T
from seqloom.operators import tokens


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("s, yes", [("12", True), ("1.5", True), ("1,000", True), (",1", False), ("1.", False), ("-3", False), ("12\n", True), ("", False)])
def test_numbers(spark, s, yes):
    assert one(spark, T.is_numerical(F.col("s")), s=s) is yes


@pytest.mark.parametrize("language, s, yes", [("english", "?!", True), ("english", "a.", False), ("german", "$,", True), ("german", ",", False), ("swedish", "IK", True), ("swedish", "ID", False)])
def test_punctuation(spark, language, s, yes):
    assert one(spark, T.is_punctuation(F.col("s"), language), s=s) is yes


def test_fields_trim_like_control_characters_are_blanks(spark):
    assert one(spark, T.fields(F.col("s")), s=" \x01a\tb\t\t\r") == ["a", "b"]


def test_suffixes(spark):
    known = ["g", "ng", "ing", "testing"]
    assert one(spark, T.longest_suffix(F.col("s"), known), s="testing") == "ing"
    assert one(spark, T.longest_suffix(F.col("s"), known), s="ng") == ""
    assert one(spark, T.all_suffixes(F.col("s"), known), s="testing") == ["g", "ng", "ing", "testing"]
    assert one(spark, T.all_suffixes(F.col("s"), known), s="") == []


def test_logsum_and_entropy(spark):
    assert one(spark, T.logsum(F.col("a"), F.col("b")), a=0.0, b=0.0) == pytest.approx(0.693147, abs=1e-6)
    assert one(spark, T.logsum(F.col("a"), F.col("b")), a=float("-inf"), b=2.0) == 2.0
    assert one(spark, T.entropy_bits(F.col("p")), p=[0.5, 0.5, 0.0]) == pytest.approx(1.0)
    assert one(spark, T.clip_normalize(F.col("p")), p=[-1.0, 1.0, 3.0]) == [0.0, 0.25, 0.75]
    assert one(spark, T.clip_normalize(F.col("p")), p=[-1.0, 0.0]) is None
    assert one(spark, T.argmax(F.col("p")), p=[0.4, 0.4, 0.2]) == 0


def test_ngrams_and_pads(spark):
    rows = spark.createDataFrame([(1, ["a", "12", "b", "."])], "seq_id long, tokens array<string>")
    got = {r["pos"]: r["ngram"] for r in tokens.ngrams(rows).collect()}
    assert got == {0: "<s0> a <num>", 1: "a <num> b", 2: "<num> b .", 3: None}
    wide = rows.select(tokens.padded(F.slice("tokens", 1, 1), 2).alias("w")).first()["w"]
    assert wide == ["<s1>", "<s0>", "a", "</s0>", "</s1>"]
    # an even size pads a lookup on the left less
    assert [r["ngram"] for r in tokens.ngrams(rows, 2, lookup=True).orderBy("pos").collect()][0] == "a <num>"


def test_context_feature_of_a_suffix_template(spark):
    rows = spark.createDataFrame([(1, ["Running", "fast"])], "seq_id long, tokens array<string>")
    got = {r["feature"] for r in tokens.context_features(rows, ["ing"]).where("pos = 0").collect()}
    assert "w2s3=<W>=running<SF>=" in got and "w24=<W>=running<W>=</s0>" in got and "w2s1=<W>=running<SF>=" in got
    assert len(got) == len(tokens.TEMPLATES)
    assert {f.split("=")[0] for f in got} == set(tokens.TEMPLATES)
    assert "w2s1=<W>=fast<SF>=ing" in {r["feature"] for r in tokens.context_features(rows, ["ing"]).where("pos = 1").collect()}


def test_pmi_of_literal_counts(spark):
    # two nodes; every template occurs once an occurrence
    rows = []
    for gram, feature, n in [("x", "f", 2), ("y", "g", 2)]:
        rows += [(gram, f"{t}={feature}") for t in tokens.TEMPLATES] * n
    got = tokens.pmi_vectors(spark.createDataFrame(rows, "ngram string, feature string")).collect()
    assert {round(r["pmi"], 9) for r in got} == {1.0}
    assert sum(r["value"] ** 2 for r in got if r["ngram"] == "x") == pytest.approx(1)


def test_dense_ids_are_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = [(r["k"], r["id"]) for r in tokens.dense_ids(df, "k").orderBy("k").collect()]
    assert got == [(i, i) for i in range(1000)]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "seq_id long, tokens array<string>")
    assert tokens.ngrams(rows).count() == 0
    assert tokens.dense_ids(rows.select("seq_id"), "seq_id").count() == 0
    assert tokens.pmi_vectors(tokens.context_features(rows, [])).count() == 0
