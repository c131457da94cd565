"""The three jobs, from files to files: build a graph, train a tagger of words, train a reader of letters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions.text import UNIVERSAL_TAGS, is_punctuation
from ..operators import crf, em, features, graph, sampling, tokens
from ..session import settle
from ..sources import text_files


def read_corpus(spark: SparkSession, c: Config) -> DataFrame:
    """(seq_id, fold, tokens, tags) of tagged sentences; ids follow file, then sentence."""
    rows = text_files.read_conll(spark, c.data_path, c.encoding)
    if c.umap_path:
        table = text_files.read_tag_map(spark, c.umap_path, UNIVERSAL_TAGS, c.encoding)
        rows = rows.join(F.broadcast(table), "tag", "left").withColumn("tag", F.coalesce("utag", F.lit("X"))).drop("utag")
    words = F.array_sort(F.collect_list(F.struct("pos", "token", "tag")))
    rows = rows.groupBy("fold", "sent_id").agg(words.alias("r"))
    return tokens.dense_ids(rows, "fold", "sent_id", name="seq_id").select("seq_id", "fold", F.col("r.token").alias("tokens"), F.col("r.tag").alias("tags"))


def build_graph(spark: SparkSession, c: Config) -> tuple[DataFrame, DataFrame]:
    """Writes and returns (edges, index): nodes are n-grams, numbered in their order."""
    corpus = settle(read_corpus(spark, c).select("seq_id", "tokens"))
    # a dictionary of suffixes is small by nature
    suffixes = [r["suffix"] for r in text_files.read_suffixes(spark, c.suffix_path, c.language, c.encoding).collect()] if c.suffix_path else []
    vectors = settle(tokens.pmi_vectors(tokens.context_features(corpus, suffixes, c.ngram_size, c.context_size, c.language)))
    index = settle(tokens.dense_ids(vectors.select("ngram").distinct(), "ngram", name="node"))
    nodes = graph.sparse_nodes(vectors).drop("node").join(index, "ngram").select("node", "feature", "value")
    top = graph.nearest(nodes, c.neighbors, c.min_similarity, sparse=True).select("src", "dst", F.col("sim").alias("weight"))
    edges = settle(graph.mutual(top) if c.mutual else graph.symmetric(top))
    text_files.write_graph(edges, c.graph_path, c.encoding)
    text_files.write_ngram_index(index, c.ngram_path, c.encoding)
    return edges, index


def _scale(spark: SparkSession, rows: DataFrame, design: crf.Design) -> float:
    """Emission mass over transition mass of the labelled sequences."""
    steps = rows.where("is_labeled").select(F.aggregate("obs", F.lit(0), lambda a, x: a + F.size(x)).alias("own"), F.size(F.col("obs")[0]).alias("first"), F.size("obs").alias("n"))
    r = steps.agg(F.sum(3 * F.col("own") - F.col("first")).alias("e"), F.sum(F.col("n") + 1).alias("t")).first()
    return float(r["e"]) / (float(r["t"]) * (7 if design.order == 2 else 3)) if r["t"] else 1.0


def train(spark: SparkSession, rows: DataFrame, edges: DataFrame, design: crf.Design, c: Config) -> tuple[np.ndarray, DataFrame]:
    """(parameters, metrics(iter, objective, train_acc, test_acc)) of ``rows`` as chain models read them."""
    design = replace(design, backoff=c.backoff)
    if c.scale_features:
        design = replace(design, scale=_scale(spark, rows, design))
    theta, log = em.fit(rows, edges, design, c.options())
    return theta, spark.createDataFrame(log, "iter int, objective double, train_acc double, test_acc double")


def word_features(c: Config) -> Callable[[DataFrame], DataFrame]:
    """The built-in extractor: ``tokens(token)`` to rows ``(token, name)``, a name per observation feature."""

    def extract(kinds: DataFrame) -> DataFrame:
        found = features.emission_templates(F.col("token"), c.order == 2, c.language)
        return kinds.select("token", F.explode(found).alias("f")).select("token", F.concat_ws("=", "f.template", "f.value").alias("name"))

    return extract


def tagger_rows(spark: SparkSession, c: Config, corpus: DataFrame, extract: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[str], int]:
    """(rows, tags, observations): words' features as numbers, n-grams as nodes, a sample labelled.

    ``extract`` maps distinct tokens to rows ``(token, name)`` of features, in place of the built-in ones.
    With ``c.prune``, punctuation may only have the tag of punctuation, where there is one.
    """
    tags = sorted(r["t"] for r in corpus.select(F.explode("tags").alias("t")).distinct().collect())
    seen = corpus.select("seq_id", F.posexplode("tokens").alias("pos", "token"))
    kinds = seen.select("token").distinct()
    named = (extract or word_features(c))(kinds).select("token", "name")
    alphabet = settle(tokens.dense_ids(named.select("name").distinct(), "name", name="obs"))
    of_token = named.join(alphabet, "name").groupBy("token").agg(F.sort_array(F.collect_list(F.col("obs").cast("int"))).alias("obs"))
    placed = seen.join(of_token, "token", "left").withColumn("obs", F.coalesce("obs", F.array().cast("array<int>")))
    if c.ngram_path:
        index = text_files.read_ngram_index(spark, c.ngram_path, c.encoding)
        grams = tokens.ngrams(corpus.select("seq_id", "tokens"), c.ngram_size, c.language, lookup=True).select("seq_id", "pos", "ngram")
        placed = placed.join(grams, ["seq_id", "pos"]).join(index, "ngram", "left")
    else:
        placed = placed.withColumn("node", F.lit(None).cast("long"))
    mark = F.lit(None).cast("array<int>")
    if c.prune and "." in tags:
        mark = F.when(is_punctuation(F.col("token"), c.language), F.array(F.lit(tags.index("."))))
    r = placed.withColumn("allowed", mark).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "obs", "node", "allowed"))).alias("r"))
    number = F.transform("tags", lambda t: (F.array_position(F.array(*map(F.lit, tags)), t) - 1).cast("int"))
    rows = corpus.select("seq_id", number.alias("tags")).join(r, "seq_id").select("seq_id", "tags", F.col("r.obs").alias("obs"), F.col("r.node").alias("nodes"), F.col("r.allowed").alias("allowed"))
    drawn = sampling.draw_fold(corpus.where(F.col("fold") == c.seed_folder), c.labels, c.folds, c.fold, c.seed)
    return rows.join(F.broadcast(drawn), "seq_id", "left").withColumn("is_labeled", F.coalesce("is_labeled", F.lit(False))), tags, alphabet.count()


def train_tagger(spark: SparkSession, c: Config, extract: Callable[[DataFrame], DataFrame] | None = None) -> tuple[np.ndarray, DataFrame]:
    rows, tags, n = tagger_rows(spark, c, settle(read_corpus(spark, c)), extract)
    edges = text_files.read_graph(spark, c.graph_path, c.encoding)
    return train(spark, settle(rows), edges, crf.Design(len(tags), n, c.order), c)


def train_letters(spark: SparkSession, c: Config) -> tuple[np.ndarray, DataFrame]:
    """Labelled words are drawn in turns over the distinct words; every glyph is its own node."""
    glyphs = text_files.read_letters(spark, c.data_path, c.encoding)
    if c.max_letters:
        glyphs = text_files.letters_until(glyphs, c.max_letters)
    rows = text_files.letter_sequences(glyphs)
    lit = F.transform("pixels", lambda p: F.filter(F.transform(p, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull()))
    word = F.array_join(F.transform("tags", lambda t: F.char(t + 97)), "")
    rows = settle(rows.select("seq_id", "fold", "tags", lit.alias("obs"), "nodes", word.alias("word"), F.size(F.col("pixels")[0]).alias("width")))
    order = F.xxhash64(F.lit(c.seed), "seq_id"), F.col("seq_id")
    drawn = sampling.stratified_sample(rows.where("fold = 0").select("seq_id", "word"), "word", c.labels * c.folds, *order)
    drawn = drawn.withColumn("_n", F.row_number().over(Window.orderBy("round", "word")) - 1)
    mine = drawn.where(F.floor(F.col("_n") / c.labels) == c.fold).select("seq_id", F.lit(True).alias("is_labeled"))
    sizes = rows.agg(F.max("width").alias("w"), F.max(F.array_max("tags")).alias("k")).first()
    rows = rows.join(F.broadcast(mine), "seq_id", "left").select("seq_id", "tags", "obs", "nodes", F.coalesce("is_labeled", F.lit(False)).alias("is_labeled"))
    edges = text_files.read_graph(spark, c.graph_path, c.encoding)
    return train(spark, settle(rows), edges, crf.Design(int(sizes["k"] or 0) + 1, int(sizes["w"] or 1), c.order), c)
