"""Queries that write the driver's tables in the text formats and read them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNIVERSAL_TAGS
from ..operators import graph
from ..sources import text_files
from .fixtures import EVENT_TAGS, EVSEQ, VECSEQ, VGRAPH, event_sequences, event_tokens, glyphs, scratch_path
from .graph_queries import top_edges

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def put(spark: SparkSession, rows: DataFrame, text: Column, name: str) -> str:
    """Writes one string a row, of one line or several that stay together."""
    path = scratch_path(spark, name)
    rows.select(text.alias("value")).write.text(path)
    return path


def _tags(spark, sf) -> DataFrame:
    """(seq_id, tokens, tags) with tags by name."""
    name = F.transform("tags", lambda t: F.element_at(F.array(*map(F.lit, EVENT_TAGS)), t + 1))
    return event_sequences(spark, sf).select("seq_id", "tokens", name.alias("tags"))


def _conll(spark, sf) -> str:
    line = F.zip_with("tokens", "tags", lambda w, t: F.concat(F.lit("1\t"), w, F.lit("\t_\t_\t"), t))
    return put(spark, _tags(spark, sf), F.concat(F.array_join(line, "\n"), F.lit("\n")), "conll")


@query(f"with {EVSEQ} select tag, token, count(*) n, sum(pos)::bigint sum_pos, count(*) filter (where pos = 0) n_first from evseq group by all")
def conll_file(spark, sf):
    rows = text_files.read_conll(spark, _conll(spark, sf))
    return rows.groupBy("tag", "token").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("sum_pos"), F.count_if(F.col("pos") == 0).alias("n_first"))


@query(f"with {EVSEQ} select distinct tag from evseq")
def tag_alphabet(spark, sf):
    return text_files.tag_alphabet(text_files.read_conll(spark, _conll(spark, sf)))


@query(f"with {EVSEQ} select tag, token, count(*) n, sum(pos)::bigint sum_pos from evseq group by all")
def blocks_file(spark, sf):
    four = F.concat_ws("\n", F.array_join("tokens", "\t"), F.array_join("tags", "\t"), F.lit("0"), F.lit(""))
    rows = text_files.read_blocks(spark, put(spark, _tags(spark, sf), four, "blocks"))
    return rows.groupBy("tag", "token").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("sum_pos"))


@query(f"""with {VECSEQ}, w as (select seq_id, max(fold)::int fold, string_agg(chr((97 + tag)::int), '' order by pos) word, sum(list_sum(pixels))::bigint n_lit from vecseq group by seq_id)
select seq_id, fold, word, n_lit from w""")
def letters_file(spark, sf):
    """Glyphs as letter data and back as words; the file has fold 9 for the test fold."""
    own = F.concat_ws("\t", F.col("node") + 1, F.char(F.col("tag") + 97), F.lit(-1), F.col("seq_id") + 1, F.col("pos"), F.when(F.col("fold") == 1, 9).otherwise(3), F.array_join(F.transform("pixels", lambda x: x.cast("string")), "\t"))
    read = text_files.letter_sequences(text_files.read_letters(spark, put(spark, glyphs(spark, sf), own, "letters")))
    lit = F.aggregate(F.flatten("pixels"), F.lit(0), lambda a, x: a + x)
    return read.select("seq_id", "fold", F.array_join(F.transform("tags", lambda t: F.char(t + 97)), "").alias("word"), lit.cast("long").alias("n_lit"))


_RUNS = f"""{VECSEQ}, r as (select *, lead(seq_id) over (order by node) is distinct from seq_id e from vecseq), n as (select seq_id, count(*) n from r group by 1)"""


@query(f"with {_RUNS} select count(*) n_letters, max(seq_id) last_seq from r where seq_id <= (select min(seq_id) from n where n >= 8)")
def letters_until(spark, sf):
    """Letters up to the first word of eight."""
    return text_files.letters_until(_linked(glyphs(spark, sf)), 8).agg(F.count("*").alias("n_letters"), F.max("seq_id").alias("last_seq"))


def _linked(g: DataFrame) -> DataFrame:
    last = g.groupBy("seq_id").agg(F.max("pos").alias("last"))
    return g.join(last, "seq_id").select(F.col("node").alias("node_id"), "seq_id", "fold", F.when(F.col("pos") == F.col("last"), -2).otherwise(F.col("node") + 1).alias("next_id"))


@query(f"with {VGRAPH} select src, dst, round(weight, 6) + 0.0 weight from edges")
def graph_file(spark, sf):
    path = scratch_path(spark, "graph")
    text_files.write_graph(graph.mutual(top_edges(spark, sf)), path)
    return text_files.read_graph(spark, path).select("src", "dst", (F.round("weight", 6) + 0.0).alias("weight"))


@query(f"with {VECSEQ} select node, 'w' || seq_id || ' ' || pos ngram from vecseq")
def index_file(spark, sf):
    path = scratch_path(spark, "index")
    text_files.write_ngram_index(glyphs(spark, sf).select("node", F.concat(F.lit("w"), "seq_id", F.lit(" "), "pos").alias("ngram")), path)
    return text_files.read_ngram_index(spark, path)


@query(f"with {EVSEQ}, t as (select unnest([{', '.join(repr(t) for t in EVENT_TAGS)}]) tag, generate_subscripts([{', '.join(repr(t) for t in EVENT_TAGS)}], 1)::int - 1 i) select seq_id, pos::int pos, i::int tag from evseq join t using (tag)")
def predictions_file(spark, sf):
    path = scratch_path(spark, "predictions")
    text_files.write_predictions(event_sequences(spark, sf).select("seq_id", F.col("tags").alias("pred")), path)
    return text_files.read_predictions(spark, path)


@query("select 'UTAG' || event_type tag, case event_type when 'click' then 'VERB' when 'view' then 'NOUN' end utag from events where event_type in ('click', 'view') group by event_type")
def tag_map_file(spark, sf):
    """A map's rows with unknown universal tags go."""
    kinds = event_tokens(spark, sf).select("tag").distinct()
    line = F.concat(F.lit("UTAG"), "tag", F.lit("\t"), F.when(F.col("tag") == "click", "VERB").when(F.col("tag") == "view", "NOUN").otherwise("NONE"))
    return text_files.read_tag_map(spark, put(spark, kinds, line, "map"), UNIVERSAL_TAGS)


@query("select distinct right(token, 2) suffix from (select concat('b', cast(floor(least(value, 50) / 10) as int)) as token, event_type from events) where event_type = 'view'")
def suffix_file(spark, sf):
    """Suffixes of one language; leading hyphens go."""
    line = F.concat(F.when(F.col("tag") == "view", "English").otherwise("french"), F.lit("\t-"), F.right("token", F.lit(2)))
    return text_files.read_suffixes(spark, put(spark, event_tokens(spark, sf).select("tag", "token").distinct(), line, "suffixes"), "english")


@query("select distinct concat('b', cast(floor(least(value, 50) / 10) as int)) suffix from events where event_type = 'click'")
def dictionary_file(spark, sf):
    """Suffix rows of a dictionary dump."""
    line = F.concat(F.lit("English\t-"), "token", F.lit("\t"), F.when(F.col("tag") == "click", "Suffix").otherwise("Noun"))
    return text_files.read_dictionary_dump(spark, put(spark, event_tokens(spark, sf).select("tag", "token").distinct(), line, "dump"), "english")
