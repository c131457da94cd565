"""The driver's tables in the shapes that the operators read, in Spark and in DuckDB."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, shared_folder

EVENT_TAGS = ["click", "error", "purchase", "signup", "view"]
DIGITS = 10  # labels of the embeddings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def drop():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            pass

    atexit.register(drop)
    return path


def documents_as_sequences(spark: SparkSession, sf_dir: str, punctuation: bool = True) -> DataFrame:
    """(seq_id, tokens) of whole texts; with ``punctuation`` marks are tokens of their own."""
    text = F.regexp_replace("text", "([.,!?:;]+)", " $1 ") if punctuation else F.col("text")
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("seq_id"), F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda x: x != "").alias("tokens"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_sequences(spark, sf_dir).select("seq_id", F.posexplode("tokens").alias("pos", "token"))


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, tag, token, fold): a user's events in time order."""
    e = table(spark, sf_dir, "events")
    pos = F.expr("row_number() over (partition by user_id order by ts, event_id) - 1")
    return e.select(F.col("user_id").alias("seq_id"), pos.alias("pos"), F.col("event_type").alias("tag"), F.expr("concat('b', cast(floor(least(value, 50) / 10) as int))").alias("token"), F.expr("case when user_id % 10 = 9 then 1 else 0 end").alias("fold"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, tokens, tags) with tags as numbers."""
    rows = event_tokens(spark, sf_dir)
    number = F.array_position(F.array(*map(F.lit, EVENT_TAGS)), F.col("tag")) - 1
    both = F.array_sort(F.collect_list(F.struct("pos", "token", number.cast("int").alias("tag"))))
    return rows.groupBy("seq_id").agg(both.alias("r")).select("seq_id", F.col("r.token").alias("tokens"), F.col("r.tag").alias("tags"))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, seq_id, pos, tag, pixels, fold): embeddings as letters of eight-letter words."""
    v = table(spark, sf_dir, "embeddings")
    seq = F.floor(F.col("vec_id") / 8).cast("long")
    return v.select(F.col("vec_id").alias("node"), seq.alias("seq_id"), (F.col("vec_id") % 8).cast("int").alias("pos"), F.col("label").alias("tag"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("pixels"), (seq % 10 == 9).cast("int").alias("fold"))


def glyph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph sequences for the chain models: lit pixels are the observations, three in five words are labelled."""
    lit = F.filter(F.transform(F.col("pixels"), lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    r = F.array_sort(F.collect_list(F.struct("pos", "tag", "node", lit.alias("obs"))))
    rows = glyphs(spark, sf_dir).groupBy("seq_id").agg(r.alias("r"))
    return rows.select("seq_id", F.col("r.tag").alias("tags"), F.col("r.obs").alias("obs"), F.col("r.node").alias("nodes"), (F.col("seq_id") % 5 < 3).alias("is_labeled"))


TOKP_ROWS = r"""tokp_rows as (select doc_id seq_id, list_filter(string_split_regex(regexp_replace(text, '([.,!?:;]+)', ' \1 ', 'g'), '[ \t\n\r]+'), lambda x: x <> '') toks from documents)"""
TOKP = TOKP_ROWS + ", tokp as (select seq_id, generate_subscripts(toks, 1) - 1 pos, unnest(toks) as token from tokp_rows)"
EVSEQ = """evseq as (select user_id seq_id, row_number() over (partition by user_id order by ts, event_id) - 1 pos, event_type tag,
  concat('b', cast(floor(least(value, 50) / 10) as int)) as token, case when user_id % 10 = 9 then 1 else 0 end fold from events)"""
VECSEQ = """vecseq as (select vec_id node, cast(vec_id // 8 as bigint) seq_id, cast(vec_id % 8 as int) pos, label tag, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) pixels,
  case when (vec_id // 8) % 10 = 9 then 1 else 0 end fold from embeddings)"""
#: top-k cosine, ranks on rounded similarities
TOPK = """v as (select vec_id node, label, embedding::double[] e, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings),
sims as materialized (select a.node src, b.node dst, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) sim from v a, v b where a.node <> b.node and a.n > 0 and b.n > 0),
ranked as (select src, dst, sim, row_number() over (partition by src order by sim desc, dst) rank from sims where sim > 0),
topk as materialized (select * from ranked where rank <= 10)"""
VGRAPH = TOPK + ", edges as (select t.src, t.dst, t.sim weight from topk t semi join topk b on t.src = b.dst and t.dst = b.src)"
#: seeds are every fifth node; the rest is uniform
SEEDS = """states as (select unnest(range(10))::int state),
q0 as (select node, state, node % 5 = 0 fixed, case when node % 5 = 0 then (label = state)::int::double else 0.1 end p from v, states)"""
