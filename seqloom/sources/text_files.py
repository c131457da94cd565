"""Readers and writers of tab separated files.  One ``encoding`` holds for all of them.

Files keep their ids from 1; tables count nodes and graph ids from 0.  Malformed rows are skipped.

Where the order of lines matters, files are still read split by split: a line's number is its place in its
split and the number of lines in the splits before, and running counts over lines are made in stretches
of ``STRETCH`` lines, to which the sums of the stretches before are added.  One row a split or a
stretch is sorted by itself, never a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fields, trim_all
from ..session import settle

STRETCH = 1 << 20


def paths(text: str | list[str]) -> list[str]:
    """A comma list, or a list."""
    return text.split(",") if isinstance(text, str) else list(text)


def lines(spark: SparkSession, files: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(fold, line_no, line): the fold is the path's place in the list; files of one path follow each other by name."""
    out = None
    for i, path in enumerate(paths(files)):
        rows = _whole(spark, path, encoding) if encoding.upper().replace("-", "").startswith(("UTF16", "UTF32")) else _split(spark, path, encoding)
        rows = rows.select(F.lit(i).alias("fold"), "line_no", "line")
        out = rows if out is None else out.unionByName(rows)
    return out


def _split(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    value = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.regexp_replace(value, "\r\\z", "").alias("line"))
    # the lines of a split are read in order, by one task
    per = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(F.broadcast(per), ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def _whole(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Encodings whose line ends are not bytes of their own cannot be split: a file is one row at first."""
    whole = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("c"))
    return whole.select(F.posexplode(F.split(F.regexp_replace("c", "\r?\n\\z", ""), "\r?\n")).alias("line_no", "line"))


def numbered(rows: DataFrame, is_break: Column, stretch: int = STRETCH) -> DataFrame:
    """Rows ``(fold, line_no, ...)`` that do not break, with ``run``, gapless from 0 in each fold, and ``closed``: a break follows it somewhere."""
    x = rows.withColumns({"_s": F.floor(F.col("line_no") / stretch), "_brk": is_break})
    ends = x.groupBy("fold", "_s").agg(F.max_by("_brk", "line_no").alias("_end"), F.max(F.when(F.col("_brk"), F.col("line_no"))).alias("_stop"))
    in_fold = Window.partitionBy("fold").orderBy("_s")
    ends = ends.select("fold", "_s", F.coalesce(F.lag("_end").over(in_fold), F.lit(True)).alias("_open"), F.max("_stop").over(Window.partitionBy("fold")).alias("_stop"))
    w = Window.partitionBy("fold", "_s").orderBy("line_no")
    x = x.join(F.broadcast(ends), ["fold", "_s"])
    first = (~F.col("_brk") & F.coalesce(F.lag("_brk").over(w), F.col("_open"))).cast("long")
    x = settle(x.withColumn("_first", first).withColumn("_n", F.sum("_first").over(w)))
    sums = x.groupBy("fold", "_s").agg(F.sum("_first").alias("_all"))
    sums = sums.select("fold", "_s", F.coalesce(F.sum("_all").over(in_fold.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = x.where(~F.col("_brk")).join(F.broadcast(sums), ["fold", "_s"])
    return out.withColumns({"run": F.col("_before") + F.col("_n") - 1, "closed": F.coalesce(F.col("_stop") > F.col("line_no"), F.lit(False))}).drop("_s", "_brk", "_open", "_stop", "_first", "_n", "_before")


def _table(spark: SparkSession, files, schema: str, encoding: str, least: int) -> DataFrame:
    """Rows with at least ``least`` fields, read in parallel; order does not matter."""
    raw = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").schema("line string").csv(paths(files))
    names = [x.split()[0] for x in schema.split(",")]
    types = [x.split()[1] for x in schema.split(",")]
    f = raw.select(fields(F.col("line")).alias("f")).where(F.size("f") >= least)
    return f.select(*[F.get("f", F.lit(i)).cast("string").try_cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types))])


def read_conll(spark: SparkSession, files, encoding: str = "UTF-8", legacy: bool = False) -> DataFrame:
    """(fold, sent_id, pos, token, tag): field 1 and trimmed field 4; fewer than 5 fields break sentences.

    ``legacy`` drops a last sentence that no break follows.
    """
    rows = lines(spark, files, encoding).withColumn("f", F.split(trim_all(F.col("line")), "\t"))
    rows = numbered(rows.select("fold", "line_no", "f"), F.size("f") < 5)
    if legacy:
        rows = rows.where("closed")
    pos = F.row_number().over(Window.partitionBy("fold", "run").orderBy("line_no")) - 1
    return rows.select("fold", F.col("run").alias("sent_id"), pos.alias("pos"), F.col("f")[1].alias("token"), trim_all(F.col("f")[4]).alias("tag"))


def read_blocks(spark: SparkSession, files, encoding: str = "UTF-8") -> DataFrame:
    """(fold, sent_id, pos, token, tag) of blocks of four lines: words, tags, dependencies, blank."""
    rows = lines(spark, files, encoding).withColumns({"block": F.floor(F.col("line_no") / 4), "kind": F.col("line_no") % 4, "f": fields(F.col("line"))})
    both = rows.groupBy("fold", "block").agg(F.max(F.when(F.col("kind") == 0, F.col("f"))).alias("w"), F.max(F.when(F.col("kind") == 1, F.col("f"))).alias("t"))
    z = F.posexplode(F.arrays_zip(F.col("w").alias("token"), F.col("t").alias("tag"))).alias("pos", "x")
    return both.where("w is not null and t is not null").select("fold", F.col("block").alias("sent_id"), z).select("fold", "sent_id", "pos", "x.token", "x.tag")


def tag_alphabet(tokens: DataFrame) -> DataFrame:
    return tokens.select("tag").distinct()


def read_tag_map(spark: SparkSession, path: str, universal: tuple[str, ...], encoding: str = "UTF-8") -> DataFrame:
    """(tag, utag): rows with an unknown universal tag are skipped, the later row wins."""
    rows = lines(spark, path, encoding).withColumn("f", fields(F.col("line"))).where(F.size("f") >= 2)
    rows = rows.select("fold", "line_no", F.col("f")[0].alias("tag"), F.col("f")[1].alias("utag")).where(F.col("utag").isin(*universal))
    return rows.groupBy("tag").agg(F.max_by("utag", F.struct("fold", "line_no")).alias("utag"))


def read_letters(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(node_id, letter, next_id, seq_id, fold, pixels): fold 9 is 1, others 0; ids count from 0."""
    f = F.split("line", "\t")
    raw = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").schema("line string").csv(path).where(F.size(f) > 6)
    pixels = F.transform(F.filter(F.slice(f, 7, 1 << 20), lambda x: x != ""), lambda x: x.cast("int"))
    return raw.select((f[0].cast("long") - 1).alias("node_id"), (F.ascii(f[1]) - 97).alias("letter"), (f[2].cast("long") - 1).alias("next_id"), (f[3].cast("long") - 1).alias("seq_id"), F.when(f[5].cast("int") == 9, 1).otherwise(0).alias("fold"), pixels.alias("pixels"))


def letter_sequences(glyphs: DataFrame) -> DataFrame:
    """Glyph rows as sequence rows: (seq_id, fold, tags, nodes, pixels), in node order."""
    rows = F.array_sort(F.collect_list(F.struct("node_id", "letter", "pixels")))
    return glyphs.groupBy("seq_id").agg(F.max("fold").alias("fold"), rows.alias("r")).select("seq_id", "fold", F.col("r.letter").alias("tags"), F.col("r.node_id").alias("nodes"), F.col("r.pixels").alias("pixels"))


def letters_until(glyphs: DataFrame, most: int) -> DataFrame:
    """The glyphs in file order up to the first sequence of ``most`` letters or more; letters without an end behind them go.

    A sequence ends at a glyph that has no next one, and node ids number the lines.
    """
    rows = glyphs.withColumns({"line_no": F.col("node_id"), "_f": F.col("fold")}).withColumn("fold", F.lit(0))
    x = rows.withColumn("_end", (F.col("next_id") < 0).cast("long")).withColumn("_s", F.floor(F.col("line_no") / STRETCH))
    sums = x.groupBy("_s").agg(F.sum("_end").alias("_all"))
    sums = sums.select("_s", F.coalesce(F.sum("_all").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # ends before the row: the number of its sequence
    own = F.sum("_end").over(Window.partitionBy("_s").orderBy("line_no")) - F.col("_end")
    x = settle(x.withColumn("_own", own).join(F.broadcast(sums), "_s").withColumn("_run", F.col("_before") + F.col("_own")))
    runs = x.groupBy("_run").agg(F.count("*").alias("n"), F.max("_end").alias("e")).where("e = 1")
    last = runs.agg(F.min(F.when(F.col("n") >= most, F.col("_run"))).alias("stop"), F.max("_run").alias("top")).select(F.coalesce("stop", "top").alias("_last"))
    kept = x.join(F.broadcast(last)).where("_run <= _last").withColumn("fold", F.col("_f"))
    return kept.select(*glyphs.columns)


def read_graph(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(src, dst, weight), ids from 0; rows with fewer than three fields are skipped, nothing is deduplicated."""
    rows = _table(spark, path, "src long,dst long,weight double", encoding, 3).where("src is not null and dst is not null and weight is not null")
    return rows.select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"), "weight")


def read_ngram_index(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(node, ngram), nodes from 0."""
    return _table(spark, path, "id long,ngram string", encoding, 2).where("id is not null").select((F.col("id") - 1).alias("node"), "ngram")


def read_suffixes(spark: SparkSession, path: str, language: str, encoding: str = "UTF-8") -> DataFrame:
    """(suffix): of the language, case aside; leading hyphens go."""
    rows = _table(spark, path, "language string,suffix string,more string", encoding, 2).where("more is null")
    return rows.where(F.lower("language") == language.lower()).select(F.regexp_replace("suffix", "^-", "").alias("suffix")).distinct()


def read_dictionary_dump(spark: SparkSession, path: str, language: str, encoding: str = "UTF-8") -> DataFrame:
    """(suffix) of a dictionary dump ``Language, word, class, ...``: rows of class Suffix."""
    rows = _table(spark, path, "language string,word string,class string", encoding, 3)
    return rows.where((F.col("language") == language.capitalize()) & (F.col("class") == "Suffix")).select(F.regexp_replace("word", "^-", "").alias("suffix")).distinct()


def read_predictions(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(seq_id, pos, tag) of rows ``id, tag, tag, ...``."""
    raw = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
    f = raw.select(fields(F.col("line")).alias("f")).where(F.size("f") >= 1)
    return f.select(F.col("f")[0].try_cast("long").alias("seq_id"), F.posexplode(F.expr("slice(f, 2, size(f))")).alias("pos", "tag")).select("seq_id", "pos", F.col("tag").try_cast("int").alias("tag"))


def _write(rows: Column | str, df: DataFrame, path: str, encoding: str) -> None:
    df.select(rows).write.mode("overwrite").option("encoding", encoding).text(path)


def write_graph(edges: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """``src, dst, weight`` with ids from 1 and twelve decimals, positive weights only."""
    _write(F.format_string("%d\t%d\t%.12f", F.col("src") + 1, F.col("dst") + 1, "weight").alias("value"), edges.where("weight > 0"), path, encoding)


def write_ngram_index(index: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """``id, ngram`` with ids from 1, in their order."""
    _write(F.format_string("%d\t%s", F.col("node") + 1, "ngram").alias("value"), index.orderBy("node"), path, encoding)


def write_predictions(predictions: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """``id, tag, tag, ...`` of ``(seq_id, pred array<int>)``."""
    _write(F.concat_ws("\t", F.col("seq_id").cast("string"), F.array_join(F.transform("pred", lambda x: x.cast("string")), "\t")).alias("value"), predictions, path, encoding)
