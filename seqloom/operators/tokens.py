"""Dictionaries, boundary windows, n-grams and context features of token sequences.

Token rows are ``(seq_id, pos, token, ...)``; sequence rows are ``(seq_id, tokens)``.  What needs
only a sequence's own tokens is computed on sequence rows, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_punctuation, longest_suffix, normalize

#: The context templates; a digit less two is a relative position, w a word, s a suffix
TEMPLATES = ("w12", "w13", "w23", "w2", "w2s3", "w2s1", "w01", "w34", "w0134", "w012", "w234", "w024", "w023", "w124", "w02", "w24")


def pads(n: int) -> tuple[Column, Column]:
    left = F.array(*[F.lit(f"<s{i}>") for i in reversed(range(n))]) if n else F.array().cast("array<string>")
    right = F.array(*[F.lit(f"</s{i}>") for i in range(n)]) if n else F.array().cast("array<string>")
    return left, right


def padded(tokens: Column, n: int, after: int | None = None) -> Column:
    """Normalised tokens between ``n`` boundary symbols before and ``after`` (or n) behind."""
    return F.concat(pads(n)[0], F.transform(tokens, normalize), pads(n if after is None else after)[1])


def ngrams(sequences: DataFrame, n: int = 3, language: str = "english", keep_punctuation: bool = False, lookup: bool = False) -> DataFrame:
    """(seq_id, pos, token, ngram) around each token; ngram null at punctuation.

    ``lookup`` pads as an index lookup does: (n - 1) / 2 before and n / 2 behind; else n / 2 on both sides.
    """
    head = (n - 1) // 2 if lookup else n // 2
    out = sequences.withColumn("_words", padded(F.col("tokens"), head, n // 2)).select("seq_id", "_words", F.posexplode("tokens").alias("pos", "token"))
    gram = F.array_join(F.slice("_words", F.col("pos") + 1, n), " ")
    out = out.withColumn("ngram", gram if keep_punctuation else F.when(~is_punctuation(F.col("token"), language), gram))
    return out.select("seq_id", "pos", "token", "ngram")


def parse_template(name: str, context: int = 5) -> tuple[list[int], list[int]]:
    """Relative positions of words and of suffixes."""
    centre = (context - 1) // 2
    found: dict[str, list[int]] = {"w": [], "s": []}
    for kind, digits in re.findall("([a-z])([0-9]+)", name):
        found[kind] = [int(d) - centre for d in digits]
    return found["w"], found["s"]


def context_features(sequences: DataFrame, suffixes: list[str], n: int = 3, context: int = 5, language: str = "english") -> DataFrame:
    """(seq_id, pos, ngram, feature): one row per template and token that is no punctuation."""
    reach = (context - 1) // 2
    both = sequences.withColumns({"_wide": padded(F.col("tokens"), reach), "_words": padded(F.col("tokens"), n // 2)})
    low, suf = F.transform("_wide", lambda w: F.lower(w)), F.transform("_wide", lambda w: longest_suffix(w, suffixes))
    both = both.withColumns({"_low": low, "_suf": suf}).select("seq_id", "_low", "_suf", "_words", F.posexplode("tokens").alias("pos", "token"))
    both = both.where(~is_punctuation(F.col("token"), language))

    def feature(name: str) -> Column:
        words, ends = parse_template(name, context)
        at = lambda column, j: F.get(F.col(column), F.col("pos") + (j + reach))
        parts = [F.lit(f"{name}=")]
        for kind, mark, offsets in (("_low", "<W>=", words), ("_suf", "<SF>=", ends)):
            for j in offsets:
                parts += [F.lit(mark), at(kind, j)]
        return F.concat(*parts)

    return both.select("seq_id", "pos", F.array_join(F.slice("_words", F.col("pos") + 1, n), " ").alias("ngram"), F.explode(F.array(*map(feature, TEMPLATES))).alias("feature"))


def pmi_vectors(features: DataFrame) -> DataFrame:
    """(ngram, feature, pmi, value): pointwise mutual information, and the entry of the unit vector.

    ``log2(c_xy N / (c_x c_y))`` with N the occurrences; a node whose entries are all 0 has null values.
    The three counts are sums over one table of joint counts, which is made once.
    """
    joint = features.groupBy("ngram", "feature").agg(F.count("*").alias("xy"))
    # every occurrence has one feature of each template, so a prefix counts the occurrences
    per = joint.groupBy("ngram").agg((F.sum("xy") / len(TEMPLATES)).alias("x"))
    of = joint.groupBy("feature").agg(F.sum("xy").alias("y"))
    n = joint.agg((F.sum("xy") / len(TEMPLATES)).alias("n"))
    out = joint.join(of, "feature").join(per, "ngram").join(F.broadcast(n))
    out = out.withColumn("pmi", F.log2(F.col("xy") * F.col("n") / (F.col("x") * F.col("y"))))
    norm = out.groupBy("ngram").agg(F.sqrt(F.sum(F.col("pmi") * F.col("pmi"))).alias("norm"))
    return out.join(norm, "ngram").select("ngram", "feature", "pmi", F.try_divide("pmi", "norm").alias("value"))


def vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, n, first_seq, first_pos), map-side combined."""
    first = F.min(F.struct("seq_id", "pos"))
    return tokens.groupBy(token).agg(F.count("*").alias("n"), first.alias("f")).select(token, "n", F.col("f.seq_id").alias("first_seq"), F.col("f.pos").alias("first_pos"))


def dense_ids(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """Gapless ids in the order of columns that tell all rows apart, without a single-partition sort.

    Rows are sorted in ranges; only the ranges' row counts reach the driver.
    """
    from ..session import settle

    parts = settle(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _before long")
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


UNKNOWN_WORD, UNKNOWN_TAG, UNKNOWN_ID = "<unk>", "<unk_t>", -1


def names_of(ids: DataFrame, dictionary: DataFrame, id_col: str = "id", name: str = "token", default: str = UNKNOWN_WORD) -> DataFrame:
    """``ids`` with the names that ``dictionary(id, name)`` has for them, or the default."""
    return ids.join(dictionary.select(id_col, name), id_col, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def ids_of(names: DataFrame, dictionary: DataFrame, id_col: str = "id", name: str = "token") -> DataFrame:
    """``names`` with the ids that ``dictionary(id, name)`` has for them, or -1."""
    return names.join(dictionary.select(id_col, name), name, "left").withColumn(id_col, F.coalesce(id_col, F.lit(UNKNOWN_ID)))


def neighbours(tokens: DataFrame, *columns: str) -> DataFrame:
    """prev_/next_ of the columns within the sequence; null at its ends."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    return tokens.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns})


def islands(rows: DataFrame, key: str, order: list[str], is_break: Column) -> DataFrame:
    """Numbered runs of rows between breaks; the rows that break are left out."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"_break": is_break, "sent_id": F.sum(is_break.cast("long")).over(w)}).where(~F.col("_break")).drop("_break")


def map_tags(tokens: DataFrame, mapping: dict[str, str], tag: str = "tag") -> DataFrame:
    """Universal tags; what the mapping lacks is X."""
    spark = tokens.sparkSession
    table = spark.createDataFrame(list(mapping.items()) or [("", "X")], f"{tag} string, utag string")
    return tokens.join(F.broadcast(table), tag, "left").withColumn("utag", F.coalesce("utag", F.lit("X")))
