"""Language identification by a linear-chain conditional random field over words.

Every word of a whole text gets a distribution over the learned languages by forward-backward, so
code-switched texts are labelled word by word; a document's language is the one with the largest sum
of marginals, and its score is that language's share.

Learned from at most ``per_class`` texts a language, those with the smallest hash of the id among
rows with id, text and language outside the held-out fold, and of texts up to ``longest`` bytes; an id with several
texts of a language gives the least one.  One pass counts the languages, one takes the texts below a bound
of the hash that the counts give.

A text without a letter (null and empty ones too) is ``und`` with score 0; where nothing was learned, all texts are.
An empty table gives none.  Rows are judged one by one, so repeated rows and rows without a doc_id get their text's
language; of equal shares the first language by code point wins.  Long texts are labelled in windows.  Other
columns pass through; lang_pred and lang_score replace columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONGEST_SAMPLE, flat, fold, hash_bound, in_small_batches, share, slices
from .word_crf import Model, fit, words_of

UNKNOWN = "und"


def sample(documents: DataFrame, per_class: int, folds: int, held_out: int, longest: int = LONGEST_SAMPLE) -> list[tuple[bytes, str]]:
    usable = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    # hashes are uniform: three times as many as are wanted lie below the bound, on average
    bounds = {lang: hash_bound(3 * per_class / n) for lang, n in counts.items()}
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang"))
    near = usable.withColumn("h", F.xxhash64("doc_id")).where((F.col("h") <= bound) & (F.octet_length("text") <= longest))
    rows = near.groupBy("lang", "h", "doc_id").agg(F.min("text").alias("text")).collect()
    taken = [r for lang in counts for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["h"], r["doc_id"]))[:per_class]]
    return [(r["text"].encode("utf-8"), r["lang"]) for r in sorted(taken, key=lambda r: (r["doc_id"], r["lang"]))]


class LanguageModel:
    def __init__(self, langs: list[str], model: Model | None):
        self.langs, self.model = langs, model

    @classmethod
    def train(cls, rows: list[tuple[bytes, str]], epochs: int = 3) -> LanguageModel:
        langs = sorted({lang for _, lang in rows})
        if not langs:
            return cls([], None)
        gold = np.array([langs.index(lang) for _, lang in rows])
        tags = lambda w, ids: np.repeat(gold[ids], np.diff(w.bounds))
        return cls(langs, fit([t for t, _ in rows], tags, len(langs), epochs, together=4))

    def labels(self, texts: pa.Array):
        """Per text: spans of words (bytes) and their marginals."""
        data, off = flat(texts)
        w = words_of(data, off)
        return w, self.model.posterior(w)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, -1 without a word, and the score."""
        data, off = flat(texts)
        n, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        for _, _, w, p in self.model.labelled(data, off):
            total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(p, 0)])
            n, sums = n + np.diff(w.bounds), sums + total[w.bounds[1:]] - total[w.bounds[:-1]]
        share = sums / np.maximum(n, 1)[:, None]
        best = np.where(n > 0, share.argmax(1), -1)
        return best, np.where(n > 0, np.clip(share.max(1), 0, 1), 0.0)


def learn(documents: DataFrame, per_class: int = 200, folds: int = 3, held_out: int = 1, epochs: int = 3) -> LanguageModel:
    return LanguageModel.train(sample(documents, per_class, folds, held_out), epochs)


def identify(documents: DataFrame, model: LanguageModel | None = None, keep_text: bool = True, **parameters) -> DataFrame:
    """``documents`` with lang_pred and lang_score; without ``keep_text``, texts do not come back from Python."""
    model = model or learn(documents, **parameters)
    names = [c for c in documents.columns if c not in ("lang_pred", "lang_score") and (keep_text or c != "text")]
    if model.model is None:
        return documents.select(*names).withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0)})
    shared = share(documents.sparkSession, model)
    # bytes of other characters are not all letters
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    judged = letters if keep_text else F.when(letters, F.col("text"))
    sent = in_small_batches(documents).select(F.struct(*names).alias("row"), judged.alias("judged"))
    schema = T.StructType([sent.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches):
        m = shared()
        langs = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            row, texts = batch.column("row"), batch.column("judged")
            if keep_text:
                own = row.field(names.index("text"))
                texts = pc.if_else(texts, own, pa.scalar(None, own.type))
            for lo, hi in slices(texts):
                best, score = m.predict(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([row.slice(lo, hi - lo), pa.array(langs[best], pa.string()), pa.array(score)], names=["row", "lang_pred", "lang_score"])

    return sent.mapInArrow(run, schema).select("row.*", "lang_pred", "lang_score")


def keep_identified(documents: DataFrame, least: float = 0.3, **parameters) -> DataFrame:
    """The documents that are mostly of one language, as rows of ``documents``."""
    return identify(documents, **parameters).where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)).select(*documents.columns)
