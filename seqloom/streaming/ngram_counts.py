"""Incremental dictionaries: counts of n-grams over a stream of sequences.

An extension: batch n-gram counts, kept up to date as files of sequences arrive.  Counts are a
stateful aggregation; a sequence that arrives twice within the watermark counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokens import ngrams


def counts(sequences: DataFrame, n: int = 3, language: str = "english", at: str | None = None, late: str = "1 hour") -> DataFrame:
    """(ngram, freq) of a stream of ``(seq_id, tokens)``; with the event-time column ``at``, repeats within ``late`` go."""
    if at:
        sequences = sequences.withWatermark(at, late).dropDuplicatesWithinWatermark(["seq_id"])
    return ngrams(sequences.select("seq_id", "tokens"), n, language).where("ngram is not null").groupBy("ngram").agg(F.count("*").alias("freq"))


def start(frame: DataFrame, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the whole current table to memory under ``name``; ``once`` takes what is there and ends."""
    writer = frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
