"""Shared tools: scratch tables, bounded samples, and vectorised work on UTF-8 bytes.

The byte tools never loop over words in Python.  A batch of texts is one byte
array with row offsets; words are spans found by a lookup table, and a word's
64-bit hash comes from differences of a running polynomial, so it does not
depend on the batch the word is in.
"""

from __future__ import annotations

import atexit
import pickle
import re
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: ``WORD``'s separators, for :func:`pyspark.sql.functions.translate`
BLANKS = " \t\n\x0b\x0c\r"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: rows up to which a list of ids is broadcast; beyond, the join shuffles
BROADCAST_ROWS = 1_000_000
#: bytes of a batch of rows on its way to a Python worker, unless the session says otherwise
BATCH_BYTES = 2 << 20
#: bytes of text that the array kernels take at a time; one longer text is cut at blanks, or within a longer word
SLICE_BYTES = 1 << 19
#: bytes of the longest text that a classifier learns from
LONGEST_SAMPLE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables


class Scratch:
    """Tables in the folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    A table that an executor's loss cannot take away cuts the lineage; the folder goes when the
    driver's process ends, or with :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="seqloom-")  # a local session, as in tests
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended
            pass


def keep_small(ids: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for at most ``BROADCAST_ROWS`` rows; above, Spark shuffles both sides."""
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows will reach Python in batches bounded by bytes: long texts do not fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def share(spark: SparkSession, value):
    """A function that gives workers the value, classes of this package included; sent to each executor once, made once a worker."""
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), f"shared {uuid.uuid4().hex}"

    def get():
        kept = _kept_in_worker()
        if kept.get("shared", ("",))[0] != key:  # the last value only
            kept["shared"] = key, pickle.loads(sent.value)
        return kept["shared"][1]

    return get


def _kept_in_worker() -> dict:
    return sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")).__dict__


def once_a_worker(key: str, make):
    """What ``make`` returns, made once in a Python worker's life, whatever tasks it runs."""
    kept = _kept_in_worker()
    if key not in kept:
        kept[key] = make()
    return kept[key]


# ---------------------------------------------------------------- folds and samples


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def hash_bound(share: float) -> int:
    """At most this are ``share`` of all 64-bit hashes, on average."""
    return min(int(min(1.0, share) * 2.0**64) - (1 << 63), (1 << 63) - 1)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, held_out: int, folds: int, per_class: int, longest: int = LONGEST_SAMPLE) -> tuple[list[tuple[str, int]], list[int]]:
    """Whole texts and labels of at most ``per_class`` rows a class, and the class counts of all labels that may be used.

    The rows are those with the smallest hash of the id, which is a fixed random sample; texts of more
    than ``longest`` bytes are not learned from.  An id with several labels has the largest one, an id
    with several texts the least one, so that reruns agree.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    usable = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect() for y in (0, 1)]
    by_id = {r["doc_id"]: r["y"] for rows in chosen for r in rows}
    if not by_id:
        return [], [0, 0]
    texts = documents.where(F.col("doc_id").isin(list(by_id))).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    got = texts.groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r["text"] or "", by_id[r["doc_id"]]) for r in sorted(got, key=lambda r: r["doc_id"])], [counts.get(0, 0), counts.get(1, 0)]


# ---------------------------------------------------------------- bytes

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
CODE_LOWER = CODE.copy()
CODE_LOWER[65:91] = CODE[97:123]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = np.arange(97, 123)
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: letters of ASCII and all bytes of other characters
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class _Kept(dict):
    """Is sent to workers empty."""

    def __reduce__(self):
        return _Kept, ()


_POWERS = _Kept()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the polynomial's base and of its inverse, at least ``n``; the longest so far are kept."""
    if "all" not in _POWERS or len(_POWERS["all"][0]) < n:
        out = []
        for base in (_P, _PINV):
            a = np.full(1 << max(16, int(n).bit_length()), base, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _POWERS["all"] = out[0], out[1]
    return _POWERS["all"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array, end: str = "") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, each followed by ``end``, and the rows' offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if end:
        texts = pc.binary_join_element_wise(texts, pa.scalar(end, pa.large_string()), pa.scalar("", pa.large_string()))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Row ranges of at most ``most`` bytes each, or of one row."""
    if not len(texts):
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, lo, done = np.cumsum(size), 0, 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, done + most, "right")))
        yield lo, hi
        lo, done = hi, int(total[hi - 1])


def spans(data: np.ndarray, off: np.ndarray, inside_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, which never cross rows, and the offsets of each row's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = inside_of[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = off[:-1]
    before[first[first < n]] = False
    last = off[1:]
    after[last[last > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def running(data: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Running polynomial, of which :func:`span_hash` takes differences."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(run))
    return mix((run[ends] - run[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of each word; arrays of about ``most`` bytes of text are held at a time, whatever the text's length."""
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(ends, base + most, "right"))
        if hi > lo:
            out[lo:hi] = span_hash(running(data[base : int(ends[hi - 1])], code), starts[lo:hi] - base, ends[lo:hi] - base)
            lo = hi
            continue
        up, _ = powers(most)  # one longer word, part by part
        total, ahead = np.zeros(1, np.uint64), np.ones(1, np.uint64)
        for at in range(base, int(ends[lo]), most):
            part = data[at : min(at + most, int(ends[lo]))]
            total += ahead * np.sum(code[part] * up[: len(part)], dtype=np.uint64)
            ahead = ahead * (up[most - 1] * up[1 : 2])
        out[lo : lo + 1] = mix(total)
        lo += 1
    return out
