"""Counts of words, trigrams and context features over whole corpora, and the features' mutual information.

Sixteen feature strings a token are too much to shuffle.  A feature is a choice of words near its token, so
words meet instead: a record is a few neighbouring words under a key that is part of every feature counted
there, and one record serves up to eight templates.  Tokens are taken in chunks; a chunk's distinct records
go to buckets by key, with how often they occur, a bucket's records as one packed and compressed row.  Where
a bucket is put together, all occurrences of its features meet, so counts are exact: words are compared
as such, never by a hash, which only chooses the bucket.

Mutual information sends each record's counts back to its chunk, then n-grams with their contexts to buckets
by n-gram, where joint counts, norms and sums are local.  A task holds a chunk or a bucket.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .tokens import TEMPLATES

#: records have a word at these places from their first; key places come first
_PLACES = ((0, 1, 2, 3, 4), (0, 2, 3, 4), (0,))
_KEYS = (2, 2, 1)
#: template: kind of record, place of the feature's token, columns of the feature (of kind 2: word, suffix after, suffix before)
_COUNTED = {
    "w12": (0, 1, (0, 1)), "w23": (0, 0, (0, 1)), "w01": (0, 2, (0, 1)), "w34": (0, -1, (0, 1)),
    "w012": (0, 2, (0, 1, 2)), "w234": (0, 0, (0, 1, 2)), "w124": (0, 1, (0, 1, 3)), "w0134": (0, 2, (0, 1, 3, 4)),
    "w02": (1, 2, (0, 1)), "w13": (1, 1, (0, 1)), "w24": (1, 0, (0, 1)), "w024": (1, 2, (0, 1, 3)), "w023": (1, 2, (0, 1, 2)),
    "w2": (2, 0, (0,)), "w2s3": (2, 0, (0, 1)), "w2s1": (2, 0, (0, 2)),
}
#: what of a token's context, beside its n-gram, a template's feature hangs on: 0 nothing, 1 the word two before, 2 that two behind, 3 both
_JOINT = {t: ("0" in t and 1) + ("4" in t and 2) for t in TEMPLATES}
_PADS = ("<s1>", "<s0>", "</s0>", "</s1>")
#: tokens of a chunk, bytes of input to a bucket
CHUNK, BUCKET = 3 << 19, 8 << 20
_ROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary())])
_SCHEMA = "chunk long, bucket int, packed binary"
_codec = functools.partial(pa.Codec, "zstd", compression_level=1)


def _planes(x: np.ndarray) -> tuple[int, list[bytes]]:
    """Numbers from 0 as bytes, low ones and high ones apart."""
    top = int(x.max()) if len(x) else 0
    return len(x), [_codec().compress((x >> s).astype(np.uint8).tobytes(), asbytes=True) for s in range(0, max(1, top.bit_length()), 8)]


def _numbers(packed: tuple[int, list[bytes]]) -> np.ndarray:
    n, planes = packed
    out = np.zeros(n, np.int64 if len(planes) > 3 else np.int32)
    for i, p in enumerate(planes):
        out += np.frombuffer(_codec().decompress(p, n, asbytes=True), np.uint8).astype(out.dtype) << 8 * i
    return out


def _pack(words: pa.Array, columns: dict[str, list[np.ndarray]], **numbers: np.ndarray) -> bytes:
    """``columns`` are numbers of ``words``, of which only those that occur go along, frequent ones first."""
    at = np.concatenate([c for of in columns.values() for c in of])
    times = np.bincount(at, minlength=len(words))
    some = np.flatnonzero(times)
    some = some[np.argsort(-times[some], kind="stable")]
    place = np.empty(len(words), np.int32)
    place[some] = np.arange(len(some))
    own = words.take(pa.array(some))
    cuts = np.frombuffer(own.buffers()[1], np.int32)[: len(own) + 1]
    text = own.buffers()[2].to_pybytes()[: cuts[-1]] if len(own) and cuts[-1] else b""
    out, lo, at = {k: _planes(v) for k, v in numbers.items()}, 0, place[at]
    for name, of in columns.items():
        out[name] = []
        for c in of:
            out[name].append(_planes(at[lo : lo + len(c)]))
            lo += len(c)
    return pickle.dumps(out | {"text": (len(text), _codec().compress(text, asbytes=True)), "sizes_of_words": _planes(np.diff(cuts))})


def _words(part: dict) -> pa.Array:
    n, text = part["text"]
    cuts = np.concatenate([[0], np.cumsum(_numbers(part["sizes_of_words"]))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(_codec().decompress(text, n, asbytes=True) if n else b""))


def _together(parts: list[dict]) -> tuple[list[np.ndarray], pa.Array]:
    """For each part the number of each of its words, in one numbering; the words so numbered."""
    own = [_words(p) for p in parts]
    whole = pa.concat_arrays(own).dictionary_encode()
    return np.split(whole.indices.to_numpy(), np.cumsum([len(w) for w in own])[:-1]), whole.dictionary


def _columns(parts: list[dict], numbers: list[np.ndarray], name: str) -> list[np.ndarray]:
    return [np.concatenate([n[_numbers(c)] for n, c in zip(numbers, column)]) for column in zip(*[p[name] for p in parts])]


def _joined(parts: list[dict], name: str) -> np.ndarray:
    return np.concatenate([_numbers(p[name]) for p in parts])


def _rank(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal where all columns are."""
    at = columns[0].astype(np.int64)
    for c in columns[1:]:
        at = pd.factorize(at * (int(c.max()) + 1 if len(c) else 1) + c)[0]
    return at


class _Chunk:
    """Some sequences' words as numbers, with pads, and their distinct records."""

    def __init__(self, words: pa.Array, codes: np.ndarray, sizes: np.ndarray, suffixes: list[str], punctuation: str):
        """``words`` as they are in the text."""
        n, docs = len(codes), len(sizes)
        starts = np.cumsum(sizes) - sizes + 4 * np.arange(docs) + 2  # two more before all
        self.at = np.arange(n) + 4 * np.repeat(np.arange(docs), sizes) + 4
        number = pc.match_substring_regex(words, r"\A[\x00-\x20]*(?:[0-9]+|[0-9]+\.[0-9]+|[0-9]+[0-9,]+)[\x00-\x20]*\z")
        marks = pc.match_substring_regex(words, punctuation).to_numpy(zero_copy_only=False)
        plain = pa.concat_arrays([pa.array(["", *_PADS]), pc.if_else(number, "<num>", words)])
        ends = sorted(set(suffixes), key=len, reverse=True)
        found = [next((s for s in ends if len(w) > len(s) > 1 and w.endswith(s)), "") for w in plain.to_pylist()]
        kinds = pa.concat_arrays([pa.array(["", *_PADS]), plain, pc.utf8_lower(plain), pa.array(found, pa.string())]).dictionary_encode()
        order = pc.sort_indices(kinds.dictionary)  # so that words of like beginnings are packed together
        number = np.empty(len(order), np.int32)
        number[order.to_numpy()] = np.arange(len(order))
        self.words, number_of = kinds.dictionary.take(order), number[kinds.indices.to_numpy()][5:].reshape(3, -1)
        whole = np.zeros(n + 4 * docs + 8, np.int32)
        whole[self.at] = codes + 5
        for k, place in enumerate((starts, starts + 1, starts + sizes + 2, starts + sizes + 3)):
            whole[place] = k + 1
        self.plain, self.low, self.suffix = (x[whole] for x in number_of)
        self.centre = np.zeros(len(whole), bool)
        self.centre[self.at] = ~marks[codes]
        crc = np.array([zlib.crc32(w.encode()) for w in self.words.to_pylist()], np.uint64)
        self.hash = crc * np.uint64(0x9E3779B97F4A7C15) ^ (crc << np.uint64(29))
        # records begin at any place but the last few, where nothing is
        self.first = np.arange(1, len(whole) - 4, dtype=np.int32)

    def records(self, kind: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns of words and ``flags`` of each record: bit c + 1 says that the token at place c is one that has features."""
        j, is_centre = self.first, lambda c: self.centre[self.first + c]
        c0, c1, c2 = is_centre(0), is_centre(1), is_centre(2)
        if kind == 2:
            return [self.low[j], self.suffix[j + 1], self.suffix[j - 1]], c0.astype(np.uint8) << 1
        needed = {2: c0 | c2, 3: c1 | c2, 4: c2} if kind == 0 else {2: c0 | c1 | c2, 3: c2, 4: c2}
        columns = [self.low[j + p] if p not in needed else np.where(needed[p], self.low[j + p], 0) for p in _PLACES[kind]]
        flags = is_centre(-1).astype(np.uint8) * (kind == 0) + (c0.astype(np.uint8) << 1) + (c1.astype(np.uint8) << 2) + (c2.astype(np.uint8) << 3)
        return columns, flags

    def buckets(self, columns: list[np.ndarray], keys: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets by the ``keys`` first columns, and a hash of the columns, those of one key side by side."""
        mixed = np.zeros(len(columns[0]), np.uint64)
        for i, c in enumerate(columns):
            if i == keys:
                bucket, key = (mixed % np.uint64(buckets)).astype(np.int32), mixed
            mixed = (mixed ^ self.hash[c]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
        if len(columns) == keys:
            bucket, key = (mixed % np.uint64(buckets)).astype(np.int32), mixed
        return bucket, (key & np.uint64(0xFFFFFFF000000000)) | (mixed >> np.uint64(28))

    def distinct(self, kind: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Columns of distinct records in order of their buckets (flags last), buckets, how often each occurs; each record of these places, and the places."""
        columns, flags = self.records(kind)
        some = np.flatnonzero(flags).astype(np.int32)
        columns, flags = [c[some] for c in columns], flags[some]
        return (*_distinct([*columns, flags], *self.buckets(columns, _KEYS[kind], buckets)), some)


def _distinct(columns: list[np.ndarray], bucket: np.ndarray, mixed: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by bucket; one whose hash others share may be there more than once, with a part of its times each."""
    order = np.argsort(mixed, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")].astype(np.int32)
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in (bucket, *columns):
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    number = np.cumsum(new, dtype=np.int32) - 1
    heads = order[new]
    record = np.empty(len(order), np.int32)
    record[order] = number
    return [c[heads] for c in columns], bucket[heads], np.bincount(number, minlength=len(heads)), record


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Tokens and sizes of sequences, about :data:`CHUNK` tokens at a time."""
    lists = batch.column(0)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens, total = lists.flatten(), np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + CHUNK, "right")))
        yield tokens.slice(before, int(total[hi - 1]) - before), sizes[lo:hi]
        lo = hi


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ROW)], schema=_ROW)


def _by_bucket(chunk: int, own: _Chunk, buckets: int) -> Iterator[pa.RecordBatch]:
    """The chunk's records of all kinds, a row a bucket."""
    kinds = [own.distinct(k, buckets)[:3] for k in range(3)]
    cuts = [np.searchsorted(bucket, np.arange(buckets + 1)) for _, bucket, _ in kinds]
    for b in range(buckets):
        at = [slice(c[b], c[b + 1]) for c in cuts]
        if any(x.stop > x.start for x in at):
            columns = {str(k): [c[at[k]] for c in found[0][:-1]] for k, found in enumerate(kinds)}
            numbers = {f"{n}{k}": v[at[k]] for k, found in enumerate(kinds) for n, v in (("flags", found[0][-1]), ("times", found[2]))}
            yield _batch([(chunk, b, _pack(own.words, columns, **numbers))])


def _chunks(batches) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Chunks of a task's sequences: number, words, words' places in the text, sizes of the sequences."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        for tokens, sizes in _lists(batch):
            if len(tokens):
                codes = tokens.dictionary_encode()
                yield chunk, codes.dictionary, codes.indices.to_numpy(), sizes
                chunk += 1


def _counts(kind: int, parts: list[dict], numbers: list[np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(template, the number of each record's feature, occurrences by that number, which records count) of a bucket's records of a kind."""
    columns, times, flags = _columns(parts, numbers, str(kind)), _joined(parts, f"times{kind}"), _joined(parts, f"flags{kind}")
    ranks: dict[tuple, np.ndarray] = {}
    for name, (of, place, used) in _COUNTED.items():
        if of == kind:
            for k in range(1, len(used) + 1):
                if used[:k] not in ranks:
                    ranks[used[:k]] = columns[used[0]] if k == 1 else _rank(ranks[used[: k - 1]], columns[used[k - 1]])
            on = (flags >> (place + 1) & 1).astype(bool)
            yield name, ranks[used], np.bincount(ranks[used][on], times[on]), on


def _grams(own: _Chunk, centre: np.ndarray, buckets: int, around: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of these places, ``around`` with the words beside them, by bucket: as of :func:`_distinct`."""
    columns = [own.plain[centre - 1], own.plain[centre], own.plain[centre + 1]] + ([own.low[centre - 2], own.low[centre + 2]] if around else [])
    return _distinct(columns, *own.buckets(columns, 3, buckets))


def _read(batches) -> tuple[list[tuple[int, int]], list[dict]]:
    """Chunk and bucket of each part of a task, and the parts, in the chunks' order."""
    rows = [((r["chunk"], r["bucket"]), r["packed"]) for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: r[0])
    return [c for c, _ in rows], [pickle.loads(p) for _, p in rows]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), names)], names=[n for n, _ in names])


def _buckets(sequences: DataFrame) -> int:
    """By the bytes of what is read; one at least for each core."""
    spark = sequences.sparkSession
    leaves = sequences._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size > 1 << 50:  # not known
        size = BUCKET * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-size // BUCKET))


_ENGLISH = r"\A[.,!?:;]+\z"


def _met_grams(sequences: DataFrame, punctuation: str, buckets: int) -> DataFrame:
    """Trigrams of every chunk, met by bucket; a chunk's number of tokens goes to one of them."""

    def send(batches):
        for chunk, words, at, sizes in _chunks(batches):
            own = _Chunk(words, at, sizes, [], punctuation)
            columns, bucket, times, _ = _grams(own, np.flatnonzero(own.centre), buckets, False)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                yield _batch([(chunk, int(b), _pack(own.words, {"gram": [c[part] for c in columns]}, times=times[part]))])
            yield _batch([(chunk, zlib.crc32(str(chunk).encode()) % buckets, pickle.dumps({"tokens": len(at)}))])

    return sequences.select("tokens").mapInArrow(send, _SCHEMA).repartitionById(buckets, F.col("bucket"))


def _counted_grams(parts: list[dict]) -> tuple[list[np.ndarray], pa.Array, np.ndarray]:
    """Columns of words of a bucket's distinct trigrams, the words, and how often each occurs."""
    numbers, words = _together(parts)
    columns = _columns(parts, numbers, "gram")
    gram = _rank(*columns)
    gram = pd.factorize(gram)[0]
    times = np.bincount(gram, _joined(parts, "times")).astype(np.int64)
    one = np.empty(len(times), np.int64)
    one[gram] = np.arange(len(gram))
    return [c[one] for c in columns], words, times


def trigrams(sequences: DataFrame, punctuation: str = _ENGLISH) -> DataFrame:
    """(ngram, freq) of the n-grams of :func:`tokens.ngrams` around tokens that are no punctuation."""

    def run(batches):
        parts = [p for p in _read(batches)[1] if "gram" in p]
        if parts:
            columns, words, times = _counted_grams(parts)
            for lo in range(0, len(times), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                text = pc.binary_join_element_wise(*[words.take(pa.array(c[part])) for c in columns], " ")
                yield pa.RecordBatch.from_arrays([text, pa.array(times[part])], names=["ngram", "freq"])

    return _met_grams(sequences, punctuation, _buckets(sequences)).mapInArrow(run, "ngram string, freq long")


def trigram_coverage(sequences: DataFrame, least: int = 2, punctuation: str = _ENGLISH) -> DataFrame:
    """One row: tokens whose trigram is in the index of those that occur ``least`` times, and other tokens.

    A lookup pads an odd n-gram as the index does, so a trigram's occurrences are found or not as one, and counts tell.
    """

    def run(batches):
        _, parts = _read(batches)
        tokens, parts = sum(p.get("tokens", 0) for p in parts), [p for p in parts if "gram" in p]
        times = _counted_grams(parts)[2] if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(times[times >= least].sum())]), pa.array([tokens])], names=["covered", "tokens"])

    met = _met_grams(sequences, punctuation, _buckets(sequences)).mapInArrow(run, "covered long, tokens long")
    covered = F.coalesce(F.sum("covered"), F.lit(0))
    return met.agg(covered.alias("covered"), (F.coalesce(F.sum("tokens"), F.lit(0)) - covered).alias("uncovered"))


def vocabulary(sequences: DataFrame) -> DataFrame:
    """(token, n, first_seq, first_pos) of ``sequences(seq_id, tokens)``, as :func:`tokens.vocabulary` has them; counted in chunks first."""
    low = np.iinfo(np.int64).min  # null comes first

    def run(batches):
        for batch in batches:
            lo = 0
            for tokens, sizes in _lists(batch.select(["tokens"])):
                seq = pc.fill_null(batch.column("seq_id").slice(lo, len(sizes)), low).to_numpy(zero_copy_only=False)
                lo += len(sizes)
                codes = tokens.dictionary_encode()
                at = codes.indices.to_numpy()
                of = np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(at)) - (np.cumsum(sizes) - sizes)[of]
                order = np.lexsort((pos, seq[of]))
                some, first = np.unique(at[order], return_index=True)
                first = order[first]
                seqs = seq[of[first]]
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(some)), pa.array(np.bincount(at, minlength=len(codes.dictionary))[some]), pa.array(seqs, mask=seqs == low), pa.array(pos[first].astype(np.int32))], names=["token", "n", "seq", "pos"])

    some = sequences.select("seq_id", "tokens").mapInArrow(run, "token string, n long, seq long, pos int")
    out = some.groupBy("token").agg(F.sum("n").alias("n"), F.min(F.struct("seq", "pos")).alias("f"))
    return out.select("token", "n", F.col("f.seq").alias("first_seq"), F.col("f.pos").alias("first_pos"))


def feature_kinds(sequences: DataFrame, suffixes: list[str], punctuation: str = _ENGLISH) -> DataFrame:
    """(prefix, n, n_distinct) of the context features of ``sequences(tokens)``, by template."""
    buckets, schema = _buckets(sequences), "prefix string, n long, n_distinct long"

    def send(batches):
        for chunk, words, at, sizes in _chunks(batches):
            yield from _by_bucket(chunk, _Chunk(words, at, sizes, suffixes, punctuation), buckets)

    def count(batches):
        _, parts = _read(batches)
        if parts:
            numbers, _ = _together(parts)
            for kind in range(3):
                yield _table([(name, int(times.sum()), int(np.count_nonzero(times))) for name, _, times, _ in _counts(kind, parts, numbers)], schema)

    met = sequences.select("tokens").mapInArrow(send, _SCHEMA).repartitionById(buckets, F.col("bucket"))
    return met.mapInArrow(count, schema).groupBy("prefix").agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct")).where("n > 0")


def pmi_summary(sequences: DataFrame, suffixes: list[str], punctuation: str = _ENGLISH) -> DataFrame:
    """(prefix, n, avg_pmi, mass) of the vectors of :func:`tokens.pmi_vectors`, by template: entries, their mean and the sum of squares of the unit vectors' entries."""
    buckets, schema = _buckets(sequences), "prefix string, n long, pmi double, mass double"

    def keep(batches):
        for chunk, words, at, sizes in _chunks(batches):
            centres = int(_Chunk(words, at, sizes, suffixes, punctuation).centre.sum())
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([_pack(words, {"text_at": [at]}, sizes=sizes)], pa.binary()), pa.array([centres], pa.int64())], names=["chunk", "bucket", "packed", "centres"])

    def again(packed: bytes) -> _Chunk:
        part = pickle.loads(packed)
        return _Chunk(_words(part), _numbers(part["text_at"][0]), _numbers(part["sizes"]), suffixes, punctuation)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _by_bucket(row["chunk"], again(row["packed"]), buckets)

    def count(batches):
        """What each chunk's records occur in all chunks, in the order in which the chunk sent them."""
        sent, parts = _read(batches)
        if not parts:
            return
        numbers, back = _together(parts)[0], [{} for _ in parts]
        for kind in range(3):
            cuts = np.cumsum([p[f"times{kind}"][0] for p in parts])[:-1]
            for name, number, times, on in _counts(kind, parts, numbers):
                times = times.astype(np.int64)
                for own, r, o in zip(back, np.split(number, cuts), np.split(on, cuts)):
                    own[name] = _planes(times[r[o]])
        for (chunk, bucket), own in zip(sent, back):
            yield _batch([(chunk, bucket, pickle.dumps(own))])

    def by_gram(batches):
        """Distinct n-grams with the words around, and the counts of their features, by the n-gram's bucket."""

        def rows(chunk, state, parts):
            own = again(state)
            centre = np.flatnonzero(own.centre)
            occur = {}
            for kind in range(3):
                (*_, flags), _, times, record, some = own.distinct(kind, buckets)
                at = np.zeros(len(own.centre), np.int64)
                at[own.first[some]] = record
                for name, (of, place, _) in _COUNTED.items():
                    if of == kind:
                        all_of = np.zeros(len(flags), np.int64)
                        all_of[(flags >> (place + 1) & 1).astype(bool)] = np.concatenate([_numbers(p[name]) for p in parts])
                        occur[name] = all_of[at[centre - place]].astype(np.int32 if all_of.max(initial=0) < 1 << 31 else np.int64)
            # an n-gram with a feature of its own words that occurs once occurs once: all about it is known here
            once = np.any([occur[t] == 1 for t in TEMPLATES if not _JOINT[t]], axis=0)
            if once.any():
                pmi = {t: np.log2(total / occur[t][once]) for t in TEMPLATES}
                norm = sum(v * v for v in pmi.values())
                sums = [(t, len(v), float(v.sum()), float(np.divide(v * v, norm, out=np.zeros(len(v)), where=norm > 0).sum())) for t, v in pmi.items()]
                yield _batch([(chunk, zlib.crc32(str(chunk).encode()) % buckets, pickle.dumps({"sums": sums}))])
            centre, occur = centre[~once], {t: v[~once] for t, v in occur.items()}
            columns, bucket, times, record = _grams(own, centre, buckets, True)
            one = np.empty(len(times), np.int64)
            one[record] = np.arange(len(record))
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[b], cuts[b + 1])
                yield _batch([(chunk, int(b), _pack(own.words, {"gram": [c[at] for c in columns]}, times=times[at], **{k: v[one[at]] for k, v in occur.items()}))])

        held, state, parts = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:  # a chunk's own row comes first
                    if held is not None and len(parts):
                        yield from rows(held, state, parts)
                    held, state, parts = row["chunk"], row["packed"], []
                else:
                    parts.append(pickle.loads(row["packed"]))
        if held is not None and len(parts):
            yield from rows(held, state, parts)

    def inform(batches):
        _, parts = _read(batches)
        known = [p["sums"] for p in parts if "sums" in p]
        parts = [p for p in parts if "sums" not in p]
        if known:
            yield _table([x for sums in known for x in sums], schema)
        if not parts:
            return
        columns, times = _columns(parts, _together(parts)[0], "gram"), _joined(parts, "times")
        gram = _rank(*columns[:3])
        before = _rank(gram, columns[3])
        joints = (gram, before, _rank(gram, columns[4]), _rank(before, columns[4]))
        gram = np.unique(gram, return_inverse=True)[1].ravel()
        x, norm, found = np.bincount(gram, times), 0.0, {}
        for name in TEMPLATES:
            _, one, joint = np.unique(joints[_JOINT[name]], return_index=True, return_inverse=True)
            xy, of = np.bincount(joint.ravel(), times), gram[one]
            pmi = np.log2(xy * total / (x[of] * _joined(parts, name)[one]))
            found[name] = len(pmi), float(pmi.sum()), np.bincount(of, pmi * pmi, minlength=len(x))
            norm = norm + found[name][2]
        some = norm > 0
        yield _table([(name, n, pmi, float((square[some] / norm[some]).sum())) for name, (n, pmi, square) in found.items()], schema)

    kept = settle(sequences.select("tokens").mapInArrow(keep, _SCHEMA + ", centres long"))
    total = float(kept.agg(F.sum("centres")).first()[0] or 0)
    kept = kept.drop("centres")
    counted = kept.mapInArrow(send, _SCHEMA).repartitionById(buckets, F.col("bucket")).mapInArrow(count, _SCHEMA)
    whole = kept.unionByName(counted).repartition(buckets, "chunk").sortWithinPartitions("chunk", "bucket")
    found = whole.mapInArrow(by_gram, _SCHEMA).repartitionById(buckets, F.col("bucket")).mapInArrow(inform, schema)
    return found.groupBy("prefix").agg(F.sum("n").alias("n"), (F.sum("pmi") / F.sum("n")).alias("avg_pmi"), F.sum("mass").alias("mass"))
