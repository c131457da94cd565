"""Packing token sequences by first-fit decreasing.

``pack`` tokenizes each whole text, adds the end id, and cuts only what exceeds a sequence.
Pieces are dealt at random to groups of about ``group_docs``; in each group a tournament tree over
bin capacities finds the first bin with room in O(log bins).  Only piece metadata are shuffled: ids
and checksums are made where the text is read.  They are written before they are dealt, with the
row's place in its partition, which deals repeated ids, null ids and equal texts evenly too.

Null and empty texts are one piece that holds the end id; an empty table has none.  Rows that repeat
a doc_id, or have none, are packed as documents of their own; equal lengths go by id, place and start.
Sequence ids are unique, not gapless; of extra columns none is returned, so no name clashes.  A long text is
encoded in parts, cut at single blanks between visible characters, so it costs its ids, 4 bytes each.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_small_batches, once_a_worker, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def default_tokenizer() -> tuple[str, str]:
    """The vocabulary as the tokenizers library reads it, and the same one as byte ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class FirstFit:
    """First-fit with a tournament tree: each node holds the largest free capacity below it."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """The leftmost bin with ``size`` free, and the offset there."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        offset = self.capacity - tree[node]
        tree[node] -= size
        at = node // 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
        return node - self.leaves, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; equal lengths keep their order."""
    order = np.argsort(-lengths, kind="stable")
    fit = FirstFit(capacity, len(lengths))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        bins[i], offsets[i] = fit.place(size)
    return bins, offsets


class Fragments(dict):
    """Ids of fragments, with a blank before each; what is not known yet is encoded when it is asked for."""

    longest = 64  # longer ones are rare, and are not remembered

    def __init__(self, encode, blank: str, opens: np.ndarray | None = None):
        super().__init__()
        self.encode, self.blank, self.opens = encode, blank, opens

    def learn(self, words: list[str]) -> None:
        """New fragments of a text in one call: the tokens that open with a blank part them again."""
        new = [w for w in set(words) if w not in self and 0 < len(w) <= self.longest]
        if self.opens is None or len(new) < 2:
            return
        ids = np.array(self.encode(" " + " ".join(new), True), "<u4")
        at = np.flatnonzero(self.opens[ids]) * 4
        if len(at) == len(new):  # else each is encoded when it is asked for
            raw, cuts = ids.tobytes(), [*at.tolist(), 4 * len(ids)]
            self.update((w, raw[a:b]) for w, a, b in zip(new, cuts, cuts[1:]))

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(self.blank + word)).tobytes()
        if len(word) <= self.longest:
            self[word] = ids
        return ids


#: a single blank between visible characters, which no token crosses
_SEAM = re.compile(r"(?<=\S) (?=\S)")
#: blanks that are no space
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_ASCII_BLANKS = [c for c in _BLANKS if c.isascii()]


def parts_of(text: str, most: int) -> list[str]:
    """The text cut at seams, whose blanks go, into parts that reach the first seam behind ``most`` characters."""
    out, lo = [], 0
    while len(text) - lo > most and (seam := _SEAM.search(text, lo + most)):
        out.append(text[lo : seam.start()])
        lo = seam.end()
    return [*out, text[lo:]]


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE never joins what a single space between two visible characters parts, so such
    a text is the concatenation of its fragments, and a fragment met before costs one lookup.
    Of other texts (runs of blanks, blanks at an end, special tokens), and of long ones, the parts of ``part``
    characters that are so inside go to the tokenizer whole, and the rest by fragments.
    With ``ranks``, new fragments are encoded from the same vocabulary's byte ranks, which gives
    the same ids several times faster, those of a text together.  At most ``most`` fragments are remembered.
    """

    def __init__(self, path: str, ranks: str | None = None, most: int = 200_000, part: int = 512):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most, self.part = Tokenizer.from_file(path), most, part
        slow = lambda w: self.tok.encode(w, add_special_tokens=False).ids
        encode, opens = slow, None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
            # a very long fragment would take the square of its length there
            encode = lambda w, many=False: fast(w) if many or len(w) < 4096 else slow(w)
            opens = np.zeros(max(merges.values()) + 1, bool)
            opens[[i for token, i in merges.items() if token.startswith(b" ")]] = True
        self.first, self.rest = Fragments(encode, ""), Fragments(encode, " ", opens)
        tokens = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = [t for t in tokens if t]
        self.seams = not any(" " in t for t in tokens)

    def odd(self, text: str) -> bool:
        """Whether a blank is at an end or beside a space, or a special token occurs."""
        if text[:1].isspace() or text[-1:].isspace() or "  " in text:
            return True
        blanks = _ASCII_BLANKS if text.isascii() else _BLANKS
        return any(b in text and (f" {b}" in text or f"{b} " in text) for b in blanks) or any(t in text for t in self.special)

    def _text(self, text: str) -> bytes:
        known, out, odd = self.first, [], self.odd(text)
        parts = parts_of(text, self.part) if self.seams and (odd or len(text) > 1 << 16) else [text]
        for part in parts:
            if odd and (len(parts) == 1 or self.odd(part)):
                out.append(array("I", self.tok.encode(known.blank + part, add_special_tokens=False).ids).tobytes())
            else:
                head, *rest = part.split(" ")
                self.rest.learn(rest)
                out.append(known[head] + b"".join(map(self.rest.__getitem__, rest)))
            known = self.rest
        return out[0] if len(out) == 1 else b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        for known in (self.first, self.rest):
            if len(known) > self.most:
                known.clear()
        return list(map(self._text, texts))


def pieces(documents: DataFrame, length: int = 1024, tokenizer: tuple[str, str | None] | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece, with its row's place; every piece but a document's last one fills a sequence."""
    path, end, step = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little"), 4 * length

    def run(batches):
        from pyspark import TaskContext

        encode, place = once_a_worker(f"encoder {path}", lambda: Encoder(*path)), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in slices(texts):
                out: list[list] = [[], [], [], [], [], []]
                encoded = encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                for doc, raw in zip(ids.slice(lo, hi - lo).to_pylist(), encoded):
                    raw += end
                    for s in range(0, len(raw), step):
                        piece = raw[s : s + step]
                        for column, value in zip(out, (doc, s // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4, place)):
                            column.append(value)
                    place += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    return in_small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{PIECES}, place long")


def pack(documents: DataFrame, length: int = 1024, tokenizer: tuple[str, str | None] | None = None, end_id: int = 0, group_docs: int = 2048, seed: int = 17) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module."""
    cut = Scratch(documents.sparkSession, "pack").table(pieces(documents, length, tokenizer, end_id), "pieces")
    groups = max(1, -(-cut.count() // group_docs))

    def assign(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "place", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(np.int64), length)
        frame["sequence_id"], frame["offset"] = (int(key[0]) << 32) + bins, offsets
        return frame.drop(columns=["grp", "place"])

    grp = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "place", "start"), F.lit(groups))
    return cut.withColumn("grp", grp).groupBy("grp").applyInPandas(assign, PACKED)
