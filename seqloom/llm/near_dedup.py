"""Near duplicates: MinHash bands propose, signatures sift, full shingle sets decide.

1. One pass over the texts gives each document its set of word shingles as 64-bit hashes, of
   which are kept: the size, a 128-bit hash of the set, the minima of ``bands * rows`` universal
   hashes, and a hash per band.  Documents with equal sets share one representative, found in two
   steps over salted keys, so that a group of copies is never one task.
2. Representatives that share a band meet at the band's least one; components of these proposals
   are *clusters*, and no link leaves a cluster.
3. Clusters are cut into blocks bounded in documents and in bytes of their sets.  In a block,
   signatures are compared first, and pairs above ``signature_floor`` are verified on the full
   sets, unless already joined: a block gives a spanning forest, never all pairs.  A cluster of one
   block is done.  The blocks of a larger one all hold its least document too, which joins what is
   near it; a set is shuffled once.
4. What a larger cluster's blocks left apart meets again band by band: a band whose documents are
   not all joined yet is a group of its own (cut into pairs of blocks where it is large; documents
   of its largest joined part do not meet each other), so a set moves at most once for each band
   that it shares with documents it is not joined with.
5. Components of the links, by large-star and small-star.

Links are exact; a link at the threshold is missed with probability ``(1 - t**rows)**bands``
(4e-5 for 0.85 with 32 bands of 8), and far less where copies have other ways to meet.

Null and empty texts have no set, link with nothing and stay; an empty table gives none.  Of equal
texts the least doc_id is kept.  Rows that share a doc_id are one document.  Rows without a doc_id
link with nothing, have no component, and stay.  Texts are hashed in parts, so a long one costs its
words and its set (8 bytes a word each), never more than one text at a time.  ``near_duplicates``
returns its own columns only; ``one_of_each`` passes all columns through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CODE_LOWER, NOT_BLANK, Scratch, flat, in_small_batches, keep_small, mix, slices, spans, word_hashes
from .components import components

SEED = 61
_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_hashes(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; a text of fewer words has one, of all its words."""
    starts, ends, bounds = spans(data, off, NOT_BLANK)
    words = word_hashes(data, starts, ends, CODE_LOWER)
    n = len(words) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        rolled = rolled * _STEP + words[j : j + n]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            x = np.array([hi - lo], np.uint64)  # an array: scalars warn where they wrap
            for j in range(lo, hi):
                x = x * _STEP + words[j : j + 1]
            out.append(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        else:
            out.append(words[:0])
    return out


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a = (rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The least value of each hash ``a x + b``."""
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(x), 512):
            h = self.a[:, None] * x[None, lo : lo + 512]
            h += self.b[:, None]
            np.minimum(out, h.min(1), out=out)
        return out

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        s = signature.reshape(-1, self.bands, self.rows)
        h = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), s.shape[:2]).copy()
        for j in range(self.rows):
            h = h * _STEP + (s[:, :, j] >> np.uint64(16))
        return mix(h).view(np.int64)


FINGERPRINT = T.StructType().add("doc_id", "long").add("n_shingles", "long").add("h1", "long").add("h2", "long").add("bands", T.ArrayType(T.LongType()))


def fingerprints(documents: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        minhash = MinHash(bands, rows)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in slices(texts):
                data, off = flat(texts.slice(lo, hi - lo))
                sets = shingle_hashes(data, off, width)
                n = np.array([len(s) for s in sets], np.int64)
                # sums over a set do not depend on an order
                h1 = np.array([np.bitwise_xor.reduce(s * _STEP + np.uint64(1)) if len(s) else 0 for s in sets], np.uint64)
                h2 = np.array([np.add.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
                some = np.flatnonzero(n)
                sig = np.array([minhash(sets[i]) for i in some], np.uint64).reshape(len(some), bands * rows)
                at = np.zeros(len(n) + 1, np.int32)
                at[1:] = np.cumsum(np.where(n > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(minhash.band_hashes(sig).ravel())),
                    ],
                    names=FINGERPRINT.names,
                )

    return in_small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FINGERPRINT)


def shingle_sets(documents: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Full sets and signatures of the rows of ``documents(rep, cluster, text)``."""

    def run(batches):
        minhash = MinHash(bands, rows)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                sets = shingle_hashes(*flat(texts.slice(lo, hi - lo)), width)
                sig = [(minhash(s) >> np.uint64(32)).astype(np.uint16).tobytes() for s in sets]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("cluster"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "cluster", "n", "signature", "shingles"])

    return in_small_batches(documents).select("rep", "cluster", "text").mapInArrow(run, "rep long, cluster long, n long, signature binary, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two runs
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def block_links(reps: np.ndarray, sides: np.ndarray, labels: np.ndarray, signatures: np.ndarray, sets: list[bytes], percent: int, least_equal: int) -> list[tuple[int, int]]:
    """Links that join what differs in its label, a spanning forest of them: in one block (all sides 0), or across two."""
    n, label, out = np.array([len(s) // 8 for s in sets]), labels.copy(), []
    across = bool(sides.any())
    for i in range(len(reps) - 1):
        # two documents of a part joined before need not be compared
        ok = (label[i + 1 :] != label[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :]))
        if across:
            ok &= sides[i + 1 :] != sides[i]
        rest = np.flatnonzero(ok) + i + 1
        if len(rest):
            rest = rest[(signatures[rest] == signatures[i]).sum(1) >= least_equal]
        for j in rest.tolist():
            if label[i] != label[j] and linked(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64), percent):
                label[label == label[j]] = label[i]
                out.append((int(reps[i]), int(reps[j])))
    return out


def _links(percent: int, least_equal: int):
    """Over rows sorted by group: each group's links; a group may span batches."""
    names = ["grp", "side", "label", "rep", "signature", "shingles"]

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).select(names)
        grp = part.column("grp").to_numpy()
        cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
        reps, sides, labels = (part.column(c).to_numpy() for c in ("rep", "side", "label"))
        sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(len(grp), -1)
        sets, out = part.column("shingles").to_pylist(), []
        for lo, hi in zip(cuts, cuts[1:]):
            out += block_links(reps[lo:hi], sides[lo:hi], labels[lo:hi], sig[lo:hi], sets[lo:hi], percent, least_equal)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # the group that is not at its end yet
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp").to_numpy()
            if held and grp[0] != last:
                yield solve(held)
                held = []
            if grp[0] != grp[-1]:
                cut = int(np.flatnonzero(grp != grp[-1])[-1]) + 1
                yield solve([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
            last = grp[-1]
        if held:
            yield solve(held)

    return run


#: a document's place among the copies of one set: a group of copies is spread over so many keys
_SALT = "cast(pmod(xxhash64(doc_id), 256) as int) as salt"


def copies(prints: DataFrame) -> DataFrame:
    """(h1, h2, salt, rep) of the sets that several rows have; each hot set is reduced salt by salt first."""
    part = prints.where("n_shingles > 0 and doc_id is not null").select("h1", "h2", "doc_id", F.expr(_SALT)).groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("m"), F.count("*").alias("n"))
    whole = part.groupBy("h1", "h2").agg(F.min("m").alias("rep"), F.sum("n").alias("n")).where("n > 1").select("h1", "h2", "rep")
    return part.join(whole, ["h1", "h2"]).select("h1", "h2", "salt", "rep")


def parts_of(rows: DataFrame, key: str, block_docs: int, block_bytes: int) -> DataFrame:
    """Per key: how many blocks keep within both bounds; ``rows`` has n, the size of a set."""
    return rows.groupBy(key).agg(F.expr(f"cast(greatest(ceil(count(*) / {block_docs}), ceil(sum(n) * 8 / {block_bytes})) as int)").alias("parts"))


def across_bands(banded: DataFrame, full: DataFrame, label: DataFrame, scratch: Scratch, block_docs: int, block_bytes: int) -> DataFrame:
    """Groups of the bands of ``banded(doc_id, band)`` whose documents ``label(rep, label, n)`` do not share one label."""
    met = scratch.table(banded.withColumnRenamed("doc_id", "rep").join(keep_small(label, label.count()), "rep").distinct(), "met")
    by_label = met.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    main = by_label.groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("kinds"), *[F.expr(f"cast(ceil(greatest((sum({c}) - max_by({c}, struct(c, label))) / {most}, 0)) as int)").alias(f"r{c}") for c, most in (("c", block_docs), ("n", block_bytes // 8))], *[F.expr(f"cast(ceil(max_by({c}, struct(c, label)) / {most}) as int)").alias(f"a{c}") for c, most in (("c", block_docs), ("n", block_bytes // 8))]).where("kinds > 1")
    main = scratch.table(main.select("band", "main", F.greatest("rc", "rn").alias("nr"), F.greatest("ac", "an").alias("na")), "bands")
    rows = met.join(keep_small(main, main.count()), "band").withColumn("pure", F.expr("label = main"))
    rows = rows.withColumn("i", F.expr("cast(pmod(xxhash64(rep, 7), if(pure, na, nr)) as int)"))
    # a band of one block a side is one group; else blocks of what is not in the main part meet all blocks
    one = "array(struct(0 as p, 0 as q, 0 as side))"
    open_open = "transform(sequence(0, nr - 1), j -> struct(least(i, j) as p, greatest(i, j) as q, int(i > j) as side))"
    open_pure = "transform(sequence(0, na - 1), j -> struct(i as p, nr + j as q, 0 as side))"
    pure_open = "transform(sequence(0, nr - 1), j -> struct(j as p, nr + i as q, 1 as side))"
    rows = rows.withColumn("g", F.expr(f"explode(if(nr = 1 and na = 1, {one}, if(pure, {pure_open}, concat({open_open}, {open_pure}))))"))
    dealt = rows.select(F.expr("xxhash64(band, g.p, g.q)").alias("grp"), F.col("g.side").alias("side"), "label", "rep")
    return dealt.join(full.select("rep", "signature", "shingles"), "rep").select("grp", "side", "label", "rep", "signature", "shingles")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 85, bands: int = 32, rows: int = 8, block_docs: int = 1024, block_bytes: int = 32 << 20, signature_floor: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``documents``."""
    scratch = Scratch(documents.sparkSession, "near")
    at = percent / 100
    floor = signature_floor if signature_floor is not None else at - 5 * (at * (1 - at) / (bands * rows)) ** 0.5
    solve = lambda dealt: dealt.repartition("grp").sortWithinPartitions("grp", "rep").mapInArrow(_links(percent, int(floor * bands * rows)), "a long, b long")

    prints = scratch.table(fingerprints(documents, width, bands, rows), "prints")
    shared = scratch.table(copies(prints), "copies")
    n_shared = shared.count()
    marked = prints.withColumn("salt", F.expr(_SALT)).join(keep_small(shared, n_shared), ["h1", "h2", "salt"], "left")
    marked = marked.withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))

    # equal sets share their least document
    banded = marked.where("doc_id = rep").select("doc_id", F.explode("bands").alias("band"))
    hubs = scratch.table(banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub <> top").select("band", "hub"), "hubs")
    met = scratch.table(banded.join(keep_small(hubs, hubs.count()), "band"), "banded")
    cluster = components(met.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), scratch, "cluster")
    cluster = scratch.table(cluster.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")

    texts = documents.select(F.col("doc_id").cast("long"), "text").join(keep_small(cluster, cluster.count()), "doc_id").withColumnRenamed("doc_id", "rep")
    full = shingle_sets(texts, width, bands, rows).where("n > 0")
    if marked.where("doc_id = rep").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():  # rows that repeat a document
        full = full.dropDuplicates(["rep", "shingles"])
    full = scratch.table(full, "sets")

    big = scratch.table(parts_of(full, "cluster", block_docs, block_bytes).where("parts > 1"), "big")
    n_big = big.count()
    placed = full.join(keep_small(big, n_big), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))
    blocks = placed.withColumn("b", F.col("block"))
    if n_big:  # the least document of a large cluster is in all its blocks
        blocks = placed.withColumn("b", F.explode(F.expr("if(rep = cluster and parts > 1, sequence(0, parts - 1), array(block))")))
    links = scratch.table(solve(blocks.select(F.xxhash64("cluster", "b").alias("grp"), F.lit(0).alias("side"), F.col("rep").alias("label"), "rep", "signature", "shingles")), "links")
    found = scratch.table(components(links, scratch, "linked"), "found")
    if n_big:
        label = full.join(keep_small(big, n_big), "cluster", "left_semi").select("rep", "n").join(keep_small(found, found.count()), F.col("rep") == F.col("node"), "left")
        label = scratch.table(label.groupBy("rep").agg(F.min(F.coalesce("component", "rep")).alias("label"), F.max("n").alias("n")), "labels")
        more = solve(across_bands(met.select("doc_id", "band"), full, label, scratch, block_docs, block_bytes))
        found = scratch.table(components(links.unionAll(more), scratch, "all"), "found_all")
    # copies get their component with their set's, all others by their own id: no join meets a hot key
    node = keep_small(found.withColumnRenamed("node", "doc_id"), found.count())
    of_set = scratch.table(shared.join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", "salt", F.coalesce("component", "rep").alias("of_set")), "of_set")
    out = prints.withColumn("salt", F.expr(_SALT)).join(keep_small(of_set, n_shared), ["h1", "h2", "salt"], "left").join(node, "doc_id", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("of_set", "component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame, **parameters) -> DataFrame:
    """The documents that stay: one of each component, as rows of ``documents``."""
    found = near_duplicates(documents, **parameters)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    scratch = Scratch(documents.sparkSession, "gone")
    gone = scratch.table(gone, "gone")
    stay = documents.join(keep_small(gone, gone.count()), "doc_id", "left_anti")
    again = scratch.table(documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "again")
    if n := again.count():  # a repeated doc_id is one document: the row of its least text stays
        again = keep_small(again, n)
        least = F.min_by(F.struct(*documents.columns), F.struct(F.coalesce(F.xxhash64("text"), F.lit(0)))).alias("row")
        stay = stay.join(again, "doc_id", "left_anti").unionByName(stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("row.*"))
    return stay
