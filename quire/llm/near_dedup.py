"""MinHash near-duplicates by min-max hashing, confirmed on full shingle sets.

1. One pass names each document's shingles and keeps, under each of 48 permutations, both the least and the greatest
   image: 96 signature values for 48 evaluations. Four values of four permutations make a band, 24 bands in all; a
   pair at similarity 0.8 shares none with probability (1 - 0.8**4)**24, below 4e-6.
2. Documents with equal sets collapse to their least doc_id by a digest of the set.
3. In each band's bucket every representative is paired with the bucket's least one only, and every such pair is
   confirmed on the full sets. Links join to components.
4. Buckets whose members are in several components may still hide links between them. Their members are joined
   exactly: shingles ordered by rarity (counts by hash slot over those members; any fixed order is exact, a rare-first
   one is fast), the prefix filter, and the length and positional filters within the join, so that neither a passage
   that thousands of documents share nor a hot group of near copies makes all its pairs. Only pairs of different
   components are made; they are confirmed and the components joined.

Words are maximal runs without white space, A-Z lowered. A set is the distinct ``shingle``-word sequences; a text with
fewer words has its whole word sequence as its one shingle. Texts without words have no set and link with nothing.
Rows that share a doc_id count as one document, and equal rows, however many, are confirmed once; a null doc_id links
with nothing, has no component and is kept. Texts of any length are read whole; ties go to the least doc_id; an empty
table gives an empty one; other columns are ignored or, by ``keep_one_of_each``, carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import NOT_SPACE, blocks, mix, pair, trimmed, words
from .common import BROADCAST_IDS, fresh, one_row_each, staged
from .components import components

PERMUTATIONS, BANDS, ROWS = 48, 24, 4
#: Counters of shingle frequency.
SLOTS = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20_260_101))
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    for block in blocks(column):
        w = words(block, NOT_SPACE)
        names = w.name
        rolled = names[: max(0, len(names) - shingle + 1)]
        for j in range(1, shingle):
            rolled = pair(rolled, names[j : len(names) - shingle + 1 + j])
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= shingle:
                s = np.sort(rolled[a : b - shingle + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                one = names[a : a + 1]
                for j in range(a + 1, b):
                    one = pair(one, names[j : j + 1])
                yield mix(one ^ np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band names of non-empty sets, BANDS a row: half of the bands are of least, half of greatest images."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    low, high = (np.empty((PERMUTATIONS, len(sets)), np.uint64) for _ in range(2))
    for k in range(PERMUTATIONS):
        image = flat * _A[k] + _B[k]
        low[k], high[k] = np.minimum.reduceat(image, first), np.maximum.reduceat(image, first)
    values = np.concatenate([low, high])
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        name = np.full(len(sets), band + 1, np.uint64)
        for row in range(ROWS):
            name = pair(name, values[band * ROWS + row])
        out[:, band] = name
    return out


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands. Not staged."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, digest, bands = [], [], []
            waiting: list[np.ndarray] = []

            def flush() -> None:
                if waiting:
                    bands.extend(signatures(waiting).view(np.int64).tolist())
                    waiting.clear()

            at = []
            size = 0
            for k, s in enumerate(shingle_sets(batch.column(1), shingle)):
                count.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    waiting.append(s)
                    at.append(k)
                    size += len(s)
                    if size > 250_000:
                        flush()
                        size = 0
            flush()
            every: list = [None] * len(count)
            for k, b in zip(at, bands, strict=True):
                every[k] = b
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(every, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return source.mapInArrow(trimmed(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(node, set) for the documents in ``ids`` (node), staged."""
    source = one_row_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).withColumnRenamed("doc_id", "node")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["node", "set"])

    return staged(source.join(ids, "node", "left_semi").mapInArrow(trimmed(run), "node long, set binary"))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with ``inter`` and ``union`` of their full sets, staged."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, union = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                inter.append(both)
                union.append(len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "inter", "union"])

    return staged(joined.mapInArrow(trimmed(run), "a long, b long, inter long, union long"))


def _cross_pairs(sets: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may reach ``percent``, by an exact set-similarity join."""
    ids = F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed
    theirs = sets.dropDuplicates(["node"]).join(ids, "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    counts = theirs.select("set").mapInArrow(trimmed(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = np.zeros(SLOTS, np.int64)
    for r in counts.toLocalIterator():  # SLOTS rows at most
        table[r["slot"]] = r["n"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, row, at, size = [], [], [], []
            for k, x in enumerate(batch.column(2)):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                order = np.lexsort((s, table[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))
                p = len(s) + 1 - -(-percent * len(s) // 100)
                token.append(s[order[:p]].view(np.int64))
                row.append(np.full(p, k))
                at.append(np.arange(p))
                size.append(np.full(p, len(s)))
            token, row, at, size = (pa.array(np.concatenate(x)) for x in (token, row, at, size))
            yield pa.RecordBatch.from_arrays([token, batch.column(0).take(row), batch.column(1).take(row), at, size], names=["token", "node", "component", "at", "n"])

    rows = theirs.select("node", "component", "set").mapInArrow(trimmed(prefixes), "token long, node long, component long, at long, n long")
    several = rows.groupBy("token").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("token")
    rows = staged(rows.join(several, "token"))
    one = rows.toDF("k", "a", "ca", "ia", "na")
    two = rows.toDF("token", "b", "cb", "ib", "nb")
    can = (
        (F.col("token") == F.col("k"))
        & (F.col("ca") < F.col("cb"))
        & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & ((100 + percent) * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= percent * (F.col("na") + F.col("nb")))
    )
    return staged(one.join(two, can).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links) and kept."""
    sketched = staged(sketch(docs, shingle))
    named = sketched.where("doc_id is not null and digest is not null")
    classes = staged(named.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    ours = named.join(classes.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")))
    members = ours.dropDuplicates(["digest"]).select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    members = members.dropDuplicates(["node", "bucket"])
    least = members.groupBy("bucket").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    shared = staged(members.join(least.withColumnRenamed("bucket", "k"), F.col("bucket") == F.col("k")).select("bucket", "node", "n", "center"))
    stars = shared.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    sets = _sets_of(docs, shared.select("node").distinct(), shingle)
    tried = _confirm(stars, sets)
    linked = f"100 * inter >= {percent} * union"
    links = tried.where(linked).select("a", "b")
    found = staged(components(links))
    of = shared.join(found.select(F.col("node").alias("x"), "component"), F.col("node") == F.col("x"), "left").withColumn("component", F.coalesce("component", "node"))
    met = of.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select(F.col("bucket").alias("k"))
    mixed = staged(of.join(met, F.col("bucket") == F.col("k"), "left_semi").groupBy("node").agg(F.min("component").alias("component")))
    rest = _cross_pairs(sets, mixed, percent)
    more = _confirm(rest, sets).where(linked)
    if more.limit(1).count():
        step = found.select(F.col("node").alias("x"), "component")
        more = more.join(step, F.col("a") == F.col("x"), "left").select(F.coalesce("component", "a").alias("a"), "b")
        more = more.join(step, F.col("b") == F.col("x"), "left").select("a", F.coalesce("component", "b").alias("b"))
        joined = staged(components(more)).select(F.col("node").alias("x"), F.col("component").alias("top"))
        # a component's root may be in no link of the first round
        roots = joined.select(F.col("x").alias("node"), F.col("top").alias("component"))
        found = found.join(joined, F.col("component") == F.col("x"), "left").select("node", F.coalesce("top", "component").alias("component"))
        found = staged(found.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")))
    named_rep = staged(classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component")))
    out = sketched.join(named_rep, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of least doc_id; every column as it was.

    Rows that share a kept document's id all stay.
    """
    found = near_duplicates(docs, shingle, percent)
    key = fresh(docs, "gone")
    gone = staged(found.where("not kept").select(F.col("doc_id").alias(key)).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(key), "left_anti").select([docs[f"`{c}`"] for c in docs.columns])
