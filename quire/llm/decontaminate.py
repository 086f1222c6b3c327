"""Benchmark decontamination with suffix arrays over the training shards.

Each executor takes its documents in shards of a few MB. A shard's suffix array holds the suffixes of its word
sequence, sorted to the depth of a window (ten words); suffixes whose first words begin no benchmark window cannot
match and are left out before sorting. Every benchmark suffix is then binary-searched in each shard's array; the
range it finds gives its occurrences, and occurrences that follow one another in both texts join to the longest
verbatim match with its place in the document and in the item. All of it is within a document, so nothing is
shuffled.

The benchmark is read to the driver in parts of at most ``PART_BYTES`` (checked before each is read) and broadcast;
a larger benchmark makes more parts, and each document passes through all of them.

Defined results: a null or empty text has no words and is never contaminated; items without id or text are ignored;
items that share an id count once; repeated document rows are treated alike; texts of any length are read whole, in blocks; an empty table of documents gives
an empty one, an empty benchmark hits nothing; other columns are carried, never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import ALNUM, Block, Words, blocks, pair, trimmed, words

WINDOW = 10
PART_BYTES = 16_000_000
_BITS = 20


@dataclass
class Depth:
    """Benchmark windows of one length."""

    length: int
    keys: np.ndarray  # distinct windows, sorted
    owner_first: np.ndarray  # for each key, where its owners begin
    owner_item: np.ndarray
    owner_place: np.ndarray  # word offset of the window in its item
    gate: np.ndarray  # which hashed leading words begin a window


@dataclass
class Index:
    items: list[str]
    vocabulary: np.ndarray
    depths: list[Depth] = field(default_factory=list)


def _lead(names: np.ndarray, length: int) -> np.ndarray:
    """Names of the first one, two or three words at each position that has them."""
    g = min(3, length)
    out = names[: len(names) - g + 1] if len(names) >= g else names[:0]
    for j in range(1, g):
        out = pair(out, names[j : len(names) - g + 1 + j])
    return out


def _keys(ranks: np.ndarray) -> np.ndarray:
    """Rows of word ranks as fixed-width strings that compare as the rows do."""
    wide = np.ascontiguousarray(ranks.astype(">u4"))
    return wide.view(f"S{4 * wide.shape[1]}").ravel() if len(wide) else np.zeros(0, f"S{4 * wide.shape[1]}")


def build_index(items: list[tuple[str, str]], window: int = WINDOW) -> Index:
    ids, texts = [i for i, _ in items], [t for _, t in items]
    names, of, at, size = [], [], [], []
    for block in blocks(pa.array(texts, pa.large_string())):
        w = words(block, ALNUM)
        count = np.diff(w.first)
        names.append(w.name)
        of.append(w.doc + block.first)
        at.append(np.arange(len(w.name)) - np.repeat(w.first[:-1], count))
        size.append(np.repeat(count, count))
    if not names:
        return Index(ids, np.zeros(0, np.uint64))
    name, item, place, count = map(np.concatenate, (names, of, at, size))
    index = Index(ids, np.unique(name))
    rank = np.searchsorted(index.vocabulary, name) + 1
    depth_of = np.minimum(count, window)
    for length in np.unique(depth_of):
        starts = np.flatnonzero((depth_of == length) & (place + length <= count))
        keys = _keys(rank[starts[:, None] + np.arange(length)])
        order = np.argsort(keys, kind="stable")
        found, first = np.unique(keys[order], return_index=True)
        gate = np.zeros(1 << _BITS, bool)
        g = min(3, int(length))
        lead = name[starts]
        for j in range(1, g):
            lead = pair(lead, name[starts + j])
        gate[(lead >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        index.depths.append(Depth(int(length), found, np.append(first, len(order)), item[starts][order], place[starts][order], gate))
    return index


def search(block: Block, w: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of benchmark windows in a shard: word position, item, word offset in the item, window length."""
    got: list[tuple[np.ndarray, ...]] = []
    room = w.first[1:][w.doc] if len(w.doc) else np.zeros(0, np.int64)  # end of each word's text, in words
    for depth in index.depths:
        lead = _lead(w.name, depth.length)
        at = np.flatnonzero(depth.gate[(lead >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = at[at + depth.length <= room[at]]
        if not len(at):
            continue
        grams = w.name[at[:, None] + np.arange(depth.length)]
        rank = np.searchsorted(index.vocabulary, grams)
        known = (index.vocabulary[np.minimum(rank, len(index.vocabulary) - 1)] == grams).all(1)
        at, rank = at[known], rank[known] + 1
        if not len(at):
            continue
        keys = _keys(rank)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array, to this depth
        suffixes, at = keys[order], at[order]
        low, high = np.searchsorted(suffixes, depth.keys, "left"), np.searchsorted(suffixes, depth.keys, "right")
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        where = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key = np.repeat(hit, many)
        owners = (depth.owner_first[1:] - depth.owner_first[:-1])[key]
        own = np.repeat(depth.owner_first[key], owners) + np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners)
        pos = np.repeat(at[where], owners)
        got.append((pos, depth.owner_item[own], depth.owner_place[own], np.full(len(pos), depth.length)))
    if not got:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))  # type: ignore[return-value]


def longest(pos: np.ndarray, item: np.ndarray, place: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Occurrences that follow one another in document and item, joined: (item, word in item, word position, words)."""
    if not len(pos):
        return []
    order = np.lexsort((pos, pos - place, item))
    pos, item, place, length = pos[order], item[order], place[order], length[order]
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | ((pos - place)[1:] != (pos - place)[:-1]) | (pos[1:] > pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos)) - 1
    return list(zip(item[first].tolist(), place[first].tolist(), pos[first].tolist(), (pos[last] + length[last] - pos[first]).tolist(), strict=True))


def _covered(pos: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _parts(benchmark: DataFrame, part_bytes: int) -> list:
    """The benchmark's parts, broadcast. Their number follows from its size, which is summed first."""
    spark = benchmark.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()["b"]
    count = -(-int(total) // part_bytes)
    if count <= 1:
        return [spark.sparkContext.broadcast(build_index([(r.item_id, r.text) for r in items.collect()]))]
    part = F.pmod(F.xxhash64("item_id"), F.lit(2 * count))
    return [spark.sparkContext.broadcast(build_index([(r.item_id, r.text) for r in items.where(part == k).collect()])) for k in range(2 * count)]


def _scan(column: pa.Array, parts: list) -> Iterator[tuple[Block, Words, np.ndarray, list[tuple]]]:
    """Per block: which words are hit, and the occurrences in each part."""
    for block in blocks(column):
        w = words(block, ALNUM)
        hit, found = np.zeros(len(w.start), bool), []
        for part in parts:
            pos, item, place, length = search(block, w, part.value)
            hit |= _covered(pos, length, len(w.start)) if len(pos) else False
            found.append((part.value.items, pos, item, place, length))
        yield block, w, hit, found


MATCHES = "array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids found, sorted as strings) and matches (longest verbatim
    matches: item, word offset in the item, word offset in the document, words)."""
    parts = _parts(benchmark, part_bytes)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, matches {MATCHES}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
        for batch in batches:
            n_words, n_hit, items, matches = [], [], [], []
            for _, w, hit, found in _scan(batch.column(1), parts):
                docs_here = len(w.first) - 1
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words += np.diff(w.first).tolist()
                n_hit += (total[w.first[1:]] - total[w.first[:-1]]).tolist()
                mine: list[list[dict]] = [[] for _ in range(docs_here)]
                for names, pos, item, place, length in found:
                    for i, at, p, n in longest(pos, item, place, length):
                        d = int(w.doc[p])
                        mine[d].append({"item_id": names[i], "item_word": at, "doc_word": p - int(w.first[d]), "n_words": n})
                for rows in mine:
                    items.append(sorted({r["item_id"] for r in rows}))
                    matches.append(sorted(rows, key=lambda r: (r["doc_word"], r["item_id"], r["item_word"])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(matches, pa.list_(match))],
                names=["doc_id", "n_words", "n_hit", "items", "matches"],
            )

    return source.mapInArrow(trimmed(scan), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without the documents that hold any benchmark window; every column as it was."""
    parts = _parts(benchmark, part_bytes)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for block, w, hit, _ in _scan(batch.column(at), parts):
                clean[block.first + w.doc[hit]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(trimmed(keep), docs.schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract of ``op5``."""
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "matches",
    )


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()
