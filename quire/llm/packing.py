"""Packing of tokenised documents into fixed-length sequences: cutting stock by column generation.

1. Each executor tokenises its documents and cuts those longer than a sequence into full pieces and a rest.
2. The histogram of piece lengths, in classes of ``QUANTUM`` tokens, goes to the driver (at most SEQUENCE / QUANTUM
   rows), where ``cutting_stock`` turns it into patterns.
3. Pieces are ranked within their class without gathering a class: hashed buckets of a class are counted, their
   counts give offsets, and a piece's rank is its bucket's offset plus its rank there. A rank falls into one use of
   one pattern, which is its sequence; offsets are running sums within a sequence.

Tokens are looked up by word: the tokenizer's pieces never cross white space, nor the border between an ASCII letter
and most ASCII marks, and it lowers all letters, so that a word gets the same ids whatever stands around it. Texts
near a special token's string are cut at white space only and keep their case. Words not yet in an executor's bounded
table are tokenised together.

Defined results: null text is an empty text and still one piece of one token (the end id); repeated rows are packed
once each; pieces of equal length are ranked by id, start and checksum, equal ones in any order; a text of any length is
tokenised whole, in slices cut at white space; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cutting_stock
from .bytescan import NOT_SPACE, Block, blocks, trimmed, words
from .common import staged

SEQUENCE = 2048
QUANTUM = 8
END_ID = 1
TABLE_WORDS = 250_000
#: 1: ASCII letters; 2: marks that end a run of letters. The apostrophe begins contractions, and <, | and > stand in
#: special tokens: no cut is made beside them.
CUTS = np.zeros(256, np.uint8)
CUTS[[*range(65, 91), *range(97, 123)]] = 1
CUTS[list(b'!"#$%&()*+,-./:;=?@[]^_`{}~')] = 2
LONG_TEXT = 4_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Ids of words, by the words' names. The table is emptied when it holds ``TABLE_WORDS`` words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.first = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _tokenise(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if max(map(len, texts)) > 10_000:
            each = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each])
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size + 1) - size - 1
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        at = np.array([s for s, _ in found.offsets], np.int64)
        owner = np.searchsorted(begin, at, "right") - 1
        return np.array(found.ids, np.uint32), np.bincount(owner, minlength=len(texts))

    def _learn(self, names: list[int], texts: list[str]) -> None:
        for lo in range(0, len(texts), 20_000):
            ids, count = self._tokenise(texts[lo : lo + 20_000])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
            base = len(self.slot)
            if base + len(count) > len(self.first):
                more = np.zeros(max(len(self.first), len(count)), np.int64)
                self.first, self.size = np.concatenate([self.first, more]), np.concatenate([self.size, more])
            self.ids[self.used : self.used + len(ids)] = ids
            self.first[base : base + len(count)] = self.used + np.cumsum(count) - count
            self.size[base : base + len(count)] = count
            self.used += len(ids)
            for k, name in enumerate(names[lo : lo + 20_000]):
                self.slot[name] = base + k

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts one after the other, and where each text begins (one more at the end)."""
        raw = block.data.tobytes()
        special = b"<|" in raw
        w = words(block, NOT_SPACE, lower=not special, split=None if special else CUTS)
        if special:
            w.name ^= np.uint64(0x5BD1E9955BD1E995)
        if len(self.slot) > TABLE_WORDS:
            self._clear()
        distinct, at, inverse = np.unique(w.name, return_index=True, return_inverse=True)
        listed = distinct.tolist()
        missing = [k for k, name in enumerate(listed) if name not in self.slot]
        if missing:
            pick = at[missing]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[pick].tolist(), w.end[pick].tolist(), strict=True)]
            self._learn([listed[k] for k in missing], texts)
        slot = np.array([self.slot[name] for name in listed], np.int64)[inverse.ravel()]
        size, first = self.size[slot], self.first[slot]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(first - (ends - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[w.first]


@lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _slices(block: Block) -> Iterator[Block]:
    """A block of one very long text, cut at white space."""
    n, lo = len(block.data), 0
    while lo < n:
        hi = min(n, lo + LONG_TEXT)
        while hi < n:
            space = np.flatnonzero(~NOT_SPACE[block.data[hi : hi + 65_536]])
            if len(space):
                hi += int(space[0])
                break
            hi = min(n, hi + 65_536)
        yield Block(block.first, block.last, block.data[lo:hi], np.array([0, hi - lo]))
        lo = hi


def _cut(parts: Iterator[np.ndarray], sequence: int) -> list[tuple[int, int, int]]:
    """Pieces (start, length, crc32) of one document, whose ids come in parts and end with the end id."""
    out, start, length, crc = [], 0, 0, 0
    for ids in parts:
        raw, lo = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
        while lo < len(ids):
            take = min(sequence - length, len(ids) - lo)
            crc = zlib.crc32(raw[4 * lo : 4 * (lo + take)], crc)
            length, lo = length + take, lo + take
            if length == sequence:
                out.append((start, length, crc))
                start, length, crc = start + length, 0, 0
    if length:
        out.append((start, length, crc))
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for block in blocks(batch.column(1)):
                if len(block.data) > LONG_TEXT:
                    mine = [_cut(iter(x for s in (*_slices(block), None) for x in ([end] if s is None else [tokens.encode(s)[0]])), sequence)]
                else:
                    ids, bounds = tokens.encode(block)
                    mine = [_cut(iter((ids[a:b], end)), sequence) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                for d, found in enumerate(mine, block.first):
                    for s, n, c in found:
                        row.append(d)
                        start.append(s)
                        length.append(n)
                        crc.append(c)
                    total += [found[-1][0] + found[-1][1]] * len(found)
            long = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *long], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return source.mapInArrow(trimmed(cut), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def _layout(patterns: list[tuple[cutting_stock.Pattern, int]], classes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: from which rank each pattern serves it, the pattern's first sequence, copies in each sequence."""
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(classes + 1)]
    given, base = [0] * (classes + 1), 0
    for pattern, uses in patterns:
        for c, copies in pattern:
            spans[c].append((given[c], base, copies))
            given[c] += copies * uses
        base += uses
    return [tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) if s else () for s in spans]  # type: ignore[misc]


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, quantum: int = QUANTUM) -> DataFrame:
    """Contract of ``op7``: each piece with its sequence and its offset there."""
    if sequence % quantum:
        raise ValueError("a sequence must be a multiple of the quantum")
    classes = sequence // quantum
    cut = staged(pieces(docs, tokenizer, sequence)).withColumn("class", F.ceil(F.col("length") / quantum).cast("int"))
    histogram = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.array([histogram.get(c, 0) for c in range(1, classes + 1)], np.int64)
    layout = _layout(cutting_stock.solve(demand, classes), classes)
    # buckets of some ten thousand pieces, 4096 a class at most
    buckets = 1 << max(4, min(12, int(demand.sum() // 50_000).bit_length()))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # at most classes * buckets rows
    within = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within)).join(F.broadcast(first), ["class", "bucket"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = ranked.select(*names, "class", (F.col("first") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            to = np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == c)
                begin, base, copies = layout[c]
                k = np.searchsorted(begin, rank[mine], "right") - 1
                to[mine] = base[k] + (rank[mine] - begin[k]) // copies[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(to)], names=[*names, "sequence_id"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    placed = ranked.mapInArrow(trimmed(place), f"{schema}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
