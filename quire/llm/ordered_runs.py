"""Long ordered groups without a task that gathers one: rows in global order, and checksums of streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import trimmed
from .common import partitions_for, staged

#: Stored bytes of rows for each range.
RANGE_BYTES = 256_000_000
#: Characters of a text that count in the order of rows before its hash does.
PREFIX = 200
#: Rows of a block where a group's running totals are taken block by block.
BLOCK = 1 << 16


def turn_order(text: str) -> list[Column]:
    """Order of a conversation's rows: by turn (null first), then role, then the text's first ``PREFIX`` characters, then
    its hash. Needs columns conv_id, turn, role, ``text`` and ``row`` (any number, to deal equal rows to several ranges)."""
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.substring(text, 1, PREFIX), F.xxhash64(text), F.col("row")]


def in_order(df: DataFrame, order: list[Column], *names: str) -> DataFrame:
    """Columns ``names`` of ``df``, with ``part`` (range that a row lies in) and ``pos`` (ascends in ``order`` over all
    rows), staged. A group of rows that follow one another is split where it spans ranges."""
    parts = partitions_for(df, RANGE_BYTES)
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(dealt.select(*names, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")))


def totals_before(rows: DataFrame, keys: list[str], block: str, how: Column, empty: Column, backwards: bool = False) -> DataFrame:
    """(keys, block, before): aggregate ``how`` (of a column ``x``) over the blocks of a group before each block. One row
    for each block is in the window, not the rows."""
    sums = rows.groupBy(*keys, block).agg(how.alias("x"))
    order = F.desc(block) if backwards else F.asc(block)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, block, F.coalesce(how.over(before), empty).alias("before"))


def hashed_streams(chunks: DataFrame, keys: list[str], order: list[str], separator: bytes) -> DataFrame:
    """(keys, sha256): lowercase hex SHA-256 of each key's ``chunk`` strings in ``order``, joined by ``separator``. A
    checksum can only be taken front to back, so that a key's chunks pass through one task, sorted on disk where
    they must be, but are never held there."""
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema}
    dealt = chunks.select(*keys, *order, "chunk").repartition(*keys).sortWithinPartitions(*[F.asc_nulls_first(c) for c in keys], *order)
    width, at = len(keys), len(keys) + len(order)
    names = [*keys, "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, kinds = None, None, None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:width]]
            out: list[tuple] = []
            for *mine, chunk in zip(*(batch.column(k).to_pylist() for k in (*range(width), at)), strict=True):
                if digest is None or mine != key:
                    if digest is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = mine, hashlib.sha256()
                else:
                    digest.update(separator)
                digest.update(chunk.encode())
            if out:
                yield _rows(out, kinds, names)
        if digest is not None:
            yield _rows([(*key, digest.hexdigest())], kinds, names)

    return dealt.mapInArrow(trimmed(run), ", ".join(f"{k} {fields[k]}" for k in keys) + ", sha256 string")


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*kinds, pa.string()], strict=True)], names=names)


def listed(ids: DataFrame, keys: list[str], item: str, size: int = 4096) -> DataFrame:
    """``ids`` as comma-joined ``chunk`` strings of up to ``size`` ids each, in ascending order: keys, item (the first id
    of the chunk), chunk. Longs only. What is a row each becomes a row for thousands before a key's rows meet."""
    dealt = ids.select(*keys, item).repartitionByRange(partitions_for(ids, RANGE_BYTES), *keys, item).sortWithinPartitions(*keys, item)
    names = [*keys, item, "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            key, n = None, 0
            for *mine, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mine != key or n >= size:
                    out.append([*mine, i, [str(i)]])
                    key, n = mine, 1
                else:
                    out[-1][-1].append(str(i))
                    n += 1
            if out:
                *columns, chunk = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([",".join(x) for x in chunk])], names=names)

    return dealt.mapInArrow(trimmed(run), ", ".join(f"{k} long" for k in [*keys, item]) + ", chunk string")
