"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers without a global sort: each row hashes to one of ``BUCKETS`` buckets, the
buckets' counts give offsets, and a row's number is its bucket's offset plus its rank in the bucket. A generalised
Feistel network over Z_a x Z_b, with a = ceil(sqrt(N)) and b = ceil(N / a), permutes the numbers; an image at or
above N walks on along its cycle until it is below N. ``shard = image mod S`` and ``slot = image div S``, so both
are computable from the row number alone, shard sizes differ by one row at most and slots have no gap.

Defined results of ``shard_documents``: null text has size 16 and the checksum of nothing; ids may be null or repeat, and
equal rows have a slot each; ties can't arise, as rows that equal each other in all columns are numbered one after the
other; a text of any length counts by its size and checksum only; an empty table gives an empty one; other columns are
ignored, whatever their names.

Everything is DataFrame expressions; equal rows are counted before they are shuffled and expanded again after it,
so that no row, however often repeated, gathers in one task.
"""

from __future__ import annotations

import struct
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 8192
ROUNDS = 6
#: An image outside [0, N) is one of fewer than sqrt(N) + 1 points, so that a walk of WALK steps always ends for
#: N <= 4096; beyond, the chance that any of N walks is longer is below N * N ** (-WALK / 2).
WALK = 64


def round_function(value: Column, seed: int, k: int) -> Column:
    """A keyed 64-bit mix (XXH64 of the value, then of the key), cut to 31 bits. It names ``value`` only once, so that
    nested rounds stay small expressions."""
    return F.xxhash64(value, F.lit(seed * ROUNDS + k).cast("long")).bitwiseAND(F.lit(0x7FFFFFFF))


def feistel(value: Column, a: Column, b: Column, seed: int) -> Column:
    """The permutation of [0, a * b)."""
    right = value % b
    left = F.call_function("div", value, b)
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = (left + round_function(right, seed, k)) % a
        else:
            right = (right + round_function(left, seed, k)) % b
    return left * b + right


def row_numbers(df: DataFrame) -> DataFrame:
    """``df`` (all columns identify a row) plus ``row_number`` (from 0, gapless) and ``total``."""
    cols = df.columns
    key = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in cols])
    same = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bucket", F.crc32(key.cast("binary")) % BUCKETS)
    in_order = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    counts = same.groupBy("__bucket").agg(F.sum("__n").alias("__size"))
    # at most BUCKETS rows, whatever the input
    starts = counts.select(
        "__bucket",
        F.coalesce(F.sum("__size").over(in_order), F.lit(0)).alias("__start"),
        F.sum("__size").over(everything).alias("total"),
    )
    within = Window.partitionBy("__bucket").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in cols])
    before = F.coalesce(F.sum("__n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = same.withColumn("__before", before).join(F.broadcast(starts), "__bucket")
    first = F.col("__start") + F.col("__before")
    numbers = F.when(F.col("__n") == 1, F.array(first)).otherwise(F.sequence(first, first + F.col("__n") - 1))
    return ranked.select(*cols, F.explode(numbers).alias("row_number"), "total")


def feistel_shards(df: DataFrame, shards: int, seed: int = 20_240_517) -> DataFrame:
    """``df`` plus ``row_number``, ``shard`` (int) and ``slot`` (long).

    All columns together identify a row: give the narrow ones (ids, sizes, digests) and join the rest by id.
    Rows may repeat: each copy has a number and a slot of its own. Nulls count as values of their own. An empty
    table gives an empty one. Columns named row_number, shard, slot, total or starting with ``__`` are refused.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    if clash := {"row_number", "shard", "slot", "total"} & {c.lower() for c in df.columns} | {c for c in df.columns if c.startswith("__")}:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    a = F.ceil(F.sqrt(F.col("total"))).cast("long")
    b = F.ceil(F.col("total") / a).cast("long")
    numbered = row_numbers(df).withColumn("__a", a).withColumn("__b", b)
    a, b, total = F.col("__a"), F.col("__b"), F.col("total")
    once = numbered.withColumn("__image", feistel(F.col("row_number"), a, b, seed))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.col("__image"),
        lambda acc, _: F.when(acc < total, acc).otherwise(feistel(acc, a, b, seed)),
    )
    image = F.when(F.col("__image") < total, F.col("__image")).otherwise(walk)
    done = once.withColumn("__image", image)
    checked = F.when(F.col("__image") < total, F.col("__image")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return done.withColumn("__image", checked).select(
        *df.columns,
        "row_number",
        (F.col("__image") % shards).cast("int").alias("shard"),
        F.expr(f"__image div {shards}").alias("slot"),
    )


def shard_and_slot(row_number: int, total: int, shards: int, seed: int = 20_240_517) -> tuple[int, int]:
    """Where the row of this number is, computed without any table."""
    a = next(x for x in range(max(1, int(total**0.5) - 1), total + 2) if x * x >= total)
    b = -(-total // a)

    def mix(value: int, k: int) -> int:
        first = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
        return xxhash.xxh64_intdigest(struct.pack("<q", seed * ROUNDS + k), first) & 0x7FFFFFFF

    def step(value: int) -> int:
        left, right = divmod(value, b)
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + mix(right, k)) % a
            else:
                right = (right + mix(left, k)) % b
        return left * b + right

    image = reduce(lambda v, _: v if v is not None and v < total else step(row_number if v is None else v), range(WALK + 1), None)
    return image % shards, image // shards


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Contract of ``op1``: sizes, checksums, law ``rows``. Null text: size 16, checksum of no bytes (0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = feistel_shards(narrow, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
