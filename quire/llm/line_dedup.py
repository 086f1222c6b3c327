"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct lower-cased words. A line is removed if an earlier one, by (doc_id, line number), has
a Jaccard similarity of ``percent`` or more; both are taken from the input, not from what is left.

1. Equal lines are found by a 128-bit digest; all but the first go, and only first ones are looked at further.
2. Token frequencies over all documents are counted in ``SLOTS`` hash slots and become levels; a line's tokens are
   ordered by level, then by hash: rare ones first. Any fixed order is exact, a rare-first one is fast.
3. Prefix filter on pairs of neighbours in that order, since single tokens of prose make long lists. Of two lines of a
   and b tokens with o in common, each token that only one has parts at most one pair of common tokens that follow one
   another, so that the first pair that stands in both begins within 2(a-o) + (b-o) places of a's beginning. With the
   least o that reaches ``percent`` this is 2(1 - percent/100) of the line's length. Lines of one token have it as key.
4. Keys are counted. Two or three lines with a key are its candidates straight from the count. Lists of four and more
   are joined: first each line with its list's earliest, and again with the earliest of those left undecided, which
   decides the members of a group of near copies at linear cost; then what is still undecided with every earlier line.
   Candidates must pass the length filter, the positional filter of step 3 and a bitmap filter (half of the tokens set
   one of 128 bits each; more differing bits than the two sets may differ by rule a pair out).
5. Candidates are verified on the lines' whole token sets (words as 64-bit hashes).

Everything is DataFrame expressions; the level table, SLOTS small numbers whatever the corpus holds, stands in the plan
as one constant array.

Defined results: null and empty texts have one empty line; lines without words are never removed and remove nothing;
rows of null doc_id are left alone; rows that share a doc_id are taken for one document (repeated rows, however many,
lose the same lines, and none because of each other); ties can't arise, as (doc_id, line number) is a total order;
texts and lines of any length are read whole; an empty table gives an empty one; other columns are carried or ignored,
whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, one_row_each, staged

SLOTS = 1 << 18
#: Line numbers, ids and keys are broadcast up to this many rows; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Least similarity for which the prefix of pairs is proven (tests/llm/test_line_dedup.py counts all small cases).
LEAST_PERCENT = 70
#: Classes of length to a factor of two.
LENGTHS = 16
#: Lists of so many lines are crowded: their lines meet leaders first, ``TURNS`` times more if they stay undecided.
CROWD, TURNS = 16, 2


def _few(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _words(line: Column) -> Column:
    """Words of a line. Splitting at one character is several times as fast as at a class, so that other white space
    becomes a space first, where there is any."""
    low = F.lower(line)
    one = F.when(low.rlike(r"[\x09-\x0D]"), F.regexp_replace(low, r"[\x09-\x0D]", " ")).otherwise(low)
    return F.array_remove(F.split(one, " "), "")


def _hashes(line: Column) -> Column:
    return F.transform(_words(line), lambda w: F.xxhash64(w))


def _levels(docs: DataFrame) -> Column:
    """A constant array: for each slot the frequency of its tokens, eight levels to a factor of two, eight slots to a
    long."""
    words = docs.select(F.explode(_words(F.col("text"))).alias("w"))
    slots = words.select(F.xxhash64("w").bitwiseAND(SLOTS - 1).cast("int").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    known = slots.select(F.expr("s div 1024").alias("part"), F.concat_ws(":", "s", F.least(F.lit(255), F.floor(8 * F.log2(F.col("n") + 1)))).alias("e"))
    table = bytearray(SLOTS)
    for r in known.groupBy("part").agg(F.array_join(F.collect_list("e"), ",").alias("e")).collect():  # SLOTS short entries at most
        for e in r["e"].split(","):
            slot, level = e.split(":")
            table[int(slot)] = int(level)
    return F.split(F.lit(",".join(map(str, memoryview(table).cast("q")))), ",").cast("array<long>")


def _level(levels: Column, h: Column) -> Column:
    slot = h.bitwiseAND(SLOTS - 1).cast("int")
    eight = F.coalesce(F.get(levels, F.shiftright(slot, 3)), F.lit(0).cast("long"))
    return F.call_function("shiftright", eight, F.call_function("shiftleft", slot.bitwiseAND(7), F.lit(3))).bitwiseAND(255)


def _worded(docs: DataFrame) -> DataFrame:
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _place() -> Column:
    return (F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("ln").cast("decimal(12,0)")).cast("decimal(38,0)")


def _later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, ln) of every line that an earlier one equals."""
    every = staged(_worded(docs).select("doc_id", "ln", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    same = staged(every.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("d")).where("m > 1").drop("m"))
    copies = staged(every.join(_few(same), ["h1", "h2"]))
    first = copies.where("doc_id = d").groupBy("h1", "h2").agg(F.min("ln").alias("l"))
    return staged(copies.join(first, ["h1", "h2"]).where("doc_id <> d or ln <> l").select("doc_id", "ln").distinct())


def _bits(half: int) -> Column:
    """One half of a line's odd sketch, as a long: each token of array t turns one of 128 bits over. Of two lines, what
    they share cancels out, so that no more bits differ than tokens do."""
    one = lambda x: F.when(x.bitwiseAND(64) == half, F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(one(x)))


def _prefix_length(n: Column, percent: int) -> Column:
    """Pairs in the prefix of a line of n tokens, if it has as many."""
    return (2 * (100 - percent) * n / 100).cast("int") + 1


def _prefixes(lines: DataFrame, levels: Column, percent: int) -> DataFrame:
    """For each line: id (its last byte: the class of its length), at (its place), n (tokens), bits and more (its sketch), t (its rarest tokens, rare first)."""
    mask = F.lit((1 << 48) - 1)
    keyed = F.transform(_hashes(F.col("line")), lambda h: F.shiftleft(_level(levels, h), 48).bitwiseOR(h.bitwiseAND(mask)))
    sets = lines.select(_place().alias("at"), F.sort_array(F.array_distinct(keyed)).alias("t")).withColumn("n", F.size("t"))
    short = F.slice("t", F.lit(1), _prefix_length(F.col("n"), percent) + 1)
    number = F.shiftleft(F.monotonically_increasing_id(), 8).bitwiseOR(F.least(F.lit(255), F.floor(LENGTHS * F.log2("n"))).cast("long"))
    return sets.select(number.alias("id"), "at", "n", _bits(0).alias("bits"), _bits(64).alias("more"), short.alias("t"))


def _keys(lines: DataFrame, percent: int, *carried: str) -> DataFrame:
    """Keys k of each line, with their place i: pairs of neighbours of the prefix, or the only token. v: the token before
    the pair (none: 0)."""
    length = F.greatest(F.lit(1), F.least(_prefix_length(F.col("n"), percent), F.col("n") - 1))
    rows = lines.select(*carried, "n", "t", F.posexplode(F.slice("t", F.lit(1), length)).alias("i", "x"))
    near = lambda step: F.coalesce(F.get("t", F.col("i") + step), F.lit(0).cast("long"))
    return rows.select(*carried, "n", "i", F.xxhash64("x", near(1)).alias("k"), F.when(F.col("i") > 0, near(-1)).otherwise(F.lit(0).cast("long")).alias("v"))


def _alike(percent: int) -> Column:
    """Length and sketch filters for two lines; columns of the sides end in _a and _b."""
    na, nb = F.col("n_a"), F.col("n_b")
    apart = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) + F.bit_count(F.col("more_a").bitwiseXOR(F.col("more_b")))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def _placed(percent: int) -> Column:
    """Positional filter: where the first pair that stands in both lines may stand in each."""
    na, nb, ia, ib = (F.col(c) for c in ("n_a", "n_b", "i_a", "i_b"))
    far = lambda i, n, m: (100 + percent) * i <= (200 - percent) * n + (100 - 2 * percent) * m
    return far(ia, na, nb) & far(ib, nb, na) & ((100 + percent) * (ia + ib) <= 3 * (100 - percent) * (na + nb))


SKETCH = ("at", "n", "bits", "more")


def _side(df: DataFrame, end: str, *names: str) -> list[Column]:
    return [df[c].alias(f"{c}_{end}") for c in names]


def _of_counts(counts: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among keys of two or three lines. ``counts``: m, least, most and exclusive or of the ids of a key,
    which gives the third of three whatever the ids are, where a sum would overflow."""
    third = F.col("mixed").bitwiseXOR(F.col("least")).bitwiseXOR(F.col("most"))
    two = lambda x, y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    all_pairs = F.when(F.col("m") == 2, F.array(two(F.col("least"), F.col("most")))).otherwise(
        F.array(two(F.col("least"), F.col("most")), two(F.col("least"), third), two(third, F.col("most")))
    )
    apart = F.abs(F.col("x").bitwiseAND(255) - F.col("y").bitwiseAND(255))  # of lengths a factor of 100 / percent apart at most
    pairs = counts.where("m between 2 and 3").select(F.explode(all_pairs).alias("p")).select("p.x", "p.y")
    pairs = pairs.where((F.col("x") != F.col("y")) & (apart <= ceil(LENGTHS * log2(100 / percent)) + 1)).distinct()
    sketch = lines.select("id", *SKETCH)
    left = sketch.select(sketch["id"].alias("x"), *_side(sketch, "a", *SKETCH))
    right = sketch.select(sketch["id"].alias("y"), *_side(sketch, "b", *SKETCH))
    met = pairs.join(left, "x").join(right, "y").where(_alike(percent)).where("at_a <> at_b")
    return met.select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b"))


def _of_leaders(left: DataFrame, rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Candidates (a, b): each of ``left`` with the earliest of its list; from the second turn on with the earliest of
    its part of the list, which is dealt anew into about sqrt(m) parts for each key and turn, so that a line meets
    another of its group at almost each of its keys."""
    salt = F.pmod(F.xxhash64("at", "k", F.lit(turn)), F.ceil(F.sqrt("m"))) if turn else F.lit(0).cast("long")
    rows, left = rows.withColumn("s", salt), left.withColumn("s", salt)
    top = rows.groupBy("k", "s").agg(F.min(F.struct("at", "n", "i", "bits", "more")).alias("top"))
    top = top.select("k", "s", *[F.col(f"top.{c}").alias(f"{c}_a") for c in ("at", "n", "i", "bits", "more")])
    own = left.select("k", "s", *_side(left, "b", "at", "n", "i", "bits", "more"))
    met = own.join(top, ["k", "s"]).where("at_a < at_b").where(_placed(percent) & _alike(percent))
    return met.select(F.col("at_a").alias("a"), F.col("at_b").alias("b")).distinct()


def _similar(lines: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Places b of the lines that an earlier one resembles."""
    keys = _keys(lines, percent, "id")
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least"), F.max("id").alias("most"), F.bit_xor("id").alias("mixed"))
    counts = staged(counts.where("m > 1"))
    many = _few(staged(counts.where("m > 3").select("k", "m")))
    rows = staged(_keys(lines, percent, *(c for c in SKETCH if c != "n")).join(many, "k"))
    crowded = rows.where(F.col("m") >= CROWD)
    first = _of_counts(counts, lines, percent).unionByName(_of_leaders(crowded, crowded, 0, percent)).distinct()
    decided = _few(_verified(staged(first), docs, percent))
    for turn in range(1, TURNS + 1):
        left = crowded.join(decided.withColumnRenamed("b", "at"), "at", "left_anti")
        pairs = staged(_of_leaders(left, crowded, turn, percent))
        if pairs.isEmpty():
            break
        decided = _few(staged(decided.unionByName(_verified(pairs, docs, percent)).distinct()))
    left = crowded.join(decided.withColumnRenamed("b", "at"), "at", "left_anti")
    small = rows.where(F.col("m") < CROWD)
    pairs = _within(small, small, percent).unionByName(_within(left, crowded, percent)).distinct()
    return decided.unionByName(_verified(staged(pairs), docs, percent)).distinct()


def _within(left: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b): each of ``left`` with every earlier row of its list."""
    own = left.select("k", *_side(left, "b", "at", "n", "i", "bits", "more", "v"))
    every = rows.select(F.col("k").alias("key"), *_side(rows, "a", "at", "n", "i", "bits", "more", "v"))
    # of keys that follow one another in both lines the first is enough
    begins = (F.col("v_a") != F.col("v_b")) | (F.col("i_a") == 0) | (F.col("i_b") == 0)
    met = own.join(every, (F.col("k") == F.col("key")) & (F.col("at_a") < F.col("at_b")) & _placed(percent) & begins & _alike(percent))
    return met.select(F.col("at_a").alias("a"), F.col("at_b").alias("b"))


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of places, each b with a similar a."""
    base = F.lit(1 << 31).cast("decimal(12,0)")
    doc = lambda c: F.floor(F.col(c) / base).cast("long")
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct().withColumn("d", doc("at")))
    count = wanted.count()
    numbers = wanted.groupBy("d").agg(F.collect_list((F.col("at") - F.col("d") * base).cast("int")).alias("wanted"))
    numbers = F.broadcast(numbers) if count <= BROADCAST_ROWS else numbers
    found = docs.where("doc_id is not null and text is not null").join(numbers, F.col("doc_id") == F.col("d"))
    picked = F.element_at(F.transform(F.array(F.split("text", "\n")), lambda x: F.transform("wanted", lambda i: F.struct(i.alias("ln"), F.get(x, i).alias("line")))), 1)
    lines = found.select("doc_id", F.explode(picked).alias("p")).select("doc_id", "p.ln", "p.line")
    sets = staged(lines.select(_place().alias("at"), F.array_distinct(_hashes(F.col("line"))).alias("w")))
    left = sets.select(F.col("at").alias("a"), F.col("w").alias("wa"))
    right = sets.select(F.col("at").alias("b"), F.col("w").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("wa", "wb")))
    near = both.where(100 * F.col("both") >= percent * (F.size("wa") + F.size("wb") - F.col("both")))
    return staged(near.select("b").distinct())


def _removed(docs: DataFrame, percent: int) -> DataFrame:
    """(d, gone): for each document that loses lines, their numbers. ``docs``: doc_id long, text string."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    docs = one_row_each(docs)
    later = _later_copies(docs)
    first = _worded(docs).join(_few(later), ["doc_id", "ln"], "left_anti")
    lines = staged(_prefixes(first, _levels(docs), percent))
    base = F.lit(1 << 31).cast("decimal(12,0)")
    doc = F.floor(F.col("b") / base).cast("long")
    near = _similar(lines, docs, percent).select(doc.alias("doc_id"), (F.col("b") - doc * base).cast("int").alias("ln"))
    return later.unionByName(near).groupBy(F.col("doc_id").alias("d")).agg(F.collect_set("ln").alias("gone"))


def _with_removals(docs: DataFrame, percent: int) -> tuple[DataFrame, Column, Column]:
    """``docs`` with three more columns, and those: the lines of each text that remain (null text: null) and whether
    any was removed."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key, gone, kept = fresh(docs, "key"), fresh(docs, "gone"), fresh(docs, "kept")
    found = staged(_removed(narrow, percent)).toDF(key, gone)
    size = found.agg(F.coalesce(F.sum(F.size(gone) + 4), F.lit(0)).alias("n")).first()["n"]
    found = F.broadcast(found) if size <= 4 * BROADCAST_ROWS else found
    joined = docs.join(found, docs["doc_id"].cast("long") == F.col(key), "left")
    sieve = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    joined = joined.withColumn(kept, F.when(F.col(key).isNull(), F.split(docs["text"], "\n")).otherwise(sieve))
    return joined, F.col(kept), F.col(key).isNotNull()


def report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Query ``op8``: doc_id, n_lines, n_removed and the SHA-256 of the lines that remain, joined by newlines."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found, kept, _ = _with_removals(docs, percent)
    lines = F.size(F.split("text", "\n"))
    return found.select("doc_id", lines.cast("long").alias("n_lines"), (lines - F.size(kept)).cast("long").alias("n_removed"), F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the repeated lines; every other column as it was, but that ``n_chars``, if there, counts the new
    text. A document that lost lines and has no word left goes: all it said stands elsewhere."""
    found, kept, lost = _with_removals(docs, percent)
    text = F.when(lost, F.array_join(kept, "\n")).otherwise(F.col("text"))
    found = found.where(~lost | text.rlike(r"[^\x20\x09-\x0D]"))
    columns = [text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(columns)
