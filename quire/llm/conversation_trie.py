"""The prefix trie of rebuilt conversations, its totals by leaf-peeling message passing.

1. Rows are put in global order by ranges of (conversation, turn, role, text), and numbered within their conversation from
   counts of blocks, so that no conversation need fit a task.
2. A conversation is rebuilt by joining it with the first turns (five at most) of the one it borrows from.
3. A prefix is named by the exclusive or of 2 x 64-bit hashes of (depth, role and text) of its turns: a running one, again
   block by block. Equal names are taken for equal prefixes. Grouping by name gives the trie's nodes.
4. A node belongs to the path of its longest member (of several: the one with the smallest id). Below a node that member
   goes on to a leaf, so that paths are vertical, end in leaves and have one top each; chains are never peeled node by node.
5. Peeling: a path holds a counter of the paths that hang from its nodes. Paths whose counter is nought are complete and
   send their totals (leaves, saved tokens) to the path they hang from, summed before the shuffle; counters go down; rounds
   go on until the root's path is complete. With paths there are as many rounds as a way from root to leaf changes paths:
   a few in practice, and of the order of the square root of the nodes at worst.
6. Totals that arrived at the nodes of a path are summed from its leaf up, block by block.

Defined results: null role or text counts as empty; rows of null conv_id are left out; rows of one turn follow each other
by role, then by text (its first 200 characters, then its hash), and repeated rows stand one after the other, each a turn
of its own; ids below nought borrow from the next lower multiple of 100; an empty table has no node, not even a root;
texts of any length are hashed whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .ordered_runs import BLOCK, hashed_streams, in_order, listed, totals_before, turn_order

#: Fixed values of the rebuilding rule: ids are grouped by so many, and up to MOST_BORROWED turns are borrowed.
FAMILY, MOST_BORROWED = 100, 5
NOTHING = hashlib.sha256().hexdigest()
NAME = ("n1", "n2")


def _none() -> Column:
    return F.lit(0).cast("long")


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, pos, k (place from 1), a and b (hashes of role and text), len (code points), n (turns of the conversation)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "role", "text"), "len": F.length("text").cast("long")})
    turns = in_order(rows, turn_order("text"), "conv_id", "a", "b", "len").withColumn("x", F.lit(1).cast("long"))
    before = totals_before(turns, ["conv_id"], "part", F.sum("x"), _none())
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("pos"))
    numbered = turns.withColumn("here", here).join(before, ["conv_id", "part"]).join(size, "conv_id")
    return staged(numbered.select("conv_id", "part", "pos", (F.col("before") + F.col("here")).alias("k"), "a", "b", "len", "n"))


def _turn_name(d: Column, a: Column, b: Column) -> tuple[Column, Column]:
    return F.xxhash64(d.cast("long"), a, b), F.xxhash64(F.lit(1), d.cast("long"), a, b)


def _rebuilt(turns: DataFrame, borrowed: Column) -> tuple[DataFrame, DataFrame]:
    """Members (c, d, n1, n2, p1, p2, len, total): each rebuilt conversation with each of its prefixes, and the
    conversations themselves. n: name of the prefix, p: of its last turn; total: turns of the conversation."""
    firsts = turns.where("k = 1").select("conv_id", "n", borrowed.cast("long").alias("h"), (F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))).alias("base"))
    p1, p2 = _turn_name(F.col("k"), F.col("a"), F.col("b"))
    heads = turns.where(F.col("k") <= MOST_BORROWED).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("k", p1.alias("p1"), p2.alias("p2"), "len"))).alias("head"))  # MOST_BORROWED entries at most
    own = firsts.join(heads, "base", "left").withColumn("head", F.filter(F.coalesce("head", F.array()), lambda x: x["k"] <= F.col("h")))
    all_of = lambda p: F.aggregate("head", _none(), lambda acc, x: acc.bitwiseXOR(x[p]))
    own = own.withColumns({"nb": F.size("head").cast("long"), "x1": all_of("p1"), "x2": all_of("p2")})
    own = staged(own.withColumn("total", F.col("nb") + F.greatest(F.col("n") - F.col("h"), _none())))
    upto = lambda p: F.aggregate(F.slice("head", 1, F.col("i") + 1), _none(), lambda acc, x: acc.bitwiseXOR(x[p]))
    lent = own.select("conv_id", "total", "head", F.posexplode("head").alias("i", "e"))
    lent = lent.select(F.col("conv_id").alias("c"), F.col("e.k").alias("d"), upto("p1").alias("n1"), upto("p2").alias("n2"), F.col("e.p1").alias("p1"), F.col("e.p2").alias("p2"), F.col("e.len").alias("len"), "total")
    rest = turns.drop("n").join(own.select("conv_id", "h", "nb", "x1", "x2", "total"), "conv_id").where("k > h").withColumn("d", F.col("nb") + F.col("k") - F.col("h"))
    p1, p2 = _turn_name(F.col("d"), F.col("a"), F.col("b"))
    rest = staged(rest.withColumns({"p1": p1, "p2": p2}).drop("a", "b", "k", "nb", "h"))
    for p, x, n in (("p1", "x1", "n1"), ("p2", "x2", "n2")):
        before = totals_before(rest.withColumn("x", F.col(p)), ["conv_id"], "part", F.bit_xor("x"), _none())
        here = F.bit_xor(p).over(Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        rest = rest.withColumn(n, here).join(before, ["conv_id", "part"]).withColumn(n, F.col(n).bitwiseXOR(F.col("before")).bitwiseXOR(F.col(x))).drop("before")
    names = ["c", "d", "n1", "n2", "p1", "p2", "len", "total"]
    root = own.select(F.col("conv_id").alias("c"), *[_none().alias(x) for x in names[1:-1]], "total")
    return staged(root.unionByName(lent.select(names)).unionByName(rest.withColumnRenamed("conv_id", "c").select(names))), own


def _nodes(members: DataFrame) -> DataFrame:
    """d, n1, n2, u1, u2 (name of the parent), conv_id, n_convs, own (tokens that this node alone saves), path, n_children,
    parent_conv_id, parent_path."""
    longest = F.max(F.struct("total", (-F.col("c")).alias("c")))
    by_name = members.groupBy("d", *NAME).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("len").alias("len"), longest.alias("longest"))
    parent = [F.col(n).bitwiseXOR(F.col(p)).alias(u) for n, p, u in (("n1", "p1", "u1"), ("n2", "p2", "u2"))]
    nodes = staged(by_name.select("d", *NAME, *parent, "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("len")).alias("own"), (-F.col("longest.c")).alias("path")))
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("u1").alias("n1"), F.col("u2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("n1").alias("u1"), F.col("n2").alias("u2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    counted = nodes.join(children, ["d", *NAME], "left").withColumn("n_children", F.coalesce("n_children", _none()))
    return staged(counted.join(above, ["d", "u1", "u2"], "left"))


def _peeled(nodes: DataFrame) -> DataFrame | None:
    """(path, d, leaves, saved): what the paths that hang from a node sent to it. None if there is no node."""
    own = nodes.groupBy("path").agg(F.sum("own").alias("saved"))
    tops = nodes.where("parent_path is null or parent_path <> path").select("path", "parent_path", (F.col("d") - 1).alias("d"))
    hanging = tops.where("parent_path is not null").groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("waits"))
    waiting = tops.join(own, "path").join(hanging, "path", "left").select("path", "parent_path", "d", F.lit(1).cast("long").alias("leaves"), "saved", F.coalesce("waits", _none()).alias("waits"))
    waiting, sent = staged(waiting), []
    while True:
        complete = staged(waiting.where("waits = 0").drop("waits"))
        seen = complete.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("parent_path").isNull()).alias("root")).first()
        if not seen["n"]:
            if sent:
                raise RuntimeError("a path waits for one that does not exist")
            return None
        sent.append(complete)
        if seen["root"]:
            break
        messages = complete.groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        told = waiting.where("waits > 0").join(messages, "path", "left").na.fill(0, ["n", "l", "s"])
        waiting = staged(told.select("path", "parent_path", "d", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"), (F.col("waits") - F.col("n")).alias("waits")))
    arrived = reduce(DataFrame.unionByName, sent).where("parent_path is not null")
    return arrived.groupBy(F.col("parent_path").alias("path"), "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def trie(conversations: DataFrame, borrowed: Column | None = None) -> DataFrame:
    """Contract of ``op12``. ``borrowed``: turns that a conversation borrows, from nought to five, as an expression over
    conv_id (by default the contract's; ``F.lit(0)`` takes every conversation as it is)."""
    if borrowed is None:
        borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)
    members, _ = _rebuilt(_numbered(conversations), borrowed)
    nodes = _nodes(members)
    arrived = _peeled(nodes)
    if arrived is None:
        return _result(nodes.withColumns({"n_leaves": _none(), "saved_tokens": _none(), "sha256": F.lit("")}))
    here = nodes.join(arrived, ["path", "d"], "left").na.fill(0, ["leaves", "saved"])
    here = here.withColumns({"leaves": F.col("leaves") + (F.col("n_children") == 0).cast("long"), "saved": F.col("saved") + F.col("own"), "block": F.expr(f"d div {BLOCK}")})
    here = staged(here.select("d", *NAME, "conv_id", "parent_conv_id", "n_convs", "n_children", "path", "block", "leaves", "saved"))
    up = Window.partitionBy("path", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    summed = here
    for c, to in (("leaves", "n_leaves"), ("saved", "saved_tokens")):
        below = totals_before(here.withColumn("x", F.col(c)), ["path"], "block", F.sum("x"), _none(), backwards=True)
        summed = summed.withColumn(to, F.sum(c).over(up)).join(below, ["path", "block"]).withColumn(to, F.col(to) + F.col("before")).drop("before")
    ends = members.where("d = total").select("d", *NAME, "c")
    digests = hashed_streams(listed(ends, ["d", *NAME], "c"), ["d", *NAME], ["c"], b",")
    return _result(summed.join(digests, ["d", *NAME], "left"))


def _result(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(NOTHING)).alias("ends_sha256"))
