"""Connected components of a link table by alternating large-star and small-star steps, each written to shared storage.

No node's neighbours are ever gathered: a step takes each node's least neighbour (combined before the shuffle) and
joins it back to the links, a join that Spark may split where a node is hot. Depth falls with each pair of steps, so
that their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, steps: int = 60) -> DataFrame:
    """(node, component) for each node with a link; component is the least node reachable. ``links``: columns a, b,
    longs, in any direction, repeated or not; null ends and self links are ignored."""
    now = staged(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(steps):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(small.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    child = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return child.unionByName(child.select(F.col("component").alias("node"), "component").distinct())
