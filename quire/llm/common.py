"""What several operators of this subpackage share: table paths, scale from the plan, shared storage."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    k = 0
    while (out := f"__{name}_{k}".lower()) in taken:
        k += 1
    return out


def input_bytes(df: DataFrame) -> int | None:
    """Bytes that the plan's own statistics give for ``df``, which reads no data; None where it has none. No more than all
    that the plan reads: the estimate for a join is the product of its sides."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    size = min(read, int(str(plan.stats().sizeInBytes())))
    return size if size < 1 << 57 else None


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Number of shuffle partitions that keeps each near ``bytes_each`` of ``df``'s stored bytes, and no fewer than the
    session's own number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return least if size is None else max(least, -(-size // bytes_each))


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of an int column (Murmur3, seed 42)."""
    u = np.uint32
    turn = lambda v, n: (v << u(n)) | (v >> u(32 - n))
    k = turn(x.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593)
    h = turn(u(42) ^ k, 13) * u(5) + u(0xE6546B64)
    h = h ^ u(4)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).astype(np.int32)


def even_keys(parts: int) -> np.ndarray:
    """Ints of which ``repartition(parts, key)`` deals one to each partition: key k goes to partition k."""
    out, missing, lo = np.full(parts, -1, np.int64), parts, 0
    while missing:
        x = np.arange(lo, lo + 4 * parts + 64)
        to = _spark_hash(x).astype(np.int64) % parts
        place, first = np.unique(to, return_index=True)
        new = out[place] < 0
        out[place[new]] = x[first[new]]
        missing, lo = int((out < 0).sum()), lo + len(x)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; one of our own only where none is set and all runs on one machine,
    as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not top:
        top = "/tmp/quire-checkpoints"
    return f"{top.rstrip('/')}/quire-{uuid.uuid4().hex}"


#: While a step is written: shuffle files go when the statement ends, not when the driver next collects garbage, and the
#: text of plans that hold a constant table is cut in logs.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "20000"}
#: So many steps after the last time the driver is told to collect garbage, which lets Spark drop old broadcasts.
COLLECT_AFTER = 12
_steps = 0


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to shared storage and read back: lineage is cut, lost executors lose nothing, and what
    the step shuffled is dropped."""
    global _steps
    spark = df.sparkSession
    path = shared_dir(spark)
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    _steps += 1
    if _steps % COLLECT_AFTER == 0:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Ids are broadcast up to this many; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def one_row_each(docs: DataFrame) -> DataFrame:
    """``docs`` with equal rows once. Only documents whose id stands in several rows are shuffled."""
    several = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    count = several.count()
    if not count:
        return docs
    several = F.broadcast(several) if count <= BROADCAST_IDS else several
    return docs.join(several, "doc_id", "left_anti").unionByName(docs.join(several, "doc_id", "left_semi").distinct())
