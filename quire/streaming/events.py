"""Streams over event logs, translation chunks and page arrivals.

Every function takes a streaming frame and gives one; ``drain`` runs a stream over what its source holds now, through
a checkpointed sink in shared storage, and gives the result as a table. Restarting from the same checkpoint goes on
where the last run ended, which is the persisted cursor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files


def _folder(spark: SparkSession) -> str:
    return files.shared_folder(spark, "stream")


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """The stream's output over all that is there, appended to ``folder``; run again with the same folder to go on."""
    spark = stream.sparkSession
    folder = folder or _folder(spark)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    folder, _, last = batch.inputFiles()[0].rpartition("/")
    if last == f"{name}.parquet":
        return spark.readStream.schema(batch.schema).option("pathGlobFilter", last).parquet(folder)
    return spark.readStream.schema(batch.schema).parquet(folder)


def tail(events: DataFrame, after: int, stage: str | None = None) -> DataFrame:
    """Events after a cursor, of one stage if given."""
    out = events.where(F.col("event_id") > after)
    return out.where(F.col("event_type") == stage) if stage else out


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, whatever reconnects repeat."""
    return events.dropDuplicates(keys)


MARK = re.compile(r"<!-- id=(\S+) -->")


def assemble_blocks(chunks: DataFrame) -> DataFrame:
    """Chunks (document, place, text) to whole blocks (document, block, body): a block closes where the next marker
    comes, or at a chunk whose text is null (the end); of one id the first block counts."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, seen = state.get if state.exists else ("", "")
        known = set(filter(None, seen.split("\n")))
        out = []
        for r in pd.concat(parts).sort_values("place").itertuples():
            end = r.text is None
            buffer += "" if end else r.text
            marks = list(MARK.finditer(buffer))
            closed = marks if end else marks[:-1]
            for k, m in enumerate(closed):
                stop = marks[k + 1].start() if k + 1 < len(marks) else len(buffer)
                if m[1] not in known:
                    known.add(m[1])
                    out.append((key[0], m[1], buffer[m.end() : stop].strip()))
            if closed:
                buffer = "" if end else buffer[marks[len(closed)].start() :]
        state.update((buffer, "\n".join(sorted(known))))
        yield pd.DataFrame(out, columns=["document", "block", "body"])

    return chunks.groupBy("document").applyInPandasWithState(step, "document long, block string, body string", "buffer string, seen string", "append", GroupStateTimeout.NoTimeout)


def page_readiness(arrivals: DataFrame) -> DataFrame:
    """Arrivals (document, page, unit, expected) to ready pages, each once: all expected units are there, or the run has
    ended (an arrival of page -1)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        held = json.loads(state.get[0]) if state.exists else {"units": {}, "expected": {}, "ready": []}
        out = []
        for r in pd.concat(parts).sort_values(["page", "unit"], key=lambda c: c if c.name == "unit" else c.replace(-1, 1 << 40)).itertuples():
            if r.page < 0:
                for p in sorted(set(held["expected"]) - set(held["ready"]), key=int):
                    held["ready"].append(p)
                    out.append((key[0], int(p), len(held["units"][p]), True))
                continue
            p = str(r.page)
            mine = held["units"].setdefault(p, [])
            held["expected"][p] = int(r.expected)
            if int(r.unit) not in mine:
                mine.append(int(r.unit))
            if len(mine) >= r.expected and p not in held["ready"]:
                held["ready"].append(p)
                out.append((key[0], int(r.page), len(mine), False))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["document", "page", "units", "forced"])

    return arrivals.groupBy("document").applyInPandasWithState(step, "document long, page long, units long, forced boolean", "held string", "append", GroupStateTimeout.NoTimeout)


def latest_only(stream: DataFrame, key: str, order: str, folder: str | None = None) -> DataFrame:
    """Coalescing sink: each batch keeps the latest row a key, merged with the table of the batch before.

    The table of batch n is folder/latest-n, made from batch n's rows and latest-(n-1), so that a restart from the same
    folder goes on with what is there and a batch that is run again gives the same table. Only the last two are kept. A
    source without rows gives an empty table.
    """
    spark = stream.sparkSession
    folder = folder or _folder(spark)
    fs, make = files.storage(spark, folder)

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{folder}/latest-{number - 1}"
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(before)) if number and fs.exists(make(before)) else batch
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{folder}/latest-{number}")
        fs.delete(make(f"{folder}/latest-{number - 2}"), True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = fs.globStatus(make(f"{folder}/latest-*/_SUCCESS")) or []
    last = max((int(s.getPath().getParent().getName().rpartition("-")[2]) for s in found), default=None)
    return spark.createDataFrame([], stream.schema) if last is None else spark.read.schema(stream.schema).parquet(f"{folder}/latest-{last}")


# Queries over the driver's tables ------------------------------------------------------------------------------


def stm01_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(tail(table_stream(spark, sf_dir, "events"), 1000, "error")).select("event_id", "user_id", "event_type")


def stm02_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tail run twice from one checkpoint: the second run finds the cursor at the end and adds nothing."""
    folder = _folder(spark)
    for _ in range(2):
        out = drain(tail(table_stream(spark, sf_dir, "events"), 500), folder)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("cursor_at"))


def stm08_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table_stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return drain(once(events.unionByName(events), ["user_id", "event_id"]))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table_stream(spark, sf_dir, "conversations")
    text = F.concat(F.lit("<!-- id="), F.col("role"), F.col("turn").cast("string"), F.lit(" -->"), F.col("text"))
    body = turns.select(F.col("conv_id").alias("document"), F.col("turn").alias("place"), text.alias("text"))
    ends = turns.where("turn = 0").select(F.col("conv_id").alias("document"), F.lit(1 << 40).cast("long").alias("place"), F.lit(None).cast("string").alias("text"))
    return body.unionByName(ends)


def stm04_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(assemble_blocks(_chunks(spark, sf_dir)))


def stm05_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table_stream(spark, sf_dir, "conversations")
    units = turns.select(F.col("conv_id").alias("document"), F.expr("turn div 2").alias("page"), F.col("turn").alias("unit"), F.lit(2).alias("expected"))
    ends = turns.where("turn = 0").select(F.col("conv_id").alias("document"), F.lit(-1).cast("long").alias("page"), F.lit(0).cast("long").alias("unit"), F.lit(0).alias("expected"))
    return drain(page_readiness(units.unionByName(ends)))


def stm07_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_only(table_stream(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


QUERIES = {"stm01_tail": stm01_tail, "stm02_cursor": stm02_cursor, "stm04_block_assembly": stm04_blocks, "stm05_page_readiness": stm05_pages, "stm07_latest_only": stm07_latest, "stm08_once": stm08_once}

ORACLE = {
    "stm02_cursor": "SELECT user_id, count(*) AS events, max(event_id) AS cursor_at FROM events WHERE event_id > 500 GROUP BY user_id",
    "stm01_tail": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 1000 AND event_type = 'error'",
    "stm04_block_assembly": "SELECT conv_id AS document, role || CAST(turn AS VARCHAR) AS block, trim(text) AS body FROM conversations",
    "stm05_page_readiness": "SELECT conv_id AS document, turn // 2 AS page, count(*) AS units, count(*) < 2 AS forced FROM conversations GROUP BY conv_id, turn // 2",
    "stm07_latest_only": "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations GROUP BY conv_id",
    "stm08_once": "SELECT user_id, event_id, event_type FROM events",
}
