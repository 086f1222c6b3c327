"""Sources and sinks: JSON lines, JSON, glossary CSV, and publishing by swap."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or one of our own where none is set
    and all runs on one machine, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(top or '/tmp/quire-checkpoints').rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def storage(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path``, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that doesn't parse is skipped, as is a last line without an end."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.col("value"))
    return parsed.where(F.col("r").isNotNull() & F.col("value").rlike(r"^\s*\{.*\}\s*$")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document or array a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def charsets(spark: SparkSession, path: str) -> DataFrame:
    """(path, charset) of every file: by the mark it begins with; else UTF-16 where every other byte of its first thousand
    pairs is nearly always nought; else UTF-8 if all of it is valid; else GB18030. Files are looked at where they lie."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = lambda *b: F.substring("content", 1, len(b)) == F.lit(bytes(b))
    pairs = F.hex(F.substring("content", 1, 2000))
    noughts = lambda half: F.size(F.filter(F.sequence(F.lit(half), F.length(pairs) - 1, F.lit(4)), lambda i: F.substr(pairs, i, F.lit(2)) == "00"))
    many = lambda half: (F.length(pairs) >= 8) & (noughts(half) * 8 >= F.length(pairs))
    found = F.when(first(0xFF, 0xFE), "UTF-16LE").when(first(0xFE, 0xFF), "UTF-16BE").when(first(0xEF, 0xBB, 0xBF), "UTF-8").when(many(3), "UTF-16LE").when(many(1), "UTF-16BE")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", found.when(valid, "UTF-8").otherwise("GB18030").alias("charset"))


#: Charsets that Spark's own CSV reader takes.
SPARK_CHARSETS = ("UTF-8", "UTF-16LE", "UTF-16BE")
GLOSSARY_COLUMNS = ("source", "target", "tgt_lng", "note")


def _decoded_csv(files: DataFrame, charset: str) -> DataFrame:
    """Glossaries in a charset that Spark's reader does not know, one file at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                records = list(csv.DictReader(io.StringIO(bytes(content).decode(charset, "replace"), newline="")))
                yield pd.DataFrame([[r.get(c) for c in GLOSSARY_COLUMNS] for r in records], columns=list(GLOSSARY_COLUMNS), dtype=object)

    return files.select("content").mapInPandas(rows, ", ".join(f"{c} string" for c in GLOSSARY_COLUMNS))


def read_glossary(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """Glossary CSVs with a header (source, target and, if there, tgt_lng or note), each in its own charset; rows of another
    language are left out, with case and - or _ alike. Columns that only some files have are null in the others."""
    by_charset: dict[str, list[str]] = {}
    for r in charsets(spark, path).collect():  # names of files, not what they hold
        by_charset.setdefault(r["charset"], []).append(r["path"])
    rows = None
    for charset, paths in sorted(by_charset.items()):
        if charset not in SPARK_CHARSETS:
            part = _decoded_csv(spark.read.format("binaryFile").load(paths), charset)
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            continue
        part = spark.read.option("header", True).option("encoding", charset).option("multiLine", True).option("escape", '"').csv(paths)
        part = part.toDF(*[c.lstrip("\ufeff").strip() for c in part.columns])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise ValueError(f"no glossary at {path}")
    if missing := {"source", "target"} - set(rows.columns):
        raise ValueError(f"glossary lacks {sorted(missing)}")
    if language and "tgt_lng" in rows.columns:
        same = F.lower(F.replace("tgt_lng", F.lit("-"), F.lit("_"))) == language.lower().replace("-", "_")
        rows = rows.where(F.col("tgt_lng").isNull() | same)
    return rows.where(F.trim("source") != "")


def write_glossary(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def publish(df: DataFrame, path: str) -> str:
    """Writes beside ``path``, moves the old table aside, puts the new one in its place and drops the old one. No reader
    ever finds a table half written, and at every moment one whole table is at ``path`` or ``path.old``: ``published``
    reads it, and the next call puts it back where a crash left it aside. One writer at a time."""
    spark = df.sparkSession
    fs, make = storage(spark, path)
    target, aside, fresh = make(path), make(f"{path}.old"), make(f"{path}.{uuid.uuid4().hex}")
    if not fs.exists(target) and fs.exists(aside):
        fs.rename(aside, target)
    df.write.parquet(fresh.toString())
    fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(fresh, target):
        fs.rename(aside, target)
        raise OSError(f"{path} could not be published")
    fs.delete(aside, True)
    return path


def published(spark: SparkSession, path: str) -> DataFrame:
    """The table last published whole at ``path``."""
    fs, make = storage(spark, path)
    return spark.read.parquet(path if fs.exists(make(path)) else f"{path}.old")
