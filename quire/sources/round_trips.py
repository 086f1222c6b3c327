"""Queries that write a derived table through each sink and read it back through its source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCKDB, SPARK
from ..operators.catalog import over_files
from . import files
from .derived import with_clause


def _folder(spark: SparkSession) -> str:
    return files.shared_folder(spark, "files")


def _table(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    return over_files(spark, with_clause(SPARK, body), sf_dir)


LOG = "SELECT run_id, seq, stage, kind FROM log"
TERMS = "SELECT source, target, lang AS tgt_lng FROM glossary WHERE trim(source) <> ''"
SHEET = "SELECT doc_id, id, label, source FROM units"
#: Documents of one JSON array, which a reader holds whole.
ARRAY_DOCUMENTS = 500
SIZES = "SELECT doc_id, sha, size FROM assets"


def sc01_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, with broken lines among them that the scan skips."""
    path = _folder(spark)
    lines = _table(spark, sf_dir, LOG).select(F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(lines.where("value like '%error%'").select(F.expr("substr(value, 1, 20)").alias("value"))).write.text(path)
    return files.read_jsonl(spark, path, "run_id long, seq long, stage string, kind string")


def sc04_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array a file, written whole."""
    path = _folder(spark)
    rows = _table(spark, sf_dir, SIZES).groupBy(F.floor(F.col("doc_id") / ARRAY_DOCUMENTS).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "sha", "size"))).alias("value"))
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json(spark, path, "doc_id long, sha string, size long")


def sc05_glossary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary through CSV, rows of the target language or none."""
    path = _folder(spark)
    files.write_glossary(_table(spark, sf_dir, TERMS), path)
    return files.read_glossary(spark, path, "zh-CN").select("source", "target")


def sc06_tool_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary CSV with a byte-order mark and notes; a file without the columns is refused."""
    path = _folder(spark)
    terms = _table(spark, sf_dir, TERMS).select(F.col("source").alias("\ufeffsource"), "target", F.lit("n").alias("note"))
    terms.write.option("header", True).option("escape", '"').csv(path)
    return files.read_glossary(spark, path).select("source", "target", "note")


def sc07_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of units as JSON lines, and as one array."""
    lines, array = _folder(spark), _folder(spark)
    units = _table(spark, sf_dir, SHEET)
    units.write.json(lines)
    units.groupBy(F.floor(F.col("doc_id") / ARRAY_DOCUMENTS).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "id", "label", "source"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(array)
    schema = "doc_id long, id string, label string, source string"
    first = files.read_jsonl(spark, lines, schema)
    second = files.read_json(spark, array, schema)
    return first.withColumn("form", F.lit("lines")).unionByName(second.withColumn("form", F.lit("array")))


def sk01_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published twice: readers find the second."""
    path = _folder(spark)
    files.publish(_table(spark, sf_dir, SIZES).where("size < 0"), path)
    files.publish(_table(spark, sf_dir, SIZES), path)
    return spark.read.parquet(path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"sc01_jsonl": sc01_jsonl, "sc04_json": sc04_json, "sc05_glossary_csv": sc05_glossary_csv, "sc06_tool_glossary": sc06_tool_glossary, "sc07_sheet": sc07_sheet, "sk01_publish": sk01_publish}
ORACLE = {"sc01_jsonl": with_clause(DUCKDB, LOG), "sc04_json": with_clause(DUCKDB, SIZES), "sc05_glossary_csv": with_clause(DUCKDB, TERMS.replace("SELECT source, target, lang AS tgt_lng", "SELECT source, target")), "sc06_tool_glossary": with_clause(DUCKDB, TERMS.replace("lang AS tgt_lng", "'n' AS note")), "sc07_sheet": with_clause(DUCKDB, "SELECT doc_id, id, label, source, form FROM units, (SELECT 'lines' AS form UNION ALL SELECT 'array' AS form) f"), "sk01_publish": with_clause(DUCKDB, SIZES)}
