"""The catalogue of operators that are one SQL definition each."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCKDB, SPARK, Dialect
from ..sources.derived import DEAL, prefixed, with_clause

BASE_TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "events", "embeddings", "lineitem", "orders", "customer", "supplier", "part", "nation", "region")


def over(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A statement over frames by name. The frames stand in views of names of their own, which only common table expressions
    of the statement see and which go once it is analysed, so that neither the session's views nor other threads' are met."""
    views = {name: f"quire_{uuid.uuid4().hex}" for name in tables}
    for name, frame in tables.items():
        frame.createOrReplaceTempView(views[name])
    try:
        return spark.sql(prefixed(text, [f"{name} AS (SELECT * FROM {view})" for name, view in views.items()]))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


#: Bytes of a file of documents to a part of the deal: sixty times as much, what glyphs take, is sorted in a task's memory.
PART = 1 << 21


def parts(spark: SparkSession, documents: DataFrame) -> int:
    """Parts that documents are dealt into: by their size, and no fewer than the session's own number."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(-(-size // PART), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealing(spark: SparkSession) -> SparkSession:
    """A session of its own with the caller's settings, in which a join by document and page or unit keeps to a deal by document;
    the caller's session is left as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def over_files(spark: SparkSession, text: str, sf_dir: str) -> DataFrame:
    """A statement over those of the driver's tables that it names."""
    spark = dealing(spark) if DEAL in text else spark
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES if re.search(rf"\b{t}\b", text)}
    if DEAL in text:
        text = text.replace(DEAL, DEAL.replace("(", f"({parts(spark, tables['documents'])}, "))
    return over(spark, text, tables)


@dataclass(frozen=True)
class Operator:
    name: str
    doc: str
    body: Callable[[Dialect], str]

    def sql(self, d: Dialect) -> str:
        """The whole statement over the driver's base tables."""
        return with_clause(d, self.body(d))

    def on(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        """The operator on the caller's own tables: each table that its definition names is taken from ``tables``."""
        return over(spark, self.body(SPARK), tables)

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return over_files(spark, self.sql(SPARK), sf_dir)

    def oracle(self) -> str:
        return self.sql(DUCKDB)


CATALOG: dict[str, Operator] = {}


def operator(name: str) -> Callable[[Callable[[Dialect], str]], Operator]:
    def add(f: Callable[[Dialect], str]) -> Operator:
        if name in CATALOG:
            raise ValueError(f"{name} is defined twice")
        CATALOG[name] = Operator(name, (f.__doc__ or "").strip(), f)
        return CATALOG[name]

    return add


def simple(name: str, doc: str, body: str | Callable[[Dialect], str]) -> Operator:
    """An operator whose text is the same for every engine, or needs one expression only."""

    def f(d: Dialect) -> str:
        return body(d) if callable(body) else body

    f.__doc__ = doc
    return operator(name)(f)
