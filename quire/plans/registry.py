"""All queries of the analytics operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import frames, lifecycle, merge, ordered, pairing, protocol, quality, regions, selection, spatial, text, timeline, unit_html  # noqa: F401  (each module adds its operators to the catalogue)
from ..operators.catalog import CATALOG
from ..operators.sequential import FOLDS
from ..sources import provider_layout, round_trips
from ..streaming import events, pages

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["qc02_document_check"].query(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: op.query for name, op in CATALOG.items()} | {name: f.query for name, f in FOLDS.items()} | events.QUERIES | pages.QUERIES | provider_layout.QUERIES | round_trips.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: op.oracle() for name, op in CATALOG.items()} | events.ORACLE | pages.ORACLE | provider_layout.ORACLE | round_trips.ORACLE
