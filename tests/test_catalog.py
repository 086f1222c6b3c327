"""Every catalogued operator: Spark's rows against DuckDB's on the smallest tables."""

import duckdb
import pytest

from quire.operators.catalog import BASE_TABLES, CATALOG
from quire.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(schema):
    """Columns by name, doubles to nine places; nested ones as they are."""
    return ", ".join(f'round("{f.name}", 9) AS "{f.name}"' if str(f.type) in ("double", "float") else f'"{f.name}"' for f in sorted(schema, key=lambda f: f.name))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_agree(spark, duck, name):
    got = registry.queries()[name](spark, SF).toArrow()
    want = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert got.num_rows == want.num_rows
    own = duck.cursor()
    own.register("got", got)
    own.register("want", want)
    mine, theirs = f"SELECT {rounded(got.schema)} FROM got", f"SELECT {rounded(want.schema)} FROM want"
    assert own.execute(f"{mine} EXCEPT ALL {theirs} LIMIT 5").fetchall() == []
    assert own.execute(f"{theirs} EXCEPT ALL {mine} LIMIT 5").fetchall() == []


def test_every_operator_says_what_it_does():
    assert all(op.doc for op in CATALOG.values())


def test_flagship_runs_and_operators_take_own_tables(spark):
    assert registry.flagship(spark, SF).count() > 0
    units = spark.createDataFrame([(1, 1, 1, "P01-001", "text", "A sentence that is long enough to be checked here."), (1, 2, 1, "P01-002", "text", "Also a sentence of some length, which has no target.")], "doc_id long, seq long, page long, id string, label string, source string")
    targets = spark.createDataFrame([(1, 1, "<!-- id -->")], "doc_id long, seq long, target string")
    found = {(r.seq, r.code) for r in CATALOG["qc02_document_check"].on(spark, units=units, targets=targets).collect()}
    assert found == {(1, "low_cjk"), (1, "markdown_comment_leak"), (1, "sentence_end_mismatch"), (2, "missing_ids")}
