"""Empty tables and columns whose names clash, for operators whose own tests lack them."""

from collections import Counter

import pytest

from quire.llm import decontaminate, packing, pii, quality_cnn, sharding, suffix_dedup

EMPTY = "doc_id long, text string"


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three")], EMPTY)
    assert pii.report(none).collect() == []
    assert suffix_dedup.removal_report(none).collect() == []
    assert decontaminate.contamination_report(none, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination_report(some, items).collect()] == [(3, 0)]
    assert quality_cnn.score(none, labels).collect() == []


def test_names_that_clash(spark):
    """Columns named like those of the result or of steps inside change nothing."""
    rows = [(i, f"text {i} of some words, mail a{i}@b.org", 9, 9, "x", 9, 9) for i in range(40)]
    plain = spark.createDataFrame([r[:2] for r in rows], EMPTY)
    names = {
        sharding.shard_documents: "size long, shard int, law string, slot long, total long",
        packing.pack: "start long, length long, bucket string, rank long, sequence_id long",
        pii.report: "spans long, n_email long, kind string, base_sha256 long, n_ip long",
    }
    for operator, more in names.items():
        clashing = spark.createDataFrame(rows, f"{EMPTY}, {more}")
        assert Counter(operator(clashing).collect()) == Counter(operator(plain).collect()), operator


def test_empty_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
