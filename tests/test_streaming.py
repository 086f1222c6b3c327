from pyspark.sql import functions as F

from quire.sources import files
from quire.streaming import events

SF = "/root/testdata/sf0.001"


def test_drain_goes_on_where_it_ended(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(5).write.parquet(f"{src}/a")
    stream = spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(src)
    assert events.drain(stream, out).count() == 5
    spark.range(5, 8).write.parquet(f"{src}/b")
    assert sorted(r.id for r in events.drain(stream, out).collect()) == list(range(8))


def test_blocks_close_at_the_next_marker_or_the_end(spark, tmp_path):
    rows = [(1, 1, "<!-- id=a --> one"), (1, 2, " more <!-- id=b"), (1, 3, " --> two"), (1, 4, "<!-- id=a --> again"), (1, 9, None), (2, 1, "<!-- id=x --> open")]
    spark.createDataFrame(rows, "document long, place long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("document long, place long, text string").parquet(f"{tmp_path}/in")
    out = events.drain(events.assemble_blocks(stream), f"{tmp_path}/out").collect()
    assert sorted(map(tuple, out)) == [(1, "a", "one more"), (1, "b", "two")]


def test_pages_are_ready_once(spark, tmp_path):
    schema = "document long, page long, unit long, expected int"
    rows = [(1, 0, 1, 2), (1, 0, 1, 2), (1, 0, 2, 2), (1, 0, 3, 2), (1, 1, 1, 2), (1, -1, 0, 0), (2, 0, 1, 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = events.drain(events.page_readiness(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out").collect()
    assert sorted((r.document, r.page, r.forced) for r in out) == [(1, 0, False), (1, 1, True)]


def test_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"seq": 1, "kind": "a"}\nbroken\n{"seq": 2, "kind": "b"}\n{"seq": 3, "ki')
    assert [r.seq for r in files.read_jsonl(spark, str(tmp_path / "log.jsonl"), "seq long, kind string").orderBy("seq").collect()] == [1, 2]
    (tmp_path / "g.csv").write_text("﻿source,target,tgt_lng\nA,甲,zh-CN\nB,乙,zh_cn\nC,丙,ja\n ,x,zh-CN\n", encoding="utf-8")
    assert sorted(r.source for r in files.read_glossary(spark, str(tmp_path / "g.csv"), "ZH-cn").collect()) == ["A", "B"]
    for n in (3, 5):
        files.publish(spark.range(n), f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").agg(F.count("id")).first()[0] == 5


def test_latest_rows_survive_a_restart(spark, tmp_path):
    src, folder, schema = f"{tmp_path}/in", f"{tmp_path}/out", "k long, n long, v string"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    spark.createDataFrame([], schema).write.parquet(f"{src}/none")
    assert events.latest_only(stream(), "k", "n", folder).count() == 0
    for name, rows in (("a", [(1, 1, "a"), (2, 1, "b")]), ("b", [(1, 2, "c")]), ("c", [(3, 1, "d"), (1, 1, "old")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")
        out = events.latest_only(stream(), "k", "n", folder)
    assert sorted(map(tuple, out.collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    assert sorted(map(tuple, events.latest_only(stream(), "k", "n", folder).collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_publish_leaves_a_whole_table_after_a_crash(spark, tmp_path):
    path = tmp_path / "table"
    files.publish(spark.range(3), str(path))
    path.rename(f"{path}.old")  # as a crash between the two moves leaves it
    assert files.published(spark, str(path)).count() == 3
    files.publish(spark.range(5), str(path))
    assert files.published(spark, str(path)).count() == 5
    assert [x.name for x in tmp_path.iterdir()] == ["table"]
