import zlib
from collections import Counter

from quire.llm import sharding


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, shard string")


def check(out, data):
    assert Counter(r.doc_id for r in out) == Counter(d[0] for d in data)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_sizes_slots_and_checksums(spark):
    data = [(i, f"text {i} é" * (i % 7), "x") for i in range(997)] + [(None, None, "y")] * 300 + [(5, "same", "z")] * 400
    docs = rows(spark, data)
    out = sharding.shard_documents(docs).collect()
    check(out, data)
    want = Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert Counter(out) == Counter(again)
    assert len({r.shard for r in out}) == 40


def test_small_and_empty_tables(spark):
    assert sharding.shard_documents(rows(spark, [])).collect() == []
    for n in (1, 2, 3, 7, 39, 40, 41):
        data = [(i, "a", "b") for i in range(n)]
        check(sharding.shard_documents(rows(spark, data)).collect(), data)


def test_place_is_computable_from_the_row_number(spark):
    df = spark.range(1234).withColumnRenamed("id", "doc_id")
    out = sharding.feistel_shards(df, 13).collect()
    assert all((r.shard, r.slot) == sharding.shard_and_slot(r.row_number, 1234, 13) for r in out)
    assert sorted(r.row_number for r in out) == list(range(1234))
    assert sum(r.shard == r.row_number % 13 for r in out) < 300  # shuffled
