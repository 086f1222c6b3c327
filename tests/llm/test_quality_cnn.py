import random
import zlib

import numpy as np
import pyarrow as pa

from quire.llm import quality_cnn as q


def fixture(n=400, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randrange(20, 200))]
        bad = i % 3 == 0
        docs.append((i, " ".join(x + r.choice(["***", "%%%", "$$"]) if bad else x for x in w)))
        if i % 4:
            labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_chunks_cover_every_byte():
    for n in (0, 1, 7, 511, 512, 513, 960, 961, 5000):
        data = np.arange(n) % 251
        rows = q.chunks(data.astype(np.uint8))
        whole = np.concatenate([rows[0], *[x[q.CHUNK - q.STEP :] for x in rows[1:]]])
        assert whole[:n].tolist() == data.tolist() and (whole[n:] == q.PAD).all()


def test_held_out_accuracy(spark):
    docs, labels = fixture()
    extra = [(900, None), (901, ""), (None, "some words"), (5, docs[5][1])]
    table = spark.createDataFrame([(i, t, 3, "en") for i, t in docs + extra], "doc_id long, text string, score int, lang string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = q.score(table, marks).collect()
    assert len(out) == len(docs) + 4
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    # labels of held-out rows have no say
    other = spark.createDataFrame([(i, 1 - k if zlib.crc32(str(i).encode()) % 5 == 0 else k, t) for i, k, t in labels], "doc_id long, quality int, toxic int")
    again = {(r.doc_id, round(r.score, 6)) for r in q.score(table, other).collect()}
    assert again == {(r.doc_id, round(r.score, 6)) for r in out}


def test_long_text_scores_as_its_chunks_do():
    docs, _ = fixture(60)
    net = q.fit([t.encode() for _, t in docs], np.array([float(i % 3 != 0) for i, _ in docs], np.float32))
    long = "wörd and more " * 150_000
    rows = q.chunks(np.frombuffer(long.encode(), np.uint8))
    pool = np.concatenate([q.pooled(net, x)[0] for x in np.array_split(rows, 40)])
    x, _ = q._document(pool, np.array([0]), np.array([len(long.encode())]))
    got = q._scores(net, pa.array([long, "short", None]))
    assert abs(got[0] - q._probability(net, x)[0][0]) < 1e-4 and len(got) == 3


def test_no_labels_and_empty_tables(spark):
    docs, labels = fixture(30)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in q.score(table, none).collect()} == {0.5}
    assert q.score(table.limit(0), spark.createDataFrame(labels, none.schema)).collect() == []
