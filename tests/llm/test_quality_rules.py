import random
import re
import struct
from collections import Counter
from math import log

import xxhash

from quire.llm import quality_rules as q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def grams(t):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [xxhash.xxh64_intdigest(m[0].encode(), 42) for m in re.finditer(r"[^\W_]+|(?:_|[^\w\s])+", t or "")]
    out = [x & (q.HALF - 1) for x in h]
    for a, b in zip(h, h[1:]):
        pair = signed(xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)))
        out.append(q.HALF if a == b else q.HALF + 1 + pair % (q.HALF - 1))
    return out


def fixture():
    r = random.Random(2)
    vocabulary = [f"word{i}" for i in range(60)] + ["Über,", "été.", "日本"]
    docs = []
    for i in range(120):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 120))]
        if i % 5 == 0:
            w = w[:10] + w[:10] + w
        if i % 7 == 0:
            w = [x + r.choice(["***", "%%%", "$$$"]) for x in w]
        if i % 11 == 0:
            w = [x for x in w[:12] for _ in range(5)]
        docs.append((i, "".join(x + r.choice([" ", " ", "\n", "\t", "  ", "\n\n"]) for x in w)))
    return docs + [(500, None), (501, ""), (502, " \n \n"), (None, docs[3][1]), (3, docs[3][1])], [(i, int(i % 7 != 0), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (9999, 1, 0)]


def tables(spark, docs, labels):
    return spark.createDataFrame([(i, t, "x", 2) for i, t in docs], "doc_id long, text string, Quality string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark):
    docs, labels = fixture()
    good = {i for i, k, _ in labels if k == 1 and i is not None}
    raw, fine = [0] * q.BUCKETS, [0] * q.BUCKETS
    for i, t in docs:
        for b in grams(t):
            raw[b] += 1
            fine[b] += i in good
    share = sum(fine) / sum(raw)
    table = [round(log((g + 10 * share) / ((r + 10) * share)), 3) for g, r in zip(fine, raw)]
    want = []
    for i, t in docs:
        g = grams(t)
        s = sum(table[b] for b in g) / len(g) if g else 0.0
        n = base(t)
        want.append((i, *n, not n[5] and s >= q.THRESHOLD, round(s, 9)))
    out = [(*r[:-1], round(r[-1], 9)) for r in q.report(*tables(spark, docs, labels)).collect()]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert {r[7] for r in out} == {True, False}
    kept = q.keep_good(*tables(spark, docs, labels))
    assert kept.columns == ["doc_id", "text", "Quality", "score"]
    assert sorted((repr(r.doc_id), r.Quality, r.score) for r in kept.collect()) == sorted((repr(r[0]), "x", 2) for r in want if r[7])


def test_no_labels_and_empty_tables(spark):
    docs, _ = fixture()
    out = q.report(*tables(spark, docs, [])).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in out)
    assert q.report(*tables(spark, [], [])).collect() == []


def test_clashing_columns_long_and_empty(spark):
    long = " ".join(f"word{i}" for i in range(120_000))
    names = "doc_id long, text string, __words string, __n int, quality string, __quality_0 string, __score double"
    rows = [(1, long, "a", 1, "q", "r", 0.5), (2, None, "a", 1, "q", "r", 0.5), (None, long, "b", 2, None, "r", 0.5)]
    docs, labels = spark.createDataFrame(rows, names), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = q.keep_good(docs, labels)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[2]], key=repr)
    assert q.keep_good(docs.limit(0), labels).collect() == []
