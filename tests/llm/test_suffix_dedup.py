import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import suffix_dedup as sd


def brute(docs, n=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = True
        gone = gone[:-1]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


def fixture(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["the ", "of ", "in ", "año ", "thing ", "a", "\n"] + [f"w{i} " for i in range(300)]
    passages = ["".join(r.choice(vocabulary) for _ in range(r.randrange(8, 60))) for _ in range(12)] + ["a" * 130, "ab" * 60]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            if r.random() < 0.4:
                p = r.choice(passages)
                lo = r.randrange(len(p))
                parts.append(p if r.random() < 0.5 else p[lo : lo + r.randrange(30, 90)])
            else:
                parts.append("".join(r.choice(vocabulary) for _ in range(r.randrange(1, 40))))
        t = "".join(parts)
        if docs and r.random() < 0.2:
            t = r.choice(docs)[1]
            if r.random() < 0.6 and t:
                k = r.randrange(len(t))
                t = t[:k] + "X" + t[k + 1 :]
        docs.append((i, t))
    return docs + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "FLUSH_BYTES", 3000)
    docs = fixture(seed)
    table = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, blob string").repartition(3)
    assert Counter(map(tuple, sd.removal_report(table).collect())) == brute(docs)


def test_long_text_in_segments(monkeypatch):
    docs = fixture(5, 60)
    text = "".join(t or "" for _, t in docs).encode()
    monkeypatch.setattr(sd, "SEGMENT", 100)
    parts = list(sd._segments(sd.pa.array([text.decode()])))
    starts = sorted(s + p[3] for p in parts for a in [sd.anchors(p[0], p[1])] for lo, n in zip(a["lo"].tolist(), a["span"].tolist()) for s in range(lo, lo + n + 1))
    assert sorted(set(starts)) == list(range(len(text) - 49))


def test_kept_bytes_and_repeated_rows(spark):
    p = "This passage is long enough to be found again, word for word, elsewhere. "
    rows = [(1, p + "one"), (2, "two " + p), (2, "two " + p), (None, p), (3, "short")]
    out = {(r.doc_id, bytes(r.kept).decode()): r.n_removed for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, p + "one"): 0, (2, "two "): len(p), (None, p): 0, (3, "short"): 0}
    assert sd.removal_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keys_are_dealt_one_to_a_partition(spark):
    from pyspark.sql import functions as F

    from quire.llm.common import even_keys

    keys = even_keys(37)
    out = spark.createDataFrame([(int(k),) for k in keys], "k int").repartition(37, "k").select("k", F.spark_partition_id().alias("p")).collect()
    assert {r.p: r.k for r in out} == dict(enumerate(keys.tolist()))
