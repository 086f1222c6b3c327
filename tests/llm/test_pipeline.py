import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import packing, quality_rules

from .test_decontaminate import brute as contaminated
from .test_line_dedup import words as line_words
from .test_quality_rules import base

pipeline = pytest.importorskip("corpus_pipeline")


def write(spark, top, docs, labels, items):
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")


def fixture():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(700)]
    text = lambda n: "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 20))) for _ in range(n))
    docs = [text(r.randrange(2, 7)) for _ in range(60)]
    items = [(i, text(2)) for i in range(4)]
    docs += [docs[k] for k in range(6)]  # copies
    for k in range(6, 14):  # near copies
        w = docs[k].split(" ")
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
    docs += [text(1) + "\n" + items[k][1] + "\n" + text(1) for k in range(3)]  # leaks
    docs += [re.sub(r"\b(w\d+)\b", r"\1***", text(4)) for _ in range(8)]  # junk
    docs += ["too short"]
    r.shuffle(docs)
    docs = list(enumerate(docs))
    labels = [(i, int("***" not in t), 0) for i, t in docs]
    return docs, labels, items


def brute(docs, items):
    """The stages on plain lists. Junk is known here by its marks."""
    docs = [(i, t) for i, t in docs if not base(t)[5] and "***" not in t]
    seen, kept = [], []
    for i, t in docs:
        left = []
        for x in t.split("\n"):
            w = line_words(x)
            if not w or not any(100 * len(w & v) >= 80 * len(w | v) for v in seen):
                left.append(x)
            seen.append(w)
        if any(map(line_words, left)):
            kept.append((i, "\n".join(left)))
    sets, docs = {}, []
    for i, t in kept:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[b] = min(root[b], root[a])
    docs = [(i, t) for i, t in kept if root[i] == i]
    dirty = {x[0] for x in contaminated(docs, items) if x[5]}
    return [(i, t) for i, t in docs if i not in dirty]


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items = fixture()
    write(spark, tmp_path, docs, labels, items)
    want = brute(docs, items)
    out = pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = {(i, 0): zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in want}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in out} == pieces
    assert 20 < len(want) < len(docs) - 10
    room = defaultdict(int)
    for r in out:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, labels, items = fixture()
    write(spark, tmp_path, docs, labels, items)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert quality_rules.THRESHOLD < 0
