import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import conversation_trie
from quire.llm.queries import QUERIES

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, borrow=None):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in by.items()}
    rebuilt = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow is None else borrow
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, n long")


def some(seed, convs, step, words):
    r = random.Random(seed)
    out = []
    for _ in range(convs):
        c = r.randrange(0, 700) * step
        for t in range(r.choice([1, 2, 3, 7, 12])):
            out.append((c, r.choice([None, t, t]), r.choice(["user", "assistant", None, ""]), r.choice([*words, None])))
    return out


@pytest.mark.parametrize("seed,step,words", [(1, 1, ["a", "b"]), (2, 3, ["é𝒳", "x" * 500, "y" + "x" * 400]), (3, 1, ["same"]), (4, -1, ["p", "q"])])
def test_against_brute_force(spark, seed, step, words):
    rows = some(seed, 150, step, words)
    assert got(conversation_trie.trie(frame(spark, rows))) == brute(rows)


def test_turnless_absent_base_and_nulls(spark):
    rows = [(c, 0, "user", "hi") for c in range(1, 99)] + [(None, 1, "user", "lost"), (200, None, None, None), (205, 3, "user", "x")]
    assert got(conversation_trie.trie(frame(spark, rows))) == brute(rows)
    assert any(d == 0 for _, d, *_ in brute(rows))


def test_copies_long_chain_and_snapshots(spark):
    """One conversation of 300 turns, a snapshot of it after each of 40 turns, and many copies of one turn."""
    talk = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(300)]
    rows = [(1000, *x) for x in talk] + [(k, *x) for k in range(40) for x in talk[: 40 - k]] + [(5000 + k, 0, "user", "turn 0") for k in range(300)]
    for borrow in (0, None):
        out = conversation_trie.trie(frame(spark, rows), None if borrow is None else F.lit(borrow))
        assert got(out) == brute(rows, borrow)


def test_conversations_over_several_ranges(spark, monkeypatch):
    """A conversation with most rows lies in several ranges, its path in several blocks."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 16)
    rows = [(7, t, "user", f"t{t % 5}") for t in range(900)] + [(8, t, "user", f"t{t % 5}") for t in range(450)] + some(5, 30, 1, ["z"])
    assert got(conversation_trie.trie(frame(spark, rows), F.lit(0))) == brute(rows, 0)


def test_empty_table(spark):
    assert conversation_trie.trie(frame(spark, [])).collect() == []
    assert conversation_trie.trie(frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_conversation_trie"](spark, sf)) == brute(rows)
