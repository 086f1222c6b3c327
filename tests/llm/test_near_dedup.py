import random
import re
from itertools import combinations

import pytest

from quire.llm import near_dedup as nd
from quire.llm.components import components


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]


def brute(docs, k=2):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def fixture(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünder", "É"]
    docs, n = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 3, 6, 30, 60, 200]))]
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(copy) // 14)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.3:
                base = copy  # chains
            docs.append((n, r.choice([" ", "\n", " \t"]).join(copy)))
            n += 1
    r.shuffle(docs)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "a a a a"), (n + 6, "a a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = fixture(seed)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, component string, kept int")
    out = nd.near_duplicates(table, 2).collect()
    assert sorted(map(tuple, out)) == brute(docs)


def test_rows_that_repeat_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (3, "a b c"), (4, "")]
    out = sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, schema), 2).collect()), key=repr)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (3, 2, 1, False), (4, 0, 4, True)], key=repr)
    assert nd.near_duplicates(spark.createDataFrame([], schema), 2).collect() == []
    kept = nd.keep_one_of_each(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[0], rows[2], rows[4]], key=repr)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 350)] + [(349, 5), (5, 5), (None, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, 7, *range(300, 350)]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_many_equal_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 0)] * 3000 + [(2, text + " x", "b", 1)] * 3000 + [(3, "other words " + " ".join(f"q{i}" for i in range(70_000)), "c", 2), (None, text, "d", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __gone_0 string, __gone int").repartition(8)
    sets = nd._sets_of(table, spark.createDataFrame([(1,), (2,)], "node long"), 5)
    assert sets.count() == 2
    out = nd.keep_one_of_each(table)
    assert out.columns == table.columns
    assert sorted(map(tuple, out.distinct().collect()), key=repr) == sorted([rows[0], rows[6000], rows[6001]], key=repr)
    assert out.where("doc_id = 1").count() == 3000
    assert nd.keep_one_of_each(table.limit(0)).collect() == []
