import hashlib
import random
import re

import pytest

from quire.llm import line_dedup as ld


def words(t):
    return frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w)


def brute(docs, percent=80):
    lines = sorted({(i, k, x) for i, t in docs if i is not None for k, x in enumerate((t or "").split("\n"))})
    gone, seen = set(), []
    for i, k, x in lines:
        w = words(x)
        if w:
            if any((a, b) < (i, k) and 100 * len(w & v) >= percent * len(w | v) for a, b, v in seen):
                gone.add((i, k))
            seen.append((i, k, w))
    out = []
    for i, t in docs:
        x = (t or "").split("\n")
        left = [y for k, y in enumerate(x) if (i, k) not in gone]
        out.append((i, len(x), len(x) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def fixture(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(400)] + ["Über", "The"]
    lines = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 5, 10, 25]))) for _ in range(60)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(r.randrange(0, 8)):
            w = r.choice(lines).split() if r.random() < 0.7 else [r.choice(vocabulary) for _ in range(r.randrange(1, 30))]
            if r.random() < 0.5 and len(w) > 1:
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                r.shuffle(w)
            own.append(r.choice([" ", "  ", "\t"]).join(w).upper() if r.random() < 0.1 else " ".join(w))
        docs.append((i, "\n".join(own + [""] * r.randrange(2))))
    return docs + [(900, None), (901, ""), (902, " \n\n"), (None, docs[3][1]), (7, docs[7][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = fixture(seed)
    table = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, line string, n long")
    out = ld.report(table).collect()
    assert sorted(map(tuple, out), key=repr) == brute(docs)


def test_lines_are_dropped_and_columns_kept(spark):
    rows = [(1, "one two three\nfour", "en", 18), (2, "Four\nfive six seven", "de", 19), (3, "THREE two one\nfour", "fr", 18), (None, "four", "x", 4), (4, None, "y", None), (5, "", "z", 0)]
    out = ld.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"))
    assert out.columns == ["doc_id", "text", "lang", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], (2, "five six seven", "de", 14), rows[3], rows[4], rows[5]], key=repr)
    assert ld.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefix_of_pairs_is_long_enough():
    """For all small sizes: a pair of neighbours stands in both lines within the two prefixes, wherever the tokens that
    only one has are put. Worst cases: each such token parts another pair of common ones, from the front on."""
    for percent in (70, 80, 90):
        for a in range(1, 70):
            for b in range(a, 70):
                for o in range(1, a + 1):
                    if 100 * o < percent * (a + b - o):
                        continue
                    if a == b == 1:
                        continue
                    only = a - o + b - o
                    assert o >= only + 2, (a, b, o)
                    for n, other in ((a, b), (b, a)):
                        mine = n - o
                        assert 2 * mine + (other - o) <= 2 * (100 - percent) * n // 100, (n, other, o)
                        assert (100 + percent) * (2 * mine + (other - o)) <= (200 - percent) * n + (100 - 2 * percent) * other
                    assert (100 + percent) * 3 * only <= 3 * (100 - percent) * (a + b)


def near_copies(r, base, count):
    """Variants of one line, each with some words taken out or changed."""
    out = []
    for _ in range(count):
        w = [x for x in base if r.random() > 0.08]
        w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_hot_groups(spark):
    """A line in every document, a passage in every other one, 300 near copies and many copies of one row."""
    r = random.Random(3)
    base, passage = [f"b{i}" for i in range(40)], " ".join(f"p{i}" for i in range(25))
    docs = []
    for i, x in enumerate(near_copies(r, base, 300)):
        own = " ".join(f"o{r.randrange(5000)}" for _ in range(20))
        docs.append((i, "\n".join(["Licensed to all under terms", x, own + (" " + passage if i % 2 else "")])))
    want = brute(docs)
    docs += [docs[7]] * 10_000
    out = ld.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).distinct().collect()
    assert sorted(map(tuple, out), key=repr) == want


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 1, "g", "k", 2, None), (2, long + " x\ny", 2, "g", "k", 3, "z"), (3, "a b\n" * 30_000, 3, "h", "l", 4, "z")]
    names = "doc_id long, text string, d int, gone string, __gone_0 string, __lines int, at string"
    out = ld.drop_lines(spark.createDataFrame(rows, names))
    assert out.columns == ["doc_id", "text", "d", "gone", "__gone_0", "__lines", "at"]
    assert {tuple(x) for x in out.collect()} == {rows[0], (2, "y", *rows[1][2:]), (3, "a b" + "\n", *rows[2][2:])}
    with pytest.raises(ValueError):
        ld.report(spark.createDataFrame(rows, names), percent=50)


def test_common_key_over_many_partitions(spark):
    """25,000 lines with one key, in 400 partitions: ids are large and there are many of them."""
    docs = spark.range(25_000, numPartitions=400).selectExpr("id AS doc_id", "concat('alpha beta u', id) AS text")
    near = spark.createDataFrame([(30_000 + i, f"one two three four five six seven eight nine {x}") for i, x in enumerate(["ten", "tenth", "tens", "ten ten"])], "doc_id long, text string")
    out = ld.report(docs.unionByName(near)).where("n_removed > 0").select("doc_id").collect()
    assert sorted(r.doc_id for r in out) == [30_001, 30_002, 30_003]
