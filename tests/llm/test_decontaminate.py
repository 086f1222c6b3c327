import random
import re

from quire.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        if w:
            size = min(n, len(w))
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for doc_id, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), d.items_digest(list(found)), bool(hit)))
    return sorted(out, key=repr)


def fixture(seed=7):
    r = random.Random(seed)
    vocabulary = ["alpha", "Béta", "c3", "d", "ﬁ", "the", "of", "x" * 9]
    sep = [" ", "  ", "\n", "-", ", ", " ", "_"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice(sep) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(20)] + [(90, "zz9 only"), (91, None), (92, " - ")]
    docs = [(i, text(r.randrange(60))) for i in range(60)]
    for i in range(40):
        a = WORD.findall(items[r.randrange(20)][1])
        lo = r.randrange(len(a) + 1)
        docs.append((100 + i, text(5) + "; ".join(a[lo : lo + r.randrange(1, 25)]).upper() + " " + text(4)))
    return docs + [(200, None), (201, ""), (202, "ZZ9--ONLY"), (202, "ZZ9--ONLY"), (None, items[7][1]), (203, text(40_000))], items


def test_against_brute_force(spark):
    docs, items = fixture()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    keys = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute(docs, items)
    out = d.contamination_report(table, bench).select(keys).collect()
    assert sorted(map(tuple, out), key=repr) == want
    few = d.find_contamination(table, bench, part_bytes=900)
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in few.collect() if r.doc_id is not None) == sorted(x[:4] for x in want if x[0] is not None)


def test_matches_hold_and_are_longest(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "a b " + " ".join(f"W{i}" for i in range(5, 25)) + " c"), (2, item + " " + item)]
    found = {r.doc_id: r.matches for r in d.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string")).collect()}
    assert [tuple(m) for m in found[1]] == [("4", 5, 2, 20)]
    assert [tuple(m) for m in found[2]] == [("4", 0, 0, 30), ("4", 0, 30, 30)]


def test_removal_keeps_columns_and_clean_rows(spark):
    docs, items = fixture(3)
    schema = "n_hit string, doc_id long, text string, matches int"
    table = spark.createDataFrame([("x", i, t, 5) for i, t in docs], schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = sorted(repr(x[0]) for x in brute(docs, items) if not x[5])
    out = d.decontaminate(table, bench)
    assert out.columns == table.columns
    assert sorted(repr(r.doc_id) for r in out.collect()) == clean
    assert d.decontaminate(table, bench.limit(0)).count() == len(docs)
    assert d.contamination_report(table.limit(0), bench).count() == 0
