"""Queries read every document and the whole of each text: small tables whose answer is known."""

import difflib
import random
import time
from collections import namedtuple

import pytest

from quire.operators import sequential
from quire.operators.catalog import CATALOG
from quire.plans import registry


@pytest.fixture
def sf_of(spark, tmp_path):
    """A folder of test tables with these (doc_id, text) documents."""

    def write(*docs):
        rows = [(i, t, "en", "web", len(t)) for i, t in docs]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_glyphs_of_every_document_and_the_whole_text(spark, sf_of):
    sf = sf_of((1, "ab" * 65), (10, "x" * 41 + "\n\n" + "é𝒳" * 50))
    sizes = {(1, 1): 130, (10, 1): 41, (10, 3): 100}
    run = lambda name: registry.queries()[name](spark, sf).collect()
    assert {(r.doc_id, r.seq): r.n_lines for r in run("ag13_line_count")} == {k: -(-n // 40) for k, n in sizes.items()}
    assert {(r.doc_id, r.seq): r.n_lines for r in run("xo17_source_lines")} == {k: -(-n // 40) for k, n in sizes.items()}
    assert {r.doc_id: r.n for r in run("ag17_alignment_summary")} == {1: 130, 10: 141}
    assert sorted((r.doc_id, r.seq, r.i) for r in run("xo04_char_classes")) == sorted((d, s, i) for (d, s), n in sizes.items() for i in range(n))
    want = {(d, s, y): min(40, n - 40 * y) for (d, s), n in sizes.items() for y in range(-(-n // 40))}
    assert {(r.doc_id, r.seq, r.line): r.n for r in run("wf09_line_groups")} == want


def test_ocr_text_is_whole(spark, sf_of):
    """h = 312 has an OCR text, of 130 characters."""
    rows = registry.queries()["xo02_ocr_backfill"](spark, sf_of((10, "\n" + "ab" * 65))).collect()
    assert {r.i: r.ch for r in rows} == {i: "AB"[i % 2] for i in range(130)}


def slow_ratio(a, b):
    """2 LCS / (summed length), by the whole table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            table[i + 1][k + 1] = table[i][k] + 1 if x == y else max(table[i][k + 1], table[i + 1][k])
    return 2 * table[-1][-1] / (len(a) + len(b))


def test_ratio_against_the_whole_table():
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé译") for _ in range(r.randrange(0, 90))) for _ in range(2))
        assert sequential.indel_ratio(a, b) == (slow_ratio(a, b) if a or b else 1)


def test_matching_blocks_against_difflib():
    r, kind = random.Random(4), namedtuple("Row", "doc_id seq a b")
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randrange(1, 40)))
        b = r.choice([a[r.randrange(9) :], a + "c", "b" + a[:9], "".join(r.choice("abc") for _ in range(20)), ""])
        n = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert sequential.formula_match([kind(1, 1, a, b)]) == [(1, 1, n / len(a), n / len(a) >= 0.7)]


def test_matching_blocks_of_a_long_unit():
    """Every fourth word has a sign whose capital is spelled otherwise; difflib was cut off after 55 s."""
    r, kind = random.Random(5), namedtuple("Row", "doc_id seq a b")
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) + ("ß" if k % 4 == 0 else "") for k in range(1500)]
    a = " ".join(words)  # 375 of 9,375 signs have no like
    began = time.process_time()
    (found,) = sequential.formula_match([kind(1, 1, a, a.upper())])
    assert time.process_time() - began < 20 and found[2] == 9000 / 9375
    for _ in range(200):
        a = "".join(r.choice("abcß-") for _ in range(r.randrange(1, 60)))
        signs = [s.replace("-", "") for s in (a, a.upper().lower())]
        want = sum(m.size for m in difflib.SequenceMatcher(None, *signs, autojunk=False).get_matching_blocks())
        assert sequential.formula_match([kind(1, 1, a, a.upper())])[0][2] == (want / len(signs[0]) if signs[0] else 0.0)


def test_folds_over_every_document_and_whole_texts(spark, sf_of):
    """h = 312 (h % 40 = 32, h % 50 = 12) and h = 32, of long lines."""
    long = "abcdefghij " * 200
    sf = sf_of((10, "\n" + long), (1, long))
    run = lambda name: {(r.doc_id, r.seq): r for r in registry.queries()[name](spark, sf).collect()}
    qc11, xo18, wf26 = run("qc11_back_translation"), run("xo18_formula_match"), run("wf26_line_breaking")
    n = 2200 * 28 // 60
    assert qc11[10, 2].similarity == qc11[1, 1].similarity == 2 * n / (2200 + n)
    head = sum(c != " " for c in long[: 2200 * 68 // 80])
    assert xo18[10, 2].covered == head / 2000 and set(xo18) == set(qc11) == {(1, 1), (10, 1), (10, 2)}
    assert wf26[10, 2].n_lines == wf26[1, 1].n_lines == 40  # five words of ten letters fill 54 of 60


def slow_repeats(text, period=16, span=12):
    most = 0
    for i in range(len(text)):
        for p in range(1, period + 1):
            times = 1
            while i + (times + 1) * p <= len(text) and text[i : i + p] == text[i + times * p : i + (times + 1) * p]:
                times += 1
            if times > 1 and times * p >= span:
                most = max(most, times)
    return most


def test_repeats_against_every_start():
    r = random.Random(5)
    for _ in range(600):
        text = "".join(r.choice(["a", "b", "é", "译", "𝒳", "ab" * 3, "abc" * 4, "a" * 7]) for _ in range(r.randrange(0, 25)))
        assert sequential.repeats(text) == slow_repeats(text), text


def test_repetition_of_every_reply_after_its_head(spark):
    """h = 31 leaves a rest of 1 by 3; the reply runs away after 500 characters."""
    r = random.Random(6)
    head = "".join(r.choice("abcdefgh ") for _ in range(500))
    replies = spark.createDataFrame([(1, 0, 31, head, head + "xyz" * 9)], "doc_id long, seq long, h long, source string, reply string")
    replies.createOrReplaceTempView("replies")
    fold = sequential.FOLDS["fs24_repetition"]
    found = fold.on(spark.sql(fold.source)).collect()
    spark.catalog.dropTempView("replies")
    assert [(x.doc_id, x.in_reply, x.pathological) for x in found] == [(1, 9, True)]


def test_distances_of_whole_texts(spark):
    source = "The same sixty characters and more begin this text and its reply, then they part."
    data = [(1, source, source[:62] + "译" * 19), (2, source, source[:-4] + "x译y"), (3, "x" * 21 + "译" * 9, "x" * 21 + "文" * 9), (4, "译" * 30, "译" * 26 + "文" * 4), (5, "a" * 30, "a" * 25)]
    units = spark.createDataFrame([(i, 1, a) for i, a, _ in data], "doc_id long, seq long, source string")
    targets = spark.createDataFrame([(i, 1, b) for i, _, b in data], "doc_id long, seq long, target string")
    gate = {r.doc_id: r.gate for r in CATALOG["fs15_reply_gate"].on(spark, units=units, targets=targets).collect()}
    assert gate == {1: "ok", 2: "near_same", 3: "ok", 4: "near_same", 5: "ok"}
    replies = spark.createDataFrame(data, "doc_id long, source string, reply string").selectExpr("*", "1L AS seq")
    far = {r.doc_id: r.distance for r in CATALOG["fs14_edit_distance"].on(spark, replies=replies).collect()}
    assert far == {1: 19, 2: 4, 3: 9, 4: 4, 5: 5}


def test_no_row_is_left_out(spark, sf_of):
    docs = [(i, "\n".join(f"line {k}" for k in range(9))) for i in (1, 2, 499, 500, 1200)]
    sf = sf_of(*docs)
    places = registry.queries()["st01_multi_key_sort"](spark, sf).collect()
    assert [x.place for x in sorted(places, key=lambda x: (-x.page, x.label, x.doc_id, x.seq))] == list(range(1, 46))
    assert registry.queries()["fs10_empty_spans"](spark, sf).count() == 45
    log = spark.createDataFrame([(1, k, "view") for k in range(1, 6)], "run_id long, seq long, stage string")
    assert sorted((x.seq, x.earlier) for x in CATALOG["xo24_inherited_evidence"].on(spark, log=log).collect() if x.seq > 1) == [(2, 1), (3, 2), (4, 3), (5, 4)]


def test_commas_split_outside_brackets(spark):
    lines = [(1, "f(a, b), c"), (2, "a), b, (c, d"), (3, ",,[x, {y, z}], w,"), (4, "plain")]
    numbered = spark.createDataFrame([(i, 1, t, 31 * i + 1) for i, t in lines], "doc_id long, seq long, line string, h long")
    found = sorted((x.doc_id, x.place, x.piece) for x in CATALOG["xo06_comma_split"].on(spark, numbered=numbered).collect())
    assert found == [(1, 1, "f(a, b)"), (1, 2, "c"), (2, 1, "a)"), (2, 2, "b"), (2, 3, "(c, d"), (3, 1, "[x, {y, z}]"), (3, 2, "w"), (4, 1, "plain")]


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for k, y in enumerate(b):
            row.append(min(before[k] + (x != y), before[k + 1] + 1, row[k] + 1))
    return row[-1]


def test_distances_against_the_whole_table(spark):
    """Ends that agree, texts without a sign in common, near and far ones; and long units, which need no table."""
    r, pairs = random.Random(7), [("", ""), ("", "ab"), ("a{v1}", "译{v1}"), ("{v1}", "x{v1}{v1}"), ("aaaaaaaaaaaaaaaaaaaa", "aaa"), ("𝒳b", "𝒳译")]
    for _ in range(300):
        a = "".join(r.choice("abcd𝒳") for _ in range(r.randrange(0, 45)))
        b = r.choice([a + "{v1}", a[3:], "".join(r.choice("abcd译") for _ in range(r.randrange(0, 45))), "译" * r.randrange(0, 30) + "。" + a[-20:], a[:9] + "xy" + a[9:]])
        pairs.append((a, b))
    run = lambda rows: {x.seq: x.distance for x in CATALOG["fs14_edit_distance"].on(spark, replies=spark.createDataFrame([(1, k, *p) for k, p in enumerate(rows)], "doc_id long, seq long, source string, reply string")).collect()}
    assert run(pairs) == {k: slow_distance(a, b) for k, (a, b) in enumerate(pairs)}
    began = time.monotonic()
    assert run([("ab" * 60000 + "{v1}", "译" * 60000 + "。{v1}")] * 6) == dict.fromkeys(range(6), 120000)
    assert time.monotonic() - began < 15
