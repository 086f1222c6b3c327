"""Glyphs and boxes by cells, against every pair; operators leave the session's views alone."""

import random
import threading

import pytest

import quire.plans.registry  # noqa: F401
from quire.operators.catalog import CATALOG

BOX = "x long, y long, x2 long, y2 long"
PRIORITY = {"title": 0, "paragraph_title": 1, "text": 2, "figure_caption": 3, "figure": 9}


def pages(seed):
    r = random.Random(seed)
    glyphs, regions = [], []
    for doc, page in ((1, 0), (1, 1), (2, 0)):
        for i in range(120):
            x, y = r.randrange(-300, 700), r.randrange(-400, 900)
            w, h = (r.choice([0, 3, 5]), r.choice([0, 10])) if r.random() < 0.9 else (r.randrange(400), r.randrange(300))
            glyphs.append((doc, page, page + 1, i, r.choice("ab "), x, y, x + w, y + h))
        for rid in range(r.choice([0, 12, 40])):
            x, y = r.randrange(-300, 700), r.randrange(-400, 900)
            w, h = r.choice([(0, 0), (40, 30), (250, 120), (900, 10)])
            regions.append((doc, page, rid, r.choice(list(PRIORITY)), x, y, x + w, y + h))
    regions += [(2, 0, 90, "figure", -(10**9), -(10**9), 10**9, 10**9), (3, 0, 1, "text", 0, 0, 9, 9)]
    return glyphs, regions


def meets(g, r):
    return g[0] < r[2] and r[0] < g[2] and g[1] < r[3] and r[1] < g[3]


def shared(g, r):
    return max(0, min(g[2], r[2]) - max(g[0], r[0])) * max(0, min(g[3], r[3]) - max(g[1], r[1]))


def centred(g, r, slack=0):
    return 2 * r[0] - slack <= g[0] + g[2] <= 2 * r[2] + slack and 2 * r[1] - slack <= g[1] + g[3] <= 2 * r[3] + slack


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_against_every_pair(spark, seed):
    glyphs, regions = pages(seed)
    g = spark.createDataFrame(glyphs, f"doc_id long, page long, seq long, i long, ch string, {BOX}")
    r = spark.createDataFrame(regions, f"doc_id long, page long, rid long, label string, {BOX}")
    boxes = spark.createDataFrame([(d, p, rid, *b) for d, p, rid, _, *b in regions], f"doc_id long, page long, seq long, {BOX}")
    on_page = {k: [q for q in regions if q[:2] == k] for k in {x[:2] for x in glyphs}}
    best, bare, centre, span = {}, set(), set(), {}
    for x in glyphs:
        key, box, near = (x[0], x[2], x[3]), x[5:], on_page[x[:2]]
        hit = [(PRIORITY[q[3]], -shared(box, q[4:]), q[2]) for q in near if meets(box, q[4:])]
        if hit:
            best[key] = min(hit)[2]
        else:
            bare.add(key)
        if any(centred(box, q[4:]) for q in near):
            centre.add(key)
        size = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
        first = [(size(q[4:]), q[2]) for q in near if centred(box, q[4:], 2)]
        second = [(size(q[4:]), q[2]) for q in near if size(box) and shared(box, q[4:]) / size(box) >= 0.6]
        if first or second:
            span[key] = (min(first or second)[1], 1 if first else 2, len(first or second) > 1)
    run = lambda name, **t: CATALOG[name].on(spark, **t).collect()
    key = lambda q: (q.doc_id, q.seq, q.i)
    assert {key(q): q.rid for q in run("jn01_char_region", glyphs=g, regions=r)} == best
    uncovered = run("jn02_uncovered_chars", glyphs=g, regions=r)
    assert {key(q) for q in uncovered} == bare and len(uncovered) == len(bare)
    assert {key(q) for q in run("jn03_glyph_centre", glyphs=g, regions=r)} == centre
    assert {key(q): (q.box, q.stage, q.ambiguous) for q in run("jn04_char_span", glyphs=g, boxes=boxes)} == span
    total = next(q for q in run("ag01_coverage", glyphs=g, regions=r) if q.doc_id is None)
    assert (total.total, total.uncovered) == (len(glyphs), sum((x[0], x[2], x[3]) in bare and x[4] != " " for x in glyphs))
    assert {q.doc_id: q.uncovered for q in run("ag02_coverage_gate", glyphs=g, regions=r)} == {d: sum(k[0] == d for k in bare) for d in (1, 2)}
    assert sum(q.covered for q in run("ag03_glyph_report", glyphs=g, regions=r)) == len(centre)


def test_a_centre_on_the_edge_of_a_piece(spark):
    """Boxes that share edges, lie in one another or are fractions apart: on an edge a centre is in both, beside it in one."""
    boxes = [(0, 0, 10, 10), (12, 0, 20, 10), (2, 2, 8, 8), (2, 2, 8, 8), (40.5, 0, 41, 10), (300, 0, 298.5, 10)]
    glyphs = [(x / 4, 4, x / 4 + w, 6) for x in range(-8, 170) for w in (0, 0.5)] + [(x / 4, y, x / 4, y) for x in range(1190, 1210) for y in (-1, 11, 11.5)]
    want = {}
    for i, g in enumerate(glyphs):
        hit = [((b[2] - b[0]) * (b[3] - b[1]) if b[2] > b[0] else 0, k) for k, b in enumerate(boxes) if centred(g, b, 2)]
        if hit:
            want[i] = (min(hit)[1], 1, len(hit) > 1)
    box = BOX.replace("long", "double")
    g = spark.createDataFrame([(1, 0, 1, i, "a", *map(float, x)) for i, x in enumerate(glyphs)], f"doc_id long, page long, seq long, i long, ch string, {box}")
    b = spark.createDataFrame([(1, 0, k, *map(float, x)) for k, x in enumerate(boxes)], f"doc_id long, page long, seq long, {box}")
    assert {q.i: (q.box, q.stage, q.ambiguous) for q in CATALOG["jn04_char_span"].on(spark, glyphs=g, boxes=b).collect()} == want


def test_round_trips_leave_no_views(spark):
    quire.plans.registry.queries()["sc05_glossary_csv"](spark, "/root/testdata/sf0.001").count()
    assert not any(spark.catalog.tableExists(t) for t in ("documents", "benchmark", "events"))


def test_views_of_the_session_are_left_alone(spark):
    spark.range(3).createOrReplaceTempView("label_records")
    records = spark.createDataFrame([("text",), (None,)], "label string")
    assert CATALOG["ag15_label_inventory"].on(spark, label_records=records).count() == 2
    assert spark.table("label_records").count() == 3
    CATALOG["ag15_label_inventory"].query(spark, "/root/testdata/sf0.001").count()
    assert not spark.catalog.tableExists("documents")
    spark.catalog.dropTempView("label_records")


def test_two_threads_use_tables_of_their_own(spark):
    found = {}

    def run(n):
        records = spark.createDataFrame([(f"l{n}",)] * n, "label string")
        found[n] = [tuple(r) for r in CATALOG["ag15_label_inventory"].on(spark, label_records=records).select("label", "n").collect()]

    threads = [threading.Thread(target=run, args=(n,)) for n in range(1, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {n: [(f"l{n}", n)] for n in range(1, 9)}
