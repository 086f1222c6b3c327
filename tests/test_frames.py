"""Layout frames, free bands, columns set anew and regions that cut no line: hand pages and brute force."""

import random
from collections import namedtuple
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import quire.plans.registry  # noqa: F401
from quire.operators import frames
from quire.operators.catalog import CATALOG, over
from quire.operators.sequential import FOLDS

PARAGRAPH = "doc_id long, page long, seq long, x long, y long, x2 long, y2 long, rx long, rx2 long, centred boolean, kind string, baseline long, used long"
OBSTACLE = "doc_id long, page long, owner long, x long, y long, x2 long, y2 long"


def on(spark, name, paragraphs, obstacles):
    return CATALOG[name].on(spark, frame_paragraphs=spark.createDataFrame(paragraphs, PARAGRAPH), frame_obstacles=spark.createDataFrame(obstacles, OBSTACLE)).collect()


def frame_of(p, obstacles):
    _, page, seq, x, y, x2, y2, rx, rx2, centred, kind, baseline, _ = p
    others = [o[3:] for o in obstacles if o[:2] == p[:2] and o[2] != seq]
    lone = kind == "caption" and centred
    fx, fx2 = max(0, rx if lone else x), min(612, max(x2, rx2))
    for ox, oy, ox2, oy2 in others:
        if lone and (oy2 <= y or oy >= y2):
            continue
        fx = max(fx, (x + ox2) / 2) if ox2 <= x else fx
        fx2 = min(fx2, (x2 + ox) / 2) if ox >= x2 else fx2
    if centred:
        half = min((x + x2) / 2 - fx, fx2 - (x + x2) / 2)
        fx, fx2 = (x + x2) / 2 - half, (x + x2) / 2 + half
    fy, fy2 = 0, 792
    for ox, oy, ox2, oy2 in others:
        if ox2 > fx and ox < fx2:
            fy = max(fy, (y + oy2) / 2) if oy2 <= y else fy
            fy2 = min(fy2, (y2 + oy) / 2) if oy >= y2 else fy2
    return (fx, fy, fx2, fy2) if fx2 > fx and fy2 > fy and fy <= baseline <= fy2 else None


def bands_of(p, frame, obstacles):
    _, _, seq, x, y, x2, y2, *_, baseline, used = p
    free = [True] * (792 * 4)
    for o in obstacles:
        if o[:2] == p[:2] and o[2] != seq and o[5] > frame[0] and o[3] < frame[2]:
            for k in range(max(0, o[4] * 4 - 1), min(792 * 4, o[6] * 4 + 1)):
                free[k] = False
    out, k = [], 0
    while k < len(free):
        if free[k]:
            start = k
            while k < len(free) and free[k]:
                k += 1
            lo, hi = start / 4, k / 4
            if hi > y and lo < y2 and hi - lo >= used:
                moved = min(max(baseline, lo + baseline - y), hi - (y + used - baseline))
                out.append((abs(moved - baseline), lo, hi, moved))
        else:
            k += 1
    return [(lo, hi, moved) for _, lo, hi, moved in sorted(out)]


def pages(seed):
    r = random.Random(seed)
    paragraphs, obstacles = [], []
    for page in range(12):
        for seq in range(9):
            x, y = r.randrange(0, 500), r.randrange(0, 700)
            x2, y2 = x + r.randrange(5, 200), y + r.randrange(5, 120)
            obstacles.append((1, page, seq, x, y, x2, y2))
            if seq < 6:
                paragraphs.append((1, page, seq, x, y, x2, y2, x - r.randrange(20), x2 + r.randrange(200), r.random() < 0.4, r.choice(["caption", "text"]), y2 - r.randrange(1, 5), r.randrange(1, 160)))
    return paragraphs, obstacles


def test_frames_and_bands_against_brute_force(spark):
    paragraphs, obstacles = pages(3)
    want = {p[:3]: f for p in paragraphs if (f := frame_of(p, obstacles))}
    got = {(r.doc_id, r.page, r.seq): (r.fx, r.fy, r.fx2, r.fy2) for r in on(spark, "xo28_layout_frames", paragraphs, obstacles)}
    assert got == want and len(got) > 30
    bands = {}
    for r in sorted(on(spark, "xo28_free_bands", paragraphs, obstacles), key=lambda r: r.choice):
        bands.setdefault((r.doc_id, r.page, r.seq), []).append((r.low, r.high, r.first_baseline))
    assert bands == {p[:3]: b for p in paragraphs if p[:3] in want and (b := bands_of(p, want[p[:3]], obstacles))}
    assert sum(map(len, bands.values())) > 20


def test_frame_on_a_hand_page(spark):
    own = (1, 0, 1, 100, 400, 300, 500, 90, 320, False, "text", 490, 50)
    around = [(1, 0, 1, 100, 400, 300, 500), (1, 0, 2, 0, 0, 60, 20), (1, 0, 3, 340, 700, 500, 720), (1, 0, 4, 150, 560, 200, 600), (1, 0, 5, 150, 300, 200, 380), (2, 0, 6, 0, 0, 600, 700)]
    assert [tuple(r)[3:] for r in on(spark, "xo28_layout_frames", [own], around)] == [(100.0, 390.0, 320.0, 530.0)]
    assert [tuple(r)[3:] for r in on(spark, "xo28_free_bands", [own], around)] == [(380.25, 559.75, 490.0, 1)]


Row = namedtuple("Row", "doc_id page seq x y x2 y2 used")


def test_column_is_set_from_the_top():
    rows = [Row(1, 0, 1, 50, 700, 250, 750, 120), Row(1, 0, 2, 50, 400, 250, 500, 90), Row(1, 0, 3, 300, 690, 500, 790, 60), Row(1, 0, 4, 60, 300, 200, 390, 900)]
    got = {r[2]: r[3:] for r in frames.column_reflow(rows)}
    assert got[1] == (630.0, 750.0, 0.0, True)  # grows down into free room
    assert got[2] == (410.0, 500.0, 0.0, True)
    assert got[3] == (730.0, 790.0, 0.0, True)  # another column
    assert got[4] == (300.0, 390.0, 0.0, False)  # higher than any room: stays
    crowded = [Row(1, 0, 1, 50, 700, 250, 780, 80), Row(1, 0, 2, 50, 640, 250, 690, 100), Row(1, 0, 3, 50, 200, 250, 630, 430)]
    got = {r[2]: r[3:] for r in frames.column_reflow(crowded)}
    assert got[2] == (100.0, 200.0, -490.0, True)  # no room above: below the last one


def test_no_two_of_a_column_overlap_once_they_fit():
    r = random.Random(7)
    for _ in range(300):
        rows = [Row(1, 0, k, x := r.choice([50, 300]), y := 90 * k, x + 200, y + 60, r.randrange(10, 140)) for k in range(7)]
        out = {o[2]: o for o in frames.column_reflow(rows)}
        for a in rows:
            for b in rows:
                if a.seq < b.seq and a.x == b.x and out[a.seq][6] and out[b.seq][6]:
                    assert out[a.seq][4] <= out[b.seq][3] or out[b.seq][4] <= out[a.seq][3], rows


Item = namedtuple("Item", "doc_id page rid what x y x2 y2")


def test_chain_of_lines_takes_three_rounds():
    lines = [Item(1, 0, None, 0, *b) for b in [(40, 95, 160, 105), (155, 100, 300, 112), (290, 108, 400, 125), (500, 0, 550, 10)]]
    regions = [Item(1, 0, 1, 1, 50, 50, 100, 100), Item(1, 0, 2, 1, 490, 0, 560, 20), Item(1, 0, 3, 1, 0, 700, 5, 705)]
    got = {r[2]: r[3:] for r in frames.region_fixpoint(lines + regions)}
    assert got == {1: (40.0, 50.0, 400.0, 125.0, 3, 3), 2: (490.0, 0.0, 560.0, 20.0, 1, 0), 3: (0.0, 700.0, 5.0, 705.0, 0, 0)}


def test_regions_cut_no_line_in_the_end():
    r = random.Random(1)
    for _ in range(200):
        box = lambda w, h: (x := r.randrange(500), y := r.randrange(500), x + r.randrange(1, w), y + r.randrange(1, h))
        lines = [Item(1, 0, None, 0, *box(120, 12)) for _ in range(40)]
        for *_, x, y, x2, y2, inside, _ in frames.region_fixpoint([*lines, Item(1, 0, 1, 1, *box(80, 80))]):
            met = [b for b in lines if b.x < x2 and x < b.x2 and b.y < y2 and y < b.y2]
            assert all(x <= b.x and b.x2 <= x2 and y <= b.y and b.y2 <= y2 for b in met)
            assert inside == len(met)


def test_words_far_apart_are_two_lines(spark):
    glyphs = [(1, 0, 1, k, "a", x, 10, x + 5, 20) for k, x in enumerate([0, 6, 12, 60, 66])]
    g = spark.createDataFrame(glyphs, "doc_id long, page long, seq long, i long, ch string, x long, y long, x2 long, y2 long")
    r = spark.createDataFrame([(1, 0, 5, "text", 3, 12, 8, 15), (1, 0, 6, "figure", 0, 0, 9, 9)], "doc_id long, page long, rid long, label string, x long, y long, x2 long, y2 long")
    out = FOLDS["xo29_region_fixpoint"].on(over(spark, frames.LINES, {"glyphs": g, "regions": r})).collect()
    assert [tuple(x)[2:] for x in out] == [(5, 0.0, 10.0, 17.0, 20.0, 1, 1)]


def boxes_of_pages(r, degenerate):
    """Glyphs of two heights on three pages, many at one place, some wide, some with their edges the wrong way round."""
    out = []
    for page in range(3):
        for k in range(r.randrange(1, 120)):
            x, y = r.choice([r.randrange(600), 6 * k % 600]), r.choice([10, 10, 40])
            width = r.choice([5, 5, 0, 200]) if not degenerate or r.random() < 0.9 else -r.randrange(1, 60)
            out.append((1, page, x, y, x + width, y + (r.choice([10, 10, 12]) if not degenerate or r.random() < 0.9 else -20)))
    return out


@pytest.mark.parametrize("degenerate", [False, True])
def test_lines_in_arrays_are_those_of_the_windows(spark, degenerate):
    """Lines of pages by runs, in batches of any size, and by the SQL's windows."""
    r = random.Random(7)
    rows = [(doc, *q[1:]) for doc in range(40) for q in boxes_of_pages(r, degenerate)]
    names = ["doc_id", "page", "x", "y", "x2", "y2"]
    glyphs = [(d, p, 1, k, "a", *b) for k, (d, p, *b) in enumerate(rows)]
    box = "x long, y long, x2 long, y2 long"
    tables = {"glyphs": spark.createDataFrame(glyphs, f"doc_id long, page long, seq long, i long, ch string, {box}"), "regions": spark.createDataFrame([], f"doc_id long, page long, rid long, label string, {box}")}
    want = sorted(tuple(map(float, (q.doc_id, q.page, q.x, q.y, q.x2, q.y2))) for q in over(spark, frames.LINES, tables).collect())
    for size in (1, 7, 100, 10_000):
        parts = [pa.RecordBatch.from_pandas(pd.DataFrame(rows[k : k + size], columns=names), preserve_index=False) for k in range(0, len(rows), size)]
        got = pa.Table.from_batches(list(frames.lines_in_arrays(iter(parts)))).to_pandas()
        assert sorted(tuple(map(float, q)) for q in got.itertuples(index=False, name=None)) == want


def test_regions_in_arrays_grow_as_one_by_one(monkeypatch):
    monkeypatch.setattr(frames, "PAIRS", 100)
    r = random.Random(2)
    for _ in range(60):
        box = lambda w, h: (x := r.randrange(400), y := r.randrange(300), x + r.randrange(1, w), y + r.randrange(1, h))
        rows = [Item(1, p, k, what, *map(float, box(120, 12) if what == 0 else box(80, 80))) for p in range(4) for what in (0, 1) for k in range(r.randrange(0 if what else 1, 20))]
        pdf = pd.DataFrame(rows)
        begin = np.flatnonzero(np.append(True, np.diff(pdf["page"]) != 0))
        got = frames.region_fixpoint_table(pdf, np.repeat(np.arange(len(begin)), np.diff([*begin, len(pdf)])), begin)
        want = [x for p in range(4) for x in frames.region_fixpoint([q for q in rows if q.page == p])]
        assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_glyphs_of_the_fixpoint_stay_where_they_were_dealt_to(spark):
    """Neither glyphs nor windows over them are shuffled or sorted by more than their page; the rows are those of the rule."""
    fold = FOLDS["xo29_region_fixpoint"]
    new = fold.query(spark, "/root/testdata/sf0.001")
    assert "Window" not in new._jdf.queryExecution().executedPlan().toString()
    old = replace(fold, table=None, made=None).query(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
