"""Where translated text may stand: layout frames, free bands, columns set anew, regions that cut no line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import SPARK, Dialect
from ..sources.derived import with_clause
from .catalog import operator, over_files
from .sequential import fold

#: The crop box, clearance around an obstacle, gap between glyphs of a line in heights.
LEFT, BOTTOM, RIGHT, TOP = 0, 0, 612, 792
CLEARANCE, LINE_GAP = 0.25, 1.5
PAGE = "{0}.doc_id = {1}.doc_id AND {0}.page = {1}.page"


def frames(d: Dialect) -> str:
    """Common table expressions up to ``framed``: frame_paragraphs with their frame fx, fy, fx2, fy2."""
    same, key = PAGE.format("b", "o"), "doc_id, page, seq"
    lone = "NOT (b.kind = 'caption' AND b.centred AND (o.y2 <= b.y OR o.y >= b.y2))"
    return f"""base AS (SELECT *, greatest(CASE WHEN kind = 'caption' AND centred THEN rx ELSE x END, {LEFT}) AS bx, least(greatest(x2, rx2), {RIGHT}) AS bx2, (x + x2) / 2.0 AS middle FROM frame_paragraphs),
        sides AS (SELECT b.doc_id, b.page, b.seq, max(CASE WHEN o.x2 <= b.x THEN (b.x + o.x2) / 2.0 END) AS l, min(CASE WHEN o.x >= b.x2 THEN (b.x2 + o.x) / 2.0 END) AS r FROM base b JOIN frame_obstacles o ON {same} AND o.owner <> b.seq AND {lone} GROUP BY b.doc_id, b.page, b.seq),
        wide AS (SELECT b.*, greatest(CAST(b.bx AS DOUBLE), coalesce(s.l, b.bx)) AS wx, least(CAST(b.bx2 AS DOUBLE), coalesce(s.r, b.bx2)) AS wx2 FROM base b LEFT JOIN sides s ON {PAGE.format("b", "s")} AND b.seq = s.seq),
        aligned AS (SELECT *, CASE WHEN centred THEN middle - least(middle - wx, wx2 - middle) ELSE wx END AS fx, CASE WHEN centred THEN middle + least(middle - wx, wx2 - middle) ELSE wx2 END AS fx2 FROM wide),
        heights AS (SELECT b.doc_id, b.page, b.seq, max(CASE WHEN o.y2 <= b.y THEN (b.y + o.y2) / 2.0 END) AS under, min(CASE WHEN o.y >= b.y2 THEN (b.y2 + o.y) / 2.0 END) AS over FROM aligned b JOIN frame_obstacles o ON {same} AND o.owner <> b.seq AND o.x2 > b.fx AND o.x < b.fx2 GROUP BY b.doc_id, b.page, b.seq),
        framed AS (SELECT * FROM (SELECT a.*, greatest({BOTTOM}.0, coalesce(h.under, {BOTTOM})) AS fy, least({TOP}.0, coalesce(h.over, {TOP})) AS fy2 FROM aligned a LEFT JOIN heights h ON {PAGE.format("a", "h")} AND a.seq = h.seq) AS __f WHERE fx2 > fx AND fy2 > fy AND baseline BETWEEN fy AND fy2)"""


@operator("xo28_layout_frames")
def layout_frames(d: Dialect) -> str:
    """Frame of each paragraph: from its left edge (a centred caption: its region's) to its region's right edge, cut halfway to
    the nearest obstacle on either side; then as high as halfway to the nearest obstacles above and below that lie within
    that width, to the page's edges where there are none. A frame that does not hold the first baseline is none."""
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("fx", "fy", "fx2", "fy2"))
    return f"WITH {frames(d)} SELECT doc_id, page, seq, {columns} FROM framed"


@operator("xo28_free_bands")
def free_bands(d: Dialect) -> str:
    """Free bands of each frame's width that meet its paragraph and are as high as its used height: what a sweep from the bottom
    leaves between the obstacles it meets, the nearest to the first baseline first, with the baseline moved as little as
    the band asks. The sweep's floor is a running maximum of the obstacles' tops."""
    order = "PARTITION BY doc_id, page, seq ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    carry = "f.doc_id, f.page, f.seq, f.x, f.y, f.y2, f.baseline, f.used"
    return f"""WITH {frames(d)}, blocked AS (SELECT {carry}, o.y - {CLEARANCE} AS lo, o.y2 + {CLEARANCE} AS hi FROM framed f JOIN frame_obstacles o ON {PAGE.format("f", "o")} AND o.owner <> f.seq AND o.x2 > f.fx AND o.x < f.fx2
            UNION ALL SELECT {carry}, {TOP}.0 AS lo, {TOP}.0 AS hi FROM framed f),
        swept AS (SELECT *, greatest({BOTTOM}.0, coalesce(max(hi) OVER ({order}), {BOTTOM})) AS low FROM blocked),
        bands AS (SELECT DISTINCT doc_id, page, seq, y, y2, baseline, used, CAST(low AS DOUBLE) AS low, CAST(least(lo, {TOP}) AS DOUBLE) AS high FROM swept WHERE lo > low AND low < {TOP}),
        fitting AS (SELECT *, CAST(least(greatest(baseline, low + baseline - y), high - (y + used - baseline)) AS DOUBLE) AS moved FROM bands WHERE high > y AND low < y2 AND high - low >= used)
        SELECT doc_id, page, seq, low, high, moved AS first_baseline, CAST(row_number() OVER (PARTITION BY doc_id, page, seq ORDER BY abs(moved - baseline), low) AS BIGINT) AS choice FROM fitting"""


@fold("xo28_column_reflow", "SELECT doc_id, page, seq, x, y, x2, y2, used FROM frame_paragraphs", "doc_id page", "seq", "doc_id long, page long, seq long, y double, y2 double, moved double, fits boolean")
def column_reflow(rows: list, top: float = TOP, bottom: float = BOTTOM) -> list[tuple]:
    """Paragraphs of a page with their new heights set anew, from the top down: each goes to the place nearest to its own top
    where its height is free between what is set already and what is still to come in its columns; one that fits nowhere
    keeps its place and says so."""
    left = {r.seq: (float(r.x), float(r.y), float(r.x2), float(r.y2)) for r in rows}
    out = []
    for r in sorted(rows, key=lambda r: (-r.y2, r.x, r.seq)):
        del left[r.seq]
        solid = [*left.values(), *((o[7], o[3], o[8], o[4]) for o in out)]
        taken = [(y, y2) for x, y, x2, y2 in solid if x2 > r.x and x < r.x2]
        floor, best = bottom, None
        for lo, hi in [*sorted(taken), (top, top)]:
            if lo - floor >= r.used:
                place = min(max(r.y2 - r.used, floor), lo - r.used)
                if best is None or abs(place + r.used - r.y2) < abs(best + r.used - r.y2):
                    best = place
            floor = max(floor, hi)
        y = float(r.y if best is None else best)
        y2 = float(r.y2 if best is None else best + r.used)
        out.append((r.doc_id, r.page, r.seq, y, y2, y2 - r.y2, best is not None, r.x, r.x2))
    return [o[:7] for o in out]


#: Lines of a page: glyphs of one height that follow one another with small gaps; and the page's regions.
LINES = f"""WITH ordered AS (SELECT doc_id, page, seq, i, x, y, x2, y2, lag(x2) OVER (PARTITION BY doc_id, page, y, y2 ORDER BY x, x2, seq, i) AS before FROM glyphs WHERE ch <> ' '),
    cut AS (SELECT *, sum(CASE WHEN before IS NULL OR x - before > {LINE_GAP} * (y2 - y) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, y, y2 ORDER BY x, x2, seq, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line FROM ordered)
    SELECT doc_id, page, CAST(NULL AS BIGINT) AS rid, 0 AS what, min(x) AS x, y, max(x2) AS x2, y2 FROM cut GROUP BY doc_id, page, y, y2, line
    UNION ALL SELECT doc_id, page, rid, 1 AS what, x, y, x2, y2 FROM regions WHERE label = 'text'"""


def page_starts(doc: np.ndarray, page: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])))


def lines_of_pages(doc: np.ndarray, page: np.ndarray, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> list[np.ndarray]:
    """The lines of ``LINES`` of whole pages, one after the other. Glyphs of a page and height that come in order, each
    beginning no more than the gap after the one before, are a run, which no glyph of any width can part; only runs are
    sorted. A run that begins beyond all before it goes on their line if it is near enough to the last glyph. Where a
    glyph's edges are the wrong way round, each glyph is a run of its own and the glyph before counts."""
    begin = page_starts(doc, page)
    group = np.repeat(np.arange(len(begin)), np.diff([*begin, len(x)]))
    gap = LINE_GAP * (y2 - y)
    plain = bool((x2 >= x).all() and (gap >= 0).all())
    new = np.ones(len(x), bool)
    if plain:
        step = x[1:] - x[:-1]
        new[1:] = (step < 0) | (step > gap[1:]) | (y[1:] != y[:-1]) | (y2[1:] != y2[:-1]) | (step == 0) & (x2[1:] < x2[:-1])
        new[begin] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    top = np.maximum.reduceat(x2, first)
    at = np.lexsort((x2[first], x[first], y2[first], y[first], group[first]))
    first, last, top = first[at], last[at], top[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (np.diff(group[first]) != 0) | (np.diff(y[first]) != 0) | (np.diff(y2[first]) != 0)
    before = last[:-1]
    if plain:  # of the runs so far of this page and height, the one whose last glyph is the last of all
        order = np.lexsort((x2[last], x[last]))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        rank += np.cumsum(begins) * len(at)
        before = last[order[np.maximum.accumulate(rank)[:-1] % len(at)]]
    cut = begins.copy()
    cut[1:] |= x[first[1:]] - x2[before] > gap[first[1:]]
    if plain:
        cut[1:] &= begins[1:] | (x[first[1:]] > x[before])
    line = np.flatnonzero(cut)
    head = first[line]
    return [doc[head], page[head], x[head], y[head], np.maximum.reduceat(top, line), y2[head]]


def lines_in_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a partition's glyphs, sorted by page; a batch's last page waits for what follows."""
    held: list[list[np.ndarray]] = []
    names = ("doc_id", "page", "x", "y", "x2", "y2")

    def out(pieces: list[list[np.ndarray]]) -> pa.RecordBatch:
        found = lines_of_pages(*(np.concatenate(c) for c in zip(*pieces)))
        return pa.RecordBatch.from_arrays([pa.array(v if k < 2 else v.astype(float)) for k, v in enumerate(found)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
        same = held and all(held[-1][k][-1] == new[k][0] for k in (0, 1))
        last = int(page_starts(*new[:2])[-1])
        if last or held and not same:
            whole = [*held, *([[v[:last] for v in new]] if last else [])]
            if whole:
                yield out(whole)
            held = []
        held.append([v[last:] for v in new])
    if held:
        yield out(held)


def lines_and_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``LINES`` gives, but that lines have region 0, and that glyphs of no document, which have no height and are on no
    line that a region meets, are left out. Glyphs are whole pages where they were dealt to and come in arrays, sorted by page."""
    box = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("x", "y", "x2", "y2"))
    glyphs = over_files(spark, with_clause(SPARK, "SELECT doc_id, page, x, y, x2, y2 FROM glyphs WHERE ch <> ' ' AND doc_id IS NOT NULL"), sf_dir)
    lines = glyphs.sortWithinPartitions("doc_id", "page").mapInArrow(lines_in_arrays, "doc_id long, page long, x double, y double, x2 double, y2 double")
    regions = over_files(lines.sparkSession, with_clause(SPARK, f"SELECT doc_id, page, CAST(rid AS BIGINT) AS rid, 1 AS what, {box} FROM regions WHERE label = 'text'"), sf_dir)
    return lines.selectExpr("doc_id", "page", "0L AS rid", "0 AS what", "x", "y", "x2", "y2").unionByName(regions)


#: Pairs of a region and a line of its page that are looked at together.
PAIRS = 1 << 19


def region_fixpoint_table(rows: pd.DataFrame, group: np.ndarray, begin: np.ndarray) -> pd.DataFrame:
    """``region_fixpoint`` of many pages: in each round all regions that grew meet the lines of their page that they have not
    taken in. Rows of a page: lines, then regions."""
    what = rows["what"].to_numpy()
    box = rows[["x", "y", "x2", "y2"]].to_numpy(float)
    is_line = what == 0
    count = np.bincount(group[is_line], minlength=len(begin))
    regions = np.flatnonzero(what == 1)
    grown, inside, rounds = box[regions], np.zeros(len(regions), np.int64), np.zeros(len(regions), np.int64)
    many = count[group[regions]]
    total, lo = np.cumsum(many), 0
    while lo < len(regions):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        n = many[lo:hi]
        region = np.repeat(np.arange(lo, hi), n)
        line = np.repeat(begin[group[regions[lo:hi]]] - np.cumsum(n) + n, n) + np.arange(len(region))
        while len(region):
            a, b = box[line], grown[region]
            met = (a[:, 0] < b[:, 2]) & (b[:, 0] < a[:, 2]) & (a[:, 1] < b[:, 3]) & (b[:, 1] < a[:, 3])
            who, taken = region[met], a[met]
            if not len(who):
                break
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            which = who[first]
            inside[which] += np.diff(np.append(first, len(who)))
            wide = np.concatenate([np.minimum.reduceat(taken[:, :2], first), np.maximum.reduceat(taken[:, 2:], first)], axis=1)
            wide = np.concatenate([np.minimum(wide[:, :2], grown[which, :2]), np.maximum(wide[:, 2:], grown[which, 2:])], axis=1)
            which = which[(wide != grown[which]).any(axis=1)]
            moved = np.zeros(hi - lo, bool)
            moved[which - lo] = True
            grown[who[first]] = wide
            rounds[which] += 1
            left = ~met & moved[region - lo]
            region, line = region[left], line[left]
        lo = hi
    if (rounds > many).any():
        raise RuntimeError("a region grew more often than there are lines")
    out = rows.iloc[regions]
    return pd.DataFrame({"doc_id": out["doc_id"].to_numpy(), "page": out["page"].to_numpy(), "rid": out["rid"].to_numpy(), "x": grown[:, 0], "y": grown[:, 1], "x2": grown[:, 2], "y2": grown[:, 3], "lines": inside, "rounds": rounds})


@fold("xo29_region_fixpoint", LINES, "doc_id page", "what rid y x", "doc_id long, page long, rid long, x double, y double, x2 double, y2 double, lines long, rounds long", table=region_fixpoint_table, made=lines_and_regions)
def region_fixpoint(rows: list) -> list[tuple]:
    """Text regions grown until they cut no line: a region takes in each line that it meets, whole, and what it has grown to may
    meet others. Each round takes a line at least, so that there are no more rounds than lines; a region is given with the
    rounds that it took. Lines are looked up by height, in order."""
    lines = sorted(((float(r.x), float(r.y), float(r.x2), float(r.y2)) for r in rows if r.what == 0), key=lambda b: b[1])
    out = []
    for r in (r for r in rows if r.what == 1):
        box, rounds, open_ = (float(r.x), float(r.y), float(r.x2), float(r.y2)), 0, lines
        inside = 0
        while True:
            met = [b for b in open_ if b[0] < box[2] and box[0] < b[2] and b[1] < box[3] and box[1] < b[3]]
            if not met:
                break
            inside += len(met)
            grown = (min(box[0], *(b[0] for b in met)), min(box[1], *(b[1] for b in met)), max(box[2], *(b[2] for b in met)), max(box[3], *(b[3] for b in met)))
            seen = set(met)
            open_ = [b for b in open_ if b not in seen]
            if grown == box:
                break
            box, rounds = grown, rounds + 1
            if rounds > len(lines):
                raise RuntimeError("a region grew more often than there are lines")
        out.append((r.doc_id, r.page, r.rid, *box, inside, rounds))
    return out
