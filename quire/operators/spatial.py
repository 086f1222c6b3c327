"""Boxes: characters and regions, overlaps, neighbours, layout lint."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..functions.geometry import area, inside, iou, meets, shared
from ..sources.derived import DEAL
from .catalog import operator, simple

# Thresholds of the layout lint, in points and ratios.
OUT_OF_PAGE, IOU, CONTAINED, FONT_SHRINK, FIGURE, SIZE_RATIO = 1, 0.15, 0.30, 0.85, 0.30, 0.2
CROP = (0, 0, 612, 792)
PRIORITY = "CASE r.label WHEN 'title' THEN 0 WHEN 'paragraph_title' THEN 1 WHEN 'text' THEN 2 WHEN 'figure_caption' THEN 3 WHEN 'table_caption' THEN 3 WHEN 'figure' THEN 9 ELSE 5 END"


def caption(label: str) -> str:
    return f"(right({label}, 8) = '_caption' OR right({label}, 9) = '_footnote' OR right({label}, 5) = '_text')"


#: Side of a cell, in points.
CELL = 128
CENTRE = "g.x + g.x2 BETWEEN 2 * r.x AND 2 * r.x2 AND g.y + g.y2 BETWEEN 2 * r.y AND 2 * r.y2"


def near(table: str, fields: str) -> str:
    """Common table expressions ``placed`` (glyphs, each in the cell of its lower left corner: cx, cy) and ``dealt`` (cells with the
    boxes of ``table`` that a glyph there may touch, a row for each: r, a struct). A box stands in every cell that it
    meets once it has grown to the left and down by the page's largest glyph, so that a glyph need look into one cell only,
    nothing is found twice, and what a glyph is compared with are its neighbours, however many boxes the page has. Boxes are
    cut to where the page has glyphs before they are dealt into cells; they are shuffled, few as they are, so that finding
    them and joining them do not share one task's memory. For Spark only: the check uses a plain join."""
    cells = lambda lo, hi: f"explode(CASE WHEN {hi} >= {lo} THEN sequence(CAST(floor(({lo}) / {CELL}) AS BIGINT), CAST(floor(({hi}) / {CELL}) AS BIGINT)) ELSE array() END)"
    sides = {c: (f"greatest(r.{c} - s.wide_{c}, s.low_{c})", f"least(r.{c}2, s.high_{c})") for c in "xy"}
    return f"""spans AS (SELECT doc_id, page, {", ".join(f"max({c}2 - {c}) AS wide_{c}, min({c}) AS low_{c}, max({c}) AS high_{c}" for c in "xy")} FROM glyphs GROUP BY doc_id, page),
        dealt AS (SELECT /*+ {DEAL} */ r.doc_id, r.page, struct({fields}) AS r, cx, cy FROM {table} r JOIN spans s ON r.doc_id = s.doc_id AND r.page = s.page LATERAL VIEW {cells(*sides["x"])} AS cx LATERAL VIEW {cells(*sides["y"])} AS cy),
        placed AS (SELECT *, CAST(floor(x / {CELL}) AS BIGINT) AS cx, CAST(floor(y / {CELL}) AS BIGINT) AS cy FROM glyphs)"""


#: Cells' boxes are the small side of their join: hashed, so that glyphs need no sort.
HASHED = "/*+ SHUFFLE_HASH(n) */"
SAME_CELL = "g.doc_id = n.doc_id AND g.page = n.page AND g.cx = n.cx AND g.cy = n.cy"
SIDES = "r.x, r.y, r.x2, r.y2"


@operator("jn01_char_region")
def char_region(d: Dialect) -> str:
    """Each character's best region: label priority, then share of its area, then region order."""
    if d.name == "duckdb":
        return f"""WITH c AS (SELECT g.doc_id, g.page, g.seq, g.i, r.rid, r.label, row_number() OVER (PARTITION BY g.doc_id, g.seq, g.i ORDER BY {PRIORITY}, {shared("g", "r")} DESC, r.rid) AS n
            FROM glyphs g JOIN regions r ON g.doc_id = r.doc_id AND g.page = r.page AND {meets("g", "r")}) SELECT doc_id, page, seq, i, rid, label FROM c WHERE n = 1"""
    # A glyph's best box is the one that no other of its cell beats; both joins look boxes up in a hash, in compiled code.
    part = shared("g", "n.r")
    return f"""WITH {near("regions", f"{PRIORITY} AS rank, r.rid, r.label, {SIDES}")}, alone AS (SELECT DISTINCT * FROM dealt), met AS (SELECT {HASHED} g.doc_id, g.page, g.seq, g.i, g.x, g.y, g.x2, g.y2, g.cx, g.cy, n.r, {part} AS part FROM placed g JOIN alone n ON {SAME_CELL} AND {meets('g', 'n.r')})
        SELECT {HASHED} g.doc_id, g.page, g.seq, g.i, g.r.rid, g.r.label FROM met g LEFT ANTI JOIN dealt n ON {SAME_CELL} AND {meets('g', 'n.r')} AND (n.r.rank < g.r.rank OR n.r.rank = g.r.rank AND ({part} > g.part OR {part} = g.part AND n.r < g.r))"""


def anti(d: Dialect) -> str:
    return "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"


def semi(d: Dialect) -> str:
    return "LEFT SEMI JOIN" if d.name == "spark" else "SEMI JOIN"


@operator("jn02_uncovered_chars")
def uncovered_chars(d: Dialect) -> str:
    """Characters that no region overlaps."""
    if d.name == "duckdb":
        return f"SELECT g.doc_id, g.page, g.seq, g.i FROM glyphs g {anti(d)} regions r ON g.doc_id = r.doc_id AND g.page = r.page AND {meets('g', 'r')}"
    return f"WITH {near('regions', SIDES)} SELECT {HASHED} g.doc_id, g.page, g.seq, g.i FROM placed g LEFT ANTI JOIN dealt n ON {SAME_CELL} AND {meets('g', 'r')}"


@operator("jn03_glyph_centre")
def glyph_centre(d: Dialect) -> str:
    """Glyphs whose centre lies in a region, edges included."""
    if d.name == "duckdb":
        return f"SELECT g.doc_id, g.seq, g.i FROM glyphs g {semi(d)} regions r ON g.doc_id = r.doc_id AND g.page = r.page AND {CENTRE}"
    return f"WITH {near('regions', SIDES)} SELECT {HASHED} g.doc_id, g.seq, g.i FROM placed g LEFT SEMI JOIN dealt n ON {SAME_CELL} AND {CENTRE}"


@operator("jn04_char_span")
def char_span(d: Dialect) -> str:
    """Each character's provider box: by centre (one point of tolerance), else by 0.6 of its area; ambiguous if several."""
    centre = "g.x + g.x2 BETWEEN 2 * b.x - 2 AND 2 * b.x2 + 2 AND g.y + g.y2 BETWEEN 2 * b.y - 2 AND 2 * b.y2 + 2"
    if d.name == "duckdb":
        return f"""WITH hit AS (SELECT g.doc_id, g.seq, g.i, b.seq AS box, 1 AS rank, {area("b")} AS a FROM glyphs g JOIN boxes b ON g.doc_id = b.doc_id AND g.page = b.page AND {centre}),
            rest AS (SELECT g.* FROM glyphs g {anti(d)} hit h ON g.doc_id = h.doc_id AND g.seq = h.seq AND g.i = h.i),
            second AS (SELECT g.doc_id, g.seq, g.i, b.seq AS box, 2 AS rank, {area("b")} AS a FROM rest g JOIN boxes b ON g.doc_id = b.doc_id AND g.page = b.page AND {inside("g", "b")} >= 0.6),
            every_hit AS (SELECT * FROM hit UNION ALL SELECT * FROM second), ranked AS (SELECT *, count(*) OVER (PARTITION BY doc_id, seq, i) AS many, row_number() OVER (PARTITION BY doc_id, seq, i ORDER BY rank, a, box) AS n FROM every_hit)
            SELECT doc_id, seq, i, box, CAST(rank AS BIGINT) AS stage, many > 1 AS ambiguous FROM ranked WHERE n = 1"""
    # What a centre is compared with hangs on its height and its stretch of that height only. Pieces are the stretches' parts
    # between edges of boxes, a point or what lies between two, so that no two hold one centre: glyphs look theirs up in a
    # hash, in compiled code. A box that holds 0.6 of a glyph's area holds its middle on both axes, so that the second stage
    # finds nothing that the first has left.
    return f"""WITH centred AS (SELECT doc_id, page, seq, i, x + x2 AS mx, y + y2 AS my, floor((x + x2) / {2 * CELL}) AS cell FROM glyphs),
        stretches AS (SELECT doc_id, page, my, cell, min(mx) AS low, max(mx) AS high FROM centred GROUP BY doc_id, page, my, cell),
        held AS (SELECT /*+ SHUFFLE_HASH(b) */ s.doc_id, s.page, s.my, s.cell, s.low, s.high, array_sort(collect_list(struct({area("b")} AS a, b.seq AS box, greatest(2 * b.x - 2, s.low) AS lo, least(2 * b.x2 + 2, s.high) AS hi))) AS bs
            FROM stretches s JOIN boxes b ON s.doc_id = b.doc_id AND s.page = b.page AND s.my BETWEEN 2 * b.y - 2 AND 2 * b.y2 + 2 AND s.high >= 2 * b.x - 2 AND s.low <= 2 * b.x2 + 2 AND b.x2 - b.x >= -2 GROUP BY s.doc_id, s.page, s.my, s.cell, s.low, s.high),
        edged AS (SELECT *, array_sort(array_distinct(flatten(transform(bs, b -> array(b.lo, b.hi))))) AS es FROM held),
        cut AS (SELECT doc_id, page, my, cell, bs, p.lo, p.hi, p.open FROM edged LATERAL VIEW explode(CASE WHEN size(bs) = 1 THEN array(struct(es[0] AS lo, es[size(es) - 1] AS hi, false AS open))
            ELSE concat(transform(es, e -> struct(e AS lo, e AS hi, false AS open)), transform(slice(es, 2, size(es) - 1), (e, k) -> struct(es[k] AS lo, e AS hi, true AS open))) END) AS p),
        pieces AS (SELECT doc_id, page, my, cell, lo, hi, open, found[0].box AS box, size(found) > 1 AS ambiguous FROM cut LATERAL VIEW explode(array(filter(bs, b -> b.lo <= cut.lo AND cut.hi <= b.hi))) AS found WHERE size(found) > 0)
        SELECT /*+ SHUFFLE_HASH(n) */ g.doc_id, g.seq, g.i, n.box, 1L AS stage, n.ambiguous FROM centred g JOIN pieces n ON g.doc_id = n.doc_id AND g.page = n.page AND g.my = n.my AND g.cell = n.cell AND (g.mx > n.lo OR NOT n.open AND g.mx = n.lo) AND (g.mx < n.hi OR NOT n.open AND g.mx = n.hi)"""


@operator("jn06_curve_formula")
def curve_formula(d: Dialect) -> str:
    """Each link box goes to the unit that holds it: 0.95 of it or more is exact and outranks 0.5 or more."""
    return f"""WITH c AS (SELECT l.doc_id, l.ord, b.seq, CASE WHEN {inside("l", "b")} >= 0.95 THEN 0 ELSE 1 END AS tier, {inside("l", "b")} AS part FROM links l JOIN boxes b ON l.doc_id = b.doc_id AND l.page = b.page AND {inside("l", "b")} >= 0.5),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY tier, part DESC, seq) AS n FROM c) SELECT doc_id, ord, seq, CAST(tier AS BIGINT) AS tier, part FROM r WHERE n = 1"""


simple("jn07_isolated_formula", "Regions of reference kind that no text region overlaps by half.", lambda d: f"SELECT r.doc_id, r.rid FROM regions r {anti(d)} regions t ON r.doc_id = t.doc_id AND r.page = t.page AND t.label = 'text' AND {inside('r', 't')} >= 0.5 WHERE r.label = 'reference'")


#: Labels whose paragraphs are left as they are: two of them never count as an overlap.
FIXED = "('table', 'header', 'footer', 'reference', 'figure')"


def overlaps() -> str:
    return f"""SELECT a.doc_id, a.page, a.seq AS first, b.seq AS second, {iou("a", "b")} AS iou, greatest({inside("a", "b")}, {inside("b", "a")}) AS contained FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq < b.seq AND {meets("a", "b")}
        WHERE NOT ((a.label LIKE 'figure%' OR a.label LIKE 'table%') AND (b.label LIKE 'figure%' OR b.label LIKE 'table%')) AND NOT (a.label IN {FIXED} AND b.label IN {FIXED}) AND least({area("a")}, {area("b")}) / CAST(greatest({area("a")}, {area("b")}, 1) AS DOUBLE) >= {SIZE_RATIO} AND ({iou("a", "b")} > {IOU} OR greatest({inside("a", "b")}, {inside("b", "a")}) > {CONTAINED})"""


def on_figures() -> str:
    rendered = inside("b", "r")
    source = "(CASE WHEN greatest(0, b.x2 - b.x) * greatest(0, b.sy2 - b.sy) > 0 THEN greatest(0, least(b.x2, r.x2) - greatest(b.x, r.x)) * greatest(0, least(b.sy2, r.y2) - greatest(b.sy, r.y)) / CAST(greatest(0, b.x2 - b.x) * greatest(0, b.sy2 - b.sy) AS DOUBLE) ELSE 0.0 END)"
    return f"SELECT b.doc_id, b.page, b.seq, r.rid, {rendered} AS overlap FROM boxes b JOIN regions r ON b.doc_id = r.doc_id AND b.page = r.page AND r.label IN ('figure', 'table') AND {meets('b', 'r')} WHERE NOT {caption('b.label')} AND {source} <= {FIGURE} AND {rendered} > {FIGURE}"


OVERFLOW = f"greatest(0, {CROP[0]} - b.x, {CROP[1]} - b.y, b.x2 - {CROP[2]}, b.y2 - {CROP[3]})"


def lint() -> str:
    return f"""SELECT b.doc_id, b.page, b.seq, 'out_of_page' AS code, 'P0' AS severity FROM boxes b WHERE {OVERFLOW} > {OUT_OF_PAGE} UNION ALL
        SELECT b.doc_id, b.page, b.seq, 'font_shrink' AS code, 'P1' AS severity FROM boxes b WHERE b.font10 * 100 < {int(FONT_SHRINK * 100)} * b.src_font * 10 UNION ALL
        SELECT doc_id, page, seq, 'figure_overlap' AS code, 'P1' AS severity FROM ({on_figures()}) f UNION ALL SELECT doc_id, page, first AS seq, 'paragraph_overlap' AS code, 'P1' AS severity FROM ({overlaps()}) o"""


simple("jn08_paragraph_overlap", "Pairs of paragraphs that overlap.", lambda d: overlaps())
simple("jn09_figure_overlap", "Paragraphs that came to lie on a figure or table.", lambda d: on_figures())
simple("qc04_layout_lint", "All findings of the layout lint.", lambda d: lint())
simple("pf15_lint_filter", "Findings of severity P1 or worse on the first two pages.", lambda d: f"WITH f AS ({lint()}) SELECT doc_id, page, seq, code FROM f WHERE page <= 1 AND CASE severity WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 ELSE 2 END <= 1 AND code <> 'figure_overlap'")
simple("ag14_lint_counts", "Findings by code, severity and in total.", lambda d: f"WITH f AS ({lint()}) SELECT code, severity, count(*) AS n FROM f GROUP BY GROUPING SETS ((code, severity), ())")
simple("qc08_title_shrink", "Titles set in less than 0.85 of their size.", "SELECT doc_id, seq, src_font, font10 FROM boxes WHERE label IN ('title', 'paragraph_title') AND font10 * 100 < 85 * src_font * 10")
simple("jn10_space_below", "Free space below each box, down to the next one that shares its column.", "SELECT a.doc_id, a.seq, greatest(0, a.y - coalesce(max(b.y2), 0)) AS space FROM boxes a LEFT JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq <> b.seq AND b.y2 * 2 <= a.y * 2 + 1 AND least(a.x2, b.x2) - greatest(a.x, b.x) > 1 GROUP BY a.doc_id, a.seq, a.y")
simple("jn11_unique_block", "Regions that hold 0.8 or more of exactly one paragraph.", lambda d: f"SELECT r.doc_id, r.rid, max(b.seq) AS seq FROM regions r JOIN boxes b ON r.doc_id = b.doc_id AND r.page = b.page AND {inside('b', 'r')} >= 0.8 GROUP BY r.doc_id, r.rid HAVING count(*) = 1")
simple("jn18_link_chars", "Characters under each link, and the paragraphs they belong to.", lambda d: f"SELECT {d.hashed('l')}l.doc_id, l.ord, count(*) AS chars, count(DISTINCT g.seq) AS paragraphs, {d.listed('CAST(g.i AS STRING)', 'g.seq, g.i')} AS places FROM links l JOIN glyphs g ON l.doc_id = g.doc_id AND l.page = g.page AND ({shared('g', 'l')} * 2 >= {area('g')} OR (g.x + g.x2 BETWEEN 2 * l.x AND 2 * l.x2 AND g.y + g.y2 BETWEEN 2 * l.y AND 2 * l.y2)) GROUP BY l.doc_id, l.ord")
simple("jn19_spilled_line", "For each box the later one that its centre falls in: nearest page, then smallest.", lambda d: f"WITH c AS (SELECT a.doc_id, a.seq, b.seq AS into_seq, row_number() OVER (PARTITION BY a.doc_id, a.seq ORDER BY b.page - a.page, {area('b')}, b.seq) AS n FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND b.seq > a.seq AND b.page - a.page BETWEEN 0 AND 2 AND a.x + a.x2 BETWEEN 2 * b.x AND 2 * b.x2 AND a.y + a.y2 BETWEEN 2 * b.y AND 2 * b.y2) SELECT doc_id, seq, into_seq FROM c WHERE n = 1")
simple("jn24_locate_box", "The twenty paragraphs that overlap a given box most.", lambda d: f"WITH q AS (SELECT 100 AS x, 500 AS y, 300 AS x2, 700 AS y2) SELECT b.doc_id, b.page, b.seq, {iou('b', 'q')} AS score FROM boxes b, q WHERE {meets('b', 'q')} ORDER BY score DESC, b.page, b.doc_id, b.seq LIMIT 20")
simple("jn24_locate_text", "The first paragraphs that hold a given text.", "SELECT doc_id, page, seq FROM units WHERE lower(source) LIKE '%license%' ORDER BY page, doc_id, seq LIMIT 30")
simple("jn28_unique_owner", "Links that lie in exactly one box.", lambda d: f"SELECT l.doc_id, l.ord, max(b.seq) AS owner FROM links l JOIN boxes b ON l.doc_id = b.doc_id AND l.page = b.page AND {meets('l', 'b')} GROUP BY l.doc_id, l.ord HAVING count(*) = 1")
simple("jn17_rect_cascade", "A link's rectangle: its own output, else its paragraph's box, with the method.", "SELECT l.doc_id, l.ord, coalesce(o.x, b.x) AS x, coalesce(o.y, b.y) AS y, CASE WHEN o.ord IS NOT NULL THEN 'anchor' WHEN b.seq IS NOT NULL THEN 'paragraph' ELSE 'unresolved' END AS method FROM links l LEFT JOIN out_links o ON l.doc_id = o.doc_id AND l.ord = o.ord LEFT JOIN boxes b ON l.doc_id = b.doc_id AND l.ord = b.seq")
simple("jn29_nested_cells", "Table cells appended to the page's regions.", "SELECT doc_id, page, rid, label FROM regions UNION ALL SELECT doc_id, page, 200000 + seq AS rid, 'table_cell' AS label FROM boxes WHERE label = 'table'")
simple("fm01_box_measures", "Area, intersection and IoU of neighbours.", lambda d: f"SELECT a.doc_id, a.seq, {area('a')} AS area, {shared('a', 'b')} AS shared, {iou('a', 'b')} AS iou FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND b.seq = a.seq + 2")
simple("fm02_contained", "Intersection over the first box's area.", lambda d: f"SELECT b.doc_id, b.seq, r.rid, {inside('b', 'r')} AS part FROM boxes b JOIN regions r ON b.doc_id = r.doc_id AND b.page = r.page AND {meets('b', 'r')}")
simple("fm03_y_overlap", "Vertical overlap by the first height and by the smaller.", "SELECT a.doc_id, a.seq, greatest(0, least(a.y2, b.y2) - greatest(a.y, b.y)) / CAST(a.y2 - a.y AS DOUBLE) AS of_first, greatest(0, least(a.y2, b.y2) - greatest(a.y, b.y)) / CAST(least(a.y2 - a.y, b.y2 - b.y) AS DOUBLE) AS of_smaller FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND b.seq = a.seq + 1")
simple("fm04_box_distance", "Distance between the nearest edges of neighbours.", "SELECT a.doc_id, a.seq, sqrt(CAST(greatest(0, b.x - a.x2, a.x - b.x2) * greatest(0, b.x - a.x2, a.x - b.x2) + greatest(0, b.y - a.y2, a.y - b.y2) * greatest(0, b.y - a.y2, a.y - b.y2) AS DOUBLE)) AS distance FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND b.seq = a.seq + 3")
simple("fm05_y_flip", "Boxes with the origin at the top left.", "SELECT doc_id, seq, x, 792 - y2 AS y, x2, 792 - y AS y2 FROM boxes")
simple("fm07_overflow", "How far a box passes a crop box (55, 150, 550, 745).", "SELECT doc_id, seq, greatest(0, 55 - x, 150 - y, x2 - 550, y2 - 745) AS overflow FROM boxes WHERE greatest(0, 55 - x, 150 - y, x2 - 550, y2 - 745) > 0")
@operator("ag01_coverage")
def coverage(d: Dialect) -> str:
    """Characters a page and in all, uncovered ones and white space."""
    if d.name == "duckdb":
        return f"WITH u AS (SELECT g.doc_id, g.seq, g.i FROM glyphs g {anti(d)} regions r ON g.doc_id = r.doc_id AND g.page = r.page AND {meets('g', 'r')}), m AS (SELECT g.doc_id, g.page, g.ch, u.i IS NOT NULL AS bare FROM glyphs g LEFT JOIN u ON g.doc_id = u.doc_id AND g.seq = u.seq AND g.i = u.i) SELECT doc_id, page, count(*) AS total, count_if(bare AND ch <> ' ') AS uncovered, count_if(ch = ' ') AS blanks, CASE WHEN count_if(ch <> ' ') = 0 THEN 1.0 ELSE 1.0 - count_if(bare AND ch <> ' ') / CAST(count_if(ch <> ' ') AS DOUBLE) END AS ratio FROM m GROUP BY ROLLUP (doc_id, page)"
    # Here and below glyphs are counted once in all and once as a join in compiled code leaves them.
    return f"""WITH {near("regions", SIDES)}, counted AS (SELECT doc_id, page, count(*) AS total, count_if(ch = ' ') AS blanks, count_if(ch <> ' ') AS signs FROM glyphs GROUP BY doc_id, page),
        bare AS (SELECT {HASHED} g.doc_id, g.page, count(*) AS uncovered FROM placed g LEFT ANTI JOIN dealt n ON {SAME_CELL} AND {meets("g", "n.r")} WHERE g.ch <> ' ' GROUP BY g.doc_id, g.page),
        by_page AS (SELECT /*+ SHUFFLE_HASH(b) */ t.doc_id, t.page, t.total, coalesce(b.uncovered, 0) AS uncovered, t.blanks, t.signs FROM counted t LEFT JOIN bare b ON t.doc_id = b.doc_id AND t.page <=> b.page)
        SELECT doc_id, page, sum(total) AS total, sum(uncovered) AS uncovered, sum(blanks) AS blanks, CASE WHEN sum(signs) = 0 THEN 1.0D ELSE 1.0D - sum(uncovered) / CAST(sum(signs) AS DOUBLE) END AS ratio FROM by_page GROUP BY ROLLUP (doc_id, page)"""


@operator("ag02_coverage_gate")
def coverage_gate(d: Dialect) -> str:
    """Documents of which more than 0.005 of the characters are uncovered."""
    if d.name == "duckdb":
        return f"WITH u AS (SELECT g.doc_id, g.seq, g.i FROM glyphs g {anti(d)} regions r ON g.doc_id = r.doc_id AND g.page = r.page AND {meets('g', 'r')}), t AS (SELECT doc_id, count(*) AS n FROM glyphs GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id) SELECT t.doc_id, t.n AS total, coalesce(b.n, 0) AS uncovered, coalesce(b.n, 0) * 1000 > t.n * 5 AS fails FROM t LEFT JOIN b ON t.doc_id = b.doc_id"
    return f"""WITH {near("regions", SIDES)}, t AS (SELECT doc_id, count(*) AS n FROM glyphs GROUP BY doc_id), b AS (SELECT {HASHED} g.doc_id, count(*) AS n FROM placed g LEFT ANTI JOIN dealt n ON {SAME_CELL} AND {meets("g", "n.r")} GROUP BY g.doc_id)
        SELECT /*+ SHUFFLE_HASH(b) */ t.doc_id, t.n AS total, coalesce(b.n, 0) AS uncovered, coalesce(b.n, 0) * 1000 > t.n * 5 AS fails FROM t LEFT JOIN b ON t.doc_id = b.doc_id"""


@operator("ag03_glyph_report")
def glyph_report(d: Dialect) -> str:
    """Glyphs with their centre in a region, by page."""
    if d.name == "duckdb":
        return f"WITH c AS (SELECT g.doc_id, g.seq, g.i FROM glyphs g {semi(d)} regions r ON g.doc_id = r.doc_id AND g.page = r.page AND {CENTRE}) SELECT g.doc_id, g.page, count(*) AS glyphs, count(c.i) AS covered FROM glyphs g LEFT JOIN c ON g.doc_id = c.doc_id AND g.seq = c.seq AND g.i = c.i GROUP BY g.doc_id, g.page"
    return f"""WITH {near('regions', SIDES)}, t AS (SELECT doc_id, page, count(*) AS glyphs FROM glyphs GROUP BY doc_id, page),
        c AS (SELECT {HASHED} g.doc_id, g.page, count(*) AS covered FROM placed g LEFT SEMI JOIN dealt n ON {SAME_CELL} AND {CENTRE.replace('r.', 'n.r.')} GROUP BY g.doc_id, g.page)
        SELECT /*+ SHUFFLE_HASH(c) */ t.doc_id, t.page, t.glyphs, coalesce(c.covered, 0) AS covered FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.page = c.page"""


simple("ag11_box_union", "Box around all of a page's boxes.", "SELECT doc_id, page, min(x) AS x, min(y) AS y, max(x2) AS x2, max(y2) AS y2 FROM boxes GROUP BY doc_id, page")
simple("ag12_geometry_summary", "Per page: union, fonts, counts.", "SELECT doc_id, page, min(x) AS x, max(y2) AS y2, min(src_font) AS min_font, max(src_font) AS max_font, count(*) AS n, count(DISTINCT label) AS labels FROM boxes GROUP BY doc_id, page")
simple("wf24_free_slot", "The topmost free vertical slot of sixty points in each page.", lambda d: f"WITH e AS (SELECT doc_id, page, y, y2 FROM boxes UNION ALL SELECT DISTINCT doc_id, page, -100 AS y, 0 AS y2 FROM boxes), o AS (SELECT *, coalesce(min(y) OVER (PARTITION BY doc_id, page ORDER BY y2 DESC, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 792) AS ceiling FROM e) SELECT doc_id, page, max(ceiling) AS top, max_by(y2, {d.tuple('ceiling', '-y2')}) AS bottom FROM o WHERE ceiling - y2 >= 60 GROUP BY doc_id, page")
simple("wf25_expand_box", "How far each box can grow down and up before it meets another.", "SELECT a.doc_id, a.seq, coalesce(max(CASE WHEN b.y2 <= a.y THEN b.y2 END), 0) AS down_to, coalesce(min(CASE WHEN b.y >= a.y2 THEN b.y END), 792) AS up_to FROM boxes a LEFT JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq <> b.seq AND least(a.x2, b.x2) > greatest(a.x, b.x) GROUP BY a.doc_id, a.seq")
simple("xo13_expand_four_ways", "Nearest obstacles in all four directions; the page's edge where there is none.", "SELECT a.doc_id, a.seq, coalesce(max(CASE WHEN b.x2 <= a.x AND least(a.y2, b.y2) > greatest(a.y, b.y) THEN b.x2 END), 0) AS left_to, coalesce(min(CASE WHEN b.x >= a.x2 AND least(a.y2, b.y2) > greatest(a.y, b.y) THEN b.x END), 612) AS right_to, coalesce(max(CASE WHEN b.y2 <= a.y AND least(a.x2, b.x2) > greatest(a.x, b.x) THEN b.y2 END), 0) AS down_to, coalesce(min(CASE WHEN b.y >= a.y2 AND least(a.x2, b.x2) > greatest(a.x, b.x) THEN b.y END), 792) AS up_to FROM boxes a LEFT JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq <> b.seq GROUP BY a.doc_id, a.seq")
simple("xo09_decoration", "Link boxes outside figures and tables.", lambda d: f"SELECT l.doc_id, l.ord FROM links l {anti(d)} regions r ON l.doc_id = r.doc_id AND l.page = r.page AND r.label IN ('figure', 'table') AND {meets('l', 'r')}")
simple("xo03_single_char_marker", "Small boxes that hold exactly one character.", lambda d: f"SELECT {d.hashed('l')}g.doc_id, g.seq, l.ord, min(g.i) AS i FROM links l JOIN glyphs g ON l.doc_id = g.doc_id AND l.page = g.page AND g.x >= l.x AND g.x2 <= l.x + 12 AND g.y >= l.y - 4 AND g.y2 <= l.y + 14 GROUP BY g.doc_id, g.seq, l.ord HAVING count(*) = 1")
simple("xo27_apply_overrides", "Boxes after overrides: scaled from the top left corner.", "SELECT b.doc_id, b.seq, b.x, b.y2 - (b.y2 - b.y) * coalesce(o.height10, 10) / CAST(10 AS DOUBLE) AS y, b.x + (b.x2 - b.x) * coalesce(o.width10, 10) / CAST(10 AS DOUBLE) AS x2, b.y2 FROM boxes b LEFT JOIN box_overrides o ON b.doc_id = o.doc_id AND b.seq = o.seq")
simple("xo12_descent", "Boxes shifted by their page's most common font size (ties: larger).", lambda d: f"WITH c AS (SELECT doc_id, page, src_font, count(*) AS n FROM boxes GROUP BY doc_id, page, src_font), m AS (SELECT doc_id, page, max_by(src_font, {d.tuple('n', 'src_font')}) AS f FROM c GROUP BY doc_id, page) SELECT b.doc_id, b.seq, b.y - m.f AS y, b.y2 - m.f AS y2 FROM boxes b JOIN m ON b.doc_id = m.doc_id AND b.page = m.page")
simple("xo22_fill_ratio", "Width of the glyphs of each visual row against its box.", "SELECT g.doc_id, g.seq, g.y, CAST(sum(g.x2 - g.x) AS BIGINT) AS ink, CAST(sum(g.x2 - g.x) AS BIGINT) / CAST(max(b.x2 - b.x) AS DOUBLE) AS fill FROM glyphs g JOIN boxes b ON g.doc_id = b.doc_id AND g.seq = b.seq GROUP BY g.doc_id, g.seq, g.y")
