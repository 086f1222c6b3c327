"""Region repair, captions, page frames and the remaining streaming rules in their table form."""

from __future__ import annotations

from .catalog import simple
from .quality import PLACEHOLDER

simple("jn27_caption_recovery", "Boxes within forty points below or above a figure that share its column: captions the layout missed.", "SELECT b.doc_id, b.page, b.seq, r.rid, CASE WHEN b.y2 <= r.y THEN 'below' ELSE 'above' END AS side FROM boxes b JOIN regions r ON b.doc_id = r.doc_id AND b.page = r.page AND r.label = 'figure' AND least(b.x2, r.x2) - greatest(b.x, r.x) > 20 AND (r.y - b.y2 BETWEEN 0 AND 40 OR b.y - r.y2 BETWEEN 0 AND 40)")
simple("xo29_region_growth", "Regions grown so that no text line they touch is cut.", lambda d: f"SELECT {d.hashed('r')}r.doc_id, r.page, r.rid, least(min(g.x), min(r.x)) AS x, least(min(g.y), min(r.y)) AS y, greatest(max(g.x2), max(r.x2)) AS x2, greatest(max(g.y2), max(r.y2)) AS y2, count(*) AS cut_glyphs FROM regions r JOIN glyphs g ON r.doc_id = g.doc_id AND r.page = g.page AND g.x < r.x2 AND r.x < g.x2 AND g.y < r.y2 AND r.y < g.y2 WHERE g.x < r.x OR g.x2 > r.x2 OR g.y < r.y OR g.y2 > r.y2 GROUP BY r.doc_id, r.page, r.rid")
simple("xo28_page_frames", "Frames of a page's columns and the free frame below each.", "SELECT doc_id, page, k % 2 AS col, min(x) AS x, max(x2) AS x2, max(y2) AS top, min(y) AS bottom, min(y) AS free_height, count(*) AS blocks FROM boxes GROUP BY doc_id, page, k % 2")
simple("qc13_stream_block", "Blocks of a stream that count: known id, the source's anchors in its order, first occurrence.", lambda d: f"WITH s AS (SELECT doc_id, seq, id, reply, source, row_number() OVER (PARTITION BY doc_id, id ORDER BY seq) AS n FROM replies) SELECT doc_id, seq, id, CASE WHEN n > 1 THEN 'repeated' WHEN NOT ({d.joined(d.found('source', PLACEHOLDER), ' ')} = {d.joined(d.found('reply', PLACEHOLDER), ' ')}) THEN 'anchors' ELSE 'accepted' END AS outcome FROM s")
simple("stm06_republish", "Pages to publish again: a manual edit landed after the page was complete.", "WITH p AS (SELECT document, CAST(floor(revision / 2) AS BIGINT) AS page, count(*) AS n, max(CASE WHEN origin = 'auto' THEN revision END) AS complete_at, max(CASE WHEN origin = 'manual' THEN revision END) AS edited_at FROM edits GROUP BY document, CAST(floor(revision / 2) AS BIGINT)) SELECT document, page, n, coalesce(edited_at > complete_at, false) AS republish FROM p")
simple("stm03_bounded_inbox", "What each subscriber finds in an inbox of sixty-four frames, oldest first, and how many older ones were dropped.", "WITH r AS (SELECT run_id, seq, kind, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS back FROM log), n AS (SELECT run_id, count(*) AS n FROM log GROUP BY run_id) SELECT s.subscriber, r.run_id, r.seq, CAST(r.run_id AS STRING) || ':' || CAST(r.seq AS STRING) AS frame, greatest(n.n - 64, 0) AS dropped FROM r JOIN n ON r.run_id = n.run_id JOIN subscriptions s ON r.run_id = s.run_id WHERE r.back <= 64")
simple(
    "stm10_rate_limit",
    "When each request may start: at its arrival, or one interval after the start before it, whichever is later. With n the place in its queue, start - n * interval is a running maximum of arrival - n * interval.",
    "WITH q AS (SELECT limiter, ord, arrived_us, interval_us, row_number() OVER (PARTITION BY limiter ORDER BY arrived_us, ord) AS n FROM requests), m AS (SELECT *, max(arrived_us - n * interval_us) OVER (PARTITION BY limiter ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base FROM q) SELECT limiter, ord, base + n * interval_us AS start_us, base + n * interval_us - arrived_us AS waited_us FROM m",
)
