"""Pairing by claims: log lines with the interval they fall in, links with the labels they belong to."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .catalog import operator


def _binned(d: Dialect, x: str, level: str) -> str:
    return d.div(x, f"CAST(power(2, {level}) AS BIGINT)")


@operator("xo19_line_owner")
def line_owner(d: Dialect) -> str:
    """Owner of each log line: the first segment whose lines hold the line's number; without a number, or in no segment, the
    segment of the last start marker before it; else none.

    The join is by bins. A segment's level is the number of binary digits of its length, so that it meets two bins of its
    level at most; a line looks into the bin of each level that its run has (64 at most). Cost goes with the segments that
    lie around a line, however long some are and however many a run has."""
    sized = "SELECT run_id, segment, lo, hi, CAST(length(bin(hi - lo)) AS BIGINT) AS level FROM log_segments WHERE hi >= lo"
    bins = d.unnest("sized", "run_id, segment, lo, hi, level", d.numbers(_binned(d, "lo", "level"), _binned(d, "hi", "level")), "cell")
    return f"""WITH sized AS ({sized}), cells AS (SELECT * FROM {bins} AS __c), levels AS (SELECT DISTINCT run_id, level FROM sized),
        probes AS (SELECT l.run_id, l.seq, l.number, v.level, {_binned(d, "l.number", "v.level")} AS cell FROM log_lines l JOIN levels v ON l.run_id = v.run_id WHERE l.number IS NOT NULL),
        held AS (SELECT p.run_id, p.seq, min(c.segment) AS segment FROM probes p JOIN cells c ON p.run_id = c.run_id AND p.level = c.level AND p.cell = c.cell AND p.number BETWEEN c.lo AND c.hi GROUP BY p.run_id, p.seq),
        marked AS (SELECT run_id, seq, is_issue, {d.carried("marker", "PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")} AS latest FROM log_lines)
        SELECT m.run_id, m.seq, coalesce(h.segment, m.latest) AS owner, CASE WHEN h.segment IS NOT NULL THEN 'number' WHEN m.latest IS NOT NULL THEN 'marker' ELSE 'none' END AS by_what
        FROM marked m LEFT JOIN held h ON m.run_id = h.run_id AND m.seq = h.seq WHERE m.is_issue"""


@operator("xo31_claimed_pairs")
def claimed_pairs(d: Dialect) -> str:
    """Links of a label with its places in the output, or none of them.

    First by destination: the places whose context is of the destination's kind, if there are as many as links; else all
    places, if the label has one destination and as many links as places. One destination that finds neither, or two that
    claim the same place, leave the label to the second way: of one destination, each link claims the occurrence of the
    label in the source that it stands on, if no other link claims it and the output has as many places as the source;
    the k-th occurrence is then the k-th place. What is still open is paired with nothing."""
    return """WITH places AS (SELECT doc_id, label, place, kind, row_number() OVER (PARTITION BY doc_id, label ORDER BY place) AS k, row_number() OVER (PARTITION BY doc_id, label, kind ORDER BY place) AS k_kind FROM label_places),
        counts AS (SELECT doc_id, label, count(*) AS n FROM places GROUP BY doc_id, label), kinds AS (SELECT doc_id, label, kind, count(*) AS n FROM places GROUP BY doc_id, label, kind),
        links_k AS (SELECT doc_id, label, destination, kind, ord, occurrence, row_number() OVER (PARTITION BY doc_id, label, destination ORDER BY ord) AS k FROM label_links),
        wanted AS (SELECT doc_id, label, destination, kind, count(*) AS n FROM links_k GROUP BY doc_id, label, destination, kind),
        labels_n AS (SELECT doc_id, label, count(*) AS destinations, count(DISTINCT kind) AS n_kinds FROM wanted GROUP BY doc_id, label),
        ways AS (SELECT w.doc_id, w.label, w.destination, w.kind, CASE WHEN l.n_kinds < l.destinations THEN 'open' WHEN coalesce(k.n, 0) = w.n THEN 'context' WHEN l.destinations = 1 AND coalesce(c.n, 0) = w.n THEN 'count' ELSE 'open' END AS way
            FROM wanted w JOIN labels_n l ON w.doc_id = l.doc_id AND w.label = l.label LEFT JOIN kinds k ON w.doc_id = k.doc_id AND w.label = k.label AND w.kind = k.kind LEFT JOIN counts c ON w.doc_id = c.doc_id AND w.label = c.label),
        closed AS (SELECT doc_id, label, max(CASE WHEN way = 'open' THEN 1 ELSE 0 END) = 0 AS done FROM ways GROUP BY doc_id, label),
        first_way AS (SELECT l.doc_id, l.label, l.ord, p.place, y.way FROM links_k l JOIN closed z ON l.doc_id = z.doc_id AND l.label = z.label AND z.done JOIN ways y ON l.doc_id = y.doc_id AND l.label = y.label AND l.destination = y.destination
            JOIN places p ON l.doc_id = p.doc_id AND l.label = p.label AND (y.way = 'count' AND p.k = l.k OR y.way = 'context' AND p.kind = l.kind AND p.k_kind = l.k)),
        claims AS (SELECT l.doc_id, l.label, count(*) AS n, count(l.occurrence) AS given, count(DISTINCT l.occurrence) AS distinct_given, count(DISTINCT l.destination) AS destinations, min(l.occurrence) AS least, max(l.occurrence) AS most FROM label_links l GROUP BY l.doc_id, l.label),
        second_way AS (SELECT l.doc_id, l.label, l.ord, p.place, 'occurrence' AS way FROM links_k l JOIN closed z ON l.doc_id = z.doc_id AND l.label = z.label AND NOT z.done
            JOIN claims m ON l.doc_id = m.doc_id AND l.label = m.label AND m.destinations = 1 AND m.given = m.n AND m.distinct_given = m.n JOIN label_sources s ON l.doc_id = s.doc_id AND l.label = s.label
            JOIN counts c ON l.doc_id = c.doc_id AND l.label = c.label AND c.n = s.occurrences JOIN places p ON l.doc_id = p.doc_id AND l.label = p.label AND p.k = l.occurrence WHERE m.least >= 1 AND m.most <= s.occurrences)
        SELECT doc_id, label, ord, place, way FROM first_way UNION ALL SELECT doc_id, label, ord, place, way FROM second_way"""
