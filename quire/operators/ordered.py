"""Ordered operators that plain windows and aggregates express, limits, multisets."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .catalog import operator, simple
from .quality import tokens

simple("ag04_common_translation", "Most common translation of each source term; of equals the one seen first.", lambda d: f"WITH c AS (SELECT src, tgt, count(*) AS n, min({d.tuple('doc_id', 'seq')}) AS first FROM term_pairs WHERE src <> '' GROUP BY src, tgt), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, first) AS k FROM c) SELECT src, tgt, n FROM r WHERE k = 1")
simple("ag05_style_mode", "Most common label of each page; of equals the first.", "WITH c AS (SELECT doc_id, page, label, count(*) AS n, min(seq) AS first FROM units GROUP BY doc_id, page, label), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, first) AS k FROM c) SELECT doc_id, page, label, n FROM r WHERE k = 1")
simple("ag06_mode_largest", "Most common font size; of equals the largest.", "WITH c AS (SELECT doc_id, src_font, count(*) AS n FROM boxes GROUP BY doc_id, src_font), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, src_font DESC) AS k FROM c) SELECT doc_id, src_font, n FROM r WHERE k = 1")
simple("ag07_scale_clamp", "Document mode of scales weighted by text length (ties: smallest); scales above it are clamped to it.", "WITH s AS (SELECT u.doc_id, u.seq, b.font10, length(u.source) AS w FROM units u JOIN boxes b ON u.doc_id = b.doc_id AND u.seq = b.seq), c AS (SELECT doc_id, font10, sum(w) AS w FROM s GROUP BY doc_id, font10), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, font10) AS k FROM c) SELECT s.doc_id, s.seq, least(s.font10, r.font10) AS font10 FROM s JOIN r ON s.doc_id = r.doc_id AND r.k = 1")
simple("ag08_common_style", "The font size that all of a page's boxes share, else null.", "SELECT doc_id, page, CASE WHEN count(DISTINCT src_font) = 1 THEN min(src_font) END AS font, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label FROM boxes GROUP BY doc_id, page")
simple("ag09_medians", "Median area, width and height of a page's boxes.", "SELECT doc_id, page, median((x2 - x) * (y2 - y)) AS area, median(x2 - x) AS width, median(y2 - y) AS height FROM boxes GROUP BY doc_id, page")
simple("ag13_line_count", "Lines of a unit's glyphs: gaps above 0.6 of the font size.", "WITH y AS (SELECT DISTINCT g.doc_id, g.seq, g.y, b.src_font FROM glyphs g JOIN boxes b ON g.doc_id = b.doc_id AND g.seq = b.seq), l AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, seq ORDER BY y DESC) AS above FROM y) SELECT doc_id, seq, CAST(1 + sum(CASE WHEN (above - y) * 10 > 6 * src_font THEN 1 ELSE 0 END) AS BIGINT) AS n_lines FROM l GROUP BY doc_id, seq")
simple("ag15_label_inventory", "Labels with their counts; none is a bucket of its own.", "SELECT label, count(*) AS n FROM label_records GROUP BY label")
simple("ag17_alignment_summary", "Share of glyphs that lie in a box, by document.", lambda d: f"WITH a AS (SELECT {d.hashed('b')}g.doc_id, count(*) AS n, count_if(g.x >= b.x AND g.x2 <= b.x2 AND g.y >= b.y AND g.y2 <= b.y2) AS hit FROM glyphs g JOIN boxes b ON g.doc_id = b.doc_id AND g.seq = b.seq GROUP BY g.doc_id) SELECT doc_id, n, hit, hit / CAST(n AS DOUBLE) AS coverage FROM a")
simple("ag23_document_counts", "Pages, paragraphs and translated ones; null where nothing is known, not 0.", "WITH t AS (SELECT doc_id, count_if(target <> '') AS n FROM targets GROUP BY doc_id) SELECT u.doc_id, count(DISTINCT u.page) AS pages, count(*) AS paragraphs, max(t.n) AS translated FROM units u LEFT JOIN t ON u.doc_id = t.doc_id GROUP BY u.doc_id")
simple("ag24_page_completeness", "Pages of which every unit has a translation.", "SELECT u.doc_id, u.page, count(*) AS expected, count_if(coalesce(t.target, '') <> '') AS translated, count(t.id) AS settled, count_if(coalesce(t.target, '') <> '') = count(*) AS complete FROM units u LEFT JOIN targets t ON u.doc_id = t.doc_id AND u.seq = t.seq GROUP BY u.doc_id, u.page")
simple("ag25_next_sequence", "Next sequence number of each run.", "SELECT run_id, coalesce(max(seq), 0) + 1 AS next_seq FROM log GROUP BY run_id")
simple("ag26_retry_statistics", "Units by violation code.", lambda d: f"WITH {tokens(d)}, bad AS (SELECT DISTINCT doc_id, seq, CASE WHEN actual < expected THEN 'placeholder_lost' ELSE 'placeholder_added' END AS code FROM diff WHERE expected <> actual) SELECT coalesce(b.code, 'none') AS code, count(*) AS n, count(DISTINCT r.doc_id) AS documents FROM replies r LEFT JOIN bad b ON r.doc_id = b.doc_id AND r.seq = b.seq GROUP BY coalesce(b.code, 'none')")
simple("ag27_toc_score", "Whether a page is a table of contents: five entry lines and 0.6 of all.", lambda d: f"SELECT doc_id, page, count(*) AS n_lines, count_if({d.like('line', '[. ]{2,}[0-9]+$')}) AS entries, count_if({d.like('line', '[. ]{2,}[0-9]+$')}) >= 5 AND count_if({d.like('line', '[. ]{2,}[0-9]+$')}) * 10 >= 6 * count(*) AS is_toc FROM toc_candidates GROUP BY doc_id, page")
simple("ag28_scanned_verdict", "Documents of which four fifths of the pages are flagged as scans.", "SELECT doc_id, count(*) AS pages, count_if(is_scan) * 10 >= 8 * count(*) AS scanned FROM page_flags GROUP BY doc_id")
simple("ag30_valid_totals", "Characters and words over parts of five hundred documents.", lambda d: f"SELECT {d.div('doc_id', '500')} AS part, CAST(sum(length(source)) AS BIGINT) AS chars, CAST(sum({d.times('source', '[^ ]+')}) AS BIGINT) AS words FROM units GROUP BY {d.div('doc_id', '500')}")
simple("ag32_unknown_types", "Unknown labels with their count and first page.", "SELECT label, count(*) AS n, min(page) AS first_page FROM regions WHERE label NOT IN ('text', 'title', 'figure') GROUP BY label")


@operator("ag33_acceptance_gates")
def acceptance_gates(d: Dialect) -> str:
    """Five gates of a document, each with its status and figure: coverage of the layout (equal to the bound passes), the
    same set of links in source and output, contents entries like their rows in order, protected tokens (for information),
    replies for exactly the known ids. A document is accepted if no hard gate fails; what can't be judged doesn't fail."""
    plain = lambda x: d.sub(d.sub(d.sub(f"coalesce({x}, '')", r"<style\b[^>]*>|</style>"), r"\[\[\s*/?\s*[SFsf]\s*[0-9]*\s*\]\]"), r"\s+")
    sides = lambda a, b, key: f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count_if(a.{key} IS NULL) + count_if(b.{key} IS NULL) AS bad FROM {a} a FULL OUTER JOIN {b} b ON a.doc_id = b.doc_id AND a.{key} = b.{key} GROUP BY coalesce(a.doc_id, b.doc_id)"
    gate = lambda name, table, hard, status, figure: f"SELECT g.doc_id, '{name}' AS gate, {hard} AS hard, CASE {status} END AS status, CAST(coalesce({figure}, 0) AS BIGINT) AS figure FROM gated_documents g LEFT JOIN {table} t ON g.doc_id = t.doc_id"
    judged = "WHEN coalesce(t.bad, 0) = 0 THEN 'pass' ELSE 'fail'"
    gates = " UNION ALL ".join((
        gate("layout_coverage", "coverage_reports", "true", "WHEN t.doc_id IS NULL THEN 'not_available' WHEN t.uncovered_chars * 1000 <= t.per_mille * t.total_chars THEN 'pass' ELSE 'fail'", "t.uncovered_chars"),
        gate("link_integrity", "uris", "g.rebuilt", f"WHEN NOT g.rebuilt THEN 'not_reconstructed' {judged}", "t.bad"),
        gate("toc_integrity", "toc", "true", f"WHEN NOT g.parsed THEN 'not_available' {judged}", "t.bad"),
        gate("protected_tokens", "tokens", "false", "WHEN NOT g.parsed THEN 'not_available' ELSE 'pass'", "t.n"),
        gate("protocol", "known", "true", f"WHEN NOT g.applied THEN 'not_available' {judged}", "t.bad"),
    ))
    return f"""WITH src AS (SELECT DISTINCT doc_id, uri FROM source_uris), dst AS (SELECT DISTINCT doc_id, uri FROM output_uris), uris AS ({sides("src", "dst", "uri")}),
        want AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, {plain("heading")} AS t FROM toc_headings), have AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, {plain("canonical")} AS t FROM toc_anchor_rows),
        toc AS (SELECT coalesce(w.doc_id, h.doc_id) AS doc_id, count_if(w.t IS DISTINCT FROM h.t) AS bad FROM want w FULL OUTER JOIN have h ON w.doc_id = h.doc_id AND w.n = h.n GROUP BY coalesce(w.doc_id, h.doc_id)),
        tokens AS (SELECT doc_id, sum({d.times("source", "[{]v[0-9]+[}]")}) AS n FROM units GROUP BY doc_id), ids AS (SELECT DISTINCT doc_id, id FROM units), said AS (SELECT DISTINCT doc_id, id FROM reply_ids), known AS ({sides("ids", "said", "id")}), gates AS ({gates})
        SELECT doc_id, gate, hard, status, figure, max(CASE WHEN hard AND status = 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 0 AS accepted FROM gates"""


simple("wf05_run_lengths", "Runs of consecutive units of one label.", "WITH f AS (SELECT doc_id, seq, label, CASE WHEN lag(label) OVER (PARTITION BY doc_id ORDER BY seq) = label THEN 0 ELSE 1 END AS new FROM units), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM f) SELECT doc_id, CAST(run AS BIGINT) AS run, min(label) AS label, min(seq) AS first_seq, count(*) AS n FROM g GROUP BY doc_id, run")
simple("wf09_line_groups", "Glyphs joined to lines by a vertical overlap of more than half with the one before.", "WITH o AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, seq ORDER BY y + y2 DESC, x, i) AS py, lag(y2) OVER (PARTITION BY doc_id, seq ORDER BY y + y2 DESC, x, i) AS py2 FROM glyphs), f AS (SELECT *, CASE WHEN 2 * (least(y2, py2) - greatest(y, py)) > least(y2 - y, py2 - py) THEN 0 ELSE 1 END AS new FROM o), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, seq ORDER BY y + y2 DESC, x, i) AS line FROM f) SELECT doc_id, seq, CAST(line AS BIGINT) AS line, count(*) AS n, min(x) AS x, max(x2) AS x2 FROM g GROUP BY doc_id, seq, line")


@operator("wf12_word_gaps")
def word_gaps(d: Dialect) -> str:
    """Text of each glyph line with a space where the gap to the next glyph reaches a tenth of the font size, 0.6 points
    at least."""
    return f"WITH n AS (SELECT {d.hashed('f')}g.*, f.src_font, lead(g.x) OVER (PARTITION BY g.doc_id, g.seq, g.y ORDER BY g.x) - g.x2 AS gap FROM glyphs g JOIN boxes f ON g.doc_id = f.doc_id AND g.seq = f.seq WHERE g.ch <> ' ') SELECT doc_id, seq, y, {d.nlisted('ch || CASE WHEN gap * 10 >= greatest(src_font, 6) AND gap > 1 THEN chr(32) ELSE chr(95) END', d.lit(''), 'x')} AS text FROM n GROUP BY doc_id, seq, y"


simple("wf13_page_ids", "Deterministic ids by page and order.", "SELECT doc_id, seq, id, 'P' || lpad(CAST(page + 1 AS STRING), 2, '0') || '-' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS STRING), 3, '0') AS by_order FROM units")
simple("wf14_short_line_split", "Paragraph starts: the line before is shorter than 0.8 of the document's median, or a bullet.", lambda d: f"WITH w AS (SELECT doc_id, seq, line, length(line) AS n FROM numbered), m AS (SELECT doc_id, median(n) AS mid FROM w GROUP BY doc_id), f AS (SELECT w.doc_id, w.seq, CASE WHEN lag(w.n) OVER (PARTITION BY w.doc_id ORDER BY w.seq) < 0.8 * m.mid OR {d.like('w.line', '^[-*•] ')} OR w.seq = 1 THEN 1 ELSE 0 END AS new FROM w JOIN m ON w.doc_id = m.doc_id) SELECT doc_id, seq, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS paragraph FROM f")
simple("wf19_neighbours", "Text before and after each unit.", "SELECT doc_id, seq, lag(id) OVER (PARTITION BY doc_id ORDER BY seq) AS before_id, lead(id) OVER (PARTITION BY doc_id ORDER BY seq) AS after_id, length(lag(source) OVER (PARTITION BY doc_id ORDER BY seq)) AS before_chars FROM units")
simple("wf20_carried_title", "The first title and the latest one at each unit.", lambda d: f"SELECT doc_id, seq, {d.carried(chr(39).join(['CASE WHEN label IN (', 'title', ', ', 'paragraph_title', ') THEN id END']), 'PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS latest_title, min(CASE WHEN label = 'title' THEN seq END) OVER (PARTITION BY doc_id) AS first_title FROM units")
simple(
    "wf21_toc_level",
    "Depth of contents entries: dots of the numbering plus one, else the page's distinct indents smaller by more than two points, plus one.",
    lambda d: f"WITH e AS (SELECT doc_id, page, seq, line, indent FROM toc_entries), i AS (SELECT DISTINCT doc_id, page, indent FROM e), s AS (SELECT e.doc_id, e.seq, count(i.indent) AS smaller FROM e LEFT JOIN i ON e.doc_id = i.doc_id AND e.page = i.page AND i.indent < e.indent - 2 GROUP BY e.doc_id, e.seq) SELECT e.doc_id, e.seq, CASE WHEN {d.like('e.line', r'^[0-9]+([.][0-9]+)* ')} THEN 1 + {d.times(d.group('e.line', r'^([0-9]+([.][0-9]+)*) ', 1), '[.]')} ELSE 1 + s.smaller END AS level FROM e JOIN s ON e.doc_id = s.doc_id AND e.seq = s.seq",
)
simple("wf22_tail", "The last ten events of each run, each number once (the last wins), ascending.", "WITH u AS (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY arrived DESC) AS k FROM arriving_events), t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS n FROM u WHERE k = 1) SELECT run_id, seq, ms FROM t WHERE n <= 10")
simple("wf23_line_spacing", "Upper median of the positive gaps between a unit's lines; 10 where there is none.", lambda d: f"WITH y AS (SELECT DISTINCT doc_id, seq, y FROM glyphs), g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, seq ORDER BY y DESC) - y AS gap FROM y), a AS (SELECT doc_id, seq, {d.collected('CASE WHEN gap > 0 THEN gap END')} AS gaps FROM g GROUP BY doc_id, seq), p AS (SELECT doc_id, seq, {d.present('gaps')} AS gaps FROM a) SELECT doc_id, seq, coalesce({d.at('gaps', d.div(d.size('gaps'), '2') + ' + 1')}, 10) AS spacing FROM p")


@operator("st01_multi_key_sort")
def multi_key_sort(d: Dialect) -> str:
    """Units by page descending, then label, then order."""
    if d.name == "duckdb":
        return "SELECT doc_id, seq, page, label, CAST(row_number() OVER (ORDER BY page DESC, label, doc_id, seq) AS BIGINT) AS place FROM units"
    # Ranks within ranges of the order, and the sums of what stands before each range: no window holds all units.
    return f"""WITH u AS (SELECT doc_id, seq, page, label, {d.div("doc_id", "500")} AS slab FROM units), p AS (SELECT page, label, slab, count(*) AS n FROM u GROUP BY page, label, slab),
        q AS (SELECT page, label, slab, sum(n) OVER (PARTITION BY page, label ORDER BY slab) - n AS inside FROM p), g AS (SELECT page, label, sum(n) AS n FROM p GROUP BY page, label), t AS (SELECT page, label, sum(n) OVER (ORDER BY page DESC, label) - n AS ahead FROM g),
        r AS (SELECT *, row_number() OVER (PARTITION BY page, label, slab ORDER BY doc_id, seq) AS k FROM u)
        SELECT r.doc_id, r.seq, r.page, r.label, CAST(t.ahead + q.inside + r.k AS BIGINT) AS place FROM r JOIN q ON r.page = q.page AND r.label = q.label AND r.slab = q.slab JOIN t ON r.page = t.page AND r.label = t.label"""


simple("st02_top_one", "The longest unit of each page; of equals the first.", "WITH r AS (SELECT doc_id, page, seq, length(source) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY length(source) DESC, seq) AS k FROM units) SELECT doc_id, page, seq, n FROM r WHERE k = 1")
simple("st03_limit", "The ten longest units.", "SELECT doc_id, seq, length(source) AS n FROM units ORDER BY n DESC, doc_id, seq LIMIT 10")
simple("st04_latest", "The latest revision of each document.", "SELECT document, max(revision) AS revision, max_by(target, revision) AS target FROM edits GROUP BY document")
simple("st05_keyset_page", "Events after a cursor, twenty a page, with the next cursor and whether there are more.", "WITH p AS (SELECT run_id, seq, ms, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM log WHERE seq > 30), q AS (SELECT * FROM p WHERE k <= 21) SELECT run_id, count_if(k <= 20) AS rows_out, max(CASE WHEN k <= 20 THEN seq END) AS next_after, count(*) > 20 AS has_more FROM q GROUP BY run_id")
simple("st06_priority_queue", "Waiting batches in the order they are taken: most tokens first, of equals the first put; a batch put again stands with its last put only.", "WITH q AS (SELECT doc_id, batch, max(put) AS put, max_by(tokens, put) AS tokens FROM queue_puts GROUP BY doc_id, batch) SELECT doc_id, batch, tokens, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, put) AS BIGINT) AS place FROM q")
simple("st07_candidates", "Pending candidates first, newest first within each.", "WITH e AS (SELECT document, revision, origin, CASE WHEN origin = 'manual' THEN 0 ELSE 1 END AS kind, CAST(floor(document / 100000) AS BIGINT) AS block FROM edits), b AS (SELECT kind, revision, block, count(*) AS n FROM e GROUP BY kind, revision, block), o AS (SELECT kind, revision, block, coalesce(sum(n) OVER (ORDER BY kind, revision DESC, block DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT e.document, e.revision, e.origin, CAST(o.before + row_number() OVER (PARTITION BY e.kind, e.revision, e.block ORDER BY e.document DESC) AS BIGINT) AS place FROM e JOIN o ON e.kind = o.kind AND e.revision = o.revision AND e.block = o.block")
simple("st08_newest_first", "Jobs newest first, and each document's active one.", "SELECT document, revision, revision = max(revision) OVER (PARTITION BY document) AS active FROM edits")
simple("st09_retention", "Rows kept by a cap on ids.", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
simple("so03_union_probe", "Documents known to any of three tables.", "SELECT doc_id FROM labels UNION SELECT doc_id FROM documents UNION SELECT conv_id AS doc_id FROM conversations")
simple("so04_strict_subset", "Whether a retry's leftovers are a strict subset of the first try's.", lambda d: f"WITH p AS (SELECT doc_id, {d.collected('CASE WHEN left_first THEN seq END')} AS a, {d.collected('CASE WHEN left_retry THEN seq END')} AS b FROM tries GROUP BY doc_id), q AS (SELECT doc_id, {d.present('a')} AS a, {d.present('b')} AS b FROM p) SELECT doc_id, {d.size('a')} AS first_n, {d.size('b')} AS retry_n, {d.size(d.minus('b', 'a'))} = 0 AND {d.size('b')} < {d.size('a')} AS accepted FROM q")
simple("so05_ordered_union", "Ids of three sources, each once, in the order of the first source that has it.", lambda d: f"WITH s AS (SELECT doc_id, id, 0 AS source_rank, seq FROM targets UNION ALL SELECT doc_id, id, 1 AS source_rank, seq FROM units UNION ALL SELECT doc_id, id, 2 AS source_rank, seq FROM boxes), f AS (SELECT doc_id, id, min({d.tuple('source_rank', 'seq')}) AS place FROM s GROUP BY doc_id, id) SELECT doc_id, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) AS n FROM f")
simple("so06_glossary_first", "Glossary by normalised source; the first entry wins.", lambda d: f"WITH g AS (SELECT lower(trim({d.sub('source', ' +', ' ')})) AS k, seq, source, target FROM glossary) SELECT k, min_by(source, seq) AS source, min_by(target, seq) AS target FROM g GROUP BY k")
simple("so07_glossary_last", "Glossary by source; the last entry wins, sorted, a hundred at most.", "WITH g AS (SELECT source, max(seq) AS seq, max_by(target, seq) AS target FROM glossary WHERE trim(source) <> '' GROUP BY source) SELECT source, target FROM g ORDER BY source LIMIT 100")
simple(
    "so08_uri_set",
    "Link targets of each document that are lost or added between source and output.",
    """SELECT doc_id, page, number, 'lost' AS change FROM (SELECT DISTINCT doc_id, page, number FROM links EXCEPT SELECT DISTINCT doc_id, page, number FROM out_links) a
    UNION ALL SELECT doc_id, page, number, 'added' AS change FROM (SELECT DISTINCT doc_id, page, number FROM out_links EXCEPT SELECT DISTINCT doc_id, page, number FROM links) b""",
)
simple("so09_term_key", "Terms of a document sorted, each once, as a cache key.", lambda d: f"WITH t AS (SELECT DISTINCT doc_id, src FROM term_pairs WHERE src <> ''), a AS (SELECT doc_id, {d.collected('src')} AS terms FROM t GROUP BY doc_id) SELECT doc_id, {d.size('terms')} AS n, {d.sha(d.joined('terms', '|'))} AS cache_key FROM a")
simple("so10_intersect", "Documents that have labels and conversations.", "SELECT doc_id FROM labels INTERSECT SELECT conv_id AS doc_id FROM conversations")


#: Lengths of the keys by which terms are looked up: of a word's beginning, and of a term's own where it has no blank.
WORD_SIGNS, TERM_SIGNS = (1, 2, 4), (1, 2, 6)


@operator("jn20_glossary_terms")
def glossary_terms(d: Dialect) -> str:
    """Glossary terms in a unit, ASCII letters alike in either case, each once; a term without signs is in no unit.

    An equality join on keys; the terms met are then looked for in the whole text. A term with a blank has its second word
    at the beginning of a word of the text and its first at the end of the word before, so that the key is the second
    word's beginning. Terms without a blank may stand inside a word: their keys meet every run of a unit's signs.
    """
    lower = "translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    first, second = (f"coalesce({d.at(d.split('term', ' '), k)}, '')" for k in "12")
    start = lambda x, sizes: "CASE " + " ".join(f"WHEN length({x}) >= {n} THEN substr({x}, 1, {n})" for n in reversed(sizes)) + " END"
    pairs = d.map(d.numbers("1", f"{d.size('w')} - 1"), "i", f"{d.at('w', 'i')} || ' ' || {d.at('w', 'i + 1')}")
    starts = d.unnest("p", "doc_id, seq, pair", d.array(*(f"substr(word, 1, {n})" for n in WORD_SIGNS)), "run")
    runs = [d.distinct(d.map(d.numbers("1", f"{d.size('c')} - {n - 1}"), "i", " || ".join(d.at("c", f"i + {k}") for k in range(n)))) for n in TERM_SIGNS]
    every = " UNION ALL ".join(f"SELECT * FROM {d.unnest('u', 'doc_id, seq', r, 'run')} AS __r{n}" for n, r in zip(TERM_SIGNS, runs))
    return f"""WITH l AS (SELECT doc_id, seq, {lower} AS s FROM units), t AS (SELECT DISTINCT {lower} AS term FROM glossary), spaced AS (SELECT term, {first} || ' ' || {second} AS beginning, {start(second, WORD_SIGNS)} AS start FROM t WHERE {second} <> ''),
        solid AS (SELECT term, {start("term", TERM_SIGNS)} AS start FROM t WHERE {second} = ''), u AS (SELECT doc_id, seq, {d.split("s", "")} AS c FROM l), r AS ({every}), v AS (SELECT doc_id, seq, {d.split("s", " ")} AS w FROM l),
        p AS (SELECT doc_id, seq, pair, {d.at(d.split("pair", " "), "2")} AS word FROM {d.unnest("v", "doc_id, seq", pairs, "pair")} AS __p), q AS (SELECT * FROM {starts} AS __q),
        met AS (SELECT q.doc_id, q.seq, g.term FROM q JOIN spaced g ON q.run = g.start AND contains(q.pair, g.beginning) UNION SELECT r.doc_id, r.seq, g.term FROM r JOIN solid g ON r.run = g.start)
        SELECT DISTINCT m.doc_id, m.seq, m.term FROM met m JOIN l ON m.doc_id = l.doc_id AND m.seq = l.seq WHERE contains(l.s, m.term)"""


simple("jn22_page_pairs", "Last body paragraph of a page with the first of the next.", "WITH b AS (SELECT doc_id, page, min(seq) AS first_seq, max(seq) AS last_seq FROM units WHERE label = 'text' GROUP BY doc_id, page) SELECT a.doc_id, a.page, a.last_seq, b.first_seq FROM b a JOIN b ON a.doc_id = b.doc_id AND b.page = a.page + 1")
simple("jn23_column_pairs", "Body paragraphs, column by column, of which the second begins more than twenty points higher.", "WITH n AS (SELECT doc_id, page, seq, y2, lead(seq) OVER (PARTITION BY doc_id, page ORDER BY x, y2 DESC, seq) AS next_seq, lead(y2) OVER (PARTITION BY doc_id, page ORDER BY x, y2 DESC, seq) AS next_y2 FROM boxes WHERE label = 'text') SELECT doc_id, page, seq, next_seq FROM n WHERE next_y2 - y2 > 20")
simple("xo07_numeric_formula", "Formulas to be translated: digits, commas, dots and spaces only, not raised, and not wholly within formula regions.", lambda d: f"SELECT doc_id, seq, text AS s FROM formulas WHERE {d.like('text', '^[0-9, .]+$')} AND y_offset <= 0.1 AND NOT all_in_regions")
simple("xo08_shared_layout", "Neighbouring units in one region each, the same one.", "WITH r AS (SELECT b.doc_id, b.seq, count(DISTINCT r.rid) AS n, min(r.rid) AS rid FROM boxes b JOIN regions r ON b.doc_id = r.doc_id AND b.page = r.page AND b.x >= r.x AND b.x2 <= r.x2 AND b.y >= r.y AND b.y2 <= r.y2 GROUP BY b.doc_id, b.seq) SELECT a.doc_id, a.seq, b.seq AS next_seq, a.rid = b.rid AND a.n = 1 AND b.n = 1 AS shared FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.seq = a.seq + 1")
simple("xo10_placeholder_ids", "Sequential placeholder ids: one for a formula, two for a styled run; over forty: plain.", lambda d: f"WITH p AS (SELECT doc_id, page, seq, {d.times('source', '[{]v[0-9]+[}]')} + 2 * {d.times('source', '<style id=')} AS inc FROM units) SELECT doc_id, seq, inc, CAST(1 + coalesce(sum(inc) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id, sum(inc) OVER (PARTITION BY doc_id) > 40 AS plain FROM p")
simple("xo15_move_gate", "Whether a paragraph may move to the next page, and why not.", "SELECT doc_id, seq, CASE WHEN label NOT IN ('text') THEN 'label' WHEN y > 200 THEN 'not_low' WHEN page >= 5 THEN 'last_pages' ELSE 'ok' END AS gate FROM boxes")
simple("xo19_log_owner", "Owner of each event: the nearest span start before it (backward as-of).", lambda d: f"SELECT run_id, seq, {d.carried(chr(39).join(['CASE WHEN stage = ', 'signup', ' THEN span END']), 'PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS owner FROM log")
simple("xo20_best_variant", "The first passing variant of each page by priority.", lambda d: f"SELECT doc_id, page, min_by(seq, {d.tuple('rank', 'seq')}) AS seq FROM (SELECT *, CASE label WHEN 'title' THEN 0 WHEN 'text' THEN 1 ELSE 2 END AS rank FROM variants) AS __v WHERE passed GROUP BY doc_id, page")
simple("xo21_rejections", "Candidates by the first reason that rejects them.", "SELECT CASE WHEN label = 'table' THEN 'table' WHEN length(source) < 30 THEN 'short' WHEN flagged THEN 'flagged' ELSE 'kept' END AS reason, count(*) AS n FROM flagged_units GROUP BY CASE WHEN label = 'table' THEN 'table' WHEN length(source) < 30 THEN 'short' WHEN flagged THEN 'flagged' ELSE 'kept' END")
simple("xo26_entities", "Paragraph entities and their relation to a region.", "SELECT p.doc_id, p.seq, coalesce(p.id, 'ordinal-' || CAST(p.seq AS STRING)) AS entity, r.rid AS region FROM snapshot_paragraphs p LEFT JOIN regions r ON p.doc_id = r.doc_id AND r.rid = p.layout_id")
simple("xo31_label_pairing", "The k-th source label with the k-th output label, where counts agree.", "WITH a AS (SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page, target ORDER BY ord) AS k, count(*) OVER (PARTITION BY doc_id, page, target) AS n, target FROM links), b AS (SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page, target ORDER BY ord) AS k, count(*) OVER (PARTITION BY doc_id, page, target) AS n, target FROM out_links) SELECT a.doc_id, a.ord, b.ord AS out_ord FROM a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.target = b.target AND a.k = b.k AND a.n = b.n")
simple("xo36_page_parts", "Pages in parts of two, and the merged counts.", lambda d: f"SELECT doc_id, {d.div('page', '2')} AS part, count(*) AS units, count(DISTINCT page) AS pages FROM units GROUP BY doc_id, {d.div('page', '2')}")
