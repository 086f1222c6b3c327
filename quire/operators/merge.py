"""Merge views, upserts, versions, stage state, sources and sinks as table transformations."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .catalog import operator, simple
from .spatial import anti

simple("jn12_paragraph_view", "One row a known id over four sources; the first source that has a field gives it.", "WITH ids AS (SELECT doc_id, seq FROM placed_boxes UNION SELECT doc_id, seq FROM links UNION SELECT doc_id, seq FROM targets) SELECT i.doc_id, i.seq, coalesce(b.label, u.label) AS label, coalesce(b.x, l.x) AS x, t.target IS NOT NULL AS translated, CASE WHEN b.seq IS NULL THEN NULL ELSE b.src_font END AS font FROM ids i LEFT JOIN placed_boxes b ON i.doc_id = b.doc_id AND i.seq = b.seq LEFT JOIN (SELECT doc_id, ord, x FROM links) l ON i.doc_id = l.doc_id AND i.seq = l.ord LEFT JOIN snapshot_labels u ON i.doc_id = u.doc_id AND i.seq = u.seq LEFT JOIN targets t ON i.doc_id = t.doc_id AND i.seq = t.seq".replace("SELECT doc_id, seq FROM links", "SELECT doc_id, ord AS seq FROM links"))
simple("jn13_blocks_translations", "Blocks with their translations, if any.", "SELECT u.doc_id, u.seq, u.id, t.target FROM units u LEFT JOIN targets t ON u.doc_id = t.doc_id AND u.id = t.id")
simple("jn14_pages_local", "Pages joined to their local pages.", "WITH p AS (SELECT DISTINCT doc_id, page FROM units), l AS (SELECT doc_id, page, count(*) AS blocks FROM local_blocks GROUP BY doc_id, page) SELECT p.doc_id, p.page, l.blocks FROM p JOIN l ON p.doc_id = l.doc_id AND p.page = l.page")
simple("jn21_id_alignment", "Ids missing from the replies and ids they add.", lambda d: f"SELECT u.doc_id, u.id, 'missing' AS side FROM units u {anti(d)} reply_ids r ON u.doc_id = r.doc_id AND u.id = r.id UNION ALL SELECT r.doc_id, r.id, 'extra' AS side FROM reply_ids r {anti(d)} units u ON u.doc_id = r.doc_id AND u.id = r.id")
simple("jn25_layered_lookup", "Fonts by name: the form's own map wins over the page's.", "SELECT u.doc_id, u.seq, coalesce(x.font, p.font) AS font, x.font IS NOT NULL AS own FROM font_uses u LEFT JOIN xobject_fonts x ON u.doc_id = x.doc_id AND u.page = x.page AND u.xobject = x.xobject AND u.name = x.name LEFT JOIN page_fonts p ON u.doc_id = p.doc_id AND u.page = p.page AND u.name = p.name")
simple("jn26_span_pairs", "Starts and finishes of a span; a lone finish starts its duration earlier.", "WITH s AS (SELECT run_id, span, at_us FROM span_log WHERE kind = 'started'), f AS (SELECT run_id, span, at_us, ms FROM span_log WHERE kind = 'finished') SELECT coalesce(s.run_id, f.run_id) AS run_id, coalesce(s.span, f.span) AS span, coalesce(s.at_us, f.at_us - f.ms * 1000) AS start_us, f.at_us AS end_us FROM s FULL OUTER JOIN f ON s.run_id = f.run_id AND s.span = f.span")
simple("jn30_hydrate", "Missing geometry from the parse state.", "SELECT g.doc_id, g.seq, coalesce(g.x, b.x) AS x, coalesce(g.y2, b.y2) AS y2 FROM block_geometry g LEFT JOIN boxes b ON g.doc_id = b.doc_id AND g.seq = b.seq")
simple("up01_upsert", "Rows of the old table replaced or joined by the new ones' last.", "WITH n AS (SELECT document, max(revision) AS revision, max_by(target, revision) AS target FROM arriving_rows GROUP BY document), o AS (SELECT document, max(revision) AS revision, max_by(target, revision) AS target FROM stored_rows GROUP BY document) SELECT coalesce(n.document, o.document) AS document, coalesce(n.revision, o.revision) AS revision, coalesce(n.target, o.target) AS target FROM n FULL OUTER JOIN o ON n.document = o.document")
simple("up02_guarded_upsert", "As an upsert, but a manual text is never overwritten by an automatic one, and unchanged rows stay.", "WITH n AS (SELECT document, max_by(origin, revision) AS origin, max_by(target, revision) AS target FROM arriving_rows GROUP BY document), o AS (SELECT document, max_by(origin, revision) AS origin, max_by(target, revision) AS target FROM stored_rows GROUP BY document) SELECT coalesce(n.document, o.document) AS document, CASE WHEN o.origin = 'manual' AND n.origin = 'auto' THEN o.target WHEN n.target IS NULL THEN o.target ELSE n.target END AS target, o.document IS NULL OR (n.document IS NOT NULL AND n.target IS DISTINCT FROM o.target AND NOT (o.origin = 'manual' AND n.origin = 'auto')) AS written FROM n FULL OUTER JOIN o ON n.document = o.document")
simple("up03_replace_cache", "The last put of each key, and how many it replaced.", "SELECT engine, source, max(put) AS put, max_by(translation, put) AS translation, count(*) - 1 AS replaced FROM cache_puts GROUP BY engine, source")
simple("up04_insert_or_ignore", "New rows whose key is not there yet.", lambda d: f"SELECT n.document, n.revision, n.target FROM arriving_rows n {anti(d)} stored_rows o ON n.document = o.document")
simple("up05_compare_and_set", "Edits accepted where their base revision is the current one.", "WITH c AS (SELECT document, max(revision) AS current_revision FROM edits GROUP BY document) SELECT e.document, e.revision, c.current_revision, e.base_revision = c.current_revision AS accepted FROM edit_bases e JOIN c ON e.document = c.document")
simple("up06_guarded_commit", "Commits: revision matches and the job is active; a manual text wins.", "WITH c AS (SELECT document, max(revision) AS head, bool_or(origin = 'manual') AS hand FROM edits GROUP BY document) SELECT e.document, e.revision, CASE WHEN j.state IS DISTINCT FROM 'running' THEN coalesce(j.state, 'no_job') WHEN e.revision <> c.head THEN 'stale' WHEN c.hand AND e.origin = 'auto' THEN 'manual_kept' ELSE 'committed' END AS outcome FROM edits e JOIN c ON e.document = c.document LEFT JOIN jobs j ON e.document = j.document")
simple("up07_draft_merge", "Drafts field by field: set, cleared or left; empty rows go.", "WITH b AS (SELECT doc_id, seq, id, target FROM targets), p AS (SELECT doc_id, seq, has_target, target FROM draft_fields), m AS (SELECT coalesce(b.doc_id, p.doc_id) AS doc_id, coalesce(b.seq, p.seq) AS seq, CASE WHEN p.has_target THEN p.target ELSE b.target END AS target FROM b FULL OUTER JOIN p ON b.doc_id = p.doc_id AND b.seq = p.seq) SELECT doc_id, seq, target FROM m WHERE target IS NOT NULL AND target <> ''")
simple("up08_merge_replacements", "A document's texts in order, with replacements where there are any.", "SELECT u.doc_id, u.seq, coalesce(t.target, u.source) AS text, t.target IS NOT NULL AS replaced FROM units u LEFT JOIN replacements t ON u.doc_id = t.doc_id AND u.seq = t.seq")
simple("up09_cascade_delete", "What stays after some documents are deleted, in every table; a paper goes with its last document.", lambda d: " UNION ALL ".join(f"SELECT '{name}' AS tbl, {what} AS n FROM {t} s {anti(d)} deletions x ON s.doc_id = x.doc_id" for name, what, t in (("units", "count(*)", "units"), ("targets", "count(*)", "targets"), ("labels", "count(*)", "labels"), ("papers", "count(DISTINCT s.sha)", "assets"))))
simple("up10_stale_stage", "The first stage of each document whose recorded input differs from the current one.", "SELECT doc_id, min(CASE WHEN recorded IS DISTINCT FROM current_hash THEN stage END) AS first_stale, count_if(recorded IS DISTINCT FROM current_hash) AS stale FROM stage_hashes GROUP BY doc_id")
simple("up11_dirty_pages", "Pages with a changed block.", "SELECT doc_id, page, count(*) AS blocks, count_if(input_hash IS DISTINCT FROM compiled_hash) AS dirty FROM block_hashes GROUP BY doc_id, page HAVING count_if(input_hash IS DISTINCT FROM compiled_hash) > 0")
simple("up12_age_retention", "Files older than a bound.", "SELECT doc_id, mtime FROM assets WHERE mtime < 30")
simple("up13_backfill", "Rows from files that the table does not have yet.", lambda d: f"WITH f AS (SELECT doc_id, seq, id FROM units) SELECT f.doc_id, f.seq, f.id FROM f {anti(d)} targets t ON f.doc_id = t.doc_id AND f.seq = t.seq")
simple("up14_effective_target", "The draft over the translation.", "SELECT t.doc_id, t.seq, coalesce(f.target, t.target) AS target, f.target IS NOT NULL AS from_draft FROM targets t LEFT JOIN draft_texts f ON t.doc_id = f.doc_id AND t.seq = f.seq")
simple("pf14_event_filter", "Events of a stage, with the cursor of the whole page scanned.", "WITH p AS (SELECT run_id, seq, stage, kind, max(seq) OVER (PARTITION BY run_id) AS cursor_to FROM log WHERE seq <= 200) SELECT run_id, seq, kind, cursor_to FROM p WHERE stage = 'error'")
simple("pf18_override_diff", "Overrides added, changed and removed.", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.seq, b.seq) AS seq, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM overrides_before a FULL OUTER JOIN overrides_after b ON a.doc_id = b.doc_id AND a.seq = b.seq WHERE a.v IS DISTINCT FROM b.v")


@operator("pf17_override_patch")
def override_patch(d: Dialect) -> str:
    """Patch of keyed overrides: a null deletes its key, empty buckets go."""
    return "WITH m AS (SELECT coalesce(b.doc_id, p.doc_id) AS doc_id, coalesce(b.k, p.k) AS k, CASE WHEN p.k IS NOT NULL THEN p.v ELSE b.v END AS v FROM override_base b FULL OUTER JOIN override_patches p ON b.doc_id = p.doc_id AND b.k = p.k) SELECT doc_id, count(v) AS n_keys, " + d.listed("k || '=' || v", "k") + " AS entries FROM m WHERE v IS NOT NULL GROUP BY doc_id"


@operator("pf19_override_validation")
def override_validation(d: Dialect) -> str:
    """Errors of each override, in order."""
    errors = d.array("CASE WHEN scale < 5 THEN 'scale_low' END", "CASE WHEN scale > 30 THEN 'scale_high' END", "CASE WHEN font > 12 THEN 'font_range' END", "CASE WHEN k NOT IN ('box_scale', 'font_scale') THEN 'unknown_key' END")
    return f"WITH e AS (SELECT doc_id, seq, {d.present(errors)} AS errors FROM override_entries) SELECT doc_id, seq, {d.joined('errors', ',')} AS errors FROM e WHERE {d.size('errors')} > 0"


simple("qc09_document_parity", "Source and output compared: pages, links, leftovers.", "WITH s AS (SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS links FROM links GROUP BY doc_id), o AS (SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS links FROM out_links GROUP BY doc_id) SELECT s.doc_id, s.pages AS source_pages, o.pages AS output_pages, s.links AS source_links, o.links AS output_links, s.pages IS DISTINCT FROM o.pages OR s.links IS DISTINCT FROM o.links AS differs FROM s LEFT JOIN o ON s.doc_id = o.doc_id")
simple("ag16_link_summary", "Links of a document by what became of them.", "WITH j AS (SELECT l.doc_id, CASE WHEN o.ord IS NULL THEN 'missing' WHEN o.number <> l.number THEN 'renumbered' ELSE 'ok' END AS status FROM links l LEFT JOIN out_links o ON l.doc_id = o.doc_id AND l.ord = o.ord) SELECT doc_id, count(*) AS n, count_if(status = 'missing') AS missing, count_if(status = 'renumbered') AS renumbered, bool_and(status = 'ok') AS all_ok, bool_or(status <> 'ok') AS any_bad FROM j GROUP BY doc_id")
simple("sc10_newest_artefact", "The latest run that has a stage, and its last event of it.", lambda d: f"SELECT stage, max_by(seq, {d.tuple('run_id', 'seq')}) AS seq, max(run_id) AS run_id FROM log WHERE kind = 'finished' GROUP BY stage")
simple("sc11_library_scan", "One row a distinct content, the newest; test folders skipped.", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY mtime DESC, doc_id) AS k FROM assets WHERE dir <> 'src3') SELECT doc_id, sha, mtime FROM r WHERE k = 1")
simple("sc09_point_scan", "Range scan by key, in order.", "SELECT document, revision, origin FROM edits WHERE document BETWEEN 10 AND 30 ORDER BY document, revision")
simple("sc13_markdown_blocks", "Blocks of marked text; of one id the last wins.", lambda d: f"WITH p AS (SELECT doc_id, seq, {d.group('mark', 'id=([A-Z0-9-]+)', 1)} AS id, {d.group('mark', 'label=([a-z_]+)', 1)} AS label, source FROM marked_blocks) SELECT doc_id, id, max_by(label, seq) AS label, max_by(source, seq) AS body FROM p GROUP BY doc_id, id")
simple("sc14_unit_html_tallies", "Tags of unit HTML: paragraphs, spans, kept atoms, breaks.", lambda d: f"SELECT page_id, {d.times('html', '<p[ >]')} AS p, {d.times('html', '<b>')} AS b, {d.times('html', '<br>')} AS br, {d.times('html', '<a ')} AS a FROM pages")
simple("sc15_page_ranges", "Page ranges such as 1,2,5-7 as rows.", lambda d: f"WITH a AS (SELECT 'a' AS name, '1,2,5-7' AS spec UNION ALL SELECT 'b', '3' UNION ALL SELECT 'c', '4-4,9-12'), p AS {d.unnest('a', 'name', d.split('spec', ','), 'part')}, r AS (SELECT name, CAST({d.group('part', '^([0-9]+)', 1)} AS BIGINT) AS lo, CAST({d.group('part', '([0-9]+)$', 1)} AS BIGINT) AS hi FROM p) SELECT name, page FROM {d.unnest('r', 'name', d.numbers('lo', 'hi'), 'page')} z")
simple("sc08_provider_ids", "Reading-order ids of pages, blocks and lines.", "SELECT doc_id, seq, 'p' || CAST(page AS STRING) || '-b' || CAST(k AS STRING) || '-l0-s0' AS provider_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, k) AS BIGINT) AS reading_order FROM units")
simple("sk02_append_event", "New events numbered after the last of each run.", "WITH last AS (SELECT run_id, max(seq) AS top FROM log GROUP BY run_id) SELECT n.run_id, n.event_id, CAST(coalesce(l.top, 0) + row_number() OVER (PARTITION BY n.run_id ORDER BY n.ts, n.event_id) AS BIGINT) AS seq FROM incoming_events n LEFT JOIN last l ON n.run_id = l.run_id")
simple("sk03_glossary_export", "Glossary as CSV lines, quoted where needed.", lambda d: f"SELECT seq, CASE WHEN {d.has('source', chr(39) + ',' + chr(39))} THEN chr(34) || source || chr(34) ELSE source END || ',' || target || ',' || lang AS csv FROM glossary")
simple("sk04_markdown", "Markdown of a document's units; only the first title is a level-one heading.", lambda d: f"WITH t AS (SELECT *, sum(CASE WHEN label = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS titles FROM units), m AS (SELECT doc_id, seq, CASE WHEN label = 'title' AND titles = 1 THEN '# ' WHEN label = 'title' THEN '## ' WHEN label = 'paragraph_title' THEN '### ' ELSE '' END || source AS md FROM t) SELECT doc_id, {d.sha(d.nlisted('md', 'chr(10)', 'seq'))} AS markdown_sha, count(*) AS blocks FROM m GROUP BY doc_id")
simple("sk05_asset_store", "Assets by content with how often each is referred to.", "SELECT sha, count(*) AS refs, min(doc_id) AS first_doc, max(size) AS size FROM assets GROUP BY sha")
simple("sk06_stage_cache", "Results by content and stage.", "SELECT a.sha, s.stage, count(*) AS hits FROM assets a JOIN stage_hashes s ON a.doc_id = s.doc_id WHERE s.recorded = s.current_hash GROUP BY a.sha, s.stage")
simple("sk07_capped_history", "The last fifty entries of each run.", "WITH r AS (SELECT run_id, seq, stage, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM log) SELECT run_id, seq, stage FROM r WHERE k <= 50")
simple("sk08_bounded_versions", "One row a revision, the newest three.", "WITH u AS (SELECT document, revision, max(target) AS target FROM edits GROUP BY document, revision), r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY revision DESC) AS k FROM u) SELECT document, revision FROM r WHERE k <= 3")
simple("sk09_report", "Figures of the final report.", "SELECT 'units' AS metric, count(*) AS n FROM units UNION ALL SELECT 'targets' AS metric, count(*) AS n FROM targets UNION ALL SELECT 'empty' AS metric, count(*) AS n FROM targets WHERE target = '' UNION ALL SELECT 'links' AS metric, count(*) AS n FROM links")
simple("xo02_ocr_backfill", "Characters put in by place where the lengths agree.", lambda d: f"WITH c AS (SELECT doc_id, seq, count(*) AS n FROM glyphs GROUP BY doc_id, seq) SELECT {d.hashed('c', 'o')}g.doc_id, g.seq, g.i, substr(o.text, CAST(g.i + 1 AS INT), 1) AS ch FROM glyphs g JOIN c ON g.doc_id = c.doc_id AND g.seq = c.seq JOIN ocr_texts o ON g.doc_id = o.doc_id AND g.seq = o.seq AND length(o.text) = c.n WHERE {d.like('g.ch', '[a-zA-Z]')}")
simple("xo23_replay", "What a run can be rebuilt from, with availability.", "SELECT u.doc_id, count(*) AS units, count(t.id) > 0 AS has_targets, count(l.ord) > 0 AS has_links FROM units u LEFT JOIN targets t ON u.doc_id = t.doc_id AND u.seq = t.seq LEFT JOIN links l ON u.doc_id = l.doc_id AND u.seq = l.ord GROUP BY u.doc_id")
simple("xo24_inherited_evidence", "The latest earlier run of the same stage.", "WITH e AS (SELECT run_id, seq, stage, lag(seq) OVER (PARTITION BY run_id, stage ORDER BY seq) AS earlier FROM log) SELECT run_id, seq, stage, earlier FROM e")
simple("xo25_run_index", "Runs newest first with their state.", "WITH r AS (SELECT run_id, max(at_us) AS last_us, max_by(kind, seq) AS last_kind, count(*) AS n, CAST(floor(max(at_us) / 60000000) AS BIGINT) AS minute FROM log GROUP BY run_id), b AS (SELECT minute, count(*) AS n FROM r GROUP BY minute), o AS (SELECT minute, coalesce(sum(n) OVER (ORDER BY minute DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT r.run_id, r.last_us, CASE WHEN r.n < 5 THEN 'incomplete' WHEN r.last_kind = 'started' THEN 'interrupted' ELSE 'done' END AS state, CAST(o.before + row_number() OVER (PARTITION BY r.minute ORDER BY r.last_us DESC, r.run_id DESC) AS BIGINT) AS place FROM r JOIN o ON r.minute = o.minute")
simple("xo32_toc_tail", "Contents rows split into title and tail.", lambda d: f"SELECT doc_id, seq, {d.group('line', r'^(.*?)([. ]*)([0-9]+)$', 1)} AS title, {d.group('line', r'^(.*?)([. ]*)([0-9]+)$', 3)} AS tail FROM toc_rows WHERE {d.like('line', '[. ]{2,}[0-9]+$')}")
simple("xo33_document_meta", "Title: stored, else the first title, else the first line.", "WITH t AS (SELECT doc_id, min_by(source, seq) AS title FROM units WHERE label = 'title' GROUP BY doc_id), f AS (SELECT doc_id, min_by(source, seq) AS line FROM units GROUP BY doc_id) SELECT d.doc_id, coalesce(m.title, t.title, f.line) AS title FROM documents d LEFT JOIN stored_meta m ON d.doc_id = m.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN f ON d.doc_id = f.doc_id")
simple("xo34_incremental", "Pages that edits touch.", "SELECT DISTINCT u.doc_id, u.page FROM units u JOIN unit_edits e ON u.doc_id = e.doc_id AND u.seq = e.seq")
simple("xo35_outline", "Outline as level, title and page.", "SELECT doc_id, seq, CASE WHEN label = 'title' THEN 1 ELSE 2 END AS level, source AS title, page FROM units WHERE label IN ('title', 'paragraph_title')")
simple("xo37_fingerprint", "Fingerprint of a document's parts in order.", lambda d: f"SELECT doc_id, {d.sha(d.nlisted(d.sha('source'), d.lit(''), 'seq'))} AS fingerprint FROM units GROUP BY doc_id")
simple("xo38_upload_checks", "Uploads: form, size, a free name.", lambda d: f"SELECT doc_id, {d.like('text', '^[A-Z]')} AS magic, length(text) <= 20000 AS fits, source || '-' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS STRING) AS name FROM documents")
simple("xo39_artefact_whitelist", "Known artefacts by name.", "WITH k AS (SELECT 'src1' AS name, 'pdf' AS kind UNION ALL SELECT 'src2', 'log' UNION ALL SELECT 'src9', 'json') SELECT d.doc_id, k.kind FROM documents d JOIN k ON d.source = k.name ORDER BY k.kind, d.doc_id")
