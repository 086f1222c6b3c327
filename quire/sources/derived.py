"""Document tables derived from the driver's plain tables, in integer arithmetic only.

The driver's tables hold texts and events but no boxes, characters, translations or run logs. These definitions turn
them into such tables, by rule, alike in every engine. Each is a SQL text over base tables and earlier definitions;
an operator names those it reads and gets them, and what they read, as common table expressions.
"""

from __future__ import annotations

from functools import lru_cache

from ..functions.dialect import Dialect

#: Labels by ``h % 20``; text beyond.
LABELS = ("title", "paragraph_title", "figure_caption", "table_caption", "reference", "header", "footer", "table")


def _definitions(d: Dialect) -> dict[str, str]:
    label = "CASE " + " ".join(f"WHEN h % 20 = {k} THEN '{x}'" for k, x in enumerate(LABELS)) + " ELSE 'text' END"
    return {
        "lines": d.unnest("documents", "doc_id", "split(text, chr(10))" if d.name == "spark" else "string_split(text, chr(10))", "line", "seq"),
        "numbered": f"(SELECT doc_id, seq, line, doc_id * 31 + seq AS h, {d.div('seq - 1', '8')} AS page, (seq - 1) % 8 AS k FROM lines)",
        "units": f"""(SELECT doc_id, seq, h, page, k, 'P' || lpad(CAST(page + 1 AS STRING), 2, '0') || '-' || lpad(CAST(k + 1 AS STRING), 3, '0') AS id, {label} AS label,
            CASE WHEN h % 29 = 0 THEN 'Appendix A' WHEN h % 23 = 0 THEN 'References' ELSE (CASE WHEN h % 5 = 0 THEN '<style id=' || chr(39) || '1' || chr(39) || '>' || line || '</style>' WHEN seq = 8 THEN 'Abstract. ' || line ELSE line END)
            || (CASE WHEN h % 7 = 0 THEN '{{v1}}' ELSE '' END) END AS source FROM numbered)""",
        "targets": f"""(SELECT doc_id, seq, h, page, id, CASE WHEN h % 19 = 0 THEN '' WHEN h % 13 = 0 THEN repeat('译', CAST({d.div("length(source)", "10")} AS INT))
            WHEN h % 11 = 0 THEN source ELSE repeat('译', CAST({d.div("length(source) * 35", "100")} AS INT)) || '。' END AS target FROM units WHERE h % 17 <> 0)""",
        "replies": """(SELECT t.doc_id, t.seq, t.page, t.id, u.source, CASE WHEN t.h % 37 = 0 THEN t.target WHEN t.h % 41 = 0 THEN t.target || '{v1}{v1}' WHEN u.source LIKE '%{v1}%' THEN t.target || '{v1}' ELSE t.target END AS reply, t.h
            FROM targets t JOIN units u ON t.doc_id = u.doc_id AND t.seq = u.seq)""",
        "boxes": f"""(SELECT doc_id, page, seq, k, id, label, h, 50 + (k % 2) * 260 AS x, 750 - {d.div("k", "2")} * 150 - (h % 40) - (100 + h % 80) AS y, 50 + (k % 2) * 260 + 250 AS x2, 750 - {d.div("k", "2")} * 150 - (h % 40) AS y2,
            750 - {d.div("k", "2")} * 150 - (100 + h % 80) AS sy, 750 - {d.div("k", "2")} * 150 AS sy2, 10 + h % 4 AS src_font, CASE WHEN h % 9 = 0 THEN (10 + h % 4) * 7 ELSE (10 + h % 4) * 10 END AS font10 FROM units)""",
        "regions": """(SELECT doc_id, page, seq AS rid, label, 50 + seq % 50 AS conf, x - ((h % 7) - 3) AS x, y - ((h % 7) - 3) AS y, x2 + ((h % 7) - 3) AS x2, y2 + ((h % 7) - 3) AS y2 FROM boxes WHERE h % 16 <> 0
            UNION ALL SELECT doc_id, page, 100000 + page AS rid, 'figure' AS label, 40 AS conf, 300 AS x, 100 AS y, 560 AS x2, 330 AS y2 FROM boxes WHERE k = 0)""",
        "chars": d.unnest("(SELECT b.doc_id, b.page, b.seq, b.h, b.x AS bx, b.y2 AS by2, u.source FROM boxes b JOIN units u ON b.doc_id = u.doc_id AND b.seq = u.seq WHERE u.source <> '')", "doc_id, page, seq, h, bx, by2", d.split("source", ""), "ch", "place"),
        "glyphs": f"""(SELECT doc_id, page, seq, h, i, ch, bx + (i % 40) * 6 AS x, by2 - 12 * ({d.div("i", "40")} + 1) AS y, bx + (i % 40) * 6 + 5 AS x2, by2 - 12 * ({d.div("i", "40")} + 1) + 10 AS y2 FROM (SELECT *, place - 1 AS i FROM chars) AS __i)""",
        # A row for all glyphs of a text, whose places and signs follow from it by the definition above.
        "glyph_texts": "(SELECT b.doc_id, b.page, b.seq, b.h, b.x, b.y2, u.source FROM boxes b JOIN units u ON b.doc_id = u.doc_id AND b.seq = u.seq WHERE u.source <> '')",
        "bench_words": f"(SELECT item_id, {d.split('text', ' ')} AS w FROM benchmark)",
        "glossary": f"""(SELECT item_id * 2 AS seq, {d.at("w", "1")} || ' ' || {d.at("w", "2")} AS source, '词' || CAST(item_id AS STRING) AS target, CASE WHEN item_id % 3 = 0 THEN 'zh-CN' WHEN item_id % 3 = 1 THEN 'zh_cn' ELSE '' END AS lang FROM bench_words
            UNION ALL SELECT item_id * 2 + 1 AS seq, translate({d.at("w", "1")} || ' ' || {d.at("w", "2")}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS source, '词' || CAST(item_id AS STRING) || 'b' AS target, 'zh-cn' AS lang FROM bench_words WHERE item_id % 2 = 0)""",
        "term_pairs": f"(SELECT doc_id, seq, {d.at(d.split('line', ' '), '1')} AS src, 'T' || CAST(h % 3 AS STRING) AS tgt FROM numbered)",
        "run_events": f"""(SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, {d.micros("ts")} AS at_us, event_type AS stage, CAST(floor(value * 1000) AS BIGINT) AS ms, props FROM events)""",
        "log": f"(SELECT run_id, seq, at_us, stage, CASE WHEN seq % 2 = 1 THEN 'started' ELSE 'finished' END AS kind, {d.div('seq - 1', '2')} AS span, ms, props FROM run_events)",
        "edits": "(SELECT conv_id AS document, turn AS revision, CASE WHEN role = 'user' THEN 'manual' ELSE 'auto' END AS origin, text AS target FROM conversations)",
        "assets": f"(SELECT doc_id, {d.sha('text')} AS sha, n_chars AS size, source AS dir, doc_id % 97 AS mtime FROM documents)",
        "stage_inputs": d.unnest("documents", "doc_id", d.numbers("0", "6"), "stage"),
        "stage_hashes": "(SELECT doc_id, stage, md5(CAST(doc_id AS STRING) || '-' || CAST(stage AS STRING)) AS recorded, CASE WHEN (doc_id + stage) % 11 = 0 THEN 'changed' WHEN (doc_id + stage) % 29 = 0 THEN NULL ELSE md5(CAST(doc_id AS STRING) || '-' || CAST(stage AS STRING)) END AS current_hash FROM stage_inputs)",
        "links": f"(SELECT b.doc_id, b.page, b.seq AS ord, b.h, b.h % 5 AS target, b.x + 10 AS x, b.y + 5 AS y, b.x + 60 AS x2, b.y + 17 AS y2, CAST(b.h % 30 AS STRING) AS number FROM boxes b WHERE b.h % 3 = 0)",
        "out_links": "(SELECT doc_id, page, ord, target, x + 3 AS x, y - 4 AS y, x2 + 3 AS x2, y2 - 4 AS y2, CASE WHEN h % 47 = 0 THEN '99' ELSE number END AS number FROM links WHERE h % 43 <> 0)",
        # What the operators below are to find: defects, decisions and drafts, put in by rule.
        "label_records": "(SELECT doc_id, seq, CASE WHEN h % 40 = 13 THEN NULL ELSE label END AS label FROM units)",
        "toc_candidates": "(SELECT doc_id, page, seq, CASE WHEN (doc_id + page) % 9 = 0 AND h % 4 <> 0 THEN line || ' ..... ' || CAST(seq AS STRING) ELSE line END AS line FROM numbered)",
        "page_flags": "(SELECT DISTINCT doc_id, page, doc_id % 3 = 0 OR page % 5 = 0 AS is_scan FROM units)",
        "toc_entries": "(SELECT doc_id, page, seq, CASE WHEN h % 3 = 0 THEN '1.' || CAST(h % 4 AS STRING) || ' ' || line WHEN h % 3 = 1 THEN '2 ' || line ELSE line END AS line, (h % 4) * 12 + h % 2 AS indent FROM numbered)",
        "arriving_events": "(SELECT run_id, seq % 50 AS seq, ms, seq AS arrived FROM log)",
        "tries": "(SELECT doc_id, seq, h % 19 = 0 AS left_first, h % 38 = 0 OR h % 101 = 0 AS left_retry FROM units)",
        "formulas": "(SELECT doc_id, seq, CASE WHEN h % 21 = 0 THEN CAST(h AS STRING) || ', 3.5' ELSE source END AS text, CAST(h % 3 AS DOUBLE) / 10 AS y_offset, h % 4 = 0 AS all_in_regions FROM units)",
        "variants": "(SELECT doc_id, page, seq, label, h % 6 <> 0 AS passed FROM units)",
        "flagged_units": "(SELECT doc_id, seq, label, source, h % 13 = 0 AS flagged FROM units)",
        "snapshot_paragraphs": "(SELECT doc_id, seq, CASE WHEN h % 6 = 0 THEN NULL ELSE id END AS id, seq AS layout_id FROM boxes)",
        "placed_boxes": "(SELECT * FROM boxes WHERE h % 6 <> 0)",
        "snapshot_labels": "(SELECT doc_id, seq, label FROM units WHERE h % 5 <> 0)",
        "local_blocks": "(SELECT doc_id, page, seq FROM boxes WHERE h % 4 <> 0)",
        "reply_ids": "(SELECT doc_id, CASE WHEN h % 43 = 0 THEN id || 'x' ELSE id END AS id FROM replies)",
        "span_log": "(SELECT * FROM log WHERE NOT (kind = 'started' AND seq % 5 = 0))",
        "block_geometry": "(SELECT doc_id, seq, CASE WHEN h % 4 = 0 THEN NULL ELSE x END AS x, CASE WHEN h % 6 = 0 THEN NULL ELSE y2 END AS y2 FROM boxes)",
        "edit_bases": "(SELECT document, revision, origin, revision + CASE WHEN document % 4 = 0 THEN 1 ELSE 0 END AS base_revision FROM edits)",
        "jobs": "(SELECT DISTINCT document, CASE WHEN document % 7 = 0 THEN 'cancelled' ELSE 'running' END AS state FROM edits)",
        "draft_fields": "(SELECT doc_id, seq, h % 3 = 0 AS has_target, CASE WHEN h % 6 = 0 THEN NULL ELSE 'draft' END AS target FROM units WHERE h % 2 = 0)",
        "replacements": "(SELECT doc_id, seq, target FROM targets WHERE h % 2 = 0)",
        "deletions": "(SELECT doc_id FROM documents WHERE doc_id % 10 = 0)",
        "block_hashes": "(SELECT doc_id, seq, page, md5(source) AS input_hash, CASE WHEN h % 31 = 0 THEN md5(source || 'x') ELSE md5(source) END AS compiled_hash FROM units)",
        "draft_texts": "(SELECT doc_id, seq, 'draft ' || id AS target FROM targets WHERE h % 9 = 0)",
        "overrides_before": "(SELECT doc_id, seq, src_font AS v FROM boxes WHERE h % 5 <> 0)",
        "overrides_after": "(SELECT doc_id, seq, src_font + CASE WHEN h % 8 = 0 THEN 1 ELSE 0 END AS v FROM boxes WHERE h % 7 <> 0)",
        "override_base": "(SELECT doc_id, 'P' || CAST(seq AS STRING) AS k, CAST(src_font AS STRING) AS v FROM boxes WHERE h % 5 = 0)",
        "override_patches": "(SELECT doc_id, 'P' || CAST(seq AS STRING) AS k, CASE WHEN h % 4 = 0 THEN NULL ELSE 'new' END AS v FROM boxes WHERE h % 3 = 0)",
        "override_entries": "(SELECT doc_id, seq, h % 37 AS scale, src_font AS font, CASE WHEN h % 6 = 0 THEN 'colour' WHEN h % 2 = 0 THEN 'box_scale' ELSE 'font_scale' END AS k FROM boxes)",
        "marked_blocks": "(SELECT doc_id, seq, '<!-- id=' || CASE WHEN h % 9 = 0 THEN 'P00-000' ELSE id END || ' label=' || label || ' -->' AS mark, source FROM units)",
        "incoming_events": "(SELECT user_id AS run_id, event_id, ts FROM events WHERE event_id % 20 = 0)",
        "ocr_texts": "(SELECT doc_id, seq, translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text FROM units WHERE h % 3 = 0)",
        "toc_rows": "(SELECT doc_id, seq, CASE WHEN h % 6 = 0 THEN line || ' .... ' || CAST(seq AS STRING) ELSE line END AS line FROM numbered)",
        "contents_rows": "(SELECT doc_id, seq, CASE WHEN h % 8 = 0 THEN line || ' . . . ' || CAST(h % 300 AS STRING) ELSE line END AS line FROM numbered)",
        "stored_meta": "(SELECT doc_id, source AS title FROM documents WHERE doc_id % 9 = 0)",
        "unit_edits": "(SELECT doc_id, seq FROM targets WHERE h % 23 = 0)",
        "coded_units": f"(SELECT doc_id, seq, CASE WHEN h % 31 = 0 OR doc_id % 50 = 0 THEN {d.sub('line', '[^ ]+', '(cid:7)')} ELSE line END AS line FROM numbered)",
        "bare_units": "(SELECT doc_id, seq, CASE WHEN h % 14 = 0 THEN '{v1} <style id=2></style>' ELSE source END AS source FROM units)",
        "margin_units": "(SELECT doc_id, seq, CASE WHEN h % 33 = 0 THEN CAST(seq AS STRING) || ' ' ELSE source END AS source FROM units)",
        "wrapped_replies": "(SELECT doc_id, seq, CASE WHEN h % 3 = 0 THEN '```json' || chr(10) || source || chr(10) || '```' WHEN h % 3 = 1 THEN '<json>' || source || '</json>' ELSE '  ' || source END AS reply FROM units)",
        "markdown_texts": "(SELECT doc_id, seq, '[[S1]]' || line || '[[/S]] [[F' || CAST(h % 5 AS STRING) || ']]' AS markdown FROM numbered)",
        "direction_texts": "(SELECT doc_id, seq, CASE WHEN h % 45 = 0 THEN target || '\u2066' WHEN h % 46 = 0 THEN '\u202e' || target ELSE target END AS target FROM targets)",
        "stored_rows": "(SELECT document, revision, origin, target FROM edits WHERE revision % 2 = 0 AND document % 3 <> 0)",
        "arriving_rows": "(SELECT document, revision, origin, target FROM edits WHERE revision % 2 = 1)",
        "cache_puts": "(SELECT role AS engine, text AS source, conv_id * 1000 + turn AS put, CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS translation FROM conversations)",
        "font_uses": "(SELECT doc_id, page, seq, CASE WHEN h % 4 < 2 THEN k END AS xobject, 'F' || CAST(h % 3 AS STRING) AS name FROM boxes)",
        "page_fonts": "(SELECT DISTINCT doc_id, page, 'F' || CAST(h % 3 AS STRING) AS name, 10 + h % 3 AS font FROM boxes)",
        "xobject_fonts": "(SELECT doc_id, page, k AS xobject, 'F' || CAST(h % 3 AS STRING) AS name, 20 + h % 3 AS font FROM boxes WHERE h % 4 = 0)",
        "markdown_bodies": "(SELECT doc_id, seq, label, CASE WHEN label = 'title' THEN '## ' || source WHEN label = 'reference' THEN '- ' || source ELSE source END AS md FROM units)",
        "leaky_replies": "(SELECT r.doc_id, r.seq, r.source, CASE WHEN r.h % 53 = 0 THEN r.reply || coalesce(substr(p.source, 1, 20), '') ELSE r.reply END AS reply FROM replies r LEFT JOIN units p ON p.doc_id = r.doc_id AND p.seq = r.seq - 1)",
        "reference_anchors": f"""(SELECT doc_id, seq, CASE h % 4 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Table ' WHEN 2 THEN 'Equation ' ELSE 'Section ' END
            || CASE WHEN h % 8 < 4 THEN {d.at(d.split("'I II III IV V VI VII VIII IX X XI XII'", ' '), 'h % 12 + 1')} ELSE CAST(h % 99 + 1 AS STRING) END AS anchor FROM units)""",
        "queue_puts": "(SELECT doc_id, seq AS put, CASE WHEN h % 6 = 0 THEN 'repeated' ELSE id END AS batch, length(source) AS tokens FROM units)",
        "subscriptions": "(SELECT DISTINCT run_id, 'a' AS subscriber FROM log WHERE run_id % 4 <> 0 UNION ALL SELECT DISTINCT run_id, 'b' AS subscriber FROM log WHERE run_id % 6 = 0)",
        "requests": "(SELECT run_id AS limiter, seq AS ord, at_us AS arrived_us, 3600000000 * (1 + run_id % 8) AS interval_us FROM log)",
        "front_paragraphs": """(SELECT doc_id, page, seq, h % 17 <> 0 AS translatable, CASE WHEN seq = 1 THEN 'title' WHEN seq = 6 OR h % 25 = 0 THEN 'paragraph_title' ELSE 'text' END AS kind,
            CASE WHEN seq = 2 THEN 'Ada Vale, Bo Lind*' WHEN seq = 3 AND doc_id % 3 = 0 THEN 'University of Vale' WHEN seq = 4 AND doc_id % 4 = 0 THEN '{ada, bo}@vale.edu' WHEN seq = 4 AND doc_id % 4 = 1 THEN '12 Hill Street, Vale' WHEN seq = 6 THEN 'Abstract'
                WHEN seq > 6 AND h % 50 = 0 THEN 'Authors' WHEN seq > 6 AND h % 25 = 0 THEN 'B. Contributors' WHEN seq > 6 AND h % 25 = 1 THEN 'Team: Ada Vale, Bo Lind*, Cy Orr' ELSE line END AS text,
            CASE WHEN h % 13 = 0 THEN 20 ELSE 200 END AS x, 760 - 30 * (k + 1) AS y, CASE WHEN h % 13 = 0 THEN 180 ELSE 412 END AS x2, 780 - 30 * (k + 1) AS y2, 1 + h % 3 AS n_lines, 0 AS rotation FROM numbered)""",
        "escaped_lines": "(SELECT doc_id, seq, h, line, 'P' || lpad(CAST(page + 1 AS STRING), 2, '0') || '-' || lpad(CAST(k + 1 AS STRING), 3, '0') AS id, replace(replace(line, '&', '&amp;'), '<', '&lt;') AS safe FROM numbered)",
        "unit_html": """(SELECT doc_id, seq, h, id, line, '<p id="' || id || '">' || CASE WHEN h % 11 = 0 THEN '<br>' ELSE '' END || CASE WHEN h % 5 = 0 THEN '<span data-style="1">' || safe || '</span>' ELSE safe END
            || CASE WHEN h % 7 = 0 THEN ' {{KEEP_1}}' ELSE '' END || CASE WHEN h % 9 = 0 THEN ' see www.example.org/' || CAST(seq AS STRING) ELSE '' END || CASE WHEN h % 4 = 0 THEN ' in ' || CAST(h AS STRING) ELSE '' END || '</p>' AS html FROM escaped_lines)""",
        # Replies that repeat their source, but for one defect each, by h % 47.
        "html_replies": f"""(SELECT u.doc_id, u.seq, u.html AS source, coalesce(p.line, '') AS before, coalesce(n.line, '') AS after, {d.array("'x^2 + y^2'", "'ab'")} AS hints, CASE WHEN u.doc_id % 8 = 0 THEN 'ja-JP' ELSE 'zh-CN' END AS language,
            CASE u.h % 47 WHEN 1 THEN replace(u.html, '</p>', '<b>x</b></p>') WHEN 2 THEN replace(u.html, '</p>', '') WHEN 3 THEN replace(u.html, '</p>', '<span data-style="1">a<span data-style="1">b</span></span></p>') WHEN 4 THEN replace(u.html, '</p>', '<span data-style="1">a</p>')
            WHEN 5 THEN replace(u.html, ' {{{{KEEP_1}}}}', '') WHEN 6 THEN replace(u.html, '</p>', ' {{{{KEEP_9}}}}</p>') WHEN 7 THEN replace(u.html, '</p>', ' x^2 + y^2</p>') WHEN 8 THEN replace(u.html, 'example.org', 'example.com') WHEN 9 THEN replace(u.html, '</p>', '<span data-style="9">z</span></p>')
            WHEN 10 THEN replace(u.html, '</p>', '‮q</p>') WHEN 11 THEN replace(u.html, '</p>', '⁦q</p>') WHEN 12 THEN replace(u.html, '</p>', '⁩q⁦</p>') WHEN 13 THEN u.html || u.html WHEN 14 THEN replace(u.html, '</p>', ' ' || coalesce(p.safe, '') || '</p>')
            WHEN 15 THEN replace(u.html, '</p>', 'abcabcabcabcabc</p>') WHEN 16 THEN replace(u.html, '</p>', ' 4,2</p>') WHEN 17 THEN replace(u.html, u.line, u.line || ' ' || u.line || ' ' || u.line || ' ' || u.line) WHEN 18 THEN replace(u.html, '</p>', 'かな</p>') WHEN 19 THEN replace(u.html, u.id, 'P99-999')
            WHEN 20 THEN replace(u.html, '</p>', '{{{{KEEP_0}}}}</p>') WHEN 21 THEN u.line WHEN 22 THEN u.html || ' more' WHEN 23 THEN replace(u.html, '</p>', '{{{{KEEP_</p>') WHEN 24 THEN replace(u.html, '</p>', '</span></p>') WHEN 25 THEN replace(u.html, u.id, 'P00-001') WHEN 26 THEN replace(u.html, '</p>', '<span class="a">b</span></p>')
            WHEN 27 THEN u.html || replace(u.html, u.id, 'P99-999') WHEN 28 THEN replace(u.html, '<br>', '<br/> <br />') WHEN 29 THEN replace(u.html, '</p>', '&lt;b&gt; &amp;amp; &copy;</p> ') ELSE u.html END AS reply
            FROM unit_html u LEFT JOIN escaped_lines p ON p.doc_id = u.doc_id AND p.seq = u.seq - 1 LEFT JOIN escaped_lines n ON n.doc_id = u.doc_id AND n.seq = u.seq + 1)""",
        # Six events of a run are a job's; what they are, and how an exit went, is by rule.
        "job_steps": f"(SELECT CAST(run_id AS STRING) || '-' || CAST({d.div('seq - 1', '6')} AS STRING) AS job, seq, (seq - 1) % 6 AS step, {d.div('ms', '10')} AS ms FROM log)",
        "job_events": """(SELECT job, seq, CASE step WHEN 0 THEN CASE WHEN ms % 11 = 0 THEN 'start' ELSE 'create' END WHEN 1 THEN CASE WHEN ms % 11 < 2 THEN 'cancel' WHEN ms % 11 = 2 THEN 'exit' WHEN ms % 11 = 3 THEN 'restart' WHEN ms % 11 = 4 THEN 'create' ELSE 'start' END
            WHEN 2 THEN CASE WHEN ms % 11 < 3 THEN 'cancel' WHEN ms % 11 = 3 THEN 'restart' WHEN ms % 11 = 4 THEN 'start' WHEN ms % 11 < 7 THEN 'progress' ELSE 'exit' END WHEN 3 THEN CASE WHEN ms % 3 = 0 THEN 'progress' ELSE 'exit' END WHEN 4 THEN CASE WHEN ms % 5 = 0 THEN 'exit' WHEN ms % 5 = 1 THEN 'start' ELSE 'progress' END ELSE 'cancel' END AS kind,
            ms % 13 = 0 AS timed_out, ms % 7 <> 0 AS enveloped, ms % 5 <> 0 AS ok, ms % 3 AS exit_code, CASE WHEN ms % 4 = 0 THEN 'bad_input' ELSE '' END AS error_code FROM job_steps)""",
        "asset_ledger": "(SELECT 'A' || CAST(doc_id % 50 AS STRING) || '-' || label AS sha, doc_id * 1048576 + seq AS place, CASE WHEN h % 7 IN (0, 2, 5) THEN 'release' ELSE 'put' END AS op FROM units)",
        # Segments of a run's log overlap and nest; every fifth line has no number, some lie in no segment.
        "log_places": f"(SELECT run_id, seq, span, kind, {d.div('ms', '10')} AS ms FROM log)",
        "log_segments": "(SELECT run_id, span AS segment, span * 20 AS lo, span * 20 + 5 + (ms % 7) * (ms % 7) AS hi FROM log_places WHERE kind = 'started')",
        "log_lines": "(SELECT run_id, seq, CASE WHEN ms % 5 = 0 THEN NULL ELSE seq * 10 + ms % 90 - 40 END AS number, CASE WHEN kind = 'started' AND ms % 3 > 0 THEN span END AS marker, ms % 4 > 0 AS is_issue FROM log_places)",
        "label_links": "(SELECT doc_id, number AS label, CASE WHEN CAST(number AS BIGINT) % 5 = 0 THEN target % 2 ELSE 0 END AS destination, CASE WHEN CAST(number AS BIGINT) % 5 = 0 AND CAST(number AS BIGINT) % 10 > 0 THEN target % 2 ELSE 0 END AS kind, ord, CAST(row_number() OVER (PARTITION BY doc_id, number ORDER BY ord) AS BIGINT) + CASE WHEN h % 13 = 0 THEN 1 ELSE 0 END AS occurrence FROM links)",
        "label_places": "(SELECT doc_id, number AS label, ord AS place, CASE WHEN CAST(number AS BIGINT) % 5 = 0 THEN target % 2 WHEN CAST(number AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS kind FROM out_links)",
        "label_sources": "(SELECT doc_id, number AS label, count(*) AS occurrences FROM links GROUP BY doc_id, number)",
        "frame_paragraphs": """(SELECT b.doc_id, b.page, b.seq, b.x, b.y, b.x2, b.y2, coalesce(r.x, b.x) AS rx, coalesce(r.x2, b.x2) AS rx2, b.h % 6 = 0 AS centred, CASE WHEN b.label IN ('figure_caption', 'table_caption') THEN 'caption' WHEN b.label IN ('title', 'paragraph_title') THEN 'heading' ELSE 'text' END AS kind,
            b.y2 - b.src_font AS baseline, CASE WHEN b.h % 4 = 0 THEN (b.y2 - b.y) * 2 ELSE (b.y2 - b.y) - b.h % 20 END AS used FROM boxes b LEFT JOIN regions r ON b.doc_id = r.doc_id AND b.seq = r.rid WHERE b.label NOT IN ('header', 'footer', 'table'))""",
        "frame_obstacles": "(SELECT doc_id, page, seq AS owner, x, y, x2, y2 FROM boxes)",
        # Five units are a batch. Of 23 batches some replies are broken, whole or in one entry.
        "batch_items": f"(SELECT doc_id, {d.div('seq - 1', '5')} AS batch, (seq - 1) % 5 AS id, source AS input, (doc_id * 7 + {d.div('seq - 1', '5')}) % 23 AS fault, reply, seq FROM replies)",
        "batch_entries": f"""(SELECT doc_id, batch, id, fault, '{{"' || CASE WHEN fault = 7 AND id = 1 THEN 'no' ELSE 'id' END || '": ' || CASE WHEN fault = 5 AND id = 0 THEN '"0"' WHEN fault = 9 AND id = 0 THEN '77' ELSE CAST(id AS STRING) END || ', "output": '
            || CASE WHEN fault = 6 AND id = 0 THEN '12' WHEN fault = 11 AND id = 0 THEN 'null' ELSE '"' || replace(replace(replace({d.sub('reply', '[{chr92}x00-{chr92}x1f]', ' ').replace('{chr92}', chr(92))}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '/', chr(92) || '/') || '"' END || '}}' AS entry FROM batch_items)""",
        "batch_replies": f"""(SELECT doc_id, batch, CASE fault WHEN 0 THEN 'Here it is: ' || min(entry) WHEN 1 THEN '{{"a": 1}}' WHEN 2 THEN '```json' || chr(10) || '[' || {d.nlisted('entry', "', '", 'id')} || ']' || chr(10) || '```' WHEN 3 THEN '[' || min(entry) || ']' WHEN 4 THEN min(entry) WHEN 8 THEN '<json>[' || {d.nlisted('entry', "', '", 'id')} || ']</json>'
            WHEN 10 THEN NULL WHEN 12 THEN '[]' WHEN 13 THEN '[7, ' || {d.nlisted('entry', "', '", 'id')} || ']' ELSE '[' || {d.nlisted('entry', "', '", 'id')} || ']' END AS output FROM batch_entries GROUP BY doc_id, batch, fault)""",
        "gated_documents": "(SELECT doc_id, doc_id % 13 <> 0 AS parsed, doc_id % 11 <> 0 AS rebuilt, doc_id % 7 <> 0 AS applied FROM documents)",
        "coverage_reports": "(SELECT doc_id, CAST(sum(length(source)) AS BIGINT) AS total_chars, CAST(sum(CASE WHEN h % 31 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS uncovered_chars, 5 AS per_mille FROM units WHERE doc_id % 13 <> 0 GROUP BY doc_id)",
        "source_uris": "(SELECT doc_id, CAST(target AS STRING) || ':' || number AS uri FROM links)",
        "output_uris": "(SELECT doc_id, CAST(target AS STRING) || ':' || number AS uri FROM out_links WHERE doc_id % 11 <> 0)",
        "toc_headings": "(SELECT doc_id, seq AS ord, '[[S1]]' || source AS heading FROM units WHERE label IN ('title', 'paragraph_title'))",
        "toc_anchor_rows": "(SELECT doc_id, seq AS ord, CASE WHEN h % 16 = 0 THEN 'other ' || source ELSE replace(source, ' ', '  ') END AS canonical FROM units WHERE label IN ('title', 'paragraph_title'))",
        "box_overrides": "(SELECT doc_id, seq, CASE WHEN h % 10 = 0 THEN 8 ELSE 10 END AS width10, CASE WHEN h % 10 = 0 THEN 8 ELSE 12 END AS height10 FROM boxes WHERE h % 10 < 2)",
    }


#: What makes many rows of a text's, or joins a text's rows with each other. A Spark query that reads one of these deals the
#: documents' texts by id once, and all that is made of them stays where it is: joins, groups and windows by document and page
#: or unit need no shuffle of what is up to sixty times as large. ``catalog.over_files`` says into how many parts.
DEALT = {"glyphs", "glyph_texts", "replies", "html_replies"}
DEAL = "REPARTITION(doc_id)"


def _dealt(d: Dialect) -> dict[str, str]:
    """Definitions that keep to the deal: documents by id, and regions without a union, which forgets how its rows lie."""
    wide = lambda *values: ", ".join(f"CAST({v} AS BIGINT) AS {n}" for n, v in zip(("conf", "x", "y", "x2", "y2"), values))
    own = wide("50 + seq % 50", "x - ((h % 7) - 3)", "y - ((h % 7) - 3)", "x2 + ((h % 7) - 3)", "y2 + ((h % 7) - 3)")
    regions = d.unnest("boxes", "doc_id, page", f"array_compact(array(CASE WHEN h % 16 <> 0 THEN struct(seq AS rid, label, {own}) END, CASE WHEN k = 0 THEN struct(100000 + page AS rid, 'figure' AS label, {wide(40, 300, 100, 560, 330)}) END))", "r")
    return {
        "lines": d.unnest(f"(SELECT /*+ {DEAL} */ doc_id, text FROM documents)", "doc_id", "split(text, chr(10))", "line", "seq"),
        "regions": f"(SELECT doc_id, page, r.rid, r.label, r.conf, r.x, r.y, r.x2, r.y2 FROM {regions} AS __r)",
    }


@lru_cache
def definitions(name: str) -> dict[str, str]:
    from ..functions.dialect import DUCKDB, SPARK

    return _definitions(SPARK if name == "spark" else DUCKDB)


def with_clause(d: Dialect, body: str) -> str:
    """``body`` preceded by the derived tables that it names, in order."""
    import re

    found = definitions(d.name)
    needed: set[str] = set()
    work = [body]
    while work:
        text = work.pop()
        for name in found:
            if name not in needed and re.search(rf"\b{name}\b(?!\s*\()", text):
                needed.add(name)
                work.append(found[name])
    if d.name == "spark" and needed & DEALT:
        found = found | _dealt(d)
    return prefixed(body, [f"{n} AS (SELECT * FROM {found[n]} AS __{n})" for n in found if n in needed])


def prefixed(body: str, parts: list[str]) -> str:
    """``body`` with more common table expressions before its own."""
    if not parts:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body.lstrip()[15:]
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body.lstrip()[5:]
    return "WITH " + ", ".join(parts) + " " + body
