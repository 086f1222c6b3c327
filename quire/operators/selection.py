"""Which paragraphs are translated, and why not."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..functions.geometry import area, inside
from .catalog import operator, simple

# Labels and patterns of the selection rules.
CAPTIONS = ("figure_caption", "table_caption", "code_caption")
PROTECTED = (
    "author", "author_info", "author_info_hybrid", "figure", "figure_text", "figure_text_hybrid", "image", "table", "table_text", "table_footnote", "table_cell", "table_cell_hybrid",
    "reference", "reference_content", "reference_hybrid", "header", "footer", "page_header", "page_footer", "page_number", "page_footnote", "aside_text", "abandon", "toc_entry_page",
)
PROTECTED_REGIONS = (*PROTECTED, "figure_title", "table_title", "chart_title")
CANONICAL = r"<style\b[^>]*>|</style>|\{v\d+\}"
URL = r"(?i)^(?:https?://\S+|(?:doi|isbn)\s*:\s*\S+)$"
URL_WITHIN = r"(?i)https?://\S+|(?:^|[^\p{L}\p{N}_])(?:doi|isbn)\s*:\s*\S+"
EMAIL = r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}$"
ABSTRACT = r"(?i)^(?:abstract|摘要)(?:[^\p{L}\p{N}_]|$)"
REFERENCE_HEADING = "(?i)^(?:references?|bibliography|参考文献|文献)$"
APPENDIX = "(?i)^(?:append(?:ix|ices)|open science|artifact|supplement(?:ary)?|附录)"
LETTER_APPENDIX = r"^[A-Z]\s*[.:)—-]\s*\S.{2,80}$"
AUTHOR_NOTE = r"(?i)corresponding author|the author worked|permission to make digital|all rights reserved|copyright|permission is required|isbn\b"
OVERLAP = 0.55
# Patterns of front matter.
EMAIL_PART = r"(?:^|[\s,;{<>])[^\s,;{<>@]+@[^\s,;{<>]*\.[^\s,;{<>]*[^.\s,;{<>](?:[\s,;{<>]|$)"
AFFILIATION = r"(?i)university|college|institute|department|school of|laboratory|research center|research centre"
STREET = r"(?i)[0-9].* (?:street|st\.|avenue|ave\.|road|rd\.|boulevard|blvd|p\.o\. box)| (?:street|st\.|avenue|ave\.|road|rd\.|boulevard|blvd|p\.o\. box).*[0-9]"
CAPITALISED = r"^(?:(?:(?i:of|and|the)|[^\p{L}\s]*\p{Lu}\S*)(?:\s+|$))+$"
NAMES = r"^[\s,;†‡*]*\p{Lu}[\p{L}'-]*(?:[\s,;†‡*]+\p{Lu}[\p{L}'-]*){1,11}[\s,;†‡*]*$"
AUTHORS_HEADING = r"(?i)^(?:(?:[a-z]|[0-9]+(?:\.[0-9]+)*)[.)]?\s+)?(?:author list|authors|contributors)$"
ROSTER_NAME = r"[*†‡]*\p{Lu}[\p{L}.'’-]*[*†‡]*(?:\s+[*†‡]*\p{Lu}[\p{L}.'’-]*[*†‡]*){1,5}"
ROSTER = rf"^[\s,]*{ROSTER_NAME}(?:\s*,[\s,]*{ROSTER_NAME})+[\s,]*$"


def among(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(chr(39) + v + chr(39) for v in values)})"


def normal(d: Dialect, x: str) -> str:
    return d.sub(f"lower(trim({x}))", r"[\s/]+", "_")


def context(d: Dialect) -> str:
    """Table expression ``judged``: units with text, box, references state, region hit and author band."""
    return f"""texts AS (SELECT u.doc_id, u.seq, u.page, u.label, {normal(d, "u.label")} AS kind, trim({d.sub("u.source", CANONICAL)}) AS text, b.x, b.y, b.x2, b.y2 FROM units u JOIN boxes b ON u.doc_id = b.doc_id AND u.seq = b.seq),
        marked AS (SELECT *, CASE WHEN {d.like("text", REFERENCE_HEADING)} THEN 'on' WHEN {d.like("text", APPENDIX)} OR ({among("kind", ("title", "doc_title", "paragraph_title"))} AND {d.like("text", LETTER_APPENDIX)}) THEN 'off' END AS mark FROM texts),
        stated AS (SELECT *, {d.carried("mark", "PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")} AS state FROM marked),
        hits AS (SELECT DISTINCT t.doc_id, t.seq FROM texts t JOIN regions r ON t.doc_id = r.doc_id AND t.page = r.page WHERE {among("r.label", PROTECTED_REGIONS)} AND {inside("t", "r")} >= {OVERLAP}),
        titles AS (SELECT doc_id, max_by(y, {d.tuple(area("texts"), "-seq")}) AS title_y FROM texts WHERE page = 0 AND {among("kind", ("title", "doc_title"))} AND text <> '' AND NOT {d.like("text", ABSTRACT)} GROUP BY doc_id),
        abstracts AS (SELECT doc_id, max(y2) AS abstract_y2 FROM texts WHERE page = 0 AND {d.like("text", ABSTRACT)} GROUP BY doc_id),
        judged AS (SELECT s.*, h.seq IS NOT NULL AS in_region, s.page = 0 AND NOT {among("s.kind", (*CAPTIONS, "title", "doc_title", "paragraph_title"))} AND t.title_y IS NOT NULL AND a.abstract_y2 IS NOT NULL AND s.y2 <= t.title_y + 2 AND s.y >= a.abstract_y2 - 2 AS in_band
            FROM stated s LEFT JOIN hits h ON s.doc_id = h.doc_id AND s.seq = h.seq LEFT JOIN titles t ON s.doc_id = t.doc_id LEFT JOIN abstracts a ON s.doc_id = a.doc_id)"""


def reason(d: Dialect) -> str:
    """First rule that holds; null: translate. The crop box begins at 0."""
    return f"""CASE WHEN mark = 'on' THEN 'references_heading' WHEN state = 'on' THEN 'references' WHEN {among("kind", CAPTIONS)} THEN NULL WHEN {among("kind", PROTECTED)} THEN kind WHEN in_region THEN 'protected_layout_region' WHEN in_band THEN 'author_affiliation'
        WHEN {d.like("text", AUTHOR_NOTE)} AND y <= 110 THEN 'page_footnote' WHEN {d.like("text", EMAIL)} OR {d.like("text", URL)} THEN 'link_or_contact' WHEN y <= 45 AND length(text) > 20 AND ({d.like("text", AUTHOR_NOTE)} OR {d.like("text", URL_WITHIN)}) THEN 'page_footer' END"""


@operator("pf03_select_paragraph")
def select_paragraph(d: Dialect) -> str:
    """Decision and reason for every paragraph, rules in order."""
    return f"WITH {context(d)} SELECT doc_id, seq, {reason(d)} AS reason, {reason(d)} IS NULL AS translate FROM judged"


@operator("ag_selection_reasons")
def selection_reasons(d: Dialect) -> str:
    """How many paragraphs each reason keeps from translation."""
    return f"WITH {context(d)}, r AS (SELECT coalesce({reason(d)}, 'translate') AS reason FROM judged) SELECT reason, count(*) AS n FROM r GROUP BY reason"


simple("wf01_references_state", "Whether the references section is open at each paragraph, across pages.", lambda d: f"WITH {context(d)} SELECT doc_id, seq, coalesce(state, 'off') AS state, mark FROM judged")
simple("wf02_author_band", "First-page paragraphs between the largest title and the highest abstract.", lambda d: f"WITH {context(d)} SELECT doc_id, seq, y, y2 FROM judged WHERE in_band")
simple("jn05_protected_region", "Paragraphs with 0.55 or more of their area in a protected region.", lambda d: f"WITH {context(d)} SELECT doc_id, seq FROM hits")
simple("pf01_normalize_label", "Labels trimmed, lowered, white space and slashes to one underscore.", lambda d: f"SELECT doc_id, seq, {normal(d, chr(39) + '  Mixed / ' + chr(39) + ' || upper(label)')} AS label FROM units")
simple("pf02_protected_label", "Paragraphs of a protected label.", lambda d: f"SELECT doc_id, seq, label FROM units WHERE {among(normal(d, 'label'), PROTECTED)}")
simple("pf04_caption_override", "Captions are translated though they lie in a protected region.", lambda d: f"WITH {context(d)} SELECT doc_id, seq, kind, in_region FROM judged WHERE {among('kind', CAPTIONS)}")
simple("pf05_author_note", "Author and legal notes near the page's foot.", lambda d: f"WITH {context(d)} SELECT doc_id, seq, y, {d.like('text', AUTHOR_NOTE)} AS note, y <= 110 AS low FROM judged WHERE {d.like('text', AUTHOR_NOTE)} OR y <= 20")
simple("pf06_link_only", "Texts that are one address or link.", lambda d: f"SELECT doc_id, seq, w FROM {d.unnest('numbered', 'doc_id, seq', d.split('line', ' '), 'w')} z WHERE {d.like('w', EMAIL)} OR {d.like('w', URL)}")
simple("pf07_translatable", "Units that may go to a translator: label, text, length.", lambda d: f"SELECT doc_id, seq FROM units WHERE {among('label', ('text', 'title', 'paragraph_title', 'figure_caption', 'table_caption'))} AND source IS NOT NULL AND length(trim(source)) >= 5 AND NOT {d.like('source', r'^[(]cid:')}")
simple("pf08_cid_paragraph", "Units of which more than four fifths of the words are unmapped glyph codes.", lambda d: f"WITH w AS (SELECT doc_id, seq, t FROM {d.unnest('coded_units', 'doc_id, seq', d.split('line', ' '), 't')} z) SELECT doc_id, seq, count(*) AS n, count_if({d.like('t', r'^[(]cid:[0-9]+[)]$')}) AS cids, count_if({d.like('t', r'^[(]cid:[0-9]+[)]$')}) * 5 > count(*) * 4 AS is_cid FROM w GROUP BY doc_id, seq")
simple("ag29_cid_document", "Documents of which more than four fifths of the units are glyph codes.", lambda d: f"WITH w AS (SELECT doc_id, seq, t FROM {d.unnest('coded_units', 'doc_id, seq', d.split('line', ' '), 't')} z), u AS (SELECT doc_id, seq, CASE WHEN count_if({d.like('t', r'^[(]cid:[0-9]+[)]$')}) * 5 > count(*) * 4 THEN 1 ELSE 0 END AS cid FROM w GROUP BY doc_id, seq) SELECT doc_id, count(*) AS n, CAST(sum(cid) AS BIGINT) AS cids, sum(cid) * 5 > count(*) * 4 AS is_cid FROM u GROUP BY doc_id")
simple("pf09_numeric", "Words that are one number.", lambda d: f"SELECT doc_id, seq, w FROM {d.unnest('numbered', 'doc_id, seq', d.split('line', ' '), 'w')} z WHERE {d.like('w', r'^-?[0-9]+([.][0-9]+)?$')}")
simple("pf10_placeholder_only", "Units with nothing but placeholders.", lambda d: f"SELECT doc_id, seq, source AS s FROM bare_units WHERE trim({d.sub('source', CANONICAL)}) = ''")
simple("pf11_line_number", "Units of ASCII digits and spaces.", lambda d: f"SELECT doc_id, seq FROM margin_units WHERE {d.like('source', r'^[0-9 ]*$')}")
simple("pf12_region_kind", "Labels mapped to region kinds, and which kinds are translated.", "WITH kinds AS (SELECT 'title' AS label, 'heading' AS kind UNION ALL SELECT 'paragraph_title', 'heading' UNION ALL SELECT 'text', 'body' UNION ALL SELECT 'figure_caption', 'caption' UNION ALL SELECT 'table_caption', 'caption' UNION ALL SELECT 'table', 'table' UNION ALL SELECT 'figure', 'figure' UNION ALL SELECT 'header', 'margin' UNION ALL SELECT 'footer', 'margin' UNION ALL SELECT 'reference', 'reference') SELECT k.kind, count(*) AS n, k.kind IN ('heading', 'body', 'caption') AS translatable FROM regions r JOIN kinds k ON r.label = k.label GROUP BY k.kind")
simple("pf13_untranslatable", "Why a unit's content is not translated: kind, no letters, too short.", lambda d: f"SELECT doc_id, seq, CASE WHEN label IN ('table', 'header', 'footer', 'reference') THEN 'region_kind' WHEN NOT {d.like(d.sub('source', CANONICAL), r'\p{L}')} THEN 'no_letters' WHEN length(trim({d.sub('source', CANONICAL)})) < 12 THEN 'too_short' END AS reason FROM units")
@operator("pf16_front_matter")
def front_matter(d: Dialect) -> str:
    """First-page lines between the lowest line of the title and the abstract that tell of the authors: short centred
    lines with an address, an affiliation or names, protected in runs of lines at most 24 points apart that hold an
    email or an affiliation. Page of 612 by 792 points."""
    email, address = d.like("t", EMAIL_PART), d.like("t", STREET)
    affiliation = f"({d.like('t', AFFILIATION)} AND {d.like('t', CAPITALISED)} AND NOT {d.like('t', r'[!?]|[.]$')})"
    return f"""WITH p AS (SELECT *, trim(text) AS t FROM front_paragraphs WHERE page = 0 AND rotation % 180 = 0), top AS (SELECT doc_id, max(y) AS top_y FROM p WHERE kind = 'title' GROUP BY doc_id),
        low AS (SELECT p.doc_id, max(p.y2) AS low_y FROM p JOIN top ON p.doc_id = top.doc_id WHERE (p.kind = 'abstract' OR p.kind = 'paragraph_title' AND lower(p.t) = 'abstract') AND p.y2 < top.top_y GROUP BY p.doc_id),
        c AS (SELECT p.doc_id, p.seq, p.y, p.y2, p.translatable, {email} OR {affiliation} AS anchor, {email} OR {affiliation} OR {address} OR {d.like('t', NAMES)} AS told FROM p JOIN top ON p.doc_id = top.doc_id JOIN low ON p.doc_id = low.doc_id
            WHERE top_y - low_y >= 12 AND 100 * (top_y - low_y) <= 28 * 792 AND p.kind = 'text' AND p.y > low_y + 1 AND p.y2 < top_y - 1 AND 4 * (p.x2 - p.x) <= 3 * 612 AND 100 * abs(p.x + p.x2 - 612) <= 32 * 612 AND p.n_lines BETWEEN 1 AND 2 AND length(p.text) <= 160 AND p.y2 - p.y <= 2 * (p.x2 - p.x)),
        g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id ORDER BY y DESC, seq) - y2 AS gap FROM c WHERE told), r AS (SELECT *, sum(CASE WHEN gap > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y DESC, seq) AS run FROM g),
        s AS (SELECT *, max(CASE WHEN anchor THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) AS anchored FROM r) SELECT doc_id, seq, anchor FROM s WHERE anchored = 1 AND translatable"""


@operator("pf16_author_roster")
def author_roster(d: Dialect) -> str:
    """Lists of names under a heading that announces authors, up to the next heading, over pages."""
    names = f"CASE WHEN {d.like('text', '^[^:]{0,80}:')} THEN {d.sub('text', '^[^:]*:')} ELSE text END"
    state = d.carried("heading", "PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return f"""WITH h AS (SELECT *, CASE WHEN kind NOT IN ('title', 'paragraph_title') THEN NULL WHEN {d.like("trim(text)", AUTHORS_HEADING)} THEN 'on' ELSE 'off' END AS heading FROM front_paragraphs),
        s AS (SELECT *, {state} AS state FROM h) SELECT doc_id, page, seq FROM s WHERE state = 'on' AND kind = 'text' AND translatable AND {d.like(names, ROSTER)}"""



simple("pf20_redaction", "Secrets and addresses scrubbed from texts.", lambda d: f"SELECT doc_id, seq, {d.sub(d.sub('line', '(?i)(token|key|secret|password)( ?[=:] ?).?[A-Za-z0-9]{8,}.?', '$1$2***'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>')} AS scrubbed FROM numbered WHERE {d.like('line', '(?i)token|@')}")
