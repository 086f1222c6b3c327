"""Scalar text functions of the pipeline, applied to the derived units."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .catalog import operator, simple


@operator("fs05_strip_wrappers")
def strip_wrappers(d: Dialect) -> str:
    """Code fences and tags around a reply removed."""
    inner = d.sub(d.sub("trim(reply)", r"^<json>|</json>$"), r"^```(json)?|```$")
    return f"SELECT doc_id, seq, trim(replace({inner}, chr(10), ' ')) AS clean FROM wrapped_replies"


@operator("fs06_text_repair")
def text_repair(d: Dialect) -> str:
    """Spaces after marks put back, blanks collapsed, line ends to spaces."""
    x = "replace(replace(source, ', ', ','), '. ', '.')"
    x = d.sub(d.sub(d.sub(x, ",([a-z])", ", $1"), ";([a-z])", "; $1"), r"([a-z]{2})\.([A-Z])", "$1. $2")
    return f"SELECT doc_id, seq, replace({d.sub(x, '[ \\t]{2,}', ' ')}, chr(10), ' ') AS repaired FROM units"


simple("fs08_markdown_to_canonical", "Markdown anchors as canonical ones.", lambda d: f"SELECT doc_id, seq, {d.sub(d.sub(d.sub('markdown', r'\[\[S([0-9]+)\]\]', '<style id=$1>'), r'\[\[/S\]\]', '</style>'), r'\[\[F([0-9]+)\]\]', '{v$1}')} AS canonical FROM markdown_texts")
simple("fs11_strip_comments", "HTML without comments, closed or dangling.", lambda d: f"SELECT page_id, length({d.sub(d.sub('html', r'(?s)<!--.*?-->'), r'(?s)<!--.*$')}) AS n, length(html) - length({d.sub('html', r'(?s)<!--.*?-->')}) AS removed FROM pages")
simple("fs12_clean_markdown", "Markdown bodies cleaned by label.", lambda d: f"SELECT doc_id, seq, CASE WHEN label IN ('title', 'paragraph_title') THEN {d.sub('md', '^#+ +')} WHEN label = 'reference' THEN {d.sub('md', '^[-*] +')} ELSE trim(md) END AS body FROM markdown_bodies")
simple("fs13_term_normal_form", "Terms lowered, blanks to one, trimmed.", lambda d: f"SELECT seq, trim({d.sub('lower(source)', '[ ]+', ' ')}) AS term FROM glossary")
simple("fs19_bidi", "Direction marks: unsafe ones and unbalanced isolates.", lambda d: f"WITH t AS (SELECT doc_id, seq, target AS t FROM direction_texts) SELECT doc_id, seq, {d.like('t', '[‪-‮]')} AS unsafe, {d.times('t', '[⁦-⁨]')} = {d.times('t', '⁩')} AS balanced FROM t WHERE {d.like('t', '[‪-‮⁦-⁩]')}")
def numerals(most: int = 99) -> str:
    """1..most as Roman, Arabic and Chinese numerals, made by rule."""

    def roman(n: int) -> str:
        out = ""
        for value, sign in ((90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            out += sign * (n // value)
            n %= value
        return out

    def chinese(n: int) -> str:
        ones = "零一二三四五六七八九"
        tens = ("" if n < 20 else ones[n // 10]) + "十" if n >= 10 else ""
        return tens + (ones[n % 10] if n % 10 else "")

    return " UNION ALL ".join(f"SELECT {n} AS n, '{roman(n)}' AS roman, '{chinese(n)}' AS chinese" for n in range(1, most + 1))


@operator("fs26_anchor_variants")
def anchor_variants(d: Dialect) -> str:
    """Spellings of a reference that count as the same: translated prefixes, and Roman numerals as Arabic and Chinese."""
    prefix = {"Figure": "图", "Table": "表", "Equation": "式", "Section": "第"}
    sign = " ".join(f"WHEN '{w}' THEN '{z}'" for w, z in prefix.items())
    word, numeral = d.group("anchor", "^([A-Za-z]+) ", 1), d.group("anchor", " ([A-Z0-9]+)$", 1)
    return f"WITH n AS ({numerals()}), k AS (SELECT roman AS spelled, n, roman, chinese FROM n UNION ALL SELECT CAST(n AS STRING) AS spelled, n, roman, chinese FROM n), a AS (SELECT doc_id, seq, anchor, {word} AS word, {numeral} AS spelled FROM reference_anchors) SELECT a.doc_id, a.seq, a.anchor, CASE a.word {sign} END || k.roman AS translated, CAST(k.n AS STRING) AS arabic, k.chinese FROM a JOIN k ON a.spelled = k.spelled"


simple("fs27_reference_role", "Role of a link by its destination and by the text around it.", lambda d: "SELECT l.doc_id, l.ord, CASE WHEN l.target = 0 THEN 'cite' WHEN l.target = 1 THEN 'figure' WHEN l.target = 2 THEN 'table' ELSE 'section' END AS role, CASE WHEN u.label = 'figure_caption' THEN 'figure' WHEN u.label IN ('table', 'table_caption') THEN 'table' WHEN u.label = 'reference' THEN 'cite' ELSE 'section' END AS context_role FROM links l JOIN units u ON l.doc_id = u.doc_id AND l.ord = u.seq")
simple("fs28_paper_meta", "First author and cleaned title of first lines.", lambda d: f"SELECT doc_id, {d.sub('line', '[^A-Za-z ]+')} AS title, {d.at(d.split('line', ','), '1')} AS first_author FROM numbered WHERE seq = 1")
simple("fs29_slug", "Slugs: lower case, other signs to hyphens, forty characters.", lambda d: f"SELECT doc_id, seq, substr({d.sub(d.sub('lower(line)', '[^a-z0-9]+', '-'), '^-|-$')}, 1, 40) AS slug FROM numbered")
simple("fs30_escape", "Block text with its entities escaped.", "SELECT doc_id, seq, '<p id=' || id || '>' || replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' AS html FROM units")
simple("fs31_atoms", "Atoms of a unit: links, addresses, citations, numbers with units, in order.", lambda d: f"WITH a AS (SELECT doc_id, seq, {d.found('source', r'https?://[^ ]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\[[0-9, ]+\]|[0-9]+([.][0-9]+)? ?(%|kg|cm|ms)|[{]v[0-9]+[}]')} AS atoms FROM units) SELECT doc_id, seq, {d.size('atoms')} AS n, {d.joined('atoms', '|')} AS atoms FROM a WHERE {d.size('atoms')} > 0")
simple("fs32_toc_split", "Contents lines: heading, leader and page.", lambda d: f"SELECT doc_id, seq, {d.group('line', r'^(.*?)([. ]*)([0-9]+)$', 1)} AS heading, length({d.group('line', r'^(.*?)([. ]*)([0-9]+)$', 2)}) AS leader, CAST({d.group('line', r'([0-9]+)$', 1)} AS BIGINT) AS page FROM contents_rows WHERE {d.like('line', '[. ]{2,}[0-9]+$')}")
simple("fh01_identity", "Content identity: SHA-256 of text and a key of sorted parameters.", lambda d: f"SELECT doc_id, {d.sha('text')} AS sha, md5('lang=' || lang || ';source=' || source) AS params FROM documents")


# Brackets that keep a comma from splitting.
OPENS, CLOSES = "({[", ")}]"


@operator("xo06_comma_split")
def comma_split(d: Dialect) -> str:
    """Pieces of a line between commas outside brackets (depth floored at 0); empty pieces are left out."""
    if d.name == "duckdb":
        step = f"CASE WHEN contains('{OPENS}', ch) THEN 1 WHEN contains('{CLOSES}', ch) THEN -1 ELSE 0 END"
        return f"""WITH c AS {d.unnest("numbered", "doc_id, seq", "string_split(line, '')", "ch", "i")}, s AS (SELECT *, sum({step}) OVER (PARTITION BY doc_id, seq ORDER BY i) AS s FROM c),
            m AS (SELECT *, ch = ',' AND s <= least(0, min(s) OVER (PARTITION BY doc_id, seq ORDER BY i)) AS cut FROM s), p AS (SELECT *, count_if(cut) OVER (PARTITION BY doc_id, seq ORDER BY i) AS k FROM m),
            j AS (SELECT doc_id, seq, k, string_agg(ch, '' ORDER BY i) AS piece FROM p WHERE NOT cut GROUP BY doc_id, seq, k) SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id, seq ORDER BY k) AS BIGINT) AS place, trim(piece) AS piece FROM j WHERE piece <> ''"""
    tokens = d.found("line", r"[^(){}\[\],]+|[(){}\[\],]")
    ended = "CASE WHEN z.piece = '' THEN z.pieces ELSE concat(z.pieces, array(z.piece)) END"
    pieces = f"""aggregate({tokens}, named_struct('depth', 0, 'piece', '', 'pieces', CAST(array() AS ARRAY<STRING>)), (z, t) -> CASE WHEN t = ',' AND z.depth = 0 THEN named_struct('depth', 0, 'piece', '', 'pieces', {ended})
        ELSE named_struct('depth', CASE WHEN contains('{OPENS}', t) THEN z.depth + 1 WHEN contains('{CLOSES}', t) THEN greatest(0, z.depth - 1) ELSE z.depth END, 'piece', concat(z.piece, t), 'pieces', z.pieces) END, z -> {ended})"""
    return f"SELECT doc_id, seq, place, trim(piece) AS piece FROM {d.unnest('numbered', 'doc_id, seq', pieces, 'piece', 'place')} z"
