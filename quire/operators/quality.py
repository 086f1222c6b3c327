"""Translation quality: the document check and its rules, the reply protocol, the unit validator."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .catalog import operator, simple

# Anchors, patterns and thresholds of the checks.
ANCHOR = r"<style id='\d+'>|</style>|\{v\d+\}"
PLACEHOLDER = r"\{v\d+\}|<style\s+id='\d+'>|</style>|<b\d+>|</b\d+>"
CJK = "[一-鿿]"
SPLICE = r"[A-Za-z]{2,}\{v\d+\}[A-Za-z]{2,}"
SENTENCE_END = r"[A-Za-z)\]][.!?][\"'”’)\]]*$"
TARGET_END = r"[。！？…][\"'”’)\]]*$"
REFERENCE_LIKE = (
    r"(?i)proceedings of|copyright|permission to make digital|all rights reserved|https?://|doi\.org|\bdoi\b|arxiv:|\bisbn\b|@[a-z0-9.-]+\.[a-z]{2,}|\.\s*(19|20)\d{2}\.\s"
)
TRUNCATED, TRUNCATED_LEAST, MERGED, LOW_CJK, LOW_CJK_LEAST, LOW_CJK_DENSITY = 0.5, 40, 1.6, 0.15, 40, 0.3


def plain(d: Dialect, x: str) -> str:
    return d.sub(x, ANCHOR)


def share(n: str, total: str) -> str:
    return f"(CASE WHEN {total} > 0 THEN {n} / CAST({total} AS DOUBLE) ELSE 0.0 END)"


def wide(d: Dialect) -> str:
    """One row a unit with everything the rules need (table expressions ``measured`` and ``wide``)."""
    return f"""measured AS (
        SELECT u.doc_id, u.seq, u.id, u.page, u.label, u.source, t.target, trim({plain(d, "u.source")}) AS sp, trim({plain(d, "t.target")}) AS tp,
            1.0 - {share(f"length({plain(d, 'u.source')})", "length(u.source)")} AS density, length({plain(d, "t.target")}) AS tlen, {d.times(plain(d, "t.target"), CJK)} AS cjk, {d.times(plain(d, "t.target"), "[\\x00-\\x7f]")} AS ascii
        FROM units u LEFT JOIN targets t ON u.doc_id = t.doc_id AND u.seq = t.seq),
    ratios AS (SELECT doc_id, median(length(tp) / CAST(length(sp) AS DOUBLE)) AS mid FROM measured WHERE target IS NOT NULL AND sp <> '' GROUP BY doc_id),
    wide AS (SELECT m.*, r.mid, CASE WHEN m.target IS NOT NULL AND m.sp <> '' THEN length(m.tp) / CAST(length(m.sp) AS DOUBLE) END AS ratio, CASE WHEN r.mid > 0 AND m.target IS NOT NULL AND m.sp <> '' THEN length(m.tp) / CAST(length(m.sp) AS DOUBLE) / r.mid WHEN m.target IS NOT NULL AND m.sp <> '' THEN 0.0 END AS rel,
        {share("m.cjk", "m.tlen")} AS cjk_ratio, {share("m.ascii", "m.tlen")} AS ascii_ratio, {d.like("m.sp", REFERENCE_LIKE)} AS reference_like FROM measured m LEFT JOIN ratios r ON m.doc_id = r.doc_id)"""


RULES = {
    "missing_ids": ("P0", "target IS NULL"),
    "empty_target": ("P0", "target IS NOT NULL AND tp = '' AND sp <> ''"),
    "intra_paragraph_truncated": ("P1", f"length(sp) >= {TRUNCATED_LEAST} AND rel < {TRUNCATED}"),
    "low_cjk": ("P1", f"length(sp) >= {LOW_CJK_LEAST} AND tp <> '' AND density < {LOW_CJK_DENSITY} AND cjk_ratio < {LOW_CJK} AND NOT (ascii_ratio >= 0.85 AND reference_like)"),
}


def rules(d: Dialect) -> dict[str, tuple[str, str]]:
    return RULES | {
        "markdown_comment_leak": ("P0", "target LIKE '%<!--%'"),
        "sentence_end_mismatch": ("P1", f"length(sp) >= {TRUNCATED_LEAST} AND tp <> '' AND {d.like('sp', SENTENCE_END)} AND NOT reference_like AND NOT {d.like('tp', TARGET_END)}"),
        "formula_splice": ("P2", d.like("source", SPLICE)),
    }


def findings(d: Dialect) -> str:
    """All rules judged in one pass over ``wide``: an array of codes a unit, exploded."""
    codes = d.present(d.array(*(f"CASE WHEN {rule} THEN '{code}' END" for code, (_, rule) in rules(d).items())))
    severity = "CASE code " + " ".join(f"WHEN '{code}' THEN '{sev}'" for code, (sev, _) in rules(d).items()) + " END"
    return f"SELECT doc_id, seq, id, page, label, code, {severity} AS severity FROM {d.unnest('wide', 'doc_id, seq, id, page, label', codes, 'code')} AS __f"


@operator("qc02_document_check")
def document_check(d: Dialect) -> str:
    """All findings of the document check, one row a unit and code."""
    return f"WITH {wide(d)} {findings(d)}"


@operator("qc02_metrics")
def metrics(d: Dialect) -> str:
    """Per document: rows, checked targets, median length ratio and the number of findings of each kind."""
    names = {"empty_target": "empty_targets", "intra_paragraph_truncated": "truncated", "low_cjk": "low_cjk", "sentence_end_mismatch": "sentence_end_mismatch", "formula_splice": "formula_splice"}
    counts = ", ".join(f"count(CASE WHEN {rules(d)[code][1]} THEN 1 END) AS {name}" for code, name in names.items())
    return f"WITH {wide(d)} SELECT doc_id, count(*) AS n_rows, count(target) AS checked_targets, coalesce(max(mid), 0.0) AS median_len_ratio, {counts} FROM wide GROUP BY doc_id"


@operator("qc03_suspect_merge")
def suspect_merge(d: Dialect) -> str:
    """Units much longer than the median within a page of a missing or empty one; the ten longest a document."""
    return f"""WITH {wide(d)}, holes AS (SELECT DISTINCT doc_id, page AS hole FROM wide WHERE target IS NULL OR (tp = '' AND sp <> '')),
        near AS (SELECT DISTINCT w.doc_id, w.seq, w.id, w.page, w.rel FROM wide w JOIN holes h ON w.doc_id = h.doc_id AND w.page BETWEEN h.hole - 1 AND h.hole + 1 WHERE length(w.sp) >= {TRUNCATED_LEAST} AND w.cjk_ratio >= {LOW_CJK} AND w.rel > {MERGED}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rel DESC, seq) AS n FROM near) SELECT doc_id, seq, id, page, rel FROM ranked WHERE n <= 10"""


def tokens(d: Dialect) -> str:
    """Placeholders of source and reply, counted (table expression ``diff``)."""
    side = lambda col: d.unnest("replies", "doc_id, seq, id", d.found(col, PLACEHOLDER), "token")
    return f"""a AS (SELECT doc_id, seq, id, token, count(*) AS n FROM {side("source")} x GROUP BY doc_id, seq, id, token), b AS (SELECT doc_id, seq, id, token, count(*) AS n FROM {side("reply")} x GROUP BY doc_id, seq, id, token),
        diff AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.seq, b.seq) AS seq, coalesce(a.id, b.id) AS id, coalesce(a.token, b.token) AS token, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS actual FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.seq = b.seq AND a.token = b.token)"""


@operator("so01_placeholder_difference")
def placeholder_difference(d: Dialect) -> str:
    """Multiset difference of placeholders: lost and unexpected ones with their counts."""
    return f"WITH {tokens(d)} SELECT doc_id, seq, id, token, CAST(greatest(expected - actual, 0) AS BIGINT) AS lost, CAST(greatest(actual - expected, 0) AS BIGINT) AS unexpected FROM diff WHERE expected <> actual"


@operator("qc01_reply_protocol")
def reply_protocol(d: Dialect) -> str:
    """Violations of the reply protocol: ids without reply, replies without text, lost or unexpected placeholders."""
    return f"""WITH {tokens(d)} SELECT doc_id, seq, CASE WHEN actual < expected THEN 'placeholder_lost' ELSE 'placeholder_hallucinated' END AS code, token AS detail FROM diff WHERE expected <> actual
        UNION ALL SELECT u.doc_id, u.seq, 'id_mismatch' AS code, u.id AS detail FROM units u LEFT ANTI JOIN replies r ON u.doc_id = r.doc_id AND u.seq = r.seq
        UNION ALL SELECT doc_id, seq, 'no_output' AS code, id AS detail FROM replies WHERE reply = ''""".replace("LEFT ANTI JOIN", "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN")


@operator("ag19_protocol_rates")
def protocol_rates(d: Dialect) -> str:
    """Share of units with a violation, and a histogram by code."""
    return f"""WITH {tokens(d)}, bad AS (SELECT doc_id, seq, CASE WHEN actual < expected THEN 'placeholder_lost' ELSE 'placeholder_hallucinated' END AS code FROM diff WHERE expected <> actual),
        total AS (SELECT count(*) AS n FROM replies) SELECT code, count(*) AS violations, count(DISTINCT {d.tuple('doc_id', 'seq')}) AS units, count(DISTINCT {d.tuple('doc_id', 'seq')}) / CAST(max(total.n) AS DOUBLE) AS rate FROM bad, total GROUP BY code"""


@operator("so02_placeholder_order")
def placeholder_order(d: Dialect) -> str:
    """Replies whose placeholders are the source's in another order (a warning), and those whose multisets differ."""
    a, b = d.found("source", PLACEHOLDER), d.found("reply", PLACEHOLDER)
    return f"SELECT doc_id, seq, {d.size(a)} AS n_source, {d.size(b)} AS n_reply, ({d.sort(a)} = {d.sort(b)}) AS same_multiset, ({d.sort(a)} = {d.sort(b)} AND NOT ({a} = {b})) AS reordered FROM replies WHERE {d.size(a)} > 0 OR {d.size(b)} > 0"


@operator("qc05_markdown_apply")
def markdown_apply(d: Dialect) -> str:
    """What applying replies does to each unit, and whether its document may be written (all or nothing)."""
    a, b = d.found("u.source", PLACEHOLDER), d.found("r.reply", PLACEHOLDER)
    return f"""WITH judged AS (SELECT u.doc_id, u.seq, u.id, CASE WHEN r.id IS NULL THEN 'missing' WHEN trim(r.reply) = '' THEN 'empty' WHEN {d.sort(a)} <> {d.sort(b)} THEN 'violation' WHEN {d.like("r.reply", "<style id='[0-9]+'></style>")} THEN 'empty_span' ELSE 'applied' END AS outcome
        FROM units u LEFT JOIN replies r ON u.doc_id = r.doc_id AND u.seq = r.seq) SELECT doc_id, seq, id, outcome, outcome IN ('missing', 'empty') AS falls_back, sum(CASE WHEN outcome = 'violation' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 0 AS document_written FROM judged"""


def unit_flags(d: Dialect) -> list[tuple[str, str]]:
    """Codes of the unit validator with their tests, in order; the first four are structural."""
    numbers = r"[0-9]+(?:[.,][0-9]+)*"
    literal = r"https?://[^\s<>]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return [
        ("empty", "trim(t) = ''"),
        ("placeholder_lost", f"{d.size(d.minus(d.found('s', PLACEHOLDER), d.found('t', PLACEHOLDER)))} > 0"),
        ("placeholder_added", f"{d.size(d.minus(d.found('t', PLACEHOLDER), d.found('s', PLACEHOLDER)))} > 0"),
        ("placeholder_count", f"{d.size(d.found('s', PLACEHOLDER))} <> {d.size(d.found('t', PLACEHOLDER))}"),
        ("expansion", "length(s) >= 8 AND length(t) > 3 * length(s)"),
        ("literal_lost", d.any(d.found("s", literal), "z", f"NOT {d.has('t', 'z')}")),
        ("numbers_changed", f"{d.sort(d.found('s', numbers))} <> {d.sort(d.found('t', numbers))}"),
        ("kana", d.like("t", "[぀-ヿ]")),
        ("bidi", d.like("t", "[‪-‮]")),
        ("control", d.like("t", r"[\x00-\x08\x0b\x0c\x0e-\x1f]")),
        ("html_comment", "t LIKE '%<!--%'"),
        ("untranslated", "length(s) >= 8 AND s = t"),
    ]


@operator("qc06_unit_validator")
def unit_validator(d: Dialect) -> str:
    """Codes that each reply violates, sorted, and how many of them are structural."""
    flags = unit_flags(d)
    cases = d.array(*(f"CASE WHEN {test} THEN '{code}' END" for code, test in flags))
    structural = ", ".join(f"'{c}'" for c, _ in flags[:4])
    return f"WITH p AS (SELECT doc_id, seq, source AS s, reply AS t FROM replies), f AS (SELECT doc_id, seq, {d.sort(d.present(cases))} AS codes FROM p) SELECT doc_id, seq, {d.joined('codes', ',')} AS codes, {d.size(d.keep('codes', 'c', f'c IN ({structural})'))} AS n_structural FROM f WHERE {d.size('codes')} > 0"


@operator("qc07_manual_edits")
def manual_edits(d: Dialect) -> str:
    """Edits made by hand need structural validity only: which units would be refused if edited, which if automatic."""
    flags = unit_flags(d)
    cases = d.array(*(f"CASE WHEN {test} THEN '{code}' END" for code, test in flags))
    structural = ", ".join(f"'{c}'" for c, _ in flags[:4])
    return f"WITH p AS (SELECT doc_id, seq, source AS s, reply AS t FROM replies), f AS (SELECT doc_id, seq, {d.present(cases)} AS codes FROM p) SELECT doc_id, count(*) AS units, count_if({d.size('codes')} = 0) AS automatic_ok, count_if({d.size(d.keep('codes', 'c', f'c IN ({structural})'))} = 0) AS manual_ok FROM f GROUP BY doc_id"


@operator("ag18_verdict")
def verdict(d: Dialect) -> str:
    """needs_fix if any blocker, unavailable if nothing was checked, else pass."""
    hit = lambda sev: " + ".join(f"count(CASE WHEN {rule} THEN 1 END)" for s, rule in rules(d).values() if sev in (s, None))
    return f"WITH {wide(d)}, seen AS (SELECT doc_id, count(target) AS checked, CAST({hit('P0')} AS BIGINT) AS blockers, CAST({hit(None)} AS BIGINT) AS findings FROM wide GROUP BY doc_id) SELECT doc_id, CASE WHEN checked = 0 THEN 'unavailable' WHEN blockers > 0 THEN 'needs_fix' ELSE 'pass' END AS verdict, blockers, findings FROM seen"


@operator("ag14_counts_by_code")
def counts_by_code(d: Dialect) -> str:
    """Findings by code and severity."""
    return f"WITH {wide(d)}, found AS ({findings(d)}) SELECT code, severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM found GROUP BY code, severity"


#: Codes that make a unit one of high risk, those of warnings before those of blockers.
HIGH_RISK = ("intra_paragraph_truncated", "low_cjk", "sentence_end_mismatch", "missing_ids", "empty_target")


@operator("qc10_high_risk")
def high_risk(d: Dialect) -> str:
    """Of each document the first forty units of high risk, in order of first sight, each once."""
    order = " ".join(f"WHEN '{code}' THEN {k}" for k, code in enumerate(HIGH_RISK))
    return f"""WITH {wide(d)}, found AS ({findings(d)}), ids AS (SELECT doc_id, seq, id, min(CASE code {order} END) AS first_seen FROM found WHERE code IN {HIGH_RISK!r} GROUP BY doc_id, seq, id),
        placed AS (SELECT doc_id, seq, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_seen, seq) AS BIGINT) AS place FROM ids)
    SELECT doc_id, seq, id, place FROM placed WHERE place <= 40"""


@operator("qc12_fix_rounds")
def fix_rounds(d: Dialect) -> str:
    """Findings by kind with the action each asks for, and whether its rounds (two at most) are spent."""
    return f"WITH {wide(d)}, found AS ({findings(d)}) SELECT doc_id, code, count(*) AS n, CASE WHEN severity = 'P2' THEN 'note' WHEN code IN ('missing_ids', 'empty_target', 'low_cjk') THEN 'retranslate' ELSE 'review' END AS action, count(*) > 2 AS capped FROM found GROUP BY doc_id, code, severity"


@operator("ag10_relative_ratio")
def relative_ratio(d: Dialect) -> str:
    """Length ratio of each unit against its document's median."""
    return f"WITH {wide(d)} SELECT doc_id, seq, ratio, rel FROM wide WHERE ratio IS NOT NULL"


simple("fs01_plain", "Text without anchors.", lambda d: f"SELECT doc_id, seq, {plain(d, 'source')} AS plain_text, length({plain(d, 'source')}) AS n FROM units")
simple("fs02_densities", "Anchor density, CJK share and ASCII share.", lambda d: f"WITH {wide(d)} SELECT doc_id, seq, density AS anchor_density, cjk_ratio, ascii_ratio FROM wide WHERE target IS NOT NULL")
simple("fs03_sentence_patterns", "Sentence ends, reference-like text and splices.", lambda d: f"SELECT doc_id, seq, {d.like('source', SENTENCE_END)} AS sentence_end, {d.like('source', REFERENCE_LIKE)} AS reference_like, {d.times('source', SPLICE)} AS splices FROM units")
simple("fs04_placeholders", "Placeholders of a text, in order.", lambda d: f"SELECT doc_id, seq, {d.joined(d.found('source', PLACEHOLDER), ' ')} AS placeholders FROM units WHERE {d.times('source', PLACEHOLDER)} > 0")


@operator("fs14_edit_distance")
def edit_distance(d: Dialect) -> str:
    """Levenshtein distance of source and reply."""
    if d.name == "duckdb":
        return f"SELECT doc_id, seq, CAST({d.distance('source', 'reply')} AS BIGINT) AS distance FROM replies"
    # The table of all pairs of signs only where it is needed: ends that agree are cut off, texts without a sign in common differ
    # by the longer one's length, and near ones are found in a band.
    cut = "SELECT doc_id, seq, source, reply FROM replies"
    for n in (8, 4, 2, 1):
        same = f"length(source) >= {n} AND length(reply) >= {n} AND right(source, {n}) = right(reply, {n})"
        cut = f"SELECT doc_id, seq, {', '.join(f'CASE WHEN {same} THEN left({c}, length({c}) - {n}) ELSE {c} END AS {c}' for c in ('source', 'reply'))} FROM ({cut})"
    return f"""SELECT doc_id, seq, CAST(CASE WHEN source = reply THEN 0 WHEN translate(source, reply, '') = source THEN greatest(length(source), length(reply))
        ELSE coalesce(nullif(CASE WHEN abs(length(source) - length(reply)) <= 16 THEN levenshtein(source, reply, 16) ELSE -1 END, -1), levenshtein(source, reply)) END AS BIGINT) AS distance FROM ({cut})"""


simple(
    "fs15_reply_gate",
    "Gate of a reply: same text, length ratio within 0.3 and 3, near-equal text, runaway marks.",
    lambda d: f"SELECT u.doc_id, u.seq, CASE WHEN t.target = '' THEN 'empty' WHEN t.target = u.source AND length(u.source) > 10 THEN 'same' WHEN length(t.target) * 10 < 3 * length(u.source) THEN 'too_short' WHEN length(t.target) > 3 * length(u.source) THEN 'too_long' WHEN length(u.source) > 20 AND {d.closer('u.source', 't.target', 5)} THEN 'near_same' WHEN {d.like('t.target', '[.]{20,}')} THEN 'runaway' ELSE 'ok' END AS gate FROM units u JOIN targets t ON u.doc_id = t.doc_id AND u.seq = t.seq",
)
simple("fs18_control_characters", "Text without control characters.", lambda d: f"SELECT doc_id, seq, {d.sub('source', r'\p{C}')} AS clean, length(source) - length({d.sub('source', r'\p{C}')}) AS removed FROM units")
simple("fs20_kana", "Kana that stayed in a target.", lambda d: f"SELECT doc_id, seq, {d.times('target', '[぀-ヿ]')} AS kana FROM targets")
simple("fs21_literals", "URLs and addresses that a reply must keep.", lambda d: f"WITH l AS (SELECT doc_id, seq, reply, {d.found('source', r'https?://[^ ]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+')} AS a FROM replies) SELECT doc_id, seq, {d.size('a')} AS literals, {d.size(d.keep('a', 'z', f'NOT {d.has("reply", "z")}'))} AS lost FROM l WHERE {d.size('a')} > 0")
simple("fs22_numbers", "Whether the multisets of numbers agree.", lambda d: f"WITH n AS (SELECT doc_id, seq, {d.found('source', '[0-9]+(?:[.,][0-9]+)*')} AS a, {d.found('reply', '[0-9]+(?:[.,][0-9]+)*')} AS b FROM replies) SELECT doc_id, seq, {d.size('a')} AS in_source, {d.size('b')} AS in_reply, ({d.sort('a')} = {d.sort('b')}) AS same FROM n")
simple("fs25_expansion", "Replies more than three times as long as a source of eight characters or more.", "SELECT doc_id, seq, length(source) AS source_chars, length(reply) AS reply_chars, length(source) >= 8 AND length(reply) > 3 * length(source) AS too_long FROM replies")
simple("fs17_compat_ideographs", "Compatibility ideographs in a target.", lambda d: f"SELECT doc_id, seq, {d.times('target', '[豈-﫿]')} AS n FROM targets")
simple(
    "fs23_context_leak",
    "Sixteen-character windows, every eight characters, of the neighbour before that stand in the reply and not in the source.",
    lambda d: f"WITH c AS (SELECT r.doc_id, r.seq, r.source, r.reply, p.source AS before FROM leaky_replies r JOIN units p ON p.doc_id = r.doc_id AND p.seq = r.seq - 1), w AS (SELECT *, {d.map(d.numbers('0', 'CAST(floor((length(before) - 16) / 8) AS BIGINT)'), 'q', 'substr(before, CAST(q * 8 + 1 AS INT), 16)')} AS windows FROM c WHERE length(before) >= 16) SELECT doc_id, seq, {d.size(d.keep('windows', 'z', f'{d.has("reply", "z")} AND NOT {d.has("source", "z")}'))} AS leaked FROM w",
)
