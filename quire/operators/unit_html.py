"""Units of translation as restricted HTML: their parser with typed errors, and the validator of replies.

A unit is one ``<p id="P01-001">`` that holds text, ``<br>``, kept atoms ``{{KEEP_n}}`` and, one level deep,
``<span data-style="n">``. Text knows five character references; any other ``&`` stands for itself. The parser cuts a unit
into tokens, writes a letter for each, and lets the automaton of the grammar run over the letters as a regular
expression: what it could read is well formed, and the letter after that, with whether a span was open, names the error.
No rows are exploded, no function leaves the engine.
"""

from __future__ import annotations

from ..functions.dialect import Dialect
from .catalog import operator

#: The tokens of a unit after its opening tag, well-formed ones before broken ones.
TOKEN = r'</p>|<span data-style="[1-9][0-9]*">|<span|</span>|<br>|<br/>|<br />|\{\{KEEP_[\s\S]*?\}\}|\{\{KEEP_|<[^>]*>?|[^<{]+|\{'
HEAD = r'^[ \t\n\r]*<p[ \t\n\r]+id="([^"]*)">'
TAIL = r"</p>[ \t\n\r]+$"
UNIT_ID = r"^P([0-9]{2,})-([0-9]{3,})$"
STYLE = r'<span data-style="([1-9][0-9]*)">'
ATOM = r"\{\{KEEP_([1-9][0-9]*)\}\}"
#: Character references of text; the ampersand last, so that nothing is decoded twice.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
#: Largest number of a style or an atom.
MOST = 4_294_967_295

#: Letters of tokens: T text, W white space, B break, K atom, S span opened, Z span closed, Q paragraph closed;
#: s, k, U, X are a broken span, a broken atom, one without end, and any other tag.
INSIDE = "[TWBK]"
ERROR_BY_LETTER = {"s": "bad_span", "Z": "unbalanced_span", "k": "bad_atom", "U": "unterminated_atom", "X": "disallowed_tag"}
ERROR_IN_SPAN = ERROR_BY_LETTER | {"S": "nested_span", "s": "nested_span", "Q": "unclosed_span"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if "'" not in text else "chr(39)"


def _number_fits(x: str) -> str:
    return f"(length({x}) < 10 OR length({x}) = 10 AND CAST({x} AS BIGINT) <= {MOST})"


def _letter(d: Dialect, x: str) -> str:
    style, atom = d.group(x, STYLE, 1), d.group(x, f"^{ATOM}$", 1)
    return f"""CASE WHEN {x} = '</p>' THEN 'Q' WHEN {x} = '</span>' THEN 'Z' WHEN {x} IN ('<br>', '<br/>', '<br />') THEN 'B'
        WHEN {x} LIKE '<span%' THEN CASE WHEN {style} <> '' AND {_number_fits(style)} THEN 'S' ELSE 's' END
        WHEN {x} = '{{{{KEEP_' THEN 'U' WHEN {x} LIKE '{{{{KEEP_%' THEN CASE WHEN {atom} <> '' AND {_number_fits(atom)} THEN 'K' ELSE 'k' END
        WHEN {x} LIKE '<%' THEN 'X' WHEN {d.like(x, '^[ \t\n\r]+$'.replace(chr(9), r'\t').replace(chr(10), r'\n').replace(chr(13), r'\r'))} THEN 'W' ELSE 'T' END"""


def _decoded(x: str) -> str:
    for name, sign in REFERENCES:
        x = f"replace({x}, '{name}', {quoted(sign)})"
    return x


def _after(letters: str, head: str) -> str:
    return f"substr({letters}, CAST(length({head}) + 1 AS INT))"


def _by_letter(x: str, errors: dict[str, str]) -> str:
    return " ".join(f"WHEN '{letter}' THEN '{error}'" for letter, error in errors.items())


def parse_stages(d: Dialect, sides: dict[str, str], source: str) -> str:
    """Common table expressions ``stage_1`` to ``stage_4`` over ``source``: for each side (prefix: column of HTML) the columns
    id, error (null if well formed), text, styles, atoms (arrays) and breaks, by prefix."""
    one, two, three, four = [], [], [], []
    for p, html in sides.items():
        one += [f"{d.like(html, HEAD)} AS {p}headed", f"{d.group(html, HEAD, 1)} AS {p}id", f"{d.found(d.sub(d.sub(html, HEAD), TAIL, '</p>'), TOKEN)} AS {p}tokens"]
        marks = f"(x LIKE '<%' OR x LIKE '{{{{KEEP_%')"
        two += [
            f"{d.joined(d.map(f'{p}tokens', 'x', _letter(d, 'x')), '')} AS {p}letters",
            f"{_decoded(d.joined(d.keep(f'{p}tokens', 'x', f'NOT {marks}'), ''))} AS {p}text",
            f"{d.map(d.keep(f'{p}tokens', 'x', d.like('x', f'^{STYLE}$')), 'x', d.group('x', STYLE, 1))} AS {p}styles",
            f"{d.map(d.keep(f'{p}tokens', 'x', d.like('x', f'^{ATOM}$')), 'x', d.group('x', ATOM, 1))} AS {p}atoms",
            f"{d.size(d.keep(f'{p}tokens', 'x', d.like('x', '^<br ?/?>$')))} AS {p}breaks",
        ]
        read = d.group(f"{p}letters", f"^(?:{INSIDE}|S{INSIDE}*Z)*", 0)
        three += [f"{_after(f'{p}letters', read)} AS {p}rest"]
        span = d.group(f"{p}rest", f"^S{INSIDE}*", 0)
        page, place = d.group(f"{p}id", UNIT_ID, 1), d.group(f"{p}id", UNIT_ID, 2)
        bad_id = f"NOT {d.like(f'{p}id', UNIT_ID)} OR {d.like(page, '^0*$')} OR {d.like(place, '^0*$')} OR length(ltrim({page}, '0')) > 10 OR length(ltrim({place}, '0')) > 10 OR CAST({page} AS BIGINT) > {MOST} OR CAST({place} AS BIGINT) > {MOST}"
        if d.name == "spark":
            bad_id = bad_id.replace(f"ltrim({page}, '0')", f"ltrim('0', {page})").replace(f"ltrim({place}, '0')", f"ltrim('0', {place})")
        four += [
            f"""CASE WHEN NOT {p}headed THEN 'no_paragraph' WHEN {bad_id} THEN 'bad_id' WHEN {p}rest = '' THEN 'unclosed_paragraph'
            WHEN {p}rest LIKE 'Q%' THEN CASE WHEN {d.like(f'{p}rest', '^QW*$')} THEN NULL ELSE 'content_after' END
            WHEN {p}rest LIKE 'S%' THEN CASE substr({_after(f'{p}rest', span)}, 1, 1) {_by_letter('', ERROR_IN_SPAN)} ELSE 'unclosed_paragraph' END
            ELSE CASE substr({p}rest, 1, 1) {_by_letter('', ERROR_BY_LETTER)} END END AS {p}error"""
        ]
    names, before = ("stage_1", "stage_2", "stage_3", "stage_4"), (source, "stage_1", "stage_2", "stage_3")
    return ", ".join(f"{n} AS (SELECT *, {', '.join(c)} FROM {b})" for n, b, c in zip(names, before, (one, two, three, four), strict=True))


@operator("sc14_unit_html_parse")
def unit_html_parse(d: Dialect) -> str:
    """Replies parsed by the restricted grammar: the unit's id, plain text, styles, atoms and breaks, or the first error."""
    keep = lambda x: f"CASE WHEN error IS NULL THEN {x} END"
    return f"""WITH {parse_stages(d, {"": "html"}, "(SELECT doc_id, seq, reply AS html FROM html_replies) AS __r")}
        SELECT doc_id, seq, error, {keep("id")} AS id, {keep("text")} AS text, {keep(d.joined("styles", ","))} AS styles, {keep(d.joined("atoms", ","))} AS atoms, {keep("breaks")} AS breaks FROM stage_4"""


#: Codes of the validator in order, and those that a reply by hand must not violate either.
CODES = (
    "invalid_markup placeholder_count unknown_placeholder atom_hint_leakage link_label_changed unknown_style unsafe_bidi_control unbalanced_bidi_isolate duplicated_text_slots "
    "neighbor_context_leakage pathological_text_repetition protected_literal_count excessive_target_expansion residual_japanese unknown_paragraph"
).split()
STRUCTURAL = "invalid_markup placeholder_count unknown_placeholder unknown_style unsafe_bidi_control unbalanced_bidi_isolate duplicated_text_slots unknown_paragraph".split()
#: Fixed values of the checks on text.
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
EDGES = r"""^[.,;:()\[\]{}"']+|[.,;:()\[\]{}"']+$"""
LINK = r"^(?:https?://|www\.)|^[^@]+@[^@]*\.[^@]*$"
UNSAFE_BIDI = "[‪-‮]"
ISOLATES, ISOLATE_END = "[⁦-⁨]", "⁩"
KANA = "[ぁ-ゖゝ-ゟァ-ヺヽ-ヿ]"
WINDOW, STEP, LEAST_WINDOW = 16, 8, 8
REPEATED_TIMES, SHORT_SOURCE, EXPANSION = 4, 8, 3


def _links(d: Dialect, text: str) -> str:
    stripped = d.map(d.found(text, r"[^\s]+"), "w", d.sub("w", EDGES))
    return d.keep(stripped, "w", f"length(w) >= 5 AND {d.like('w', LINK)}")


def _leaks(d: Dialect, context: str) -> str:
    """Whether a window of a neighbour stands in the reply's text and not, trimmed, in the source's. Windows begin every half
    window: two cuts of the neighbour into whole windows, one a half further on."""
    whole = r"[\s\S]{%d}" % WINDOW
    test = f"{d.has('r_text', 'w')} AND length(trim(w)) >= {LEAST_WINDOW} AND NOT {d.has('s_text', 'trim(w)')}"
    return f"({d.any(d.found(f'trim({context})', whole), 'w', test)} OR {d.any(d.found(f'substr(trim({context}), {STEP + 1})', whole), 'w', test)})"


def _unbalanced(d: Dialect, text: str) -> str:
    marks = d.sub(text, f"[^⁦-{ISOLATE_END}]")
    upto = lambda q: f"substr({marks}, 1, CAST({q} AS INT))"
    closes_first = d.any(d.numbers("1", f"length({marks})"), "q", f"{d.times(upto('q'), ISOLATE_END)} * 2 > length({upto('q')})")
    return f"({d.times(text, ISOLATES)} <> {d.times(text, ISOLATE_END)} OR {closes_first})"


def checks(d: Dialect) -> dict[str, str]:
    """Tests of a well-formed reply (columns r_) of a well-formed source (columns s_), by code."""
    atoms = f"{d.sort('s_atoms')} <> {d.sort('r_atoms')}"
    repeated, source_repeated = d.repeats("r_text"), d.repeats("s_text")
    return {
        "invalid_markup": "s_breaks <> r_breaks",
        "placeholder_count": atoms,
        "unknown_placeholder": f"{d.size(d.minus('r_atoms', 's_atoms'))} > 0",
        "atom_hint_leakage": d.any("hints", "h", f"length(trim(h)) >= 3 AND {d.has('r_text', 'trim(h)')} AND NOT {d.has('s_text', 'trim(h)')}"),
        "link_label_changed": d.any(_links(d, "s_text"), "w", f"NOT {d.has('r_text', 'w')}"),
        "unknown_style": f"{d.size(d.minus('r_styles', 's_styles'))} > 0",
        "unsafe_bidi_control": d.like("r_text", UNSAFE_BIDI),
        "unbalanced_bidi_isolate": _unbalanced(d, "r_text"),
        "neighbor_context_leakage": f"r_text <> s_text AND ({_leaks(d, 'before')} OR {_leaks(d, 'after')})",
        "pathological_text_repetition": f"r_text <> s_text AND {d.any(d.array(repeated), 'k', f'k >= {REPEATED_TIMES} AND k > {source_repeated}')}",
        "protected_literal_count": f"{d.sort(d.found('s_text', NUMBER))} <> {d.sort(d.found('r_text', NUMBER))}",
        "excessive_target_expansion": f"length(s_text) >= {SHORT_SOURCE} AND length(r_text) > {EXPANSION} * length(s_text)",
        "residual_japanese": f"language NOT LIKE 'ja%' AND {d.like('r_text', KANA)}",
    }


#: What a text with a link, and one with an isolate, holds at least.
LINK_SIGN, ISOLATE_SIGN = "://|www[.]|@", f"[⁦-{ISOLATE_END}]"


def guarded(d: Dialect) -> dict[str, str]:
    """The same tests, each behind one that is cheap and must hold as well. What a reply may lose or add it neither loses nor adds
    if its text is its source's."""
    tests = checks(d)
    for code in ("atom_hint_leakage", "protected_literal_count"):
        tests[code] = f"r_text <> s_text AND {tests[code]}"
    tests["link_label_changed"] = f"r_text <> s_text AND {d.like('s_text', LINK_SIGN)} AND {tests['link_label_changed']}"
    tests["unbalanced_bidi_isolate"] = f"{d.like('r_text', ISOLATE_SIGN)} AND {tests['unbalanced_bidi_isolate']}"
    return tests


def judged(d: Dialect) -> str:
    """Common table expressions up to ``judged``: doc_id, seq, codes (in order) of each reply."""
    ids = d.map(d.keep(d.found("reply", "<p[^>]*>"), "x", d.like("x", r'^<p\s*id="')), "x", d.group("x", r'^<p\s*id="([^">]*)', 1))
    text_checks = guarded(d) if d.name == "spark" else checks(d)
    duplicated, unknown = f"{d.size(d.distinct('ids'))} < {d.size('ids')}", d.any("ids", "i", "i <> s_id")
    case = lambda code: {
        "invalid_markup": f"n_ids = 0 OR n_ids = 1 AND (r_error IS NOT NULL OR s_error IS NOT NULL OR {text_checks['invalid_markup']})",
        "duplicated_text_slots": f"n_ids > 1 AND ({duplicated} OR NOT {unknown})",
        "unknown_paragraph": f"n_ids > 0 AND (n_ids > 1 OR s_error IS NULL OR r_error IS NOT NULL) AND {unknown}",
    }.get(code, f"whole AND {text_checks.get(code)}")
    found = d.present(d.array(*(f"CASE WHEN {case(code)} THEN '{code}' END" for code in CODES)))
    # one row each: what reads the codes then never works them out again
    once = d.unnest("counted", "doc_id, seq", d.array(found), "codes")
    return f"""{parse_stages(d, {"s_": "source", "r_": "reply"}, "html_replies")}, scanned AS (SELECT *, {ids} AS ids FROM stage_4),
        counted AS (SELECT *, {d.size("ids")} AS n_ids, {d.size("ids")} = 1 AND s_error IS NULL AND r_error IS NULL AS whole FROM scanned),
        judged AS (SELECT doc_id, seq, codes FROM {once} AS __c)"""


@operator("qc06_unit_codes")
def unit_codes(d: Dialect) -> str:
    """Codes that each reply violates, of fifteen, in order (none: an empty text), and how many of them are structural."""
    structural = ", ".join(f"'{c}'" for c in STRUCTURAL)
    return f"WITH {judged(d)} SELECT doc_id, seq, {d.joined('codes', ',')} AS codes, {d.size(d.keep('codes', 'c', f'c IN ({structural})'))} AS n_structural FROM judged"


@operator("qc07_manual_codes")
def manual_codes(d: Dialect) -> str:
    """Replies of each document that pass as a machine's, and as an edit by hand, which needs structural validity only."""
    structural = ", ".join(f"'{c}'" for c in STRUCTURAL)
    return f"""WITH {judged(d)} SELECT doc_id, count(*) AS units, count(CASE WHEN {d.size('codes')} = 0 THEN 1 END) AS automatic_ok,
        count(CASE WHEN NOT {d.any('codes', 'c', f'c IN ({structural})')} THEN 1 END) AS manual_ok FROM judged GROUP BY doc_id"""
