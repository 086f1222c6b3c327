"""Restricted unit HTML: hand cases of every parse error and of every code, and random texts against a small parser."""

import random
import re

import pytest

import quire.plans.registry  # noqa: F401
from quire.functions.dialect import SPARK
from quire.operators import unit_html
from quire.operators.catalog import CATALOG
from quire.operators.unit_html import CODES, STRUCTURAL

SCHEMA = "doc_id long, seq long, source string, reply string, before string, after string, hints array<string>, language string"


def unit(text, id="P01-001"):
    return f'<p id="{id}">{text}</p>'


def run(spark, name, cases):
    rows = [(1, k, *(c + ("", "", [], "en")[len(c) - 2 :])) for k, c in enumerate(cases)]
    return [r for r in sorted(CATALOG[name].on(spark, html_replies=spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.seq)]


PARSED = {
    unit("a &amp;lt; &quot;b&quot; &copy; & {c}"): ("P01-001", 'a &lt; "b" &copy; & {c}', "", "", 0),
    ' \n<p\tid="P123-4567">x<br>y<br/>z<br />{{KEEP_12}}<span data-style="3">s{{KEEP_1}}<br></span></p> \r\n': ("P123-4567", "xyzs", "3", "12,1", 4),
    unit(""): ("P01-001", "", "", "", 0),
    unit("1 > 0 {{KEEP {KEEP_1}"): ("P01-001", "1 > 0 {{KEEP {KEEP_1}", "", "", 0),
}
BROKEN = {
    "plain": "no_paragraph",
    "": "no_paragraph",
    '<pre id="P01-001">a</p>': "no_paragraph",
    '<p id="P01-001" class="x">a</p>': "no_paragraph",
    unit("a", "P1-001"): "bad_id",
    unit("a", "P00-001"): "bad_id",
    unit("a", "P01-4294967296"): "bad_id",
    unit("a", "x"): "bad_id",
    '<p id="P01-001">a': "unclosed_paragraph",
    '<p id="P01-001"><span data-style="1">a': "unclosed_paragraph",
    unit('<span data-style="1">a'): "unclosed_span",
    unit('<span data-style="1">a<span data-style="2">b</span></span>'): "nested_span",
    unit('<span data-style="1"><span>'): "nested_span",
    unit('<span data-style="01">a</span>'): "bad_span",
    unit("<span data-style='1'>a</span>"): "bad_span",
    unit('<span data-style="4294967296">a</span>'): "bad_span",
    unit("a</span>"): "unbalanced_span",
    unit("{{KEEP_0}}"): "bad_atom",
    unit("{{KEEP_}}"): "bad_atom",
    unit("{{KEEP_1a}}"): "bad_atom",
    unit("{{KEEP_4294967296}}"): "bad_atom",
    unit("{{KEEP_1} a"): "unterminated_atom",
    unit("a <b>c</b>"): "disallowed_tag",
    unit("a <BR>"): "disallowed_tag",
    unit('<span data-style="1"><i></span>'): "disallowed_tag",
    unit("a") + "b": "content_after",
    unit("a") + unit("b"): "content_after",
}


def test_parser(spark):
    rows = run(spark, "sc14_unit_html_parse", [("", h) for h in [*PARSED, *BROKEN]])
    assert [(r.id, r.text, r.styles, r.atoms, r.breaks) for r in rows[: len(PARSED)]] == list(PARSED.values())
    assert [r.error for r in rows] == [None] * len(PARSED) + list(BROKEN.values())


def simple_parse(html):
    """Position by position, as the grammar is told."""
    m = re.match(r'[ \t\n\r]*<p[ \t\n\r]+id="([^"]*)">', html)
    if not m:
        return "no_paragraph"
    pos, span = m.end(), False
    if not re.fullmatch(r"P[0-9]{2,}-[0-9]{3,}", m[1]) or not all(int(x) for x in re.findall("[0-9]+", m[1])):
        return "bad_id"
    while pos < len(html):
        rest = html[pos:]
        if rest.startswith("</p>"):
            return "unclosed_span" if span else None if not rest[4:].strip(" \t\n\r") else "content_after"
        if rest.startswith("<span"):
            if span:
                return "nested_span"
            m = re.match('<span data-style="[1-9][0-9]*">', rest)
            if not m:
                return "bad_span"
            span, pos = True, pos + m.end()
        elif rest.startswith("</span>"):
            if not span:
                return "unbalanced_span"
            span, pos = False, pos + 7
        elif m := re.match("<br ?/?>", rest):
            if m[0] == "<br >":
                return "disallowed_tag"
            pos += m.end()
        elif rest.startswith("{{KEEP_"):
            end = rest.find("}}")
            if end < 0:
                return "unterminated_atom"
            if not re.fullmatch("[1-9][0-9]*", rest[7:end]):
                return "bad_atom"
            pos += end + 2
        elif rest.startswith("<"):
            return "disallowed_tag"
        else:
            pos += 1
    return "unclosed_paragraph"


def test_parser_on_random_markup(spark):
    r = random.Random(3)
    parts = ["a", " ", "{", "}}", "<br>", "<br >", "{{KEEP_1}}", "{{KEEP_", "{{KEEP_07}}", '<span data-style="2">', "</span>", "</span>", "<span>", "</p>", "<i>", "<", "\n"]
    texts = ['<p id="P01-001">' + "".join(r.choice(parts[:7] * 2 + parts) for _ in range(r.randrange(0, 7))) + r.choice(["</p>", "</p>", ""]) for _ in range(1500)]
    rows = run(spark, "sc14_unit_html_parse", [("", t) for t in texts])
    assert [r.error for r in rows] == [simple_parse(t) for t in texts]


S = "The value {{KEEP_1}} is 3.5 here"
CASES = {
    "invalid_markup": [(unit("Deep learning"), unit("Deep <b>learning</b>")), (unit("alpha<br>beta"), unit("alpha beta")), (unit("a"), "a")],
    "placeholder_count": [(unit(S), unit("The value is 3.5 here")), (unit(S), unit(S + "{{KEEP_1}}"))],
    "unknown_placeholder": [(unit(S), unit("The value {{KEEP_7}} is 3.5 here"))],
    "atom_hint_leakage": [(unit(S), unit("The x^2 + y^2 {{KEEP_1}} is 3.5"), "", "", [" x^2 + y^2 "])],
    "link_label_changed": [(unit("Write to alice@example.com."), unit("Write to alice@sample.com.")), (unit("(see www.ab.org)"), unit("(see www.ab.com)"))],
    "unknown_style": [(unit('a <span data-style="1">b</span>'), unit('a <span data-style="9">b</span>'))],
    "unsafe_bidi_control": [(unit("abc"), unit("ab‮c"))],
    "unbalanced_bidi_isolate": [(unit("abc"), unit("ab⁦c")), (unit("abc"), unit("ab⁩⁦c"))],
    "duplicated_text_slots": [(unit("a"), unit("a") * 2)],
    "neighbor_context_leakage": [(unit("a b c d e f"), unit("This comes before it"), "This comes before it and after", "")],
    "pathological_text_repetition": [(unit("fine text"), unit("fine abcabcabcabc")), (unit("fine text"), unit("x" * 12))],
    "protected_literal_count": [(unit("in 1998, 3.5 and 7"), unit("in 1998, 3,5 and 7"))],
    "excessive_target_expansion": [(unit("eight ch"), unit("a quick brown fox jumps over"))],
    "residual_japanese": [(unit("text"), unit("かtext"))],
    "unknown_paragraph": [(unit("a"), unit("a", "P02-001")), (unit("a"), unit("a") + unit("b", "P02-001"))],
}
VALID = [
    (unit(S), unit("Here 3.5 is {{KEEP_1}} the value")),
    (unit('a <span data-style="1">b</span> <span data-style="2">c</span>'), unit('<span data-style="2">c</span> a b')),
    (unit("text"), unit("かtext"), "", "", [], "ja-JP"),
    (unit("seven c"), unit("a quick brown fox jumps over")),
    (unit("abc"), unit("a⁦b⁧c⁩⁩")),
    (unit("aaaaaaaaaaaa"), unit("xxxxxxxxxxxx")),
    (unit("xy"), unit("aaaaaaaaaaa", )),
    (unit("A name, Ada Vale of the North, is here"), unit("Ada Vale of the North"), "", "by Ada Vale of the North"),
    (unit("a"), unit("ab ab ab"), "short", "also short", ["ab"]),
    (unit("mail a@b@c.d or www"), unit("mail")),
]


@pytest.mark.parametrize("code", CODES)
def test_codes(spark, code):
    rows = run(spark, "qc06_unit_codes", CASES[code])
    assert all(code in r.codes.split(",") for r in rows), [r.codes for r in rows]
    assert all(r.n_structural == len(set(r.codes.split(",")) & set(STRUCTURAL)) for r in rows)
    assert len(CODES) == 15 and len(STRUCTURAL) == 8


def test_valid_replies_and_edits_by_hand(spark):
    assert [r.codes for r in run(spark, "qc06_unit_codes", VALID)] == [""] * len(VALID)
    assert [r.codes for r in run(spark, "qc06_unit_codes", [(unit("a"), unit("a", "P02-001")), (unit("a"), unit("b<i>", "P02-001"))])] == ["unknown_paragraph", "invalid_markup,unknown_paragraph"]
    row = run_documents(spark, [*VALID, *CASES["protected_literal_count"], *CASES["unknown_style"]])
    assert (row.units, row.automatic_ok, row.manual_ok) == (len(VALID) + 2, len(VALID), len(VALID) + 1)


def run_documents(spark, cases):
    rows = [(1, k, *(c + ("", "", [], "en")[len(c) - 2 :])) for k, c in enumerate(cases)]
    return CATALOG["qc07_manual_codes"].on(spark, html_replies=spark.createDataFrame(rows, SCHEMA)).first()


def test_guards_let_every_fault_through(spark):
    """Tests behind their guards find what they find without, and the dear ones stand behind one."""
    texts = ["", "plain", "see http://a.b/c 1,2", "see http://a.b/d 1,2", "(www.ab.cd), 3", "mail x@y.z now 4.5", "x@y.z", "\u2066a\u2069", "\u2069a\u2066", "\u2066a", "hint and more", None]
    rows = [(s, r, ["hint", "ab"], "zh-CN") for s in texts for r in texts]
    frame = spark.createDataFrame(rows, "s_text string, r_text string, hints array<string>, language string")
    codes = ["atom_hint_leakage", "link_label_changed", "unbalanced_bidi_isolate", "protected_literal_count"]
    plain, behind = unit_html.checks(SPARK), unit_html.guarded(SPARK)
    got = frame.selectExpr(*(f"coalesce({t[c]}, false) AS {c}_{k}" for k, t in (("plain", plain), ("behind", behind)) for c in codes)).collect()
    for c in codes:
        assert behind[c] != plain[c] and any(r[f"{c}_plain"] for r in got)
        assert [r[f"{c}_plain"] for r in got] == [r[f"{c}_behind"] for r in got]
