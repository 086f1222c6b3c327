"""Rules on a caller's own small tables."""

import quire.plans.registry  # noqa: F401
from quire.operators.catalog import CATALOG


def selection(spark, texts):
    """Reasons by seq for (seq, label, source, y, y2) on page 0 of one document."""
    units = spark.createDataFrame([(1, s, 0, label, source) for s, label, source, _, _ in texts], "doc_id long, seq long, page long, label string, source string")
    boxes = spark.createDataFrame([(1, s, 50, y, 300, y2) for s, _, _, y, y2 in texts], "doc_id long, seq long, x long, y long, x2 long, y2 long")
    regions = spark.createDataFrame([], "doc_id long, page long, rid long, label string, x long, y long, x2 long, y2 long")
    return {r.seq: r.reason for r in CATALOG["pf03_select_paragraph"].on(spark, units=units, boxes=boxes, regions=regions).collect()}


def test_author_band_needs_an_abstract(spark):
    page = [(1, "title", "A title", 700, 740), (2, "text", "Jane Doe, Some University", 600, 640)]
    assert selection(spark, [*page, (3, "text", "Abstract. We show", 400, 500)])[2] == "author_affiliation"
    assert selection(spark, [*page, (3, "text", "摘要：文本", 400, 500)])[2] == "author_affiliation"
    for text in ("The first sentence of a body", "Abstraction is a body text"):
        assert selection(spark, [*page, (3, "text", text, 400, 500)])[2] is None


def test_footer_with_a_link(spark):
    rows = [(1, "text", "Available from https://example.org/data today", 30, 44), (2, "text", "Available from https://example.org/data today", 300, 340), (3, "text", "A long body line without any of it", 30, 44), (4, "text", "see doi: 10.1/x for the rest", 30, 44)]
    assert selection(spark, rows) == {1: "page_footer", 2: None, 3: None, 4: "page_footer"}


def test_high_risk_is_limited_for_each_document(spark):
    units = spark.createDataFrame([(d, s, f"P{s}", 0, "text", "some words here.") for d in (1, 2) for s in range(1, 61)], "doc_id long, seq long, id string, page long, label string, source string")
    targets = spark.createDataFrame([(2, s, f"P{s}", "") for s in range(31, 61)], "doc_id long, seq long, id string, target string")
    out = CATALOG["qc10_high_risk"].on(spark, units=units, targets=targets).collect()
    for d in (1, 2):
        mine = sorted((r.place, r.seq) for r in out if r.doc_id == d)
        assert mine == [(k, k) for k in range(1, 41)]


def test_glossary_terms_of_any_form(spark):
    """Terms inside words, of one sign, with two blanks in a row, with a blank at either end, and one that is empty."""
    terms = ["eep learn", "K", "a  b", "learning ", " of", "", "深度", "deep learning of", "absent term", "learnings"]
    texts = ["Deep Learning of k things", "a  b", "一深度二", "", "of a b"]
    units = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "doc_id long, seq long, source string")
    glossary = spark.createDataFrame([(x,) for x in terms + ["EEP learn"]], "source string")
    got = sorted((r.seq, r.term) for r in CATALOG["jn20_glossary_terms"].on(spark, units=units, glossary=glossary).collect())
    assert got == sorted((i, t.lower()) for i, x in enumerate(texts) for t in terms if t and t.lower() in x.lower())
