"""Catalogued operators on tables of the caller's own, against results written out by hand."""

import quire.plans.registry  # noqa: F401
from quire.operators.catalog import CATALOG


def rows(spark, name, *cols, **tables):
    frames = {t: spark.createDataFrame(data, schema) for t, (schema, data) in tables.items()}
    return sorted((tuple(r[c] for c in cols) for r in CATALOG[name].on(spark, **frames).collect()), key=repr)


def test_label_inventory_keeps_the_bucket_of_none(spark):
    assert rows(spark, "ag15_label_inventory", "label", "n", label_records=("label string", [("text",), (None,), ("text",), (None,), ("title",)])) == [("text", 2), ("title", 1), (None, 2)]


def test_retry_statistics_come_from_the_replies(spark):
    replies = [(1, 1, "P1", "a {v1}", "x {v1}"), (1, 2, "P2", "a {v1}", "x"), (2, 1, "P1", "a", "x {v2}"), (2, 2, "P2", "a", None)]
    got = rows(spark, "ag26_retry_statistics", "code", "n", "documents", replies=("doc_id long, seq long, id string, source string, reply string", replies))
    assert got == [("none", 2, 2), ("placeholder_added", 1, 1), ("placeholder_lost", 1, 1)]


def test_scanned_verdict_counts_pages(spark):
    flags = [(1, p, p < 4) for p in range(5)] + [(2, p, p < 3) for p in range(5)]
    assert rows(spark, "ag28_scanned_verdict", "doc_id", "pages", "scanned", page_flags=("doc_id long, page long, is_scan boolean", flags)) == [(1, 5, True), (2, 5, False)]


def test_glyph_codes_of_units_and_documents(spark):
    schema = "doc_id long, seq long, line string"
    units = [(1, 1, "(cid:1) (cid:22) (cid:3) (cid:4) word"), (1, 2, "(cid:1) (cid:2) (cid:3) (cid:4) (cid:5) (cid:6) word"), (2, 1, "plain words")]
    assert rows(spark, "pf08_cid_paragraph", "doc_id", "seq", "is_cid", coded_units=(schema, units)) == [(1, 1, False), (1, 2, True), (2, 1, False)]
    assert rows(spark, "ag29_cid_document", "doc_id", "cids", "is_cid", coded_units=(schema, units)) == [(1, 1, False), (2, 0, False)]


def test_compare_and_set_and_guarded_commit(spark):
    bases = ("document long, revision long, origin string, base_revision long", [(1, 2, "auto", 2), (1, 3, "auto", 1)])
    edits = ("document long, revision long, origin string, target string", [(1, 1, "auto", "a"), (1, 2, "auto", "b")])
    assert rows(spark, "up05_compare_and_set", "revision", "accepted", edit_bases=bases, edits=edits) == [(2, True), (3, False)]
    edits = ("document long, revision long, origin string, target string", [(1, 1, "auto", "a"), (1, 2, "auto", "b"), (2, 1, "manual", "c"), (2, 2, "auto", "d"), (3, 1, "auto", "e"), (4, 1, "auto", "f")])
    jobs = ("document long, state string", [(1, "running"), (2, "running"), (3, "cancelled")])
    assert rows(spark, "up06_guarded_commit", "document", "revision", "outcome", edits=edits, jobs=jobs) == [(1, 1, "stale"), (1, 2, "committed"), (2, 1, "stale"), (2, 2, "manual_kept"), (3, 1, "cancelled"), (4, 1, "no_job")]


def test_draft_merge_sets_clears_and_leaves(spark):
    targets = ("doc_id long, seq long, id string, target string", [(1, 1, "a", "old"), (1, 2, "b", "old"), (1, 3, "c", "old"), (1, 4, "d", "")])
    drafts = ("doc_id long, seq long, has_target boolean, target string", [(1, 1, True, "new"), (1, 2, True, None), (1, 3, False, None), (1, 5, True, "fresh")])
    assert rows(spark, "up07_draft_merge", "seq", "target", targets=targets, draft_fields=drafts) == [(1, "new"), (3, "old"), (5, "fresh")]


def test_replacements_drafts_and_hashes(spark):
    units = ("doc_id long, seq long, source string", [(1, 1, "a"), (1, 2, "b")])
    assert rows(spark, "up08_merge_replacements", "seq", "text", "replaced", units=units, replacements=("doc_id long, seq long, target string", [(1, 2, "z")])) == [(1, "a", False), (2, "z", True)]
    targets = ("doc_id long, seq long, target string", [(1, 1, "a"), (1, 2, "b")])
    assert rows(spark, "up14_effective_target", "seq", "target", "from_draft", targets=targets, draft_texts=("doc_id long, seq long, target string", [(1, 1, "mine")])) == [(1, "mine", True), (2, "b", False)]
    blocks = ("doc_id long, seq long, page long, input_hash string, compiled_hash string", [(1, 1, 0, "x", "x"), (1, 2, 0, "y", None), (1, 3, 1, "z", "z")])
    assert rows(spark, "up11_dirty_pages", "page", "blocks", "dirty", block_hashes=blocks) == [(0, 2, 1)]


def test_cascade_delete_and_orphan_papers(spark):
    one = ("doc_id long", [(1,), (2,), (None,)])
    got = rows(spark, "up09_cascade_delete", "tbl", "n", units=one, targets=one, labels=one, assets=("doc_id long, sha string", [(1, "p"), (2, "p"), (2, "q")]), deletions=("doc_id long", [(2,), (None,)]))
    assert got == [("labels", 2), ("papers", 1), ("targets", 2), ("units", 2)]


def test_override_patch_diff_and_validation(spark):
    kv = "doc_id long, k string, v string"
    got = rows(spark, "pf17_override_patch", "doc_id", "entries", override_base=(kv, [(1, "a", "1"), (1, "b", "2"), (2, "a", "1")]), override_patches=(kv, [(1, "a", None), (1, "c", "3"), (2, "a", None)]))
    assert got == [(1, "b=2,c=3")]
    v = "doc_id long, seq long, v long"
    got = rows(spark, "pf18_override_diff", "seq", "change", overrides_before=(v, [(1, 1, 5), (1, 2, 5), (1, 3, 5)]), overrides_after=(v, [(1, 1, 5), (1, 2, 6), (1, 4, 5)]))
    assert got == [(2, "changed"), (3, "removed"), (4, "added")]
    entries = ("doc_id long, seq long, scale long, font long, k string", [(1, 1, 4, 13, "colour"), (1, 2, 10, 10, "box_scale"), (1, 3, 31, 10, "font_scale")])
    assert rows(spark, "pf19_override_validation", "seq", "errors", override_entries=entries) == [(1, "scale_low,font_range,unknown_key"), (3, "scale_high")]


def test_numeric_formulas_and_placeholder_ids(spark):
    formulas = [(1, 1, "3, 4.5", 0.0, False), (1, 2, "3, 4.5", 0.2, False), (1, 3, "3, 4.5", 0.1, True), (1, 4, "x", 0.0, False), (1, 5, "7", 0.1, False)]
    assert rows(spark, "xo07_numeric_formula", "seq", formulas=("doc_id long, seq long, text string, y_offset double, all_in_regions boolean", formulas)) == [(1,), (5,)]
    units = ("doc_id long, page long, seq long, source string", [(1, 0, 1, "a {v1} {v2}"), (1, 0, 2, "<style id='1'>b</style>"), (1, 0, 3, "c")])
    assert rows(spark, "xo10_placeholder_ids", "seq", "inc", "first_id", "plain", units=units) == [(1, 2, 1, False), (2, 2, 3, False), (3, 0, 5, False)]


def test_toc_levels_rows_and_tail(spark):
    entries = [(1, 0, 1, "1.2 Two", 0), (1, 0, 2, "Plain", 0), (1, 0, 3, "Deeper", 12), (1, 0, 4, "Near", 13), (1, 0, 5, "Deepest", 24)]
    assert rows(spark, "wf21_toc_level", "seq", "level", toc_entries=("doc_id long, page long, seq long, line string, indent long", entries)) == [(1, 2), (2, 1), (3, 2), (4, 2), (5, 4)]
    assert rows(spark, "xo32_toc_tail", "seq", "title", "tail", toc_rows=("doc_id long, seq long, line string", [(1, 1, "Intro ..... 12"), (1, 2, "In 2012"), (1, 3, "End")])) == [(1, "Intro", "12")]
    events = [(1, 1, 10, 1), (1, 2, 20, 2), (1, 1, 30, 3)] + [(2, s, s, s) for s in range(1, 13)]
    got = rows(spark, "wf22_tail", "run_id", "seq", "ms", arriving_events=("run_id long, seq long, ms long, arrived long", events))
    assert got == sorted([(1, 1, 30), (1, 2, 20)] + [(2, s, s) for s in range(3, 13)], key=repr)


def test_spans_geometry_and_alignment(spark):
    log = ("run_id long, span long, at_us long, kind string, ms long", [(1, 0, 1000, "started", 0), (1, 0, 9000, "finished", 3), (1, 1, 9000, "finished", 2), (1, 2, 500, "started", 0)])
    assert rows(spark, "jn26_span_pairs", "span", "start_us", "end_us", span_log=log) == [(0, 1000, 9000), (1, 7000, 9000), (2, 500, None)]
    got = rows(spark, "jn30_hydrate", "seq", "x", "y2", block_geometry=("doc_id long, seq long, x long, y2 long", [(1, 1, None, 7), (1, 2, 5, None), (1, 3, None, None)]), boxes=("doc_id long, seq long, x long, y2 long", [(1, 1, 50, 70), (1, 2, 51, 71)]))
    assert got == [(1, 50, 7), (2, 5, 71), (3, None, None)]
    got = rows(spark, "jn21_id_alignment", "id", "side", units=("doc_id long, id string", [(1, "a"), (1, "b")]), reply_ids=("doc_id long, id string", [(1, "a"), (1, "c")]))
    assert got == [("b", "missing"), ("c", "extra")]
    boxes = ("doc_id long, seq long, x long, y long, x2 long, y2 long", [(1, 1, 0, 0, 100, 50), (1, 2, 0, 0, 100, 50)])
    assert rows(spark, "xo27_apply_overrides", "seq", "x", "y", "x2", "y2", boxes=boxes, box_overrides=("doc_id long, seq long, width10 long, height10 long", [(1, 1, 8, 12)])) == [(1, 0, -10.0, 80.0, 50), (2, 0, 0.0, 100.0, 50)]


def test_ranks_without_one_window_equal_ranks_in_one(spark):
    edits = [(d * 70_001 % 400_000, r, "manual" if d % 3 else "auto", "") for d in range(60) for r in range(3)]
    order = sorted(edits, key=lambda e: (0 if e[2] == "manual" else 1, -e[1], -e[0]))
    got = rows(spark, "st07_candidates", "place", "document", "revision", edits=("document long, revision long, origin string, target string", edits))
    assert sorted(got) == [(i + 1, e[0], e[1]) for i, e in enumerate(order)]
    log = ("run_id long, seq long, at_us long, kind string", [(r, s, (r * 7 % 20) * 30_000_000, "started") for r in range(20) for s in range(2)])
    got = sorted(rows(spark, "xo25_run_index", "place", "run_id", log=log))
    assert [r for _, r in got] == sorted(range(20), key=lambda r: (-(r * 7 % 20), -r)) and [p for p, _ in got] == list(range(1, 21))


def test_document_check_in_one_pass(spark):
    units = ("doc_id long, seq long, page long, id string, label string, source string", [(1, 1, 0, "a", "text", "Short"), (1, 2, 0, "b", "text", "wordy{v1}wordy"), (2, 1, 0, "a", "text", "Short")])
    targets = ("doc_id long, seq long, target string", [(1, 1, ""), (1, 2, "译 <!-- x -->")])
    assert rows(spark, "qc02_document_check", "doc_id", "seq", "code", "severity", units=units, targets=targets) == [(1, 1, "empty_target", "P0"), (1, 2, "formula_splice", "P2"), (1, 2, "markdown_comment_leak", "P0"), (2, 1, "missing_ids", "P0")]
    assert rows(spark, "ag18_verdict", "doc_id", "verdict", "blockers", "findings", units=units, targets=targets) == [(1, "needs_fix", 2, 3), (2, "unavailable", 1, 1)]


def test_queues_inboxes_and_rates(spark):
    puts = ("doc_id long, put long, batch string, tokens long", [(1, 1, "a", 5), (1, 2, "b", 9), (1, 3, "a", 9), (1, 4, "c", 1)])
    assert rows(spark, "st06_priority_queue", "place", "batch", "tokens", queue_puts=puts) == [(1, "b", 9), (2, "a", 9), (3, "c", 1)]
    log = ("run_id long, seq long, kind string", [(r, s, "x") for r in (1, 2) for s in range(1, 71)])
    got = rows(spark, "stm03_bounded_inbox", "subscriber", "run_id", "seq", "dropped", log=log, subscriptions=("run_id long, subscriber string", [(1, "a")]))
    assert sorted(got) == [("a", 1, s, 6) for s in range(7, 71)]
    arrivals = [0, 1, 2, 50, 51, 51, 90]
    start, want = None, []
    for k, a in enumerate(arrivals):
        start = a if start is None else max(a, start + 10)
        want.append((k, start, start - a))
    requests = ("limiter long, ord long, arrived_us long, interval_us long", [(1, k, a, 10) for k, a in enumerate(arrivals)])
    assert rows(spark, "stm10_rate_limit", "ord", "start_us", "waited_us", requests=requests) == want


def test_front_matter_and_rosters(spark):
    schema = "doc_id long, page long, seq long, translatable boolean, kind string, text string, x long, y long, x2 long, y2 long, n_lines long, rotation long"
    line = lambda seq, kind, text, y, page=0, ok=True, x=200: (1, page, seq, ok, kind, text, x, y, x + 200, y + 20, 1, 0)
    page = [
        line(1, "title", "On Things", 730), line(2, "text", "Ada Vale, Bo Lind*", 700), line(3, "text", "University of Vale", 670), line(4, "text", "we met at the college.", 640),
        line(5, "text", "Cy Orr", 600), line(6, "paragraph_title", "Abstract", 560), line(7, "text", "University of Vale", 500),
    ]
    pick = lambda p: rows(spark, "pf16_front_matter", "seq", "anchor", front_paragraphs=(schema, p))
    assert pick(page) == [(2, False), (3, True)]  # the name below stands in a run of its own
    assert pick([p for p in page if p[2] != 3]) == [] and pick([p for p in page if p[2] != 6]) == []
    assert pick([*page[:2], line(3, "text", "{ada, bo}@vale.edu", 670, ok=False), page[5]]) == [(2, False)]
    assert pick([page[0], line(2, "text", "University of Vale", 700, x=0), page[5]]) == []
    roster = [
        line(1, "text", "Ada Vale, Bo Lind", 700), line(2, "paragraph_title", "B. Contributors", 600), line(3, "text", "Team: Ada Vale, Bo J. Lind*,", 500), line(4, "text", "Ada Vale wrote, Bo Lind read", 400),
        line(5, "text", "Cy Orr, D'Arcy O’Neil", 700, page=1), line(6, "paragraph_title", "Results", 600, page=1), line(7, "text", "Ada Vale, Bo Lind", 500, page=1),
    ]
    assert rows(spark, "pf16_author_roster", "seq", front_paragraphs=(schema, roster)) == [(3,), (5,)]


def test_layers_caches_and_anchors(spark):
    uses = ("doc_id long, page long, seq long, xobject long, name string", [(1, 0, 1, None, "F0"), (1, 0, 2, 7, "F0"), (1, 0, 3, 8, "F0"), (1, 0, 4, 7, "F9")])
    got = rows(spark, "jn25_layered_lookup", "seq", "font", "own", font_uses=uses, page_fonts=("doc_id long, page long, name string, font long", [(1, 0, "F0", 10)]), xobject_fonts=("doc_id long, page long, xobject long, name string, font long", [(1, 0, 7, "F0", 20)]))
    assert got == [(1, 10, False), (2, 20, True), (3, 10, False), (4, None, False)]
    puts = ("engine string, source string, put long, translation string", [("e", "s", 1, "x"), ("e", "s", 3, "z"), ("e", "s", 2, "y"), ("f", "s", 1, "w")])
    assert rows(spark, "up03_replace_cache", "engine", "put", "translation", "replaced", cache_puts=puts) == [("e", 3, "z", 2), ("f", 1, "w", 0)]
    anchors = ("doc_id long, seq long, anchor string", [(1, 1, "Figure IV"), (1, 2, "Table 12"), (1, 3, "Table twelve")])
    assert rows(spark, "fs26_anchor_variants", "seq", "translated", "arabic", "chinese", reference_anchors=anchors) == [(1, "图IV", "4", "四"), (2, "表XII", "12", "十二")]


def test_acceptance_gates(spark):
    flags = "doc_id long, parsed boolean, rebuilt boolean, applied boolean"
    tables = {
        "gated_documents": (flags, [(1, True, True, True), (2, True, True, True), (3, False, False, False)]),
        "coverage_reports": ("doc_id long, total_chars long, uncovered_chars long, per_mille long", [(1, 1000, 5, 5), (2, 1000, 6, 5)]),
        "source_uris": ("doc_id long, uri string", [(1, "a"), (1, "a"), (2, "a"), (3, "a")]),
        "output_uris": ("doc_id long, uri string", [(1, "a"), (2, "b")]),
        "toc_headings": ("doc_id long, ord long, heading string", [(1, 1, "[[S1]]One  Two[[/S]]"), (2, 1, "x"), (2, 2, "y")]),
        "toc_anchor_rows": ("doc_id long, ord long, canonical string", [(1, 9, "<style id='1'>One</style> Two"), (2, 1, "x")]),
        "units": ("doc_id long, id string, source string", [(1, "p", "{v1} and {v2}"), (2, "p", "t")]),
        "reply_ids": ("doc_id long, id string", [(1, "p"), (2, "q")]),
    }
    got = {(r[0], r[1]): r[2:] for r in rows(spark, "ag33_acceptance_gates", "doc_id", "gate", "status", "hard", "figure", "accepted", **tables)}
    assert got[1, "layout_coverage"] == ("pass", True, 5, True) and got[2, "layout_coverage"] == ("fail", True, 6, False)
    assert got[1, "link_integrity"] == ("pass", True, 0, True) and got[2, "link_integrity"] == ("fail", True, 2, False) and got[3, "link_integrity"] == ("not_reconstructed", False, 1, True)
    assert got[1, "toc_integrity"] == ("pass", True, 0, True) and got[2, "toc_integrity"] == ("fail", True, 1, False)
    assert got[1, "protected_tokens"] == ("pass", False, 2, True) and got[1, "protocol"] == ("pass", True, 0, True) and got[2, "protocol"] == ("fail", True, 2, False)
    assert {got[3, g][0] for g in ("layout_coverage", "toc_integrity", "protected_tokens", "protocol")} == {"not_available"} and len(got) == 15


def test_places_beyond_a_hundred_thousand_lines(spark):
    """Order is by document, then line, whatever the numbers: a packed number would take document 2 first, or one for the other."""
    pairs = [(1, 100_005, "a", "x"), (2, 1, "a", "y")]
    assert rows(spark, "ag04_common_translation", "src", "tgt", term_pairs=("doc_id long, seq long, src string, tgt string", pairs)) == [("a", "x")]
    ids = "doc_id long, id string, seq long"
    got = rows(spark, "so05_ordered_union", "id", "n", targets=(ids, [(1, "t", 2_000_000)]), units=(ids, [(1, "u", 1)]), boxes=(ids, [(1, "b", 0)]))
    assert got == [("b", 3), ("t", 1), ("u", 2)]
    variants = ("doc_id long, page long, seq long, label string, passed boolean", [(1, 0, 250_000, "title", True), (1, 0, 5, "text", True), (1, 0, 1, "title", False)])
    assert rows(spark, "xo20_best_variant", "seq", variants=variants) == [(250_000,)]
    log = ("run_id long, seq long, kind string, stage string", [(1, 250_000, "finished", "a"), (2, 3, "finished", "a"), (2, 9, "started", "a")])
    assert rows(spark, "sc10_newest_artefact", "run_id", "seq", log=log) == [(2, 3)]
    boxes = ("doc_id long, page long, seq long, src_font long, y long, y2 long", [(1, 0, 1, 2_000, 0, 9), (1, 0, 2, 9, 0, 9), (1, 0, 3, 9, 0, 9)])
    assert rows(spark, "xo12_descent", "seq", "y", boxes=boxes) == [(1, -9), (2, -9), (3, -9)]
    replies = ("doc_id long, seq long, id string, source string, reply string", [(1, 100_001, "x", "a {v1}", "a"), (2, 1, "y", "a {v1}", "a"), (2, 2, "z", "a", "a")])
    assert rows(spark, "ag19_protocol_rates", "code", "violations", "units", replies=replies) == [("placeholder_lost", 2, 2)]


def test_links_lost_in_one_document_only(spark):
    links = ("doc_id long, page long, number string", [(1, 0, "7"), (2, 0, "7"), (2, 0, "7")])
    out = ("doc_id long, page long, number string", [(1, 0, "7"), (2, 0, "8")])
    assert rows(spark, "so08_uri_set", "doc_id", "number", "change", links=links, out_links=out) == [(2, "7", "lost"), (2, "8", "added")]
