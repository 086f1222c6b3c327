"""Jobs, stored assets, owners of log lines and claimed pairs: hand cases and brute force."""

import itertools
import random
import re

import quire.plans.registry  # noqa: F401
from quire.operators.catalog import CATALOG
from quire.sources import files, provider_layout

JOB = "job string, seq long, kind string, timed_out boolean, enveloped boolean, ok boolean, exit_code int, error_code string"


def on(spark, name, **tables):
    return CATALOG[name].on(spark, **{t: spark.createDataFrame(rows, schema) for t, (schema, rows) in tables.items()}).collect()


def job(name, *kinds, timed_out=False, enveloped=True, ok=True, exit_code=0, error_code=""):
    return [(name, k, kind, timed_out, enveloped, ok, exit_code, error_code) for k, kind in enumerate(kinds)]


def simple_job(kinds):
    """State by state, as the rules are told."""
    state, out = "none", []
    for kind in kinds:
        before, verdict = state, "ok"
        if kind == "create":
            state, verdict = ("queued", "ok") if state == "none" else (state, "created_twice")
        elif kind not in ("start", "cancel", "exit", "restart"):
            verdict = "unknown_event"
        elif kind == "restart":
            state = "ended" if state in ("queued", "running") else state
        elif state == "none":
            verdict = "not_created"
        elif state == "ended":
            verdict = "already_ended"
        elif kind == "start":
            state, verdict = ("running", "ok") if state == "queued" else (state, "started_twice")
        elif kind == "exit":
            state, verdict = ("ended", "ok") if state == "running" else (state, "not_started")
        elif state == "queued":
            state = "ended"
        out.append((before, state, verdict))
    return out


def test_every_order_of_job_events(spark):
    """All sequences of up to four events: each legal and each illegal transition."""
    kinds = ("create", "start", "cancel", "exit", "restart", "other")
    runs = [x for n in range(1, 5) for x in itertools.product(kinds, repeat=n)]
    rows = on(spark, "stm09_job_transitions", job_events=(JOB, [r for i, x in enumerate(runs) for r in job(str(i), *x)]))
    got = {}
    for r in sorted(rows, key=lambda r: r.seq):
        got.setdefault(int(r.job), []).append((r.before, r.after, r.verdict))
    assert [got[i] for i in range(len(runs))] == [simple_job(x) for x in runs]
    assert {v for x in got.values() for *_, v in x} == {"ok", "created_twice", "unknown_event", "not_created", "already_ended", "started_twice", "not_started"}


def test_exit_classes(spark):
    run = ("create", "start", "exit")
    jobs = {
        "ok": (job("ok", *run), ("succeeded", None)),
        "late": (job("late", *run, timed_out=True), ("failed", "timed_out")),
        "late and canceled": (job("late and canceled", "create", "start", "cancel", "exit", timed_out=True), ("failed", "timed_out")),
        "canceled": (job("canceled", "create", "start", "cancel", "exit"), ("canceled", "canceled")),
        "canceled waiting": (job("canceled waiting", "create", "cancel", "start", "exit"), ("canceled", "canceled")),
        "mute": (job("mute", *run, enveloped=False), ("failed", "envelope_unparsed")),
        "code": (job("code", *run, ok=False, exit_code=2, error_code="bad_input"), ("failed", "bad_input")),
        "exit": (job("exit", *run, ok=False, exit_code=2), ("failed", "exit_2")),
        "ok but 1": (job("ok but 1", *run, exit_code=1), ("failed", "exit_1")),
        "restart": (job("restart", "create", "start", "restart", "exit"), ("interrupted", "restarted")),
        "restart waiting": (job("restart waiting", "create", "restart"), ("interrupted", "restarted")),
        "asked too late": (job("asked too late", *run, "cancel"), ("succeeded", None)),
        "runs": (job("runs", "create", "start", "cancel"), ("running", None)),
        "waits": (job("waits", "create"), ("queued", None)),
        "never": (job("never", "start", "exit"), ("none", None)),
    }
    rows = on(spark, "stm09_job_outcomes", job_events=(JOB, [r for x, _ in jobs.values() for r in x]))
    assert {r.job: (r.status, r.code) for r in rows} == {k: want for k, (_, want) in jobs.items()}


def test_ledgers_against_a_counter(spark):
    r = random.Random(4)
    moves = [(f"s{r.randrange(6)}", k, r.choice(["put", "release", "release"] if k % 40 < 20 else ["put", "put", "release"])) for k in range(900)]
    want, counts = {}, {}
    for sha, k, op in moves:
        n = counts.get(sha, 0)
        if op == "put":
            counts[sha], what = n + 1, "reused" if n else "stored"
        else:
            counts[sha], what = max(0, n - 1), "not_found" if not n else "deleted" if n == 1 else "released"
        want[k] = (counts[sha], what)
    table = ("sha string, place long, op string", moves)
    assert {x.place: (x.refs, x.outcome) for x in on(spark, "sk05_reference_ledger", asset_ledger=table)} == want
    assert {w for _, w in want.values()} == {"stored", "reused", "released", "deleted", "not_found"}
    stored = on(spark, "sk05_stored_assets", asset_ledger=table)
    assert {x.sha: x.refs for x in stored} == {s: n for s, n in counts.items() if n}


def test_owner_by_interval_then_by_marker(spark):
    segments = [(1, 0, 10, 40), (1, 1, 20, 30), (1, 2, 35, 1_000_000), (1, 3, 50, 50), (1, 4, 9, 2), (2, 7, 0, 5)]
    lines = [(1, 1, 25, None, True), (1, 2, 9, None, True), (1, 3, None, 3, False), (1, 4, 9, None, True), (1, 5, None, None, True), (1, 6, 36, 1, True), (1, 7, 50, None, True), (1, 8, 999_999, None, True), (1, 9, 10, None, True), (2, 1, 6, None, True), (2, 2, 5, 9, True), (3, 1, 5, None, True)]
    rows = on(spark, "xo19_line_owner", log_segments=("run_id long, segment long, lo long, hi long", segments), log_lines=("run_id long, seq long, number long, marker long, is_issue boolean", lines))
    got = {(r.run_id, r.seq): (r.owner, r.by_what) for r in rows}
    assert got == {(1, 1): (0, "number"), (1, 2): (None, "none"), (1, 4): (3, "marker"), (1, 5): (3, "marker"), (1, 6): (0, "number"), (1, 7): (2, "number"), (1, 8): (2, "number"), (1, 9): (0, "number"), (2, 1): (None, "none"), (2, 2): (7, "number"), (3, 1): (None, "none")}


def test_owners_against_every_segment(spark):
    r = random.Random(2)
    segments = [(k % 3, k, lo, lo + r.choice([0, 1, 3, 60, 900])) for k in range(200) for lo in [r.randrange(2000)]]
    lines = [(k % 3, k, r.randrange(2200), None, True) for k in range(1500)]
    rows = on(spark, "xo19_line_owner", log_segments=("run_id long, segment long, lo long, hi long", segments), log_lines=("run_id long, seq long, number long, marker long, is_issue boolean", lines))
    want = {(run, seq): min((s for q, s, lo, hi in segments if q == run and lo <= n <= hi), default=None) for run, seq, n, *_ in lines}
    assert {(x.run_id, x.seq): x.owner for x in rows} == want


LINKS = "doc_id long, label string, destination string, kind string, ord long, occurrence long"
PLACES = "doc_id long, label string, place long, kind string"


def pairs(spark, links, places, sources=()):
    rows = on(spark, "xo31_claimed_pairs", label_links=(LINKS, links), label_places=(PLACES, places), label_sources=("doc_id long, label string, occurrences long", list(sources)))
    return sorted((r.ord, r.place, r.way) for r in rows)


def test_claimed_pairs(spark):
    two = [(1, "5", "a", "fig", 1, None), (1, "5", "b", "tab", 2, None)]
    assert pairs(spark, two, [(1, "5", 30, "tab"), (1, "5", 40, "fig"), (1, "5", 50, "none")]) == [(1, 40, "context"), (2, 30, "context")]
    assert pairs(spark, two, [(1, "5", 30, "tab"), (1, "5", 40, "none")]) == []  # one destination finds nothing: all is left
    assert pairs(spark, [(1, "5", "a", "fig", 1, 1), (1, "5", "b", "fig", 2, 2)], [(1, "5", 3, "fig"), (1, "5", 4, "fig")], [(1, "5", 2)]) == []  # two destinations of a kind
    one = [(1, "5", "a", "fig", 1, 2), (1, "5", "a", "fig", 2, 3)]
    assert pairs(spark, one, [(1, "5", 8, "x"), (1, "5", 9, "y")]) == [(1, 8, "count"), (2, 9, "count")]
    assert pairs(spark, one, [(1, "5", 7, "x"), (1, "5", 8, "x"), (1, "5", 9, "y")]) == []  # counts differ
    three = [(1, "5", p, "x") for p in (7, 8, 9)]
    assert pairs(spark, one, three, [(1, "5", 3)]) == [(1, 8, "occurrence"), (2, 9, "occurrence")]
    assert pairs(spark, one, three, [(1, "5", 4)]) == []  # the output has fewer than the source
    assert pairs(spark, [(1, "5", "a", "fig", 1, 2), (1, "5", "a", "fig", 2, 2)], three, [(1, "5", 3)]) == []  # one occurrence claimed twice
    assert pairs(spark, [(1, "5", "a", "fig", 1, None), (1, "5", "a", "fig", 2, 2)], three, [(1, "5", 3)]) == []
    assert pairs(spark, [(1, "5", "a", "fig", 1, 4), (1, "5", "a", "fig", 2, 2)], three, [(1, "5", 3)]) == []


NESTED = """{"pdf_info": [null, {"page_idx": "1"}, {"page_idx": 3, "para_blocks": [
  {"type": " Text ", "index": 9, "bbox": [1, 2.5, "3", 4], "lines": [{"bbox": [1, 2, 3], "spans": [{"content": "a"}, 7, {"type": "ODD", "score": 0.5, "content": 5}]}, null, {"spans": null}]},
  "no block", {"type": "list", "index": true, "children": [{"type": "what", "blocks": [{"type": "image", "children": [{"type": "Title", "sub_type": " H ", "lines": [{"spans": [{"type": "image"}]}]}]}, null]}], "blocks": [{"index": 1.5, "merge_prev": true, "angle": 90}]},
  {"type": "code", "index": 2, "level": 1, "lines": "none"}], "discarded_blocks": [{"type": "footer", "index": 1}]}, {"page_idx": 4, "para_blocks": null}]}"""


def test_layout_of_four_levels(spark):
    layouts = spark.createDataFrame([("a", NESTED), ("b", "no json"), ("c", None), ("d", '{"pdf_info": {}}'), ("e", "{}")], "doc_id string, layout string")
    found = provider_layout.blocks(layouts)
    rows = {r.block_id: r for r in found.collect()}
    shape = {k: (r.parent_block_id, r.type, r.reading_order, r.source) for k, r in rows.items()}
    para = "para_blocks"
    assert shape == {
        "p3-b0": (None, "text", 1, para), "p3-b1": (None, "list", 2, para), "p3-b2": ("p3-b1", "what", None, para), "p3-b3": ("p3-b2", "image", None, para), "p3-b4": ("p3-b3", "title", None, para),
        "p3-b5": ("p3-b1", "unknown", None, para), "p3-b6": (None, "code", 0, para), "p3-b7": (None, "footer", None, "discarded_blocks"),
    }
    assert rows["p3-b0"].box == [1, 2.5, 3, 4] and rows["p3-b1"]["index"] is None and rows["p3-b5"]["index"] is None
    assert (rows["p3-b5"].merge_prev, rows["p3-b5"].angle, rows["p3-b6"].level, rows["p3-b4"].sub_type) == (True, 90.0, 1, "h")
    spans = provider_layout.spans(found)
    assert sorted((r.span_id, r.kind, r.content, r.score, r.line_box) for r in spans.collect()) == [("p3-b0-l0-s0", "text", "a", None, None), ("p3-b0-l0-s2", "odd", "5", 0.5, None), ("p3-b4-l0-s0", "image", "", None, None)]
    unknown = sorted((r.where_found, r.type, r.page, r.n) for r in provider_layout.unknown_types(found, spans).collect())
    assert unknown == [("block", "<missing>", 3, 1), ("block", "what", 3, 1), ("span", "odd", 3, 1)]
    assert provider_layout.blocks(layouts.where("doc_id <> 'a'")).count() == 0


def test_glossaries_of_any_charset(spark, tmp_path):
    text = 'source,target,tgt_lng\nA,甲,zh-CN\n"B, b","乙ß",zh_cn\nC,丙,ja\n'
    for name, raw in {"plain": text.encode(), "marked": b"\xef\xbb\xbf" + text.encode(), "le": b"\xff\xfe" + text.encode("utf-16-le"), "be": b"\xfe\xff" + text.encode("utf-16-be"), "bare_le": text.encode("utf-16-le"), "bare_be": text.encode("utf-16-be"), "gb": text.replace("ß", "").encode("gb18030")}.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(raw)
        got = sorted((r.source, r.target.replace("ß", "")) for r in files.read_glossary(spark, str(path), "ZH-cn").collect())
        assert got == [("A", "甲"), ("B, b", "乙")], name
    assert files.read_glossary(spark, str(tmp_path), "ZH-cn").count() == 14
    found = {r.path.rpartition("/")[2]: r.charset for r in files.charsets(spark, str(tmp_path)).collect()}
    assert found == {"plain.csv": "UTF-8", "marked.csv": "UTF-8", "le.csv": "UTF-16LE", "be.csv": "UTF-16BE", "bare_le.csv": "UTF-16LE", "bare_be.csv": "UTF-16BE", "gb.csv": "GB18030"}


def test_batch_protocol(spark):
    """Every code of a batch's reply; the second item has a placeholder."""
    items = ("doc_id long, batch long, id long, input string", [(k, 0, i, t) for k in range(40) for i, t in ((0, "plain"), (1, "{v1} and <style id='1'>x</style>"))])
    whole = '[{"id": 0, "output": "a"}, {"id": 1, "output": "<style id=\'1\'>x</style> {v1}"}]'
    replies = [
        whole, f" <json>\n{whole}</json> ", f"```json\n{whole}\n```", f"```{whole}```", None, "no JSON", '{"id": 0}', "null", "7", '"text"', "[]", '{"id": 0, "output": "a"}', '[{"id": 0, "output": "a"}, {"id": 5, "output": "b"}]',
        '[{"id": 0, "output": 123}, {"id": 1, "output": null}]', '[{"id": 0, "output": "a {v9}"}, {"id": 1, "output": "{v1}{v1}"}]', '[{"id": "0", "output": "a"}, {"id": 1, "output": "b"}]', '[{"output": "a"}, 5]', '[{"id": 0}, {"id": 1, "output": ""}]', '[{"id": 0, "output": "a"}',
    ]
    rows = on(spark, "qc01_batch_protocol", batch_items=items, batch_replies=("doc_id long, batch long, output string", [(k, 0, x) for k, x in enumerate(replies)]))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.code, r.detail))
    style = [("placeholder_lost", "1 </style>"), ("placeholder_lost", "1 <style id='1'>")]
    want = {
        4: [("not_json", "")], 5: [("not_json", "")], 6: [("not_array", "")], 7: [("not_array", "")], 8: [("not_array", "")], 9: [("not_array", "")], 10: [("id_mismatch", "ids"), ("length_mismatch", "0 of 2")], 11: [("id_mismatch", "ids"), ("length_mismatch", "1 of 2")],
        12: [("id_mismatch", "ids")], 13: [("no_output", "0"), ("no_output", "1")], 14: [("placeholder_hallucinated", "0 {v9}"), ("placeholder_hallucinated", "1 {v1}"), *style], 15: [("id_mismatch", "ids")], 16: [("id_mismatch", "entry 1"), ("id_mismatch", "entry 2"), ("id_mismatch", "ids")],
        17: [("no_output", "0"), *style, ("placeholder_lost", "1 {v1}")], 18: [("not_json", "")],
    }
    assert {k: sorted(v) for k, v in got.items()} == want


def test_a_batch_is_judged_in_one_row(spark):
    """One join, of replies and items, however many codes; of entries and items of one id the last entry counts for all."""
    text = "{v1} <b>"
    items = spark.createDataFrame([(d, 0, i, text) for d in (1, 2, None) for i in (7, 7, 8)], "doc_id long, batch long, id long, input string")
    replies = spark.createDataFrame(
        [(1, 0, '[{"id": 7, "output": "{v1}"}, {"id": 8, "output": "{v1}{v2}"}, {"id": 7, "output": "{v1}{v1}"}]'), (2, 0, '[{"id": 7, "output": "a"}, {"id": 7}, {"id": 8, "output": "{v1}"}]'), (3, 0, '[{"id": 7, "output": "a"}, 1]'), (None, 0, "[]"), (None, 0, "x")], "doc_id long, batch long, output string"
    )
    frame = CATALOG["qc01_batch_protocol"].on(spark, batch_items=items, batch_replies=replies)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = sorted((r.doc_id or 0, r.code, r.detail) for r in frame.collect())
    assert got == [(0, "not_json", ""), (1, "placeholder_hallucinated", "8 {v2}"), (2, "no_output", "7"), (2, "no_output", "7"), (3, "id_mismatch", "entry 2"), (3, "id_mismatch", "ids")]
