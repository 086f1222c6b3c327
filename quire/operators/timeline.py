"""Event logs: durations, intervals, stage windows, job states."""

from __future__ import annotations

from .catalog import simple

SPANS = "spans AS (SELECT run_id, stage, seq, at_us AS lo, at_us + ms * 1000 AS hi, ms FROM log)"
ISLANDS = f"{SPANS}, marked AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY run_id, stage ORDER BY lo, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM spans), grouped AS (SELECT *, sum(new) OVER (PARTITION BY run_id, stage ORDER BY lo, seq) AS island FROM marked), islands AS (SELECT run_id, stage, island, min(lo) AS lo, max(hi) AS hi FROM grouped GROUP BY run_id, stage, island)"

simple("wf06_interval_union", "Time covered by each stage's spans, overlaps once.", f"WITH {ISLANDS} SELECT run_id, stage, count(*) AS islands, CAST(sum(hi - lo) AS BIGINT) AS covered_us FROM islands GROUP BY run_id, stage")
simple("ag20_duration_attribution", "Spans of a stage: number, summed and covered time, share of all.", f"WITH {ISLANDS}, u AS (SELECT stage, sum(hi - lo) AS covered FROM islands GROUP BY stage), s AS (SELECT stage, count(*) AS n, sum(ms) AS ms FROM log GROUP BY stage), t AS (SELECT sum(ms) AS ms FROM log) SELECT s.stage, s.n, CAST(s.ms AS BIGINT) AS total_ms, CAST(u.covered AS BIGINT) AS covered_us, CAST(s.ms AS DOUBLE) / CAST(t.ms AS DOUBLE) AS share FROM s JOIN u ON s.stage = u.stage, t")
simple("ag21_stage_window", "First and last time of each stage; an explicit boundary wins.", "SELECT run_id, stage, coalesce(min(CASE WHEN kind = 'started' THEN at_us END), min(at_us)) AS begins, coalesce(max(CASE WHEN kind = 'finished' THEN at_us END), max(at_us)) AS ends, count(*) AS n FROM log GROUP BY run_id, stage")
simple("ag22_weighted_progress", "Progress of each run: finished spans of each stage by weight.", "WITH w AS (SELECT 'view' AS stage, 14 AS w UNION ALL SELECT 'click', 30 UNION ALL SELECT 'purchase', 47 UNION ALL SELECT 'signup', 6 UNION ALL SELECT 'error', 3), p AS (SELECT run_id, stage, count_if(kind = 'finished') AS done, count(*) AS n FROM log GROUP BY run_id, stage) SELECT p.run_id, sum(CAST(w.w * p.done AS DOUBLE) / p.n) / 100 AS progress FROM p JOIN w ON p.stage = w.stage GROUP BY p.run_id".replace("sum(CAST(w.w * p.done AS DOUBLE) / p.n) / 100", "CAST(sum(CAST(floor(w.w * p.done * 1000 / p.n) AS BIGINT)) AS BIGINT)").replace("AS progress", "AS progress_per_100000"))
simple("wf07_lane_count", "Most spans at one time.", f"WITH {SPANS}, e AS (SELECT run_id, lo AS t, 1 AS step FROM spans UNION ALL SELECT run_id, hi AS t, -1 AS step FROM spans), r AS (SELECT run_id, sum(step) OVER (PARTITION BY run_id ORDER BY t, step) AS depth FROM e) SELECT run_id, CAST(max(depth) AS BIGINT) AS lanes FROM r GROUP BY run_id")
simple("stm09_job_states", "Latest state of each span and whether its last step was allowed.", "WITH t AS (SELECT run_id, span, seq, kind, lag(kind) OVER (PARTITION BY run_id, span ORDER BY seq) AS before FROM log) SELECT run_id, span, max_by(kind, seq) AS state, bool_and(NOT (kind = 'finished' AND coalesce(before, '') = 'finished')) AS allowed FROM t GROUP BY run_id, span")
simple("sc02_events_after", "Published events after a cursor.", "SELECT run_id, seq, stage, kind FROM log WHERE seq > 30")
simple("sc03_lenient_scan", "Events whose payload parses, bad ones skipped.", lambda d: f"SELECT event_id, event_type, {d.json('props', 'k')} AS k FROM events WHERE props IS NOT NULL AND {d.like('props', '^[{].*[}]$')}")
