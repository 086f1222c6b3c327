"""Life of jobs and of stored assets: automata and ledgers as windows.

An automaton whose states only go forward needs no fold: a state is entered at the first event that may enter it, which is
a minimum over the events after the state before. A counter that never falls below nought needs none either: it is the
running sum less the lowest point that the sum has reached below nought.
"""

from __future__ import annotations

from ..functions.dialect import Dialect
from .catalog import operator

#: What an event that changes nothing is told, by its kind and the job's state then.
JOB_STEPS = """c AS (SELECT job, min(seq) AS created FROM job_events WHERE kind = 'create' GROUP BY job),
    q AS (SELECT e.job, min(e.seq) AS ended_waiting FROM job_events e JOIN c ON e.job = c.job AND e.seq > c.created WHERE e.kind IN ('cancel', 'restart') GROUP BY e.job),
    s AS (SELECT e.job, min(e.seq) AS started FROM job_events e JOIN c ON e.job = c.job AND e.seq > c.created LEFT JOIN q ON e.job = q.job WHERE e.kind = 'start' AND e.seq < coalesce(q.ended_waiting, e.seq + 1) GROUP BY e.job),
    x AS (SELECT e.job, min(e.seq) AS ended_running FROM job_events e JOIN s ON e.job = s.job AND e.seq > s.started WHERE e.kind IN ('exit', 'restart') GROUP BY e.job),
    steps AS (SELECT j.job, c.created, s.started, CASE WHEN s.started IS NULL THEN q.ended_waiting ELSE x.ended_running END AS ended
        FROM (SELECT DISTINCT job FROM job_events) AS j LEFT JOIN c ON j.job = c.job LEFT JOIN q ON j.job = q.job LEFT JOIN s ON j.job = s.job LEFT JOIN x ON j.job = x.job),
    placed AS (SELECT e.*, p.created, p.started, p.ended,
        CASE WHEN p.created IS NULL OR e.seq <= p.created THEN 'none' WHEN p.ended < e.seq THEN 'ended' WHEN p.started < e.seq THEN 'running' ELSE 'queued' END AS before
        FROM job_events e JOIN steps p ON e.job = p.job)"""


@operator("stm09_job_transitions")
def job_transitions(d: Dialect) -> str:
    """Each event of a job: the state it met, the state it led to, and why it changed nothing. A job is queued, running, then
    ended: succeeded, failed, canceled or, by a restart of the service, interrupted. Cancelling a running job is a request
    that its exit fulfils; cancelling a queued one ends it. Nothing leaves an ended job."""
    return f"""WITH {JOB_STEPS}, told AS (SELECT *, CASE WHEN kind = 'create' THEN CASE WHEN before = 'none' THEN 'ok' ELSE 'created_twice' END
            WHEN kind NOT IN ('start', 'cancel', 'exit', 'restart') THEN 'unknown_event' WHEN before = 'none' THEN CASE WHEN kind = 'restart' THEN 'ok' ELSE 'not_created' END
            WHEN before = 'ended' THEN CASE WHEN kind = 'restart' THEN 'ok' ELSE 'already_ended' END
            WHEN kind = 'start' AND before = 'running' THEN 'started_twice' WHEN kind = 'exit' AND before = 'queued' THEN 'not_started' ELSE 'ok' END AS verdict FROM placed)
        SELECT job, seq, kind, before, CASE WHEN verdict <> 'ok' THEN before WHEN kind = 'create' THEN 'queued' WHEN kind = 'start' THEN 'running' WHEN before IN ('none', 'ended') THEN before
            WHEN kind IN ('exit', 'restart') OR before = 'queued' THEN 'ended' ELSE before END AS after, verdict FROM told"""


@operator("stm09_job_outcomes")
def job_outcomes(d: Dialect) -> str:
    """State of each job and, of ended ones, status and error code: by time out, then request to cancel, then missing
    envelope, then a good envelope with exit code 0, then the envelope's own code, then the exit code."""
    return f"""WITH {JOB_STEPS}, last AS (SELECT p.*, max(CASE WHEN kind = 'cancel' AND before = 'running' AND seq < coalesce(ended, seq + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY job) = 1 AS cancel_asked FROM placed p),
        ends AS (SELECT job, CASE WHEN kind = 'restart' THEN 'interrupted' WHEN kind = 'cancel' THEN 'canceled' WHEN timed_out THEN 'failed' WHEN cancel_asked THEN 'canceled' WHEN NOT enveloped THEN 'failed' WHEN ok AND exit_code = 0 THEN 'succeeded' ELSE 'failed' END AS status,
            CASE WHEN kind = 'restart' THEN 'restarted' WHEN kind = 'cancel' THEN 'canceled' WHEN timed_out THEN 'timed_out' WHEN cancel_asked THEN 'canceled' WHEN NOT enveloped THEN 'envelope_unparsed' WHEN ok AND exit_code = 0 THEN NULL
                WHEN error_code <> '' THEN error_code ELSE 'exit_' || CAST(exit_code AS STRING) END AS code FROM last WHERE seq = ended)
        SELECT s.job, CASE WHEN s.ended IS NOT NULL THEN e.status WHEN s.started IS NOT NULL THEN 'running' WHEN s.created IS NOT NULL THEN 'queued' ELSE 'none' END AS status, e.code FROM steps s LEFT JOIN ends e ON s.job = e.job"""


@operator("sk05_reference_ledger")
def reference_ledger(d: Dialect) -> str:
    """Each put and release of an asset: the count after it and what it did. A release of an asset that isn't there is
    refused and changes nothing; the release that brings the count to nought deletes; a later put stores anew."""
    order = "PARTITION BY sha ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""WITH moves AS (SELECT sha, place, op, CASE op WHEN 'put' THEN 1 ELSE -1 END AS step FROM asset_ledger WHERE op IN ('put', 'release')),
        summed AS (SELECT *, sum(step) OVER ({order}) AS total FROM moves), floored AS (SELECT *, least(min(total) OVER ({order}), 0) AS lowest FROM summed),
        counted AS (SELECT sha, place, op, total - lowest AS refs FROM floored),
        told AS (SELECT *, coalesce(lag(refs) OVER (PARTITION BY sha ORDER BY place), 0) AS before FROM counted)
        SELECT sha, place, op, CAST(refs AS BIGINT) AS refs, CASE WHEN op = 'put' AND before = 0 THEN 'stored' WHEN op = 'put' THEN 'reused' WHEN before = 0 THEN 'not_found' WHEN refs = 0 THEN 'deleted' ELSE 'released' END AS outcome FROM told"""


@operator("sk05_stored_assets")
def stored_assets(d: Dialect) -> str:
    """Assets that are in the store after all puts and releases, with their counts and how often each was stored anew."""
    return f"WITH led AS ({reference_ledger.body(d)}) SELECT sha, max_by(refs, place) AS refs, count(CASE WHEN outcome = 'stored' THEN 1 END) AS times_stored FROM led GROUP BY sha HAVING max_by(refs, place) > 0"
