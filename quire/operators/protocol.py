"""The batch protocol: a reply is a JSON array of ``{"id", "output"}`` that answers a batch of ``{"id", "input"}``."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .catalog import operator
from .quality import PLACEHOLDER

#: Wrappers around a reply's JSON.
OPENING, CLOSING = r"^[\s]*(?:<json>)?[\s]*(?:```json|```)?", r"(?:```)?[\s]*(?:</json>)?[\s]*$"


def _entries(d: Dialect) -> str:
    """Common table expressions ``heads`` (doc_id, batch, state: not_json, not_array or array) and ``entries`` (doc_id, batch,
    place, has_id, id_text, whole_id, output: null if it is no text), for the check."""
    clean = d.sub(d.sub("output", OPENING), CLOSING)
    return f"""cleaned AS (SELECT doc_id, batch, {clean} AS t FROM batch_replies), judged AS (SELECT doc_id, batch, t, CASE WHEN t IS NULL OR NOT json_valid(t) THEN 'not_json' WHEN json_type(t) = 'ARRAY' THEN 'array' WHEN json_type(t) = 'OBJECT' AND json_type(t, '$.output') IS NOT NULL THEN 'lone' ELSE 'not_array' END AS form FROM cleaned),
            heads AS (SELECT doc_id, batch, CASE form WHEN 'lone' THEN 'array' ELSE form END AS state FROM judged),
            items AS (SELECT doc_id, batch, unnest(CASE WHEN form = 'array' THEN json_extract(t, '$[*]') ELSE [t::JSON] END) AS e, generate_subscripts(CASE WHEN form = 'array' THEN json_extract(t, '$[*]') ELSE [t::JSON] END, 1) AS place FROM judged WHERE form IN ('array', 'lone')),
            entries AS (SELECT doc_id, batch, CAST(place AS BIGINT) AS place, coalesce(json_type(e) = 'OBJECT' AND json_type(e, '$.id') IS NOT NULL, false) AS has_id, json_extract_string(e, '$.id') AS id_text, coalesce(json_type(e, '$.id') IN ('BIGINT', 'UBIGINT'), false) AS whole_id,
                CASE WHEN json_type(e, '$.output') = 'VARCHAR' THEN json_extract_string(e, '$.output') END AS output FROM items)"""


def _once(d: Dialect, text: str, name: str) -> str:
    """A lateral view of one row: what reads ``name`` then never works it out again."""
    return f"LATERAL VIEW explode(array({text})) AS {name}"


def _judged_once(d: Dialect) -> str:
    """For Spark: replies are read once, and each batch is judged in one row beside its items, not by a join for each code. Codes
    of placeholders are counted by token afterwards (n: given less asked for), the others as they are (ord tells them apart)."""
    clean = d.sub(d.sub("output", OPENING), CLOSING)
    get = lambda key, kind: f"try_variant_get(e, '$.{key}', '{kind}')"
    entry = f"""struct(CAST(p + 1 AS BIGINT) AS place, schema_of_variant(e) LIKE 'OBJECT%' AND {get("id", "variant")} IS NOT NULL AS has_id, {get("id", "string")} AS id_text, coalesce(schema_of_variant({get("id", "variant")}) = 'BIGINT', false) AS whole_id,
        CASE WHEN schema_of_variant({get("output", "variant")}) = 'STRING' THEN {get("output", "string")} END AS output)"""
    form = "CASE WHEN v IS NULL THEN 'not_json' WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(v) LIKE 'OBJECT%' AND try_variant_get(v, '$.output', 'variant') IS NOT NULL THEN 'lone' ELSE 'not_array' END"
    listed = "CASE form WHEN 'array' THEN try_variant_get(v, '$', 'array<variant>') WHEN 'lone' THEN array(v) ELSE array() END"
    got = "CASE WHEN x.whole_id THEN x.id_text ELSE '?' || coalesce(x.id_text, '') END"
    row = lambda code, detail, order, token="''", n="1": f"struct({code} AS code, {detail} AS detail, {token} AS token, CAST({order} AS BIGINT) AS ord, {n} AS n)"
    tokens = lambda text, n: f"transform({d.found(text, PLACEHOLDER)}, t -> {row(chr(39) + 'token' + chr(39), 'q.id', '0', 't', n)})"
    found = f"""concat(CASE WHEN state <> 'array' THEN array({row("state", "''", "0")}) ELSE array() END,
        CASE WHEN state = 'array' AND size(es) <> size(items) THEN array({row("'length_mismatch'", "CAST(size(es) AS STRING) || ' of ' || CAST(size(items) AS STRING)", "0")}) ELSE array() END,
        transform(filter(es, x -> NOT x.has_id), x -> {row("'id_mismatch'", "'entry ' || CAST(x.place AS STRING)", "x.place")}), CASE WHEN other THEN array({row("'id_mismatch'", "'ids'", "0")}) ELSE array() END,
        transform(filter(paired, q -> q.last.output IS NULL), (q, k) -> {row("'no_output'", "q.id", "k")}),
        flatten(transform(filter(paired, q -> q.last.output IS NOT NULL), q -> concat({tokens("q.input", "-1")}, CASE WHEN q.first THEN {tokens("q.last.output", "1")} ELSE array() END))))"""
    return f"""WITH read AS (SELECT doc_id, batch, CASE form WHEN 'lone' THEN 'array' ELSE form END AS state, es FROM batch_replies {_once(d, f"try_parse_json({clean})", "v")} {_once(d, form, "form")} {_once(d, f"coalesce(transform({listed}, (e, p) -> {entry}), array())", "es")}),
        asked AS (SELECT doc_id, batch, collect_list(struct(CAST(id AS STRING) AS id, input)) AS items FROM batch_items GROUP BY doc_id, batch),
        beside AS (SELECT /*+ SHUFFLE_HASH(a) */ r.doc_id, r.batch, r.state, r.es, a.items FROM read r LEFT JOIN asked a ON r.doc_id = a.doc_id AND r.batch = a.batch),
        compared AS (SELECT *, state = 'array' AND doc_id IS NOT NULL AND batch IS NOT NULL AND array_sort(ids) <> array_sort(transform(filter(es, x -> x.has_id), x -> {got})) AS other
            FROM beside {_once(d, "coalesce(transform(items, x -> x.id), array())", "ids")} {_once(d, "array_sort(transform(filter(es, x -> x.has_id AND x.whole_id), x -> struct(x.id_text AS id, x.place AS place, x.output AS output)))", "whole")}),
        lasts AS (SELECT * FROM compared {_once(d, "map_from_entries(transform(filter(whole, (x, k) -> k = size(whole) - 1 OR whole[k + 1].id <> x.id), x -> struct(x.id, x)))", "last")}),
        matched AS (SELECT * FROM lasts {_once(d, "CASE WHEN state <> 'array' OR other OR items IS NULL THEN array() ELSE filter(transform(items, (x, k) -> struct(x.id, x.input, array_position(ids, x.id) = k + 1 AS first, last[x.id] AS last)), q -> q.last IS NOT NULL) END", "paired")}),
        counted AS (SELECT doc_id, batch, c.code, c.detail, c.token, c.ord, sum(c.n) AS n FROM matched LATERAL VIEW explode({found}) AS c GROUP BY doc_id, batch, c.code, c.detail, c.token, c.ord)
        SELECT doc_id, batch, CASE WHEN code <> 'token' THEN code WHEN n < 0 THEN 'placeholder_lost' ELSE 'placeholder_hallucinated' END AS code, CASE WHEN code <> 'token' THEN detail ELSE detail || ' ' || token END AS detail FROM counted WHERE n <> 0"""


@operator("qc01_batch_protocol")
def batch_protocol(d: Dialect) -> str:
    """Violations of a batch's reply: not_json, not_array, length_mismatch, id_mismatch (an entry without id, or other ids than
    asked for, which ends the check), no_output, placeholder_lost, placeholder_hallucinated. One object with an output counts as
    an array of one; ``<json>`` and code fences around it are taken off. Of entries with one id the last counts."""
    if d.name == "spark":
        return _judged_once(d)
    found = d.unnest("paired", "doc_id, batch, id", d.found("input", PLACEHOLDER), "token")
    given = d.unnest("paired", "doc_id, batch, id", d.found("output", PLACEHOLDER), "token")
    return f"""WITH {_entries(d)}, sizes AS (SELECT doc_id, batch, count(*) AS n FROM batch_items GROUP BY doc_id, batch), lengths AS (SELECT doc_id, batch, count(*) AS n FROM entries GROUP BY doc_id, batch),
        ids AS (SELECT doc_id, batch, id, sum(asked) AS asked, sum(got) AS got FROM (SELECT doc_id, batch, CAST(id AS STRING) AS id, 1 AS asked, 0 AS got FROM batch_items UNION ALL SELECT doc_id, batch, CASE WHEN whole_id THEN id_text ELSE '?' || coalesce(id_text, '') END AS id, 0 AS asked, 1 AS got FROM entries WHERE has_id) AS __u GROUP BY doc_id, batch, id),
        other AS (SELECT i.doc_id, i.batch FROM ids i JOIN heads h ON i.doc_id = h.doc_id AND i.batch = h.batch AND h.state = 'array' WHERE i.asked <> i.got GROUP BY i.doc_id, i.batch),
        last AS (SELECT doc_id, batch, id_text, max(place) AS place FROM entries WHERE has_id AND whole_id GROUP BY doc_id, batch, id_text),
        open AS (SELECT h.doc_id, h.batch FROM heads h LEFT JOIN other o ON h.doc_id = o.doc_id AND h.batch = o.batch WHERE h.state = 'array' AND o.doc_id IS NULL),
        paired AS (SELECT b.doc_id, b.batch, b.id, b.input, e.output FROM batch_items b JOIN open o ON b.doc_id = o.doc_id AND b.batch = o.batch JOIN last l ON b.doc_id = l.doc_id AND b.batch = l.batch AND CAST(b.id AS STRING) = l.id_text JOIN entries e ON l.doc_id = e.doc_id AND l.batch = e.batch AND l.place = e.place),
        tokens AS (SELECT doc_id, batch, id, token, sum(n) AS n FROM (SELECT p.doc_id, p.batch, p.id, p.token, -1 AS n FROM {found} p JOIN paired q ON p.doc_id = q.doc_id AND p.batch = q.batch AND p.id = q.id AND q.output IS NOT NULL
            UNION ALL SELECT doc_id, batch, id, token, 1 AS n FROM {given} g) AS __t GROUP BY doc_id, batch, id, token)
        SELECT doc_id, batch, state AS code, '' AS detail FROM heads WHERE state <> 'array'
        UNION ALL SELECT h.doc_id, h.batch, 'length_mismatch' AS code, CAST(coalesce(l.n, 0) AS STRING) || ' of ' || CAST(s.n AS STRING) AS detail FROM heads h JOIN sizes s ON h.doc_id = s.doc_id AND h.batch = s.batch LEFT JOIN lengths l ON h.doc_id = l.doc_id AND h.batch = l.batch WHERE h.state = 'array' AND coalesce(l.n, 0) <> s.n
        UNION ALL SELECT doc_id, batch, 'id_mismatch' AS code, 'entry ' || CAST(place AS STRING) AS detail FROM entries WHERE NOT has_id UNION ALL SELECT doc_id, batch, 'id_mismatch' AS code, 'ids' AS detail FROM other
        UNION ALL SELECT doc_id, batch, 'no_output' AS code, CAST(id AS STRING) AS detail FROM paired WHERE output IS NULL
        UNION ALL SELECT doc_id, batch, CASE WHEN n < 0 THEN 'placeholder_lost' ELSE 'placeholder_hallucinated' END AS code, CAST(id AS STRING) || ' ' || token AS detail FROM tokens WHERE n <> 0"""
