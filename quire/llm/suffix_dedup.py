"""Removal of repeated byte strings: distributed prefix doubling over the suffixes that can still repeat.

Positions get names for the 8, 16, 32 and 50 bytes that follow them, each from a pair of shorter names at a growing
offset, so that equal names mean equal strings. A name is a 64-bit hash in place of a global rank, which would need
every position sorted over the network in each round. Rounds work on positions that are not yet unique:

1. Of the 35 positions within a 50-byte string the one with the least 16-byte name is its anchor, whatever stands
   around the string; one position in eighteen is an anchor. Anchors are packed, dealt by name and sorted there. An
   anchor whose name occurs in one document only is unique: all strings anchored there are, and they drop out.
2. An anchor carries the name of the whole stretch that its strings cover. Where an earlier document has the same
   stretch, all its strings are repeats. Where an earlier document has the anchor but not the stretch, and 33 bytes to
   one side agree, its strings may partly repeat: they go on.
3. The strings that went on get their 50-byte names, which are dealt and sorted in turn; the least document of a name
   keeps it and all others lose it.

Before anything is dealt, equal stretches within one executor's batch are reduced to the least document's, so that a
stretch held by a third of all documents arrives once per batch only.

Defined results: null text is empty; texts under ``length`` bytes lose nothing; documents of null id lose nothing and
count for none; repeated rows (equal id and text) lose the same bytes; rows that share an id but not the text are
taken for one document, each losing what was found in any; texts of any length are read whole; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import blocks, pair, trimmed
from .common import even_keys, partitions_for, staged

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
SIDE = 17
SEGMENT = 4_000_000
FLUSH_BYTES, FLUSH_DOCS = 16_000_000, 60_000
#: Requests and ranges are broadcast up to this size; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64_000_000
_LOW48 = np.uint64((1 << 48) - 1)


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 16 and of the 50 bytes from each position that has them; at least 50 bytes are needed."""
    data = np.ascontiguousarray(data)
    n8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n16 = pair(n8[:-8], n8[8:])
    n32 = pair(n16[:-16], n16[16:])
    return n16, pair(n32[:-18], n32[18:])


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``width`` values."""
    pick, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of the texts between ``bounds``: key, stretch (ctx), left and right checks, first string (lo, in the
    block), strings less one (span), place of the anchor in the first string (off)."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return {k: empty.astype(np.uint64) for k in ("key", "ctx")} | {k: empty.astype(np.uint8) for k in ("left", "right", "span", "off")} | {"lo": empty}
    n16, n50 = names(data)
    least = _slide(n16, WINDOW, True)
    inner = bounds[1:-1]
    across = (inner[:, None] - 1 - np.arange(LENGTH - 1)).ravel()
    least[across[(across >= 0) & (across < len(least))]] = 0
    pad = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    at = np.flatnonzero((_slide(pad, WINDOW, False) == n16) & (n16 != 0))
    key = n16[at]
    own = pad[at[:, None] + np.arange(WINDOW)] == key[:, None]
    lo, span = at - (WINDOW - 1) + own.argmax(1), own.sum(1) - 1
    off = at - lo
    top = len(n16) - 1
    return {
        "key": key,
        "ctx": pair(pair(n50[lo], n50[lo + span]), (span * 64 + off).astype(np.uint64)),
        "left": (pair(n16[np.maximum(at - SIDE, 0)], key) >> np.uint64(48)).astype("<u2"),
        "right": (pair(key, n16[np.minimum(at + SIDE, top)]) >> np.uint64(48)).astype("<u2"),
        "lo": lo,
        "span": span.astype(np.uint8),
        "off": off.astype(np.uint8),
    }


def _segments(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(data, bounds, rows, shift): blocks of texts; a long text comes in overlapping segments, shifted."""
    for b in blocks(column):
        n = len(b.data)
        if n <= SEGMENT or b.last - b.first > 1:
            yield b.data, b.bounds, np.arange(b.first, b.last), 0
            continue
        for x in range(0, n - LENGTH + 1, SEGMENT):
            part = b.data[x : x + SEGMENT + LENGTH - 1]
            yield part, np.array([0, len(part)]), np.array([b.first]), x


def _groups(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, the first weighing most, and where groups of equal rows begin in it."""
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for c in cols:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _each(order: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each group."""
    ends = np.append(first[1:], len(order)).tolist() if len(first) else []
    for a, b in zip(first.tolist(), ends, strict=True):
        yield order[a:b]


def _least(value: np.ndarray, *cols: np.ndarray) -> np.ndarray:
    """For each row the least value among rows equal in ``cols``."""
    out = np.empty_like(value)
    if not len(value):
        return out
    order, first = _groups(*cols)
    low = np.minimum.reduceat(value[order], first)
    out[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return out


def _split48(x: np.ndarray) -> list[np.ndarray]:
    return [(x >> np.uint64(16)).astype("<u4"), (x & np.uint64(0xFFFF)).astype("<u2")]


def _packed(a: dict[str, np.ndarray], rows: np.ndarray) -> bytes:
    rows = rows[np.argsort(a["doc"][rows], kind="stable")]
    doc = a["doc"][rows]
    step = np.diff(doc, prepend=doc[:1])
    small = len(step) == 0 or int(step.max()) < 1 << 32
    cols = [*_split48(a["key"][rows] & _LOW48), *_split48(a["ctx"][rows] & _LOW48), a["left"][rows], a["right"][rows], a["lo"][rows].astype("<u4"), a["span"][rows], a["off"][rows]]
    cols.append(step.astype("<u4") if small else doc.astype("<i8"))
    head = np.array([len(rows), int(small), int(doc[0]) if len(doc) else 0], "<i8")
    return b"".join(c.tobytes() for c in [head, *cols])


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    n, small, base = np.frombuffer(raw, "<i8", 3).tolist()
    at, got = 24, []
    for kind in ("<u4", "<u2", "<u4", "<u2", "<u2", "<u2", "<u4", "u1", "u1", "<u4" if small else "<i8"):
        got.append(np.frombuffer(raw, kind, n, at))
        at += got[-1].nbytes
    join = lambda h, l: h.astype(np.uint64) << np.uint64(16) | l  # noqa: E731, E741
    doc = base + np.cumsum(got[9].astype(np.int64)) if small else got[9].astype(np.int64)
    return {"key": join(got[0], got[1]), "ctx": join(got[2], got[3]), "left": got[4], "right": got[5], "lo": got[6].astype(np.int64), "span": got[7].astype(np.int64), "off": got[8].astype(np.int64), "doc": doc}


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of each document's ranges (doc, start, end), in order; ranges that touch join."""
    if not len(doc):
        return doc, start, end
    _, rank = np.unique(doc, return_inverse=True)
    base = rank.ravel().astype(np.int64) << 33
    order = np.argsort(base + start, kind="stable")
    low, high = (base + start)[order], np.maximum.accumulate((base + end)[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    at = order[first]
    return doc[at], start[at], high[np.append(first[1:], len(low)) - 1] - base[at]


def _runs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges that come as blobs of (start, end)."""
    raw = np.concatenate([np.frombuffer(x, "<u4").astype(np.int64).reshape(-1, 2) for x in blobs])
    _, start, end = _merged(np.zeros(len(raw), np.int64), raw[:, 0], raw[:, 1])
    return start, end


def _ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int, buckets: int, out: list[list]) -> None:
    """Ranges merged and packed by their documents' bucket, appended to ``out`` (bucket, kind, blob)."""
    doc, start, end = _merged(doc.astype(np.int64), start.astype(np.int64), end.astype(np.int64))
    to = doc % buckets
    for mine in _each(*_groups(to)):
        out[0].append(int(to[mine[0]]))
        out[1].append(kind)
        out[2].append(np.array([len(mine)], "<i8").tobytes() + doc[mine].astype("<i8").tobytes() + start[mine].astype("<u4").tobytes() + end[mine].astype("<u4").tobytes())


def _rows(out: list[list], keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys[np.array(out[0], np.int64)], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["bucket", "kind", "blob"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed ranges of whole documents to one row for each document and kind."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for kind, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            held.setdefault(kind, []).append((np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n).astype(np.int64), np.frombuffer(raw, "<u4", n, 8 + 12 * n).astype(np.int64)))
    for kind, got in held.items():
        doc, start, end = _merged(*(np.concatenate(x) for x in zip(*got, strict=True)))
        both = np.stack([start, end], 1).astype("<u4")
        first = np.flatnonzero(np.diff(doc, prepend=-1 - doc[0])) if len(doc) else []
        blobs = [both[a:b].tobytes() for a, b in zip(first, [*first[1:], len(doc)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "kind", "blob"])


PACKED, RANGES, ASKED = 0, 1, 2


def _anchor_rows(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, np.ndarray]] = []
    size = docs = 0

    def flush() -> pa.RecordBatch:
        a = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        out: list[list] = [[], [], []]
        low = _least(a["doc"], a["key"], a["ctx"])
        known = np.flatnonzero(a["doc"] > low)
        _ranges(a["doc"][known], a["lo"][known], a["lo"][known] + a["span"][known] + LENGTH, RANGES, len(keys), out)
        rest = np.flatnonzero(a["doc"] == low)
        to = ((a["key"][rest] >> np.uint64(32)) % np.uint64(len(keys))).astype(np.int64)
        for mine in _each(*_groups(to)):
            out[0].append(int(to[mine[0]]))
            out[1].append(PACKED)
            out[2].append(_packed(a, rest[mine]))
        held.clear()
        return _rows(out, keys)

    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(0))
        for data, bounds, rows, shift in _segments(batch.column(1)):
            a = anchors(data, bounds)
            at = np.searchsorted(bounds, a["lo"], "right") - 1
            a["doc"] = ids[rows[at]]
            a["lo"] = a["lo"] - bounds[at] + shift
            held.append(a)
            size, docs = size + len(data), docs + len(rows)
            if size >= FLUSH_BYTES or docs >= FLUSH_DOCS:
                yield flush()
                size = docs = 0
    if held:
        yield flush()


def _judge_anchors(a: dict[str, np.ndarray], buckets: int, out: list[list]) -> None:
    """Anchors of some buckets, all of each key: ranges that repeat, and strings that must be looked at one by one."""
    doc = a["doc"]
    low = _least(doc, a["key"])
    high = -_least(-doc, a["key"])
    many = np.flatnonzero(low < high)
    a = {k: v[many] for k, v in a.items()}
    doc = a["doc"]
    same = _least(doc, a["key"], a["ctx"])
    gone = np.flatnonzero(doc > same)
    _ranges(doc[gone], a["lo"][gone], a["lo"][gone] + a["span"][gone] + LENGTH, RANGES, buckets, out)
    stay = np.flatnonzero(doc == same)
    a = {k: v[stay] for k, v in a.items()}
    doc, lo = a["doc"], a["lo"]
    left, right = (_least(doc, a["key"], a[side]) < -_least(-doc, a["key"], a[side]) for side in ("left", "right"))
    # a string reaches SIDE bytes to the left of the anchor, or as far to its right, or both
    turn, top = np.maximum(lo, lo + a["off"] - SIDE), lo + a["span"]
    start = np.where(left, lo, turn)
    end = np.where(right, top, np.minimum(turn, top)) + 1
    wanted = np.flatnonzero((left | right) & (start < end))
    _ranges(doc[wanted], start[wanted], end[wanted], ASKED, buckets, out)


def _judge(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        packed = pa.array(np.asarray(batch.column(1)) == PACKED)
        passed = batch.filter(pa.compute.invert(packed))
        if passed.num_rows:
            yield passed
        held += [_unpacked(x) for x in batch.filter(packed).column(2).to_pylist()]
    if held:
        out: list[list] = [[], [], []]
        _judge_anchors({k: np.concatenate([h[k] for h in held]) for k in held[0]}, len(keys), out)
        yield _rows(out, keys)


def _string_rows(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, found: the 50-byte names asked for, packed by bucket. Of equal names in a batch only the
    least document's are dealt; the others are known to repeat."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        name, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        out: list[list] = [[], [], []]
        low = _least(doc, name)
        known = np.flatnonzero(doc > low)
        _ranges(doc[known], at[known], at[known] + LENGTH, RANGES, len(keys), out)
        rest = np.flatnonzero(doc == low)
        name, doc, at = name[rest], doc[rest], at[rest]
        to = ((name >> np.uint64(32)) % np.uint64(len(keys))).astype(np.int64)
        for mine in _each(*_groups(to)):
            out[0].append(int(to[mine[0]]))
            out[1].append(PACKED)
            out[2].append(b"".join(c.tobytes() for c in (np.array([len(mine)], "<i8"), name[mine], doc[mine].astype("<i8"), at[mine].astype("<u4"))))
        return _rows(out, keys)

    for batch in batches:
        ids, asked = np.asarray(batch.column(0)), batch.column(2).to_pylist()
        for data, bounds, rows, shift in _segments(batch.column(1)):
            if len(data) < LENGTH:
                continue
            n50 = names(data)[1]
            for k, row in enumerate(rows.tolist()):
                start, end = _runs(asked[row])
                top = max(0, int(bounds[k + 1] - bounds[k]) - LENGTH + 1)
                lo, hi = np.clip(start - shift, 0, top), np.clip(end - shift, 0, top)
                count = hi - lo
                at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                held.append((n50[bounds[k] + at], np.full(len(at), ids[row]), at + shift))
                size += len(at)
            if size >= 1_500_000:
                yield flush()
                size = 0
    if held:
        yield flush()


def _judge_strings(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    name, doc, at = [], [], []
    for batch in batches:
        packed = pa.array(np.asarray(batch.column(1)) == PACKED)
        passed = batch.filter(pa.compute.invert(packed))
        if passed.num_rows:
            yield passed
        for raw in batch.filter(packed).column(2).to_pylist():
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            name.append(np.frombuffer(raw, "<u8", n, 8))
            doc.append(np.frombuffer(raw, "<i8", n, 8 + 8 * n))
            at.append(np.frombuffer(raw, "<u4", n, 8 + 16 * n).astype(np.int64))
    if name:
        n, d, a = np.concatenate(name), np.concatenate(doc), np.concatenate(at)
        gone = np.flatnonzero(d > _least(d, n))
        out: list[list] = [[], [], []]
        _ranges(d[gone], a[gone], a[gone] + LENGTH, RANGES, len(keys), out)
        yield _rows(out, keys)


def _gathered(rows: DataFrame) -> DataFrame:
    """Blobs of each document; broadcast where their summed size allows it."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("blob") + 40), F.lit(0)).alias("n")).first()["n"]
    found = rows.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list("blob").alias("found"))
    return F.broadcast(found) if size <= BROADCAST_BYTES else found


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, blob): byte ranges to remove, one or two rows a document; staged. ``docs``: doc_id long, text."""
    named = docs.where("doc_id is not null and octet_length(text) >= 50")
    parts = partitions_for(docs, 4_000_000)
    keys = even_keys(parts)
    dealt, shape = "bucket int, kind int, blob binary", "doc_id long, kind int, blob binary"
    found = named.mapInArrow(trimmed(lambda it: _anchor_rows(it, keys)), dealt).repartition(parts, "bucket")
    found = found.mapInArrow(trimmed(lambda it: _judge(it, keys)), dealt).repartition(parts, "bucket")
    first = staged(found.mapInArrow(trimmed(_by_document), shape))
    asked = _gathered(first.where(F.col("kind") == ASKED))
    strings = named.join(asked, F.col("doc_id") == F.col("d")).select("doc_id", "text", "found")
    found = strings.mapInArrow(trimmed(lambda it: _string_rows(it, keys)), dealt).repartition(parts, "bucket")
    found = found.mapInArrow(trimmed(lambda it: _judge_strings(it, keys)), dealt).repartition(parts, "bucket")
    second = staged(found.mapInArrow(trimmed(_by_document), shape))
    return first.where(F.col("kind") == RANGES).unionByName(second)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes) and kept (the bytes
    that remain)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = _gathered(repeated_ranges(source))
    joined = source.join(ranges, F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "found")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digest, kept = [], [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                raw = memoryview(text.as_buffer())
                size.append(len(raw))
                if found.is_valid:
                    start, end = _runs([x.as_buffer() for x in found])
                    runs = [(a, min(b, len(raw))) for a, b in zip(start.tolist(), end.tolist(), strict=True) if a < len(raw)]
                else:
                    runs = []
                removed.append(sum(b - a for a, b in runs))
                spans.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else raw
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            n_spans = [len(s) for s in spans]
            arrays = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return joined.mapInArrow(trimmed(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def removal_report(docs: DataFrame) -> DataFrame:
    """Contract of ``op2``."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
