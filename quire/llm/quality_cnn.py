"""A byte-level convolutional network in numpy that scores text quality.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned byte vectors pass through learned
filters (width 8, stride 4), are rectified and max-pooled within each chunk; a document is the mean and the maximum of
its chunks' pooled filters and its length on a log scale, and a small hidden layer combines them into one probability.

The network is fitted on the driver from a bounded sample: at most ``SAMPLE`` labelled documents of at most
``SAMPLE_BYTES`` bytes each, in hash order of their ids, none of them held out. Scoring reads every byte of every
document, in batches of chunks, without a shuffle.

Defined results: null and empty texts are one empty chunk and get a score like any other; without labels of both kinds
every score is the share of label 1 (0.5 without any label); repeated rows score alike; labels of null id or null
quality are ignored; a null doc_id is never held out; labels that repeat with other values count each; texts of any length are scored whole, in
chunks; an empty table gives an empty one; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import text_buffers, trimmed

CHUNK, STEP = 512, 448
WIDTH, STRIDE = 8, 4
VECTOR, FILTERS, HIDDEN = 6, 32, 16
PAD = 256
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
SAMPLE, SAMPLE_BYTES = 3000, 16_000
EPOCHS, BATCH, RATE, DROP = 12, 32, 0.004, 0.3
BATCH_CHUNKS = 256
#: Labels are broadcast up to this many rows.
BROADCAST_LABELS = 2_000_000
HOLD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


@dataclass
class Network:
    vectors: np.ndarray  # 257 x VECTOR; the padding's stays zero
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 2 * FILTERS + 2 x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def chunks(data: np.ndarray) -> np.ndarray:
    """A text's bytes as rows of CHUNK; the last is padded."""
    count = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    wide = np.full((count - 1) * STEP + CHUNK, PAD, np.int16)
    wide[: len(data)] = data
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, CHUNK)[::STEP])


def _windows(net: Network, rows: np.ndarray) -> np.ndarray:
    x = net.vectors[rows]  # n x CHUNK x VECTOR
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(rows), POSITIONS, WIDTH * VECTOR), (s[0], s[1] * STRIDE, s[2]))


def pooled(net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's greatest rectified answer of each filter, and where it was."""
    n = len(rows)
    answer = (_windows(net, rows).reshape(n * POSITIONS, -1) @ net.filters + net.bias).reshape(n, POSITIONS, FILTERS)
    answer[rows[:, ::STRIDE][:, :POSITIONS] == PAD] = 0  # windows that begin in the padding
    at = answer.argmax(1)
    return np.maximum(np.take_along_axis(answer, at[:, None], 1)[:, 0], 0), at


def _document(pool: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(np.append(first, len(pool)))[:, None]
    mean = np.add.reduceat(pool, first, 0) / count
    most = np.maximum.reduceat(pool, first, 0)
    size = np.log1p(length.astype(np.float32))[:, None] / 8
    return np.concatenate([mean, most, size, np.minimum(length, CHUNK)[:, None] / CHUNK], 1).astype(np.float32), count


def _probability(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ net.hidden + net.hidden_bias)
    return 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30))), h


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss. Deterministic for given texts, labels and seed."""
    r = np.random.Generator(np.random.PCG64(seed))
    normal = lambda *shape: r.standard_normal(shape).astype(np.float32)
    vectors = normal(257, VECTOR) * 0.5
    vectors[PAD] = 0
    features = 2 * FILTERS + 2
    net = Network(vectors, normal(WIDTH * VECTOR, FILTERS) / np.float32((WIDTH * VECTOR) ** 0.5), np.zeros(FILTERS, np.float32), normal(features, HIDDEN) / np.float32(features**0.5), np.zeros(HIDDEN, np.float32), normal(HIDDEN) / np.float32(HIDDEN**0.5), np.zeros(1, np.float32))
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        net.out[:] = 0
        net.out_bias[:] = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
        return net
    rows = [chunks(np.frombuffer(t, np.uint8)) for t in texts]
    size = np.array([len(t) for t in texts])
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step, epochs = 0, max(EPOCHS, min(60, 12_000 // max(1, len(texts))))
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            mine = order[lo : lo + BATCH]
            batch = np.concatenate([rows[i] for i in mine])
            counts = np.array([len(rows[i]) for i in mine])
            first = np.cumsum(counts) - counts
            pool, at = pooled(net, batch)
            x, count = _document(pool, first, size[mine])
            top = x[:, FILTERS : 2 * FILTERS].copy()
            keep = ((r.random(x.shape) >= DROP) / (1 - DROP)).astype(np.float32)
            x *= keep
            p, h = _probability(net, x)
            error = ((p - labels[mine]) / len(mine)).astype(np.float32)
            g_out, g_bias = h.T @ error, np.array([error.sum()], np.float32)
            back = np.outer(error, net.out) * (1 - h**2)
            g_hidden, g_hbias, g_x = x.T @ back, back.sum(0), (back @ net.hidden.T) * keep
            doc = np.repeat(np.arange(len(mine)), counts)
            g_pool = (g_x[:, :FILTERS] / count)[doc] + g_x[:, FILTERS : 2 * FILTERS][doc] * (pool == top[doc])
            g_pool *= pool > 0
            row, filt = np.nonzero(g_pool)
            g = g_pool[row, filt]
            where = at[row, filt]
            seen = batch[row[:, None], where[:, None] * STRIDE + np.arange(WIDTH)]  # bytes under each greatest answer
            g_filters = np.zeros_like(net.filters)
            g_vectors = np.zeros_like(net.vectors)
            felt = net.vectors[seen].reshape(len(g), -1) * g[:, None]
            for f in range(FILTERS):
                g_filters[:, f] = felt[filt == f].sum(0)
            pull = (net.filters.T[filt] * g[:, None]).reshape(-1, VECTOR)
            for v in range(VECTOR):
                g_vectors[:, v] = np.bincount(seen.ravel(), pull[:, v], 257)
            g_vectors[PAD] = 0
            grads = [g_vectors, g_filters, np.bincount(filt, g, FILTERS).astype(np.float32), g_hidden + 1e-4 * net.hidden, g_hbias, g_out, g_bias]
            step += 1
            rate = RATE * min(1, step / 20) * (1 - 0.9 * step / total)
            for k, (part, grad, (m, v)) in enumerate(zip(net.parts(), grads, moment, strict=True)):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                part -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _scores(net: Network, column: pa.Array) -> np.ndarray:
    data, bounds = text_buffers(column)
    n = len(bounds) - 1
    out, held, owners, waiting = np.zeros(n), [], [], 0
    mean, most, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS), np.float32), np.zeros(n)

    def flush() -> None:
        if held:
            pool = np.concatenate([pooled(net, part)[0] for rows in [np.concatenate(held)] for part in np.array_split(rows, -(-len(rows) // BATCH_CHUNKS))])
            owner = np.concatenate(owners)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            who = owner[first]
            mean[who] += np.add.reduceat(pool, first, 0)
            most[who] = np.maximum(most[who], np.maximum.reduceat(pool, first, 0))
            count[who] += np.diff(np.append(first, len(owner)))
            held.clear()
            owners.clear()

    for i in range(n):
        text, lo = data[bounds[i] : bounds[i + 1]], 0
        while True:  # a long text comes in runs of whole chunks
            part = text[lo : lo + 2048 * STEP + CHUNK - STEP]
            rows = chunks(part)
            held.append(rows)
            owners.append(np.full(len(rows), i))
            waiting += len(rows)
            if waiting >= 2048:
                flush()
                waiting = 0
            lo += 2048 * STEP
            if lo + (CHUNK - STEP) >= len(text):
                break
    flush()
    length = np.diff(bounds)
    size = np.log1p(length.astype(np.float32))[:, None] / 8
    x = np.concatenate([mean / np.maximum(count, 1)[:, None], most, size, np.minimum(length, CHUNK)[:, None] / CHUNK], 1).astype(np.float32)
    out[:] = _probability(net, x)[0]
    return out


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """The network fitted on the bounded sample."""
    marks = labels.where(f"doc_id is not null and quality is not null and not ({HOLD_OUT})").groupBy(F.col("doc_id").alias("d")).agg(F.max("quality").alias("quality"))
    marks = F.broadcast(marks) if labels.count() <= BROADCAST_LABELS else marks
    size = F.octet_length(F.coalesce("text", F.lit("")))
    known = docs.where(size <= SAMPLE_BYTES).select("doc_id").join(marks, F.col("doc_id") == F.col("d"))
    # ids first, then the texts of those: no task sends more than its share of the sample
    picked = known.select(F.xxhash64("doc_id").alias("h"), "d", "quality").distinct().orderBy("h", "d").limit(SAMPLE)
    texts = docs.where(size <= SAMPLE_BYTES).join(F.broadcast(picked), F.col("doc_id") == F.col("d"))
    sample = texts.groupBy("h", "d", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    sample.sort(key=lambda r: (r["h"], r["d"]))
    return fit([r["text"].encode() for r in sample], np.array([float(r["quality"] == 1) for r in sample], np.float32))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Contract of ``op6``: doc_id, held_out, score, predicted."""
    net = train(docs, labels)
    source = docs.select("doc_id", F.coalesce(F.expr(HOLD_OUT), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(net, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(trimmed(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
