"""Tokenised documents as Arrow files of equal-length sequences.

Format. A folder of Arrow IPC files (stream batches between magic and footer, uncompressed) and a Parquet table
``manifest`` that names them in order. Each row of a file is one sequence:

* ``ids``: fixed-size list of ``sequence`` token ids, uint16 where the vocabulary fits, else uint32;
* ``mask``: fixed-size list of ``sequence`` booleans, true for a token, false for padding;
* ``segments``: whose tokens these are, in order: doc_id, at (ids of that document before), n.

Documents follow one another in ascending doc_id order without gaps; each ends with the end id. A file ends with a
document, so that only its last sequence is padded. Batches have ``BATCH_SEQUENCES`` rows, all alike but the last of a
file, and lists of fixed size have no offsets: sequence s of a file is at a place that follows from s alone, and a
memory-mapped file gives it without copying (``TokenFile``).

1. Documents are dealt by ranges of (doc_id, hash of the text, row) and sorted there, so that a hot id is spread.
2. Each task tokenises its range, in order, and writes files as it goes; it holds one block of text and one batch of
   sequences. A text beyond ``packing.LONG_TEXT`` bytes is tokenised in slices.
3. Each file has a name of its own in each attempt of a task. What counts is the manifest, which Spark commits with the
   tasks that succeeded: files of lost or repeated attempts are named nowhere.
4. ``documents_of`` reads the files back, each in a task that maps it, and gives every document's place and checksum.

Defined results: null text is an empty text, one token (the end id); rows that share a doc_id are documents of their
own, in the order of their texts' hashes (equal rows: in any); null ids come first; an empty table gives no file and an
empty manifest; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packing
from .bytescan import blocks, trimmed
from .common import partitions_for, shared_dir

SEQUENCE = 2048
BATCH_SEQUENCES = 256
#: A file is closed at the first end of a block of documents past so many ids.
FILE_TOKENS = 64_000_000
#: Stored bytes of documents for each range.
RANGE_BYTES = 512_000_000
MANIFEST = "part int, number int, path string, documents long, sequences long, tokens long"


def _listed(values: pa.Array, size: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(values, size)


class Writer:
    """Files of one task. ``add`` takes ids and the pieces of documents they consist of."""

    def __init__(self, folder: str, sequence: int, kind: np.dtype, doc_type: pa.DataType, file_tokens: int) -> None:
        self.uri = folder
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.sequence, self.kind, self.file_tokens = sequence, kind, file_tokens
        self.segment = pa.struct([("doc_id", doc_type), ("at", pa.int64()), ("n", pa.int32())])
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence)), ("segments", pa.list_(self.segment))])
        self.attempt, self.number, self.done = uuid.uuid4().hex, 0, []
        self._fresh()

    def _fresh(self) -> None:
        self.sink, self.out = None, None
        self.ids: list[np.ndarray] = []
        self.docs: list[pa.Array] = []
        self.at: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.held = self.tokens = self.sequences = self.documents = 0

    def add(self, ids: np.ndarray, docs: pa.Array, at: np.ndarray, n: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append(docs)
        self.at.append(at)
        self.n.append(n)
        self.held += len(ids)
        self.tokens += len(ids)
        self.documents += int((at == 0).sum())
        batch = self.sequence * BATCH_SEQUENCES
        if self.held >= batch:
            self._write(self.held // batch * batch)

    def _write(self, take: int) -> None:
        """The first ``take`` of the ids held, in batches; all that are held if take is beyond them, padded."""
        length = self.sequence
        ids, docs, at, n = np.concatenate(self.ids), pa.concat_arrays(self.docs), np.concatenate(self.at), np.concatenate(self.n)
        used = min(take, len(ids))
        ends = np.cumsum(n)
        cuts = np.unique(np.concatenate([ends, np.arange(length, len(ids), length), [used]]))
        begins = np.concatenate([[0], cuts[:-1]])
        piece = np.searchsorted(ends, begins, "right")
        rows, mine = -(-used // length), int(np.searchsorted(begins, used))
        docs_cut, at_cut = docs.take(pa.array(piece)), at[piece] + begins - (ends - n)[piece]
        segments = pa.StructArray.from_arrays([docs_cut[:mine], pa.array(at_cut[:mine]), pa.array((cuts - begins)[:mine].astype(np.int32))], fields=list(self.segment))
        offsets = np.searchsorted(begins[:mine], np.arange(rows + 1) * length)
        flat = np.zeros(rows * length, self.kind)
        flat[:used] = ids[:used]
        whole = pa.RecordBatch.from_arrays(
            [_listed(pa.array(flat), length), _listed(pa.array(np.arange(rows * length) < used), length), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), segments)], schema=self.schema
        )
        if self.out is None:
            self.name = f"{self.attempt}-{self.number:06d}.arrow"
            self.sink = self.files.open_output_stream(f"{self.folder}/{self.name}")
            self.out = pa.ipc.new_file(self.sink, self.schema)
        for lo in range(0, rows, BATCH_SEQUENCES):
            self.out.write_batch(whole.slice(lo, BATCH_SEQUENCES))
        self.sequences += rows
        left = begins >= used
        self.ids, self.docs, self.at, self.n = [ids[used:]], [docs_cut.filter(pa.array(left))], [at_cut[left]], [(cuts - begins)[left]]
        self.held = len(ids) - used

    def end_document(self) -> None:
        """Between two documents: a file that is long enough ends here."""
        if self.tokens >= self.file_tokens:
            self.close()

    def close(self) -> None:
        if self.held:
            self._write(-(-self.held // self.sequence) * self.sequence)
        if self.out is not None:
            self.out.close()
            self.sink.close()
            self.done.append((self.number, f"{self.uri}/{self.name}", self.documents, self.sequences, self.tokens))
            self.number += 1
        self._fresh()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, sequence: int = SEQUENCE, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files and their manifest below ``folder``, which the driver and all executors share; returns the
    manifest as ``manifest_of`` does."""
    if sequence < 1 or sequence % 8:
        raise ValueError("sequence must be a multiple of eight, so that masks begin at bytes")
    path = tokenizer or packing.default_tokenizer()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keyed = source.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), F.col("h"), F.col("row")]
    sorted_ = keyed.repartitionByRange(partitions_for(docs, RANGE_BYTES), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = packing._tokens(path)
        kind = np.dtype("<u2" if tokens.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        end = np.array([packing.END_ID], np.uint32)
        out = None
        for batch in batches:
            out = out or Writer(folder, sequence, kind, batch.column(0).type, file_tokens)
            for block in blocks(batch.column(1)):
                own = batch.column(0).slice(block.first, block.last - block.first)
                if len(block.data) > packing.LONG_TEXT:
                    at = 0
                    for ids in (x for s in (*packing._slices(block), None) for x in [end if s is None else tokens.encode(s)[0]]):
                        if len(ids):
                            out.add(ids, own, np.array([at]), np.array([len(ids)]))
                        at += len(ids)
                else:
                    ids, bounds = tokens.encode(block)
                    out.add(np.insert(ids, bounds[1:], packing.END_ID), own, np.zeros(len(own), np.int64), np.diff(bounds) + 1)
                out.end_document()
        if out is not None:
            out.close()
            columns = list(zip(*out.done, strict=True))
            part = pa.array([TaskContext.get().partitionId()] * len(out.done), pa.int32())
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    sorted_.mapInArrow(trimmed(run), MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest_of(docs.sparkSession, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, with ``first_sequence`` and ``first_token``: what the files before each hold. Ranges are
    summed first, so that only one row for each range is ever in one window."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    counts = ("sequences", "tokens")
    parts = files.groupBy("part").agg(*[F.sum(c).alias(c) for c in counts])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c}") for c in counts])
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    first = [(F.col(f"first_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"first_{c[:-1]}") for c in counts]
    return files.join(parts, "part").select(*files.columns, *first)


class TokenFile:
    """One file, by sequence. Arrays are views of the mapped file; a file in a remote store is read once."""

    def __init__(self, path: str) -> None:
        files, where = fs.FileSystem.from_uri(path)
        local = isinstance(files, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(where) if local else pa.py_buffer(files.open_input_file(where).read()))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for k in range(self.reader.num_record_batches):
            yield self.reader.get_batch(k)

    def sequence(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence s of this file; the mask as packed bits, eight positions to a byte, lowest first."""
        batch, row = self.reader.get_batch(s // BATCH_SEQUENCES), s % BATCH_SEQUENCES
        ids, mask = batch.column(0), batch.column(1)
        length = ids.type.list_size
        if row >= len(ids):
            raise IndexError(s)
        flat = ids.values.to_numpy(zero_copy_only=True)
        begin, bits = (ids.offset + row) * length, (mask.offset + row) * length + mask.values.offset
        packed = np.frombuffer(mask.values.buffers()[1], np.uint8)[bits // 8 : (bits + length) // 8]
        return flat[begin : begin + length], packed


def documents_of(manifest: DataFrame, doc_type: str = "long") -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers)."""
    count = max(1, manifest.count())
    dealt = manifest.select("path", "first_token").repartitionByRange(count, "first_token")

    def read(path: str, first: int) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Array, int, int, int] | None = None  # doc_id, start, ids so far, checksum so far
        for batch in TokenFile(path).batches():
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<u4")
            raw = memoryview(ids).cast("B")
            segments = batch.column(2).flatten()
            names = segments.field("doc_id")
            at, n = segments.field("at").to_numpy(), segments.field("n").to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            begin = np.flatnonzero(at == 0)
            if at[0]:
                begin = np.concatenate([[0], begin])  # the rest of a document from the batch before
            low, high = (ends - n)[begin].tolist(), ends[np.append(begin[1:], len(n)) - 1].tolist()
            docs, starts, sizes, sums = [], [], [], []
            for k, lo, hi in zip(begin.tolist(), low, high, strict=True):
                if at[k] == 0:
                    if held is not None:
                        docs.append(held[0]), starts.append(held[1]), sizes.append(held[2]), sums.append(held[3])
                    held = (names.slice(k, 1), first + lo, 0, 0)
                held = (held[0], held[1], held[2] + hi - lo, zlib.crc32(raw[4 * lo : 4 * hi], held[3]))
            first += int(ends[-1])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([held[0], *(pa.array([x], pa.int64()) for x in held[1:])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from read(path, first)

    return dealt.mapInArrow(trimmed(run), f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Contract of ``op13``: writes the files (below the session's shared folder unless one is given) and reads every
    document's row from them."""
    where = folder or f"{shared_dir(docs.sparkSession)}-tokens"
    manifest = write_token_files(docs, where, tokenizer, sequence)
    return documents_of(manifest, docs.schema["doc_id"].dataType.simpleString())
