import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm import packing, token_files
from quire.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def want(tokenizer, rows):
    """By (doc_id, hash order unknown): the multiset of (doc_id, n_tokens, crc), and the starts that id order allows."""
    out = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return out


def check(tokenizer, rows, got):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, n, c) for i, n, c in want(tokenizer, rows))
    at = 0
    in_place = sorted(got, key=lambda r: r.start)
    for r in in_place:
        assert r.start == at
        at += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id) for r in in_place]
    assert ids == sorted(ids)


def rows():
    r = random.Random(5)
    some = ["Hello", "wörld's", "don't", "№5", "42%", "<|endoftext|>", "日本語", "x" * 300, "I'LL", "…", "\n", "foo_bar-baz", "\x00"]
    make = lambda n: " ".join(r.choice(some) for _ in range(n))
    out = [(7, None), (3, ""), (None, "no id"), (5, " \n "), (1, "a"), (2, make(9000)), (-4, make(30))]
    out += [(i, make(r.randrange(1, 200))) for i in range(100, 160)]
    return out + [(50, "same text")] * 30 + [(50, make(5)), (50, make(6))]


def test_files_against_the_tokenizer(spark, tokenizer, tmp_path):
    data = [(i, t, "clash", 9) for i, t in rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, start string, row int").repartition(5)
    got = token_files.token_report(docs, str(tmp_path / "files"), sequence=64).collect()
    check(tokenizer, rows(), got)
    # the files, sequence by sequence, give the whole stream
    stream = []
    for f in token_files.manifest_of(spark, str(tmp_path / "files")).orderBy("first_token").collect():
        file, at = token_files.TokenFile(f.path), 0
        for s in range(f.sequences):
            ids, mask = file.sequence(s)
            bits = np.unpackbits(mask, bitorder="little")
            assert len(ids) == 64 and ids.base is not None and ids.dtype == np.uint16
            assert bits.all() or s == f.sequences - 1
            assert not ids[bits == 0].any()
            stream += ids[bits == 1].tolist()
            at += int(bits.sum())
        assert at == f.tokens
        with pytest.raises(IndexError):
            file.sequence(f.sequences)
    order = sorted(got, key=lambda r: r.start)
    for r in order:
        assert zlib.crc32(np.array(stream[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
    assert len(stream) == order[-1].start + order[-1].n_tokens


def test_many_small_files(spark, tokenizer, tmp_path, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    manifest = token_files.write_token_files(docs, str(tmp_path / "files"), sequence=8, file_tokens=100)
    assert manifest.count() > 5
    check(tokenizer, rows(), token_files.documents_of(manifest).collect())


def test_writer_over_batches_files_and_long_documents(tmp_path, monkeypatch):
    """Documents longer than a batch, in several pieces; files of several batches."""
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 4)
    r = random.Random(2)
    out = token_files.Writer(str(tmp_path), 16, np.dtype("<u2"), pa.int64(), 300)
    docs, stream = [], []
    for d in range(200):
        n = r.choice([1, 3, 16, 64, 500])
        ids = np.array([r.randrange(40000) for _ in range(n)], np.uint32)
        cut = r.choice([n, (n + 1) // 2, 7])
        for at in range(0, n, cut):
            out.add(ids[at : at + cut], pa.array([d], pa.int64()), np.array([at]), np.array([len(ids[at : at + cut])]))
        out.end_document()
        docs.append(ids.tolist())
    out.close()
    assert len(out.done) > 10 and sum(x[2] for x in out.done) == 200
    seen = {}
    for _, path, n_docs, n_seq, n_tok in out.done:
        file = token_files.TokenFile(path)
        rows_ = [x for b in file.batches() for x in b.to_pylist()]
        assert len(rows_) == n_seq and sum(sum(x["mask"]) for x in rows_) == n_tok
        for k, x in enumerate(rows_):
            ids, mask = file.sequence(k)
            assert ids.tolist() == x["ids"] and np.unpackbits(mask, bitorder="little").astype(bool).tolist() == x["mask"]
            lo = 0
            for s in x["segments"]:
                assert s["at"] == len(seen.get(s["doc_id"], []))
                seen.setdefault(s["doc_id"], []).extend(x["ids"][lo : lo + s["n"]])
                lo += s["n"]
            assert lo == sum(x["mask"])
        stream += [n_docs]
    assert [seen[d] for d in range(200)] == docs


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_report(empty, str(tmp_path / "files")).collect() == []
    assert token_files.manifest_of(spark, str(tmp_path / "files")).count() == 0


def test_query_over_whole_table(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(tokenizer, docs, QUERIES["op13_token_files"](spark, sf).collect())
