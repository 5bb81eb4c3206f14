"""Repeated bytes against plain Python, in every way that surroundings go and with hashes that mislead."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bytetext, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def kept(texts):
    """The bytes that stay of each text."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for b in data:
        for i in range(len(b) - 199):
            count[b[i : i + 200]] = count.get(b[i : i + 200], 0) + 1
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        yield bytes(np.frombuffer(b, np.uint8)[~gone]), int((np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))) == 1).sum())


def make(rng, n):
    return "".join(rng.choices("abcdefgh ", k=n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage, text = make(rng, 450), make(rng, 3000)
    quoting = [make(rng, 90) + passage[:260] + make(rng, 30 + i) for i in range(12)]
    return ["", None, "short", text, text, passage + make(rng, 300), make(rng, 100) + passage, passage[:300] + make(rng, 50) + passage[100:], "ab" * 400, make(rng, 199), "é" * 150 + make(rng, 10), *quoting]


WAYS = [{}, {"HOT": 1, "CHUNK": 16}, {"HOT": 3, "CHUNK": 16}, {"HOT": 1, "CHUNK": 7}, {"PIECE": 256}, {"HELD": 0}, {"HOT": 1, "HELD": 0, "SORTED": 100}]


@pytest.mark.parametrize("way", WAYS, ids=str)
def test_repeats(spark, texts, monkeypatch, way):
    for name, value in way.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("k1", F.lit("x")).withColumn("id", F.lit("x")).repartition(3)
    found = {r.doc_id: (bytes(r.kept), len(r.spans) // 2) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == dict(enumerate(kept(texts)))


def test_rows_without_ids(spark, texts):
    docs = spark.createDataFrame([(i % 2 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert found == sorted((i % 2, k) for i, (k, _) in enumerate(kept(texts)))


def test_bytes_decide_where_hashes_mislead(monkeypatch):
    rng = random.Random(9)
    shared = [make(rng, 260) for _ in range(3)]
    texts = [make(rng, 40 + i) + shared[i % 3] + make(rng, 60) for i in range(9)]
    classes = [(0, 100, t.encode()) for t in texts]
    count = {}
    for _, _, c in classes:
        for i in range(len(c) - 199):
            count[c[i : i + 200]] = count.get(c[i : i + 200], 0) + 1
    # Places differ by text, so that windows of one place alone are compared; move them to the passages.
    classes = [(0, t.index(shared[i % 3]) + 70, t.encode()) for i, t in enumerate(texts)]
    expected = [[count[c[i : i + 200]] > 1 for i in range(len(c) - 199)] for _, _, c in classes]
    assert [m.tolist() for m in suffix_dedup.repeated(classes)] == expected
    fell_back = []
    monkeypatch.setattr(suffix_dedup, "_by_bytes", lambda c, f=suffix_dedup._by_bytes: fell_back.append(1) or f(c))
    monkeypatch.setattr(suffix_dedup.Prefixes, "at", lambda self, start, length: np.asarray(length) * 0)  # all parts look alike
    assert [m.tolist() for m in suffix_dedup.repeated(classes)] == expected and fell_back


def test_checksums_and_anchors_that_collide(spark, texts, monkeypatch):
    alike = lambda docs, id_col, text_col: docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    monkeypatch.setattr(suffix_dedup, "keyed", alike)
    monkeypatch.setattr(suffix_dedup, "mixed", lambda x: x % np.uint64(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == {i: k for i, (k, _) in enumerate(kept(texts))}
    assert suffix_dedup.mixed is not bytetext.mixed


def test_op9_suffix_dedup(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    expected = {i: (len((t or "").encode()), len((t or "").encode()) - len(k), n, hashlib.sha256(k).hexdigest()) for (i, t), (k, n) in zip(docs.items(), kept(docs.values()), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, SF).collect()} == expected


def test_stretches_of_a_document_go_on_as_one_row():
    """A passage that many documents quote is cut into pieces; those that are known to repeat make a row for each document, not for each piece."""
    out = suffix_dedup._Out()
    data = np.random.default_rng(3).integers(97, 123, 1000).astype(np.uint8).tobytes()
    for doc in range(500):
        for first in (0, 64, 48, 32, 16, 600):
            out.add((str(doc), 0, 0), first, first, 0, data[first : first + 215])
    (batch,) = out.take()
    known = [r for r in batch.to_pylist() if r["kind"] == suffix_dedup.KNOWN]
    assert len(known) == 500 and batch.num_rows == 506
    assert all(sorted(zip(r["ranges"][::2], r["ranges"][1::2], strict=True)) == [(0, 15), (16, 79), (600, 615)] for r in known)
