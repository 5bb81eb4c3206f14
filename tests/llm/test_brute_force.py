"""Operators that SQL can't express, against plain Python over the same rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from millrace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op2_simhash(spark, docs):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in docs.items()}
    group = {i: i for i in prints}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    expected = {i: (f"{prints[i]:016x}", find(i)) for i in ids}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()} == expected


def test_op5_audio_features(spark, docs):
    rows = {r.doc_id: r for r in queries.op5_audio_features(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    by_text = defaultdict(set)
    for i, text in docs.items():
        data, r = (text or "").encode(), rows[i]
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_bytes == len(payload) + 44
        by_text[text].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


BASE = (("assign", re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16))


def base_spans(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_op7_secret_scan(spark, docs):
    some = 0
    for r in queries.op7_secret_scan(spark, SF).collect():
        spans = base_spans(docs[r.doc_id] or "")
        count = Counter(k for k, _, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (count["assign"], count["access"], count["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        some += len(spans)
    assert some


def test_op8_sharding(spark, docs):
    rows = queries.op8_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < 40
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in rows)
    assert max(loads.values()) <= sum(loads.values()) / 40 + largest
