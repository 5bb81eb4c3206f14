"""Term fingerprints against plain Python over the same term hashes."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import queries, term_fingerprints
from millrace.llm.bytetext import CODES, Words, mixed, powers
from millrace.llm.term_fingerprints import IDF, LEAST, RATES, SUBSETS, Fingerprints, TERM

from .test_lexical_search import terms_of

SF = "/root/testdata/sf0.001"


def hash_of(term, known={}):
    if term not in known:
        data = np.frombuffer(term.encode(), dtype=np.uint8)
        known[term] = int(Words(data, np.array([0, len(data)]), TERM).hash[0])
    return known[term]


def set_hash(terms):
    held = np.array(sorted(terms), dtype=np.uint64)
    return int(mixed((mixed(held) * powers(len(held))).sum(keepdims=True))[0])


def by_hand(text, lexicon):
    """The fingerprint as hex."""
    own = {hash_of(t) for t in terms_of(text)}
    if not own:
        return f"{xxhash.xxh64_intdigest(text.encode()):016x}" + "00" * len(RATES) * SUBSETS
    kept = own & lexicon if len(own & lexicon) >= LEAST else own
    out = f"{set_hash(kept):016x}"
    draws = {t: [int(x) for x in mixed(np.uint64(t) ^ CODES[:SUBSETS])] for t in kept}
    for rate in RATES:
        for s in range(SUBSETS):
            some = [t for t in kept if draws[t][s] < rate]
            out += f"{max(1, set_hash(some) >> 56):02x}" if some else "00"
    return out


def lexicon_by_hand(texts):
    bags = [{hash_of(t) for t in terms_of(x)} for x in texts]
    df = Counter(t for b in bags for t in b)
    n = sum(1 for b in bags if b)
    return {t for t, c in df.items() if n * math.exp(-IDF[1]) <= c <= n * math.exp(-IDF[0])}


def like(a, b):
    return float(term_fingerprints.likeness(*[Fingerprints.of_bytes([bytes.fromhex(x)]) for x in (a, b)])[0])


def expected_rows(rows):
    """Rows in the operator's order, as tuples of its columns."""
    rows = [(i, t or "") for i, t in rows]
    lexicon = lexicon_by_hand([t for _, t in rows])
    found = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        own, other = by_hand(text, lexicon), by_hand(changed, lexicon)
        found.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, like(own, other), like(own, by_hand(following, lexicon))))
    return sorted(found, key=str)


def test_whole_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()]
    found = sorted((tuple(r) for r in queries.op12_term_fingerprints(spark, SF).collect()), key=str)
    assert found == expected_rows(docs)


LONG = "a very long text of some words and " * 20_000


@pytest.mark.parametrize("partitions", [1, 7])
def test_awkward_rows(spark, partitions):
    rows = [(9, None), (8, ""), (7, "..."), (6, LONG), (5, LONG), (4, "Ünïcödé ☃ \U0001f600 TEXT"), (3, "three words here"), (2, "ab"), (None, "without an id")]
    clash = [F.lit("x").alias(c) for c in ("id", "part", "border", "text_key", "following", "next_text", "fingerprint", "term", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clash).repartition(partitions)
    found = sorted((tuple(r) for r in term_fingerprints.compare_with_next(df).collect()), key=str)
    assert found == expected_rows(rows)


def test_rows_of_one_id(spark):
    rng = random.Random(1)
    rows = [(1, "same text of a third of all rows")] * 40 + [(None, " ".join(rng.choices("abcdefgh", k=9))) for _ in range(30)] + [(2, f"text number {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    key = spark.createDataFrame([(t,) for _, t in rows], "text string").distinct().select("text", F.xxhash64("text").alias("k"))
    keys = {r.text: r.k for r in key.collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), keys[r[1]]))
    found = sorted((tuple(r) for r in term_fingerprints.compare_with_next(df).collect()), key=str)
    assert found == expected_rows(ordered)


def test_one_row_follows_itself_and_none_gives_none(spark):
    df = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    (row,) = term_fingerprints.compare_with_next(df).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"some words of some w").hexdigest()
    assert term_fingerprints.compare_with_next(df.where(F.lit(False))).collect() == []


def test_likeness_follows_the_terms_in_common():
    rng = random.Random(2)
    terms = [f"t{i}" for i in range(4000)]
    lexicon = np.sort(np.uint64([hash_of(t) for t in terms]))
    for size in (60, 300, 1500):
        for share in (0.0, 0.25, 0.5, 0.75):
            both = int(2 * size * share / (1 + share))
            errors = []
            for _ in range(12):
                drawn = rng.sample(terms, 2 * size - both)
                a, b = drawn[:size], drawn[size - both :]
                prints = term_fingerprints.fingerprints([" ".join(a), " ".join(b)], lexicon)
                errors.append(float(term_fingerprints.likeness(prints[:1], prints[1:])[0]) - share)
            assert abs(sum(errors) / len(errors)) < 0.12
