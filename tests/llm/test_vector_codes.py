"""Vector codes against plain Python with integers of any length."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from millrace.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, parts, entries, rounds, scale=4096):
    """Codes and errors by id of rows that are complete and of one length, and the codebooks."""
    width = len(rows[0][1]) // parts
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [(r, [[vector_codes.whole(x, scale) for x in r[1][p * width : (p + 1) * width]] for p in range(parts)]) for r in order]
    books = [[list(x[p]) for _, x in cut[:entries]] for p in range(parts)]

    def assign(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x[p], e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = [[[] for _ in books[p]] for p in range(parts)]
        for _, x in cut:
            for p in range(parts):
                groups[p][assign(x, p)[1]].append(x[p])
        books = [[[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups[p], books[p])] for p in range(parts)]
    found = []
    for r, x in cut:
        best = [assign(x, p) for p in range(parts)]
        found.append((r[0], r[2], "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    return found, books


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def random_rows(n, width, scale=1.0, seed=5):
    import random

    import numpy as np

    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(width)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 0.0001, 1e9, 1e30])
def test_same_as_by_hand(spark, scale):
    rows = random_rows(150, 6, scale)
    rows += [rows[3], (3, rows[9][1], 1), (None, rows[4][1], None), (None, rows[5][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    coded, books = vector_codes.compress(df, parts=3, entries=7, rounds=4)
    expected, by_part = by_hand(rows, 3, 7, 4)
    limit = 1 << 63
    assert sorted(map(key, ((r.vec_id, r.label, r.code, r.error) for r in coded.collect()))) == sorted(key((i, label, c, e if e < limit else None)) for i, label, c, e in expected)
    assert [[[int(x) for x in e] for e in p] for p in books] == by_part
    assert vector_codes.codebooks_sha256(books) == hashlib.sha256(",".join(str(x) for p in by_part for e in p for x in e).encode()).hexdigest()


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    rows = random_rows(300, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    one, books = vector_codes.compress(df.coalesce(1), parts=4)
    found = sorted(map(tuple, one.collect()), key=key)
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 200)
    many, others = vector_codes.compress(df.repartition(17), parts=4)
    assert sorted(map(tuple, many.collect()), key=key) == found and (books == others).all()


def test_awkward_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [-inf, 0.0], 1), (7, [1.0, 2.0, 3.0, 4.0], 0), (8, [], 2), (9, [1.0], 2), (None, [3.0, -0.0], None), (10, [3.0, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("id", "code", "error", "labels", "ids", "block", "vector", "label_error", "total")])
    coded, books = vector_codes.compress(df, parts=2, rounds=2)
    found = {r.vec_id: (r.label, r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(coded).collect()}
    # Rows 10 and None are the same in integers, so the second of their entries is never the nearest.
    assert found == {1: (0, "0000", 0, 0), 7: (0, None, None, 0), 8: (2, None, None, None), 9: (2, None, None, None), 10: (None, "0101", 0, 0), None: (None, "0101", 0, 0)}
    assert books.shape == (2, 3, 1)


def test_empty_table(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert vector_codes.with_label_errors(coded).collect() == [] and books.size == 0
    assert vector_codes.codebooks_sha256(books) == hashlib.sha256(b"").hexdigest()


def test_label_errors_of_a_hot_label(spark):
    coded = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("label"), F.lit("00").alias("code"), F.col("id").alias("error"))
    sums = {}
    for i in range(3000):
        k = i % 7 if i % 3 else None
        sums[k] = sums.get(k, 0) + i
    found = vector_codes.with_label_errors(coded).collect()
    assert len(found) == 3000 and all(r.label_error == sums[r.label] for r in found)
    large = coded.withColumn("error", F.lit((1 << 62) + 1))
    assert {r.label_error for r in vector_codes.with_label_errors(large).collect()} == {None}
