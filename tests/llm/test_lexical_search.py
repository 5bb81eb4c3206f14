"""Ranked search against plain Python, with windows and blocks of any size."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = ("id", "ids", "digest", "terms", "rank", "score", "part", "doc", "item", "times")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms_of(text) if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def random_tables(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]

    def text(n):
        return " ".join(words[min(59, int(rng.expovariate(0.1)))] for _ in range(n))

    docs = [(rng.randrange(10**12), text(rng.choice([1, 5, 30, 200]))) for _ in range(400)]
    docs += [(i, "same words here w1 w2") for i in range(130)] + [docs[0], docs[1], (docs[2][0], "w3 w3 w3"), (None, text(20)), (None, "w1 w2 w2"), (7, None), (8, ""), (9, "... --")]
    items = [(i, text(rng.choice([1, 4, 40]))) for i in range(30)] + [(1, "w1 w2 same"), (None, "w5"), (40, "W1  w1, w1"), (41, "W1  w1, w1"), (50, None), (51, ""), (52, "unknown"), (53, "!!")]
    return docs, items


@pytest.mark.parametrize(("window", "block", "partitions"), [(64, 1 << 20, 1), (128, 25, 9), (4096, 1, 3)])
def test_same_as_by_hand(spark, window, block, partitions):
    docs, items = random_tables()
    clash = [F.lit("x").alias(c) for c in CLASH]
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", *clash).repartition(partitions)
    b = spark.createDataFrame(items, "item_id long, text string").select("*", *clash).repartition(2)
    if block == 1:
        items = items[-9:]
        b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical_search.rank(d, b, block=block, size=window)) == by_hand(docs, items)


def test_windows_of_an_index(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b"), F.col("id") % 5).alias("text")).repartition(1)
    rows = lexical_search.build_index(docs).select("ids", "n_docs", "n_terms").collect()
    assert sorted(r.n_docs for r in rows) == [808, 4096, 4096] and all(r.ids == sorted(r.ids) and r.n_terms == 2 * r.n_docs for r in rows)


def test_a_hot_term_and_a_very_long_text(spark):
    docs = [(i, f"hot word{i % 7}") for i in range(5000)] + [(6000, "hot " * 300_000 + "needle")]
    items = [(1, "hot"), (2, "needle"), (3, "word3 hot")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical_search.rank(d, b)) == by_hand(docs, items)


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty_tables(spark, empty):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string").where(F.lit(empty == "items"))
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string").where(F.lit(empty == "docs"))
    found = lexical_search.rank(d, b)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_lengths_beyond_64_bits():
    import numpy as np

    lengths = np.array([1, 10**9], dtype=np.int64)
    assert lexical_search.length_part(lengths, 10**12, 10**14).tolist() == [8 * (25 + 75 * n * 10**12 // 10**14) for n in (1, 10**9)]
