"""Groupings, quantiles, top rows and multisets against plain Python, with nulls, ties, a hot group and empty tables."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace.operators import groups


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else rng.choice(["a", None]), rng.choice([1, 2, None]), rng.choice([None, math.nan, *[rng.randrange(40) / 4 for _ in range(12)]])) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 200])
def test_summaries(spark, n):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, "k string, j int, v double")
    sets = [c for r in range(3) for c in combinations(("k", "j"), r)]
    found = groups.summaries(df, sets, [F.count("*").alias("n"), F.count_distinct("v").alias("values")]).collect()
    expected = Counter()
    for s in sets:
        held = {}
        for k, j, v in rows:
            key = (("k" not in s) * 2 + ("j" not in s), k if "k" in s else None, j if "j" in s else None)
            held.setdefault(key, []).append("nan" if v is not None and math.isnan(v) else v)
        for key, own in held.items():
            expected[(*key, len(own), len({v for v in own if v is not None}))] += 1
    assert Counter((r.grouping, r.k, r.j, r.n, r["values"]) for r in found) == expected


@pytest.mark.parametrize("n", [0, 300])
def test_totals_are_summaries(spark, n):
    """Counts, sums and distinct counts of cells are those of rows; the sets multiply cells, not rows."""
    df = spark.createDataFrame(rows_of(n), "k string, j int, v double").withColumn("c", (F.hash("v", "k") % 50).cast("long"))
    sets = [c for r in range(3) for c in combinations(("k", "j"), r)]
    wanted = groups.summaries(df, sets, [F.count("*").alias("n"), F.sum("c").alias("c"), F.count_distinct("v").alias("values")])
    found = groups.totals(df, sets, ["c"], "v", out="values")
    assert found.columns == wanted.columns and found.dtypes == wanted.dtypes
    assert Counter(found.collect()) == Counter(wanted.collect())
    assert "__n" in found._jdf.queryExecution().optimizedPlan().toString().split("Expand")[1]


@pytest.mark.parametrize(("n", "accuracy"), [(0, 100), (1, 100), (3, 100), (700, 10), (700, 1000)])
def test_quantiles(spark, n, accuracy):
    rows = rows_of(n, 2)
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(7)
    shares = (0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0)
    expected = set()
    for key in {k for k, _, _ in rows}:
        own = sorted(v for k, _, v in rows if k == key and v is not None and not math.isnan(v))
        expected |= {(key, p, own[max(1, math.ceil(p * len(own))) - 1]) for p in shares if own}
    found = [(r.k, r.share, r.v) for r in groups.quantiles(df, ["k"], "v", shares, accuracy).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_quantiles_order_only_a_part_of_a_large_group(spark):
    df = spark.range(200_000).select(F.lit("x").alias("k"), ((F.col("id") * 7919) % 200_003).alias("v"))
    (row,) = groups.quantiles(df, ["k"], "v", [0.5], 1000).collect()
    assert row.v == sorted((i * 7919) % 200_003 for i in range(200_000))[99_999] and row["rank"] == 100_000


def test_top_rows(spark):
    rows = [(k, i, v) for i, (k, _, v) in enumerate(rows_of(500, 3))]
    df = spark.createDataFrame(rows, "k string, i int, v double").where("v IS NULL OR NOT isnan(v)")
    found = {(r.k, r["rank"]): r.i for r in groups.top_rows(df, ["k"], [F.desc_nulls_last("v"), F.asc("i")], 4, parts=8).collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and not (r[2] is not None and math.isnan(r[2]))), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        expected |= {(key, n): r[1] for n, r in enumerate(own[:4], 1)}
    assert found == expected
    assert groups.top_rows(df.where("false"), ["k"], [F.asc("i")], 4).collect() == []


def test_multisets(spark):
    kind = "k string, s struct<a: int, b: array<string>>"
    left = [("x", (1, ["p"]))] * 5 + [(None, (None, None))] * 3 + [("x", None)] + [("y", (2, [None]))] * 2
    right = [("x", (1, ["p"]))] * 2 + [(None, (None, None))] * 7 + [("y", (2, [None]))] * 2 + [("z", None)]
    a, b = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    name = lambda rows: Counter(str((r[0], r[1] and tuple(r[1]))) for r in rows)
    assert name(groups.multiset(a, b, "common").collect()) == name(left) & name(right)
    assert name(groups.multiset(a, b, "more").collect()) == name(left) - name(right)
    assert groups.multiset(a.where("false"), b, "more").collect() == []
    with pytest.raises(ValueError):
        groups.multiset(a, b.select("k"), "more")


def test_crossed(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y"), ("b", "z")], "k string, t string")
    assert sorted(map(tuple, groups.crossed(df, "k", "t", ("x", "y"), F.count(F.lit(1))).collect()), key=str) == [("a", 2, 0), ("b", 0, 0), (None, 0, 1)]
