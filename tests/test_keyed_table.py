"""The stored table under batches of changes: versions, deletes, nulls, a hot key, what is read and what a failed batch leaves."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from millrace.sources.keyed_table import KeyedTable
from millrace.workspace import new_path, write_text

SCHEMA = S.StructType().add("k", "string").add("n", "long").add("value", "string").add("v", "long")


@pytest.fixture
def store(spark):
    return KeyedTable(spark, new_path(spark, "store"), SCHEMA, ["k", "n"], "v", buckets=8)


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def read(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_ties_and_nulls(spark, store):
    assert read(store.read()) == []
    store.upsert(rows(spark, ("a", 1, "x", 1), ("a", 1, "y", 2), (None, None, "null key", None), ("b", 1, "b", 5), ("b", 1, "c", 5)))
    assert read(store.read()) == sorted([("a", 1, "y", 2), (None, None, "null key", None), ("b", 1, "c", 5)], key=str)
    store.upsert(rows(spark, ("a", 1, "old", 1), ("b", 1, "a", 5), (None, None, "newer", 1)))
    # An older version loses, a batch's row wins over a stored one of its version.
    assert read(store.read()) == sorted([("a", 1, "y", 2), (None, None, "newer", 1), ("b", 1, "a", 5)], key=str)
    store.delete(rows(spark, ("a", 1, None, 2), ("b", 1, None, 4), ("z", 9, None, 9)))
    assert read(store.read()) == sorted([(None, None, "newer", 1), ("b", 1, "a", 5)], key=str)
    store.upsert(rows(spark, ("a", 1, "back too late", 1), ("z", 9, "back", 10)))
    assert read(store.read()) == sorted([(None, None, "newer", 1), ("b", 1, "a", 5), ("z", 9, "back", 10)], key=str)
    assert read(store.read(1)) == sorted([("a", 1, "y", 2), (None, None, "null key", None), ("b", 1, "c", 5)], key=str)


def test_random_batches_against_a_dictionary(spark, store):
    rng = random.Random(7)
    known = {}
    for _ in range(4):
        batch = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(12), f"t{rng.randrange(99)}", rng.randrange(6)) for _ in range(60)]
        gone = [(rng.choice(["hot", "a"]), rng.randrange(12), None, rng.randrange(6)) for _ in range(6)]
        for change, deleted in ((batch, False), (gone, True)):
            fresh = {}
            for k, n, value, v in change:
                fresh[k, n] = max(fresh.get((k, n), (-1, False, "")), (v, deleted, value or ""))
            for key, entry in fresh.items():
                if key not in known or entry[0] >= known[key][0]:
                    known[key] = entry
            store.delete(rows(spark, *change)) if deleted else store.upsert(rows(spark, *change))
    assert read(store.read()) == sorted([(*key, value, v) for key, (v, deleted, value) in known.items() if not deleted], key=str)


def test_only_touched_buckets_are_read_and_written(spark, store):
    store.upsert(spark.range(400).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("n"), F.lit("text").alias("value"), F.lit(1).cast("long").alias("v")))
    first = store.state()
    assert set(first.values()) == {1} and len(first) == 8
    store.upsert(rows(spark, ("k7", 7, "new", 2)))
    changed = {b for b, c in store.state().items() if c == 2}
    assert len(changed) == 1
    one = store.rows_of(rows(spark, ("k7", 7, None, None)))
    assert read(one) == [("k7", 7, "new", 2)]
    (bucket,) = changed
    assert one.inputFiles() and all(f"/data/2/__bucket={bucket}/" in f for f in one.inputFiles() if "/data/" in f)
    untouched = [f for f in store.read().inputFiles() if "/data/1/" in f]
    assert untouched and not any(f"__bucket={bucket}/" in f for f in untouched)


def test_a_batch_without_rows_and_a_batch_that_fails(spark, store):
    store.upsert(rows(spark, ("a", 1, "x", 1)))
    assert store.upsert(rows(spark, ("a", 1, "x", 1)).where("false")) == 2
    assert read(store.read()) == [("a", 1, "x", 1)]
    # Another writer has made the next commit in the meantime.
    number = store.commits()[-1] + 1
    store.commits = lambda: [number - 1]
    write_text(spark, f"{store.path}/commits/{number}", '{"0": 1}')
    with pytest.raises(RuntimeError):
        store.upsert(rows(spark, ("b", 1, "y", 1)))


def test_forget_and_vacuum(spark, store):
    store.upsert(rows(spark, *[("a", n, "x", 1) for n in range(20)]))
    store.delete(rows(spark, *[("a", n, None, 2) for n in range(10)]))
    store.forget(F.col("v") < 3)
    assert [r[1] for r in read(store.read())] == sorted(range(10, 20), key=str)
    store.upsert(rows(spark, ("a", 0, "again", 1)))
    store.vacuum()
    assert sorted(r[1] for r in read(store.read())) == [0, *range(10, 20)] and len(store.commits()) == 1
    store.delete(store.read().withColumn("v", F.lit(9)))
    store.forget(F.lit(True))
    assert read(store.read()) == [] and store.state() == {}
