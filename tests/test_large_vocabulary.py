"""Vocabularies that are joined: by blocks of rows, whose distinct tokens are shuffled, not all of them."""

import random

from millrace import workspace
from millrace.operators import text
from millrace.plans.queries import ORACLES, QUERIES

from .oracle import check, connect

SF = "/root/testdata/sf0.001"


def test_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([None, i, 7]), [rng.choice([f"t{n}" for n in range(40)] + [None, "<UNK>", "ünï"]) for _ in range(rng.randrange(9))] if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, tokens array<string>").repartition(3)
    vocabulary = workspace.written(text.build_vocabulary(df.where("ord % 3 = 0")), "v")  # other tokens are unknown
    ids = {r.token: r.id for r in vocabulary.collect()}
    expected = sorted(str((k, [ids.get(t, 1) for t in ts or []])) for k, ts in rows)
    back = sorted(str((k, [t if t in ids and t != "<UNK>" else "<UNK>" for t in ts or []])) for k, ts in rows)
    monkeypatch.setattr(text, "LOOKUP_BYTES", 0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for taken, batch in ((1, 3), (20, 5), (1 << 20, 7), (50, 10_000)):
        monkeypatch.setattr(text, "TAKEN", taken)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        found = text.encode(df, vocabulary, "ord")
        assert sorted(str((r.ord, r.ids)) for r in found.collect()) == expected
        assert sorted(str((r.ord, r.tokens)) for r in text.decode(found, vocabulary, "ord").collect()) == back
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_distinct_tokens_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(text, "LOOKUP_BYTES", 0)
    df = spark.range(1000, numPartitions=2).selectExpr("id AS ord", "transform(sequence(1, 300), x -> concat('token', x % 50)) AS tokens")
    vocabulary = text.build_vocabulary(df)
    made = []
    monkeypatch.setattr(text, "written", lambda df, *a: made.append(workspace.written(df, *a)) or made[-1])
    assert text.encode(df, vocabulary, "ord").where("size(ids) = 300").count() == 1000
    assert len(made) == 1 and made[0].count() == 1000 + 2 * 50


def test_what_is_used_up_goes(spark, monkeypatch):
    monkeypatch.setattr(text, "LOOKUP_BYTES", 0)
    fs, where = workspace.hadoop_path(spark, f"{workspace.shared_dir(spark)}/millrace")
    there = lambda: {f.getPath().getName() for f in fs.listStatus(where)}
    before = there()
    check(spark, connect(SF), QUERIES["text_decode"], ORACLES["text_decode"], SF)
    assert sorted(n.split("-")[0] for n in there() - before) == ["blocks", "ids", "ranges", "vocabulary"]
