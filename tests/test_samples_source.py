"""The registry as a data source: options that spare files, bundles, errors, and a writer that commits."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import samples_source as source


@pytest.fixture
def files(tmp_path):
    base = tmp_path / "in"
    (base / "sub").mkdir(parents=True)
    (base / "a.txt").write_bytes(b"one\r\ntwo")
    (base / "b.TXT").write_bytes(b"caf\xe9")
    (base / "c.png").write_bytes(b"\x89PNG")
    (base / "sub" / "d.wav").write_bytes(b"RIFF")
    (base / "e.other").write_bytes(b"?")
    (base / "empty.md").write_bytes(b"")
    return base


def rows(df):
    return sorted((r.source_name, r.id.rsplit("/", 1)[1], r.modality, r.text, r.content and bytes(r.content)) for r in df.collect())


def test_read(spark, files):
    df = source.read_samples(spark, [{"name": "x", "path": str(files)}, {"name": "y", "path": f"file://{files}/sub", "modalities": ["audio"]}, {"name": "gone", "path": f"{files}/absent"}], bundle_bytes="5")
    assert rows(df) == [("x", "a.txt", "text", "one\ntwo", None), ("x", "b.TXT", "text", "café", None), ("x", "c.png", "image", None, b"\x89PNG"), ("x", "empty.md", "text", "", None), ("y", "d.wav", "audio", None, b"RIFF")]
    assert df.rdd.getNumPartitions() == 4  # a.txt and b.TXT are too large for one bundle of 5 bytes, c.png and the empty file fit
    (fact,) = df.where("id LIKE '%a.txt'").select("metadata").collect()
    assert fact.metadata["filename"] == "a.txt" and fact.metadata["size"] == "8" and fact.metadata["extension"] == ".txt"


def test_options_spare_files(spark, files):
    given = [{"name": "x", "path": str(files)}, {"name": "y", "path": str(files), "modalities": ["audio"]}]
    assert [r[1] for r in rows(source.read_samples(spark, given, only_modalities='["image"]'))] == ["c.png"]
    assert [r[0] for r in rows(source.read_samples(spark, given, only_sources='["y", "z"]'))] == ["y"]
    reader = source.SampleReader({"sources": json.dumps(given), "only_modalities": '["text"]'})
    assert {f[2] for b in reader.partitions() for f in b.files} == {"text"}


def test_queries_over_one_frame_dont_disturb_each_other(spark, files):
    df = source.read_samples(spark, [{"name": "x", "path": str(files)}])
    assert [df.count(), df.where("modality = 'image'").count(), df.count(), df.where("modality = 'text'").count(), df.count()] == [4, 1, 4, 3, 4]


def test_object_stores_limits_and_errors(spark, files):
    found = source.read_samples(spark, [{"name": "x", "path": str(files), "object_store": True}], max_samples="2").collect()
    assert sorted((r.id[-5:], r.text, r.error) for r in found) == [("a.txt", "one\r\ntwo", None), ("b.TXT", None, "not UTF-8")]
    failed = source.read_samples(spark, [{"name": "gone", "path": f"{files}/absent"}], errors="rows").collect()
    assert [(r.source_name, r.modality) for r in failed] == [("gone", None)] and "absent" in failed[0].error
    assert source.read_samples(spark, [{"name": "gone", "path": f"{files}/absent"}]).collect() == []
    assert source.read_samples(spark, []).collect() == []


def test_writer_commits_or_leaves_nothing(spark, files, tmp_path):
    df = source.read_samples(spark, [{"name": "x", "path": str(files)}])
    out = str(tmp_path / "out")
    assert source.read_written(spark, out).collect() == []
    source.write_samples(df.repartition(3), out)
    assert rows(source.read_written(spark, out)) == rows(df)
    source.write_samples(df.where("modality = 'image'"), out)
    assert source.read_written(spark, out).count() == 5
    with pytest.raises(Exception, match="boom"):
        source.write_samples(df.withColumn("id", F.expr("CASE WHEN id LIKE '%b.TXT' THEN raise_error('boom') ELSE id END")), out)
    assert source.read_written(spark, out).count() == 5
    source.write_samples(df.where("modality = 'image'"), out, overwrite=True)
    assert source.read_written(spark, out).count() == 1
