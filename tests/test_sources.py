import pytest
from pyspark.sql import functions as F

from millrace.operators import sampling
from millrace.sources import catalog, storage
from millrace.sources.registry import LoaderConfig, MultiSource


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub" / "empty").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "b.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "sub" / "c.png").write_bytes(b"pixels")
    (tmp_path / "sub" / "d.wav").write_bytes(b"RIFF")
    (tmp_path / "e.unknown").write_bytes(b"?")
    (tmp_path / "noext").write_bytes(b"?")
    return str(tmp_path)


def test_scan_and_load(spark, folder):
    assert {(r.path.rsplit("/", 1)[1], r.modality) for r in catalog.scan(spark, folder).select("path", "modality").collect()} == {("a.txt", "text"), ("b.TXT", "text"), ("c.png", "image"), ("d.wav", "audio")}
    rows = {r.metadata["filename"]: r for r in catalog.load(spark, folder).collect()}
    assert rows.keys() == {"a.txt", "b.TXT", "c.png"}
    assert rows["a.txt"].text == "one\ntwo\nthree" and rows["b.TXT"].text == "café"
    assert bytes(rows["c.png"].content) == b"pixels" and rows["b.TXT"].metadata["extension"] == ".TXT"
    assert [r.metadata["filename"] for r in catalog.load(spark, folder, max_samples=1).collect()] == ["a.txt"]


def test_object_store_rules(spark, folder):
    rows = {r.metadata["filename"]: r for r in catalog.load(spark, folder, ("text",), extensions=catalog.OBJECT_STORE_EXTENSIONS, object_store=True).collect()}
    assert rows["a.txt"].text == "one\r\ntwo\rthree"
    assert rows["b.TXT"].text is None and rows["b.TXT"].error


def test_metadata_and_tree(spark, folder):
    row = catalog.metadata(spark, folder).first()
    assert (row.total_files, row.total_size_bytes, row.modality_counts) == (4, 28, {"audio": 1, "image": 1, "text": 2})
    tree = catalog.file_tree(spark, folder)
    assert tree["sub"]["empty"] == {} and tree["sub"]["c.png"]["modality"] == "image" and "e.unknown" not in tree
    assert catalog.file_tree(spark, folder, max_depth=0).keys() == {"a.txt", "b.TXT"}


def test_registry(spark, folder):
    sources = MultiSource(spark, LoaderConfig(modalities=("text", "image"))).add_local("here", folder).add_local("gone", folder + "/absent").add_s3("cloud", "s3://bucket/x")
    assert sources.validate_all() == {"here": True, "gone": False, "cloud": False}
    assert sources.load_combined().count() == 3
    assert sources.errors.keys() == {"gone", "cloud"}
    assert sources.load_combined(balance_by_modality=True).groupBy("modality").count().collect()[0]["count"] == 1
    total = sources.statistics().where("source_name IS NULL AND modality IS NULL").first()
    assert total.n == 3
    with pytest.raises(ValueError):
        LoaderConfig(batch_size=0)


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    base = str(tmp_path)
    storage.write_csv(df, f"{base}/c", single_file=True)
    assert sorted((r.k, r.v) for r in storage.read_csv(spark, f"{base}/c").collect()) == [(1, "a"), (2, None)]
    (tmp_path / "one.txt").write_text("x\ny")
    assert storage.read_text(spark, f"{base}/one.txt").first().value == "x\ny"
    assert storage.exists(spark, f"{base}/one.txt") and not storage.exists(spark, f"{base}/two.txt")
    assert storage.copy(spark, f"{base}/one.txt", f"{base}/two.txt") and storage.info(spark, f"{base}/two.txt").size == 3
    assert [o.path.rsplit("/", 1)[1] for o in storage.listing(spark, base, "two.txt")] == ["two.txt"]
    storage.download(spark, f"{base}/one.txt", f"{base}/three.txt")
    storage.upload(spark, f"{base}/three.txt", f"{base}/four.txt")
    assert storage.delete(spark, f"{base}/two.txt") and storage.info(spark, f"{base}/two.txt") is None
    assert storage.read_csvs(spark, [f"{base}/absent"]).columns == []
    (tmp_path / "j.json").write_text('{"a": 1,\n "b": "x"}')
    assert storage.read_json(spark, f"{base}/j.json").first().asDict() == {"a": 1, "b": "x"}


def test_paths(spark):
    df = spark.createDataFrame([("s3://b/p/q.txt",), ("s3://b",), ("s3://s3://b/x",), ("dir.d/noext",), (".txt",)], "p string")
    found = df.select(storage.bucket_and_prefix(F.col("p")).alias("x"), catalog.modality(F.col("p")).alias("m")).collect()
    assert [tuple(r.x) for r in found[:3]] == [("b", "p/q.txt"), ("b", ""), ("b", "x")]
    assert [r.m for r in found] == ["text", None, None, None, None]


def test_sampling(spark):
    df = spark.createDataFrame([(i, "text" if i % 3 else "image") for i in range(10)], "n int, modality string")
    assert [len(b) for b in sampling.iterate_batches(df, 4, ["n"])] == [4, 4, 2]
    assert [r.batch_id for r in sampling.with_batches(df, 4, ["n"]).orderBy("n").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    assert sorted(r.n for r in sampling.balance(df, ["n"]).collect()) == [0, 1, 2, 3, 4, 5, 6, 9]
    assert sampling.first_rows(df, 0, ["n"]).count() == 10
    assert sampling.keep_modalities(df, []).count() == 10
    assert sampling.remove_duplicates(df, ["modality"]).count() == 2
