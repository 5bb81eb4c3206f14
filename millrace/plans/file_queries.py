"""Queries over files: one for each nation, of all modalities and of none, in a folder that the query writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import catalog, storage
from ..sources.registry import LoaderConfig, MultiSource
from ..workspace import hadoop_path, new_path
from .registry import query

# By key: name, modality and content, as SQL has them.
FILES = """
WITH f AS (SELECT n_nationkey AS k, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS stem, n_name FROM nation),
files AS (SELECT k, stem || CASE k % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.PNG' WHEN 2 THEN '.wav' WHEN 3 THEN '.mp4' WHEN 4 THEN '.other' ELSE '.Md' END AS name,
  CASE k % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'video' WHEN 5 THEN 'text' END AS modality, CAST(length(n_name) + 2 AS BIGINT) AS size, n_name FROM f)"""
SUFFIXES = (".txt", ".PNG", ".wav", ".mp4", ".other", ".Md")


def write_file(spark, path: str, content: bytes) -> None:
    fs, where = hadoop_path(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def folder(spark, sf_dir: str) -> str:
    """25 files, those of odd keys in a folder of their own. Texts end with a carriage return and a byte that is not UTF-8."""
    base = new_path(spark, "files")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        name = f"n{r.n_nationkey:02d}{SUFFIXES[r.n_nationkey % 6]}"
        write_file(spark, f"{base}/{'odd/' if r.n_nationkey % 2 else ''}{name}", r.n_name.encode() + b"\r\xe9")
    return base


def name(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)$", 1)


@query(FILES + " SELECT name, modality, size FROM files WHERE modality IS NOT NULL")
def file_scan(spark, sf_dir):
    return catalog.scan(spark, folder(spark, sf_dir)).select(name().alias("name"), "modality", F.col("length").alias("size"))


@query(FILES + " SELECT name, modality, size FROM files WHERE modality IN ('audio', 'text') AND k % 2 = 0")
def file_scan_flat(spark, sf_dir):
    """One level, two modalities."""
    found = catalog.scan(spark, folder(spark, sf_dir), ("audio", "text"), recursive=False)
    return found.select(name().alias("name"), "modality", F.col("length").alias("size"))


LOADED = " SELECT name, modality, CASE WHEN modality = 'text' THEN n_name || chr(10) || chr(233) END AS text, CASE WHEN modality <> 'text' THEN size END AS n_bytes, name AS filename, '.' || split_part(name, '.', 2) AS extension, CAST(size AS VARCHAR) AS size FROM files WHERE modality IN ('text', 'image')"


def _loaded(samples):
    fact = lambda k: F.element_at("metadata", k)
    return samples.select(name("id").alias("name"), "modality", "text", F.octet_length("content").cast("long").alias("n_bytes"), fact("filename").alias("filename"), fact("extension").alias("extension"), fact("size").alias("size"))


@query(FILES + LOADED)
def file_load(spark, sf_dir):
    return _loaded(catalog.load(spark, folder(spark, sf_dir)))


@query(FILES + LOADED + " ORDER BY CASE WHEN k % 2 = 1 THEN 'odd/' || name ELSE name END LIMIT 7")
def file_load_first(spark, sf_dir):
    return _loaded(catalog.load(spark, folder(spark, sf_dir), max_samples=7))


@query(FILES + " SELECT name, n_name || chr(10) || chr(233) AS text FROM files WHERE k = 6")
def file_load_single(spark, sf_dir):
    return catalog.load(spark, f"{folder(spark, sf_dir)}/n06.txt").select(name("id").alias("name"), "text")


@query(FILES + " SELECT name, modality, modality = 'text' AS failed, CASE WHEN modality <> 'text' THEN size END AS n_bytes FROM files WHERE modality IS NOT NULL")
def object_load(spark, sf_dir):
    """By the rules of object stores: other bytes than UTF-8 are an error."""
    found = catalog.load(spark, folder(spark, sf_dir), tuple(catalog.EXTENSIONS), extensions=catalog.OBJECT_STORE_EXTENSIONS, object_store=True)
    return found.select(name("id").alias("name"), "modality", F.col("error").isNotNull().alias("failed"), F.octet_length("content").cast("long").alias("n_bytes"))


METADATA = " AS total_size_bytes, round(sum(size) / 1048576, 2) AS total_size_mb, string_agg(DISTINCT m, ',' ORDER BY m) AS modality_counts{more} FROM (SELECT *, modality || ':' || count(*) OVER (PARTITION BY modality) AS m FROM files WHERE modality IS NOT NULL)"


def _counted(row):
    pairs = F.transform(F.array_sort(F.map_entries("modality_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return row.withColumn("modality_counts", F.array_join(pairs, ","))


@query(FILES + " SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT)" + METADATA.format(more=""))
def file_metadata(spark, sf_dir):
    return _counted(catalog.metadata(spark, folder(spark, sf_dir)))


@query(FILES + " SELECT count(*) AS total_objects, CAST(sum(size) AS BIGINT)" + METADATA.format(more=", 'bucket' AS bucket, 'some/prefix' AS prefix, 'us-east-1' AS region"))
def object_metadata(spark, sf_dir):
    return _counted(catalog.object_metadata(spark, "s3://bucket/some/prefix", path=folder(spark, sf_dir)))


@query(FILES + " SELECT CASE WHEN k % 2 = 1 THEN 'odd/' ELSE '' END || name AS name, modality, size FROM files WHERE modality IS NOT NULL")
def file_tree(spark, sf_dir):
    def walk(tree, above=""):
        for key, value in tree.items():
            if value.get("type") == "file":
                yield above + key, value["modality"], value["size"]
            else:
                yield from walk(value, f"{above}{key}/")

    return spark.createDataFrame(list(walk(catalog.file_tree(spark, folder(spark, sf_dir)))), "name string, modality string, size long")


@query(FILES + " SELECT name, size FROM files WHERE name LIKE '%.wav' OR name LIKE '%.txt'")
def object_listing(spark, sf_dir):
    base = folder(spark, sf_dir)
    rows = [(i.path.rsplit("/", 1)[1], i.size) for suffix in (".wav", ".txt") for i in storage.listing(spark, base, suffix)]
    return spark.createDataFrame(rows, "name string, size long")


@query(FILES + ", m AS (SELECT * FROM files WHERE k % 2 = 0) SELECT 'copy-' || name AS name, size FROM m WHERE k % 4 = 0 UNION ALL SELECT name, size FROM m WHERE k % 4 = 2 UNION ALL SELECT 'again-' || name, size FROM m WHERE k % 4 = 2")
def object_management(spark, sf_dir):
    """Objects of even keys: every other one is copied and deleted, the rest is downloaded and uploaded under another name."""
    import tempfile

    base = folder(spark, sf_dir)
    storage.delete(spark, f"{base}/odd")
    with tempfile.TemporaryDirectory() as own:  # the driver's, for the download only
        for i in list(storage.listing(spark, base)):
            where, called = i.path.rsplit("/", 1)
            if int(called[1:3]) % 4 == 0:
                storage.copy(spark, i.path, f"{where}/copy-{called}")
                storage.delete(spark, i.path)
            else:
                storage.download(spark, i.path, f"{own}/{called}")
                storage.upload(spark, f"{own}/{called}", f"{where}/again-{called}")
    return spark.createDataFrame([(i.path.rsplit("/", 1)[1], i.size) for i in storage.listing(spark, base)], "name string, size long")


@query(FILES + " SELECT name, true AS found, size, false AS is_folder FROM files WHERE k = 0 UNION ALL VALUES ('odd', true, 0, true), ('absent', false, NULL, NULL)")
def object_probe(spark, sf_dir):
    base = folder(spark, sf_dir)
    rows = []
    for called in ("n00.txt", "odd", "absent"):
        info = storage.info(spark, f"{base}/{called}")
        rows.append((called, storage.exists(spark, f"{base}/{called}"), info and (0 if info.is_folder else info.size), info and info.is_folder))
    return spark.createDataFrame(rows, "name string, found boolean, size long, is_folder boolean")


def _sources(spark, sf_dir):
    base = folder(spark, sf_dir)
    return MultiSource(spark, LoaderConfig(modalities=("text", "image"))).add_local("all", base).add_local("sound", f"{base}/odd", ("video",)).add_local("gone", f"{base}/absent").add_s3("cloud", "s3://bucket/x")


@query("SELECT * FROM (VALUES ('all', true), ('sound', true), ('gone', false), ('cloud', false)) AS v(source, reached)")
def source_validation(spark, sf_dir):
    return spark.createDataFrame(list(_sources(spark, sf_dir).validate_all().items()), "source string, reached boolean")


@query(FILES + " SELECT 'all' AS source_name, name, modality FROM files WHERE modality IN ('text', 'image') UNION ALL SELECT 'sound', name, modality FROM files WHERE modality = 'video' AND k % 2 = 1")
def source_registry(spark, sf_dir):
    """Sources that fail contribute nothing."""
    return _sources(spark, sf_dir).load_combined().select("source_name", name("id").alias("name"), "modality")


@query(FILES + ", s AS (SELECT 0 AS o, CASE WHEN k % 2 = 1 THEN 'odd/' || name ELSE name END AS path, name, modality FROM files WHERE modality IN ('text', 'image') UNION ALL SELECT 1, 'odd/' || name, name, modality FROM files WHERE modality = 'video' AND k % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY o, path) AS n FROM s) SELECT name, modality FROM r WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM s GROUP BY modality))")
def source_registry_balanced(spark, sf_dir):
    return _sources(spark, sf_dir).load_combined(balance_by_modality=True).select(name("id").alias("name"), "modality")


@query(FILES + " SELECT name, n_name || chr(10) AS text FROM files WHERE k % 2 = 0")
def read_texts(spark, sf_dir):
    base = new_path(spark, "texts")
    for r in table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").collect():
        write_file(spark, f"{base}/n{r.n_nationkey:02d}{SUFFIXES[r.n_nationkey % 6]}", f"{r.n_name}\n".encode())
    return storage.read_text(spark, base).select(name("_metadata.file_path").alias("name"), F.col("value").alias("text"))
