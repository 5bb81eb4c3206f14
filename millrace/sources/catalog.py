"""Files as samples: id, modality, payload, metadata and source."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import storage

# Extensions by modality; object stores know fewer.
EXTENSIONS = {
    "text": (".txt", ".json", ".csv", ".md", ".xml", ".html"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff"),
    "audio": (".mp3", ".wav", ".flac", ".ogg", ".m4a", ".aac"),
    "video": (".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv"),
}
NOT_IN_OBJECT_STORES = (".xml", ".html", ".tiff", ".aac", ".flv")
OBJECT_STORE_EXTENSIONS = {m: tuple(e for e in own if e not in NOT_IN_OBJECT_STORES) for m, own in EXTENSIONS.items()}
DEFAULT_MODALITIES = ("text", "image")


def extension(path: Column) -> Column:
    """The last suffix, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def modality(path: Column, extensions: dict[str, Sequence[str]] = EXTENSIONS) -> Column:
    """The modality of a path's extension; null if it is unknown."""
    found, suffix = F.lit(None).cast("string"), extension(path)
    for name, own in extensions.items():
        found = F.when(suffix.isin(list(own)), name).otherwise(found)
    return found


def _glob(modalities: Sequence[str], extensions: dict[str, Sequence[str]]) -> str:
    """A file pattern, so that other files are never listed to tasks; any case."""
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*{" + ",".join(either(e) for m in modalities for e in extensions[m]) + "}"


def scan(spark: SparkSession, path: str, modalities: Sequence[str] | None = None, extensions: dict[str, Sequence[str]] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """Files of known modalities (path, modificationTime, length, modality). Contents are read only if the column `content` is selected. A single file is taken whatever its extension."""
    wanted = list(modalities or extensions)
    found = storage.info(spark, path)
    reader = spark.read.format("binaryFile")
    if found is None or found.is_folder:
        reader = reader.option("pathGlobFilter", _glob(wanted, extensions)).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).withColumn("modality", modality(F.col("path"), extensions))


def decode_text(content: Column, fallback: bool = True) -> Column:
    """UTF-8, or else Latin-1; line ends become \\n. Without fallback (object stores) other bytes are null and line ends stay."""
    good = F.is_valid_utf8(content.cast("string"))
    if not fallback:
        return F.when(good, content.cast("string"))
    return F.regexp_replace(F.when(good, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1")), "\r\n?", "\n")


def load(spark: SparkSession, path: str, modalities: Sequence[str] = DEFAULT_MODALITIES, max_samples: int | None = None, extensions: dict[str, Sequence[str]] = EXTENSIONS, object_store: bool = False) -> DataFrame:
    """Samples: id, modality, text, content, metadata, source, error.

    max_samples takes the first paths, and only their contents are read. Texts
    that don't decode have an error instead of a text; other files keep their
    bytes.
    """
    files = scan(spark, path, modalities, extensions)
    if max_samples:
        chosen = files.where(F.col("modality").isin(list(modalities))).select("path").orderBy("path").limit(max_samples)
        paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in chosen.collect()]  # max_samples names
        if paths:
            files = spark.read.format("binaryFile").load(paths).withColumn("modality", modality(F.col("path"), extensions))
    files = files.where(F.col("modality").isin(list(modalities)))
    text = F.when(F.col("modality") == "text", decode_text(F.col("content"), not object_store))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    facts = F.create_map(F.lit("filename"), name, F.lit("extension"), F.regexp_extract(name, r"(\.[^.]+)$", 1), F.lit("size"), F.col("length").cast("string"), F.lit("modified"), F.col("modificationTime").cast("string"), F.lit("absolute_path"), F.col("path"))
    samples = files.withColumn("text", text)
    return samples.select(
        F.col("path").alias("id"),
        "modality",
        "text",
        F.when(F.col("modality") != "text", F.col("content")).alias("content"),
        facts.alias("metadata"),
        F.col("path").alias("source"),
        F.when((F.col("modality") == "text") & F.col("text").isNull(), "not UTF-8").alias("error"),
    )


def metadata(spark: SparkSession, path: str, modalities: Sequence[str] | None = None, extensions: dict[str, Sequence[str]] = EXTENSIONS) -> DataFrame:
    """One row: files, their bytes and megabytes, and a map of files by modality; no contents are read."""
    files = scan(spark, path, modalities, extensions).where("modality IS NOT NULL")
    by = files.groupBy("modality").agg(F.count("*").alias("n"), F.sum("length").alias("size"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes"),
        F.round(F.coalesce(F.sum("size"), F.lit(0)) / F.lit(1 << 20), 2).alias("total_size_mb"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "n")))).alias("modality_counts"),
    )


def object_metadata(spark: SparkSession, source: str, modalities: Sequence[str] | None = None, region: str = "us-east-1", path: str | None = None) -> DataFrame:
    """metadata() of a prefix of a bucket (s3://bucket/prefix), with its bucket, prefix and region. path: where Spark reads it, if not by s3a."""
    facts = metadata(spark, path or source.replace("s3://", "s3a://", 1), modalities, OBJECT_STORE_EXTENSIONS)
    where = storage.bucket_and_prefix(F.lit(source))
    return facts.withColumnRenamed("total_files", "total_objects").withColumns({"bucket": where["bucket"], "prefix": where["prefix"], "region": F.lit(region)})


def file_tree(spark: SparkSession, path: str, max_depth: int = 3) -> dict:
    """Nested dict of folders and files of known modality ({type, modality, size}) down to a depth; empty folders stay."""
    known = {e: m for m, own in EXTENSIONS.items() for e in own}
    jvm = spark.sparkContext._jvm

    def walk(where, depth: int) -> dict:
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        tree: dict = {}
        for status in sorted(fs.listStatus(where), key=lambda s: s.getPath().getName()):
            name = status.getPath().getName()
            if status.isDirectory():
                if depth < max_depth:
                    tree[name] = walk(status.getPath(), depth + 1)
            elif kind := known.get(posixpath.splitext(name)[1].lower()):
                tree[name] = {"type": "file", "modality": kind, "size": status.getLen()}
        return tree

    return walk(jvm.org.apache.hadoop.fs.Path(path), 0)


#: The columns of load().
SAMPLE = S.StructType([S.StructField(n, t) for n, t in (("id", S.StringType()), ("modality", S.StringType()), ("text", S.StringType()), ("content", S.BinaryType()), ("metadata", S.MapType(S.StringType(), S.StringType())), ("source", S.StringType()), ("error", S.StringType()))])
