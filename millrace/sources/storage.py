"""Objects in any store that Spark reaches, through Hadoop's file systems (local files, HDFS, s3a where its jar is there)."""

from __future__ import annotations

import csv
import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is a file or folder; stores that can't be reached have none."""
    try:
        fs, where = _at(spark, path)
        return bool(fs.exists(where))
    except Exception:  # no such store, no such host, no access
        return False


@dataclass(frozen=True)
class ObjectInfo:
    path: str
    size: int
    modified: str
    is_folder: bool


def _info(status) -> ObjectInfo:
    modified = datetime.datetime.fromtimestamp(status.getModificationTime() / 1000, datetime.UTC).isoformat()
    return ObjectInfo(status.getPath().toString(), status.getLen(), modified, status.isDirectory())


def info(spark: SparkSession, path: str) -> ObjectInfo | None:
    """Size and time of an object; None if there is none."""
    fs, where = _at(spark, path)
    return _info(fs.getFileStatus(where)) if fs.exists(where) else None


def listing(spark: SparkSession, path: str, suffix: str = "") -> Iterator[ObjectInfo]:
    """Files under a path whose names end in suffix; one at a time, so that large listings don't gather."""
    fs, where = _at(spark, path)
    found = fs.listFiles(where, True)
    while found.hasNext():
        status = found.next()
        if status.getPath().getName().endswith(suffix):
            yield _info(status)


def delete(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.delete(where, True))


def copy(spark: SparkSession, source: str, target: str) -> bool:
    """Copies an object, also between stores."""
    fs_a, a = _at(spark, source)
    fs_b, b = _at(spark, target)
    jvm = spark.sparkContext._jvm
    return bool(jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, spark.sparkContext._jsc.hadoopConfiguration()))


def download(spark: SparkSession, source: str, local: str) -> None:
    fs, where = _at(spark, source)
    fs.copyToLocalFile(False, where, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), True)


def upload(spark: SparkSession, local: str, target: str) -> None:
    fs, where = _at(spark, target)
    fs.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), where)


def bucket_and_prefix(path: Column) -> Column:
    """Struct of bucket and prefix of an s3:// path: every "s3://" goes, then it splits at the first "/"."""
    bare = F.replace(path, F.lit("s3://"), F.lit(""))
    parts = F.split(bare, "/", 2)
    return F.struct(parts[0].alias("bucket"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("prefix"))


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV with a header; give a schema where its types are known, inferring takes a pass over the data."""
    return spark.read.options(**{"header": True, "inferSchema": "schema" not in options} | {k: v for k, v in options.items() if k != "schema"}).csv(path, schema=options.get("schema"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema=None, lines: bool = False) -> DataFrame:
    """JSON documents, one to a file or an array of records; with lines, one to a line, as write_json() leaves them."""
    return spark.read.json(path, schema=schema, multiLine=not lines)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one text each."""
    return spark.read.text(path, wholetext=True)


def missing_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row (path, error) for each path that is no file and no folder."""
    return spark.createDataFrame([(p, "not there") for p in paths if not exists(spark, p)], "path string, error string")


def read_csvs(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Several CSVs by column name: missing columns are null, paths that aren't there are left out (missing_files() names them). No file: an empty frame without columns.

    One pass reads the headers, and files of equal headers are one layout; one
    scan then reads all files, whatever their layouts, and picks a column's
    values by layout. Types come from a schema, if one is given, or else from one
    more pass over all values. Headers are one line each, of a name once.
    """
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.range(0).drop("id")
    given = {k: v for k, v in options.items() if k not in ("schema", "inferSchema", "header")}
    lines = spark.read.text(there).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value")
    heads = lines.where("start = 0").groupBy("path").agg(F.min(F.struct("n", "value"))["value"].alias("head"))
    heads = heads.withColumn("head", F.regexp_replace("head", "^\ufeff", ""))
    layouts = [r.head for r in heads.select("head").distinct().orderBy("head").collect()]  # one for each layout, not each file
    names = {head: _header(head, given) for head in layouts}
    wide = max((len(n) for n in names.values()), default=0)
    if not wide:
        return spark.range(0).drop("id")
    plain = ", ".join(f"_c{i} string" for i in range(wide))
    rows = spark.read.options(**given, header=True, enforceSchema=True).csv(there, schema=plain).select("*", F.col("_metadata.file_path").alias("__path"))
    numbered = F.array_position(F.array(*[F.lit(h) for h in layouts]), F.col("head")).cast("int")
    rows = rows.join(heads.select(F.col("path").alias("__path"), numbered.alias("__layout")), "__path")
    columns = list(dict.fromkeys(c for n in names.values() for c in n))

    def picked(name: str) -> Column:
        found = F.lit(None).cast("string")
        for i, head in enumerate(layouts, 1):
            if name in names[head]:
                found = F.when(F.col("__layout") == i, F.col(f"_c{names[head].index(name)}")).otherwise(found)
        return found.alias(name)

    rows = rows.select(*[picked(c) for c in columns])
    types = options["schema"] if "schema" in options else _types(rows)
    fields = types if isinstance(types, dict) else {f.name: f.dataType.simpleString() for f in (spark.createDataFrame([], types).schema if isinstance(types, str) else types)}
    return rows.select(*[(F.col(f"`{c}`") if c in columns else F.lit(None)).try_cast(kind).alias(c) for c, kind in fields.items()])


def _header(head: str, options: dict) -> list[str]:
    """Names in a header line."""
    return next(csv.reader([head], delimiter=options.get("sep", options.get("delimiter", ",")), quotechar=options.get("quote", '"')), [])


#: Types that a column of texts can have, narrowest first.
KINDS = (("int", r"^[+-]?\d{1,10}$"), ("bigint", r"^[+-]?\d{1,19}$"), ("double", r"^[^ ].*$"), ("date", r"^\d{4}-\d{2}-\d{2}$"), ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T].+$"), ("boolean", r"(?i)^(true|false)$"))


def _types(rows: DataFrame) -> dict[str, str]:
    """The narrowest type that all values of each column have; one aggregation."""

    def fits(value: Column, kind: str, pattern: str) -> Column:
        return F.coalesce(F.bool_and(F.when(value.isNotNull(), value.rlike(pattern) & value.try_cast(kind).isNotNull())), F.lit(False))

    found = rows.agg(*[fits(F.col(f"`{c}`"), kind, pattern).alias(f"{i}_{kind}") for i, c in enumerate(rows.columns) for kind, pattern in KINDS]).first()
    return {c: next((kind for kind, _ in KINDS if found[f"{i}_{kind}"]), "string") for i, c in enumerate(rows.columns)}


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; a single file means a single writing task."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
