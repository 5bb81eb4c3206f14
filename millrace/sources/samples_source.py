"""Several sources of files as one Spark data source, and a writer whose files count only once all of them are there.

`spark.read.format("millrace_samples")` lists the files of all sources, drops
those whose modality or source the options rule out, and deals the rest out in
bundles of about equal size, one partition each; only executors read contents.
Filters of a query aren't pushed to the reader: Spark 4.1 keeps a reader that has
taken filters for later queries over the same DataFrame that have none.
Files are reached through Arrow's file systems, which know local paths, s3://
(without any jar) and others; Spark's own readers (see `catalog`) remain the way
for stores that only Spark knows.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .catalog import EXTENSIONS, OBJECT_STORE_EXTENSIONS

NAME = "millrace_samples"
#: Bytes of files in a bundle, and rows of a batch on the way to Spark.
BUNDLE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
COLUMNS = "id string, modality string, text string, content binary, metadata map<string,string>, source string, error string, source_name string, source_ord int"
ARROW = pa.schema([("id", pa.string()), ("modality", pa.string()), ("text", pa.string()), ("content", pa.binary()), ("metadata", pa.map_(pa.string(), pa.string())), ("source", pa.string()), ("error", pa.string()), ("source_name", pa.string()), ("source_ord", pa.int32())])


def store_of(uri: str, credentials: dict[str, str] | None = None) -> tuple[pf.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    if uri.startswith("s3://") and credentials:
        return pf.S3FileSystem(**credentials), uri.removeprefix("s3://")
    if uri.startswith("file:") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return pf.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def text_of(data: bytes, fallback: bool) -> str | None:
    """UTF-8, or else Latin-1 with line ends as \\n; without fallback other bytes are no text and line ends stay."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        if not fallback:
            return None
        text = data.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n") if fallback else text


@dataclass
class Bundle(InputPartition):
    """Files of one partition: (source's place, path, modality, size, time); or, without files, a source's error."""

    files: list[tuple[int, str, str, int, str]]
    failed: tuple[int, str] | None = None


class SampleReader(DataSourceReader):
    """Options: sources, a JSON list of {name, path, modalities, object_store}; modalities for those that name none; only_modalities and only_sources, JSON lists of what is read at all; max_samples of each; bundle_bytes; errors ("rows" gives a source that fails a row with its error); credentials, a JSON object for s3."""

    def __init__(self, options: dict[str, str]):
        self.sources = json.loads(options["sources"])
        self.modalities = json.loads(options.get("modalities", "null")) or ["text", "image"]
        self.most = int(options.get("max_samples", 0)) or None
        self.size = int(options.get("bundle_bytes", BUNDLE_BYTES))
        self.error_rows = options.get("errors") == "rows"
        self.credentials = json.loads(options.get("credentials", "null"))
        self.only = {k: set(json.loads(options[f"only_{k}"])) for k in ("modalities", "sources") if f"only_{k}" in options}

    def _files(self, place: int, source: dict) -> list[tuple[int, str, str, int, str]]:
        fs, base = store_of(source["path"], self.credentials)
        known = OBJECT_STORE_EXTENSIONS if source.get("object_store") else EXTENSIONS
        kinds = {e: m for m in source.get("modalities") or self.modalities for e in known[m]}
        about = fs.get_file_info(base)
        if about.type is pf.FileType.NotFound:
            raise FileNotFoundError(f"{source['path']} isn't there")
        found = [about] if about.is_file else fs.get_file_info(pf.FileSelector(base, recursive=True))
        rows = [(place, i.path, kinds[e], i.size, _time(i)) for i in sorted(found, key=lambda i: i.path) if i.is_file and (e := posixpath.splitext(i.path)[1].lower()) in kinds]
        rows = rows[: self.most]
        return [r for r in rows if r[2] in self.only.get("modalities", {r[2]})]

    def partitions(self) -> Sequence[Bundle]:
        bundles, failed = [], []
        for place, source in enumerate(self.sources):
            if source["name"] not in self.only.get("sources", {source["name"]}):
                continue
            try:
                files = self._files(place, source)
            except Exception as error:  # one source doesn't end the others
                failed.append(Bundle([], (place, str(error) or type(error).__name__)))
                continue
            held, size = [], 0
            for row in files:
                if held and size + row[3] > self.size:
                    bundles.append(Bundle(held))
                    held, size = [], 0
                held.append(row)
                size += row[3]
            if held:
                bundles.append(Bundle(held))
        return [*bundles, *(failed if self.error_rows and "modalities" not in self.only else [])] or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        if partition.failed:
            place, error = partition.failed
            source = self.sources[place]
            yield pa.RecordBatch.from_pylist([{"source": source["path"], "error": error, "source_name": source["name"], "source_ord": place}], ARROW)
        rows, size = [], 0
        for place, path, modality, length, modified in partition.files:
            if rows and size + length > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, size = [], 0
            rows.append(self._sample(place, path, modality, length, modified))
            size += length
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _sample(self, place: int, path: str, modality: str, length: int, modified: str) -> dict:
        source, text, content, error = self.sources[place], None, None, None
        try:
            fs, _ = store_of(source["path"], self.credentials)
            with fs.open_input_stream(path) as held:
                content = held.read()
        except OSError as failure:  # a file that went away or can't be read
            error = str(failure)
        if modality == "text" and content is not None:
            text, content = text_of(content, not source.get("object_store")), None
            error = "not UTF-8" if text is None else None
        name = posixpath.basename(path)
        facts = {"filename": name, "extension": posixpath.splitext(name)[1], "size": str(length), "modified": modified, "absolute_path": path}
        return {"id": path, "modality": modality, "text": text, "content": content, "metadata": facts, "source": path, "error": error, "source_name": source["name"], "source_ord": place}


def _time(info: pf.FileInfo) -> str:
    return info.mtime.astimezone(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S") if info.mtime else ""


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class SampleWriter(DataSourceArrowWriter):
    """Writes Parquet files of their own names under `path`; a manifest, written last, says which of them are the table."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.credentials = json.loads(options.get("credentials", "null"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = store_of(self.path, self.credentials)
        fs.create_dir(f"{base}/data", recursive=True)
        task = TaskContext.get()
        target, rows, file = f"{base}/data/{task.partitionId():05d}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if file is None:
                file = pq.ParquetWriter(target, batch.schema, filesystem=fs)
            file.write_batch(batch)
            rows += batch.num_rows
        if file is None:
            return Written("", 0)
        file.close()
        return Written(target, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = store_of(self.path, self.credentials)
        done = [[m.path, m.rows] for m in messages if m is not None and m.rows]
        before = [] if self.overwrite else committed(self.path, self.credentials)
        draft = f"{base}/manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps([*before, *done]).encode())
        fs.move(draft, f"{base}/manifest.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = store_of(self.path, self.credentials)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


def committed(path: str, credentials: dict[str, str] | None = None) -> list[list]:
    """Files of a written table and their rows; none before its first commit."""
    fs, base = store_of(path.rstrip("/"), credentials)
    if fs.get_file_info(f"{base}/manifest.json").type is pf.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{base}/manifest.json") as held:
        return json.loads(held.read())


class SampleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> SampleReader:
        return SampleReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SampleWriter:
        return SampleWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SampleSource)


def read_samples(spark: SparkSession, sources: Sequence[dict], **options: str) -> DataFrame:
    """Samples of all sources; each is a dict of name, path and, if wanted, modalities and object_store."""
    register(spark)
    return spark.read.format(NAME).option("sources", json.dumps(list(sources))).options(**options).load()


def write_samples(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    register(samples.sparkSession)
    samples.write.format(NAME).mode("overwrite" if overwrite else "append").option("path", path).save()


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """What write_samples() has committed."""
    files = [f for f, _ in committed(path)]
    return spark.read.parquet(*files) if files else spark.createDataFrame([], COLUMNS)
