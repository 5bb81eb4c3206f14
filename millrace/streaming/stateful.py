"""Streams with state: late rows to a side output, deliveries once, sessions that timers close.

All of them run in micro-batches with exactly-once results: the split by
overwriting a batch's own partitions, the others by Spark's state store and
file sink. Any of them can stop after a batch and go on from its checkpoint.
"""

from __future__ import annotations

import contextlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, StructType

from ..workspace import read_text, write_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for queries that start inside, as timers and state larger than memory need it."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is there by now to Parquet files, going on from the checkpoint; the files' log makes each row appear once."""
    with rocksdb(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


class LateSplit:
    """Rows of a stream on time, and those that come later than `delay` microseconds after the latest row of the batches before.

    Both are Parquet, in partitions by `late` and `batch` under path/rows; rows
    without a time are late. Each batch is one pass: its latest time is observed
    while it is written and kept with the largest one before, so the next batch
    reads one number, also after a restart.
    """

    def __init__(self, path: str, time: str, delay: int):
        self.path, self.time, self.delay = path.rstrip("/"), time, delay

    def run(self, stream: DataFrame) -> None:
        """Takes what is there by now, going on from the checkpoint in path."""
        stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_text(spark, f"{self.path}/latest/{number - 1}") if number else ""
        moment = F.unix_micros(F.col(self.time).cast("timestamp"))
        late = moment <= F.lit(int(before) - self.delay) if before else F.lit(False)
        seen = Observation()
        rows = batch.withColumns({"late": F.coalesce(late & moment.isNotNull(), F.lit(True)) | moment.isNull(), "batch": F.lit(number)})
        rows = rows.observe(seen, F.max(moment).alias("latest"))
        # A batch that is done again replaces its own partitions and no others.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("late", "batch").parquet(f"{self.path}/rows")
        latest = seen.get["latest"]
        known = [int(x) for x in (before, latest) if x not in ("", None)]
        write_text(spark, f"{self.path}/latest/{number}", str(max(known)) if known else "")

    def late(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The side output, with the number of the batch in which a row came."""
        full = StructType(list(schema.fields)).add("late", "boolean").add("batch", "integer")
        return spark.read.schema(full).parquet(f"{self.path}/rows").where("late").drop("late")

    def on_time(self, spark: SparkSession, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
        """The rows on time, as a stream in the order of their batches."""
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{self.path}/rows/late=false")


def once(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first delivery of each key; keys are remembered until the watermark is `delay` past them, so state is bounded."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def _timed(stream: DataFrame, time: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp"))


Span = tuple[int, int, int, int]


def add_moment(spans: list[Span], at: int, value: int, gap: int) -> None:
    """Puts a moment into sorted spans (first, last, rows, total), in place; spans no more than `gap` apart become one."""
    i = bisect_left(spans, (at,))
    new = (at, at, 1, value)
    if i < len(spans) and spans[i][0] - at <= gap:
        right = spans.pop(i)
        new = (at, max(at, right[1]), 1 + right[2], value + right[3])
    if i and new[0] - spans[i - 1][1] <= gap:
        left = spans.pop(i - 1)
        i -= 1
        new = (left[0], max(left[1], new[1]), left[2] + new[2], left[3] + new[3])
    spans.insert(i, new)


class Sessions(StatefulProcessor):
    """Open sessions of a key. State holds a row per open session, whatever the number of events in it, and one timer."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        spans = self._spans()
        for row in rows:
            add_moment(spans, row["__at"], row["__value"], self.gap)
        self._keep(spans)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Sessions that no row on time can join any more."""
        passed, spans = timerValues.getCurrentWatermarkInMs() * 1000, self._spans()
        done = [s for s in spans if s[1] + self.gap <= passed]
        self._keep([s for s in spans if s[1] + self.gap > passed])
        for first, last, n, total in done:
            yield Row(**{self.key: key[0], "first": first, "last": last, "n": n, "total": total})

    def _spans(self) -> list[Span]:
        return sorted(tuple(s) for s in self.open.get()) if self.open.exists() else []

    def _keep(self, spans: list[Span]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not spans:
            self.open.clear()
            return
        self.open.put(spans)
        self.handle.registerTimer(-(-(min(s[1] for s in spans) + self.gap) // 1000))


def sessions(stream: DataFrame, key: str, time: str, value: str, gap: int, delay: str) -> DataFrame:
    """Sessions of a key: runs of rows no more than `gap` microseconds apart, as soon as the watermark closes them.

    Columns: key, first_at, last_at, n, total (of value, an integer; null adds
    nothing). Rows may come in any order within `delay`; later ones are left out
    (LateSplit keeps them). Rows of a null key are one key's, rows without a time
    are left out. A key with a third of all rows is one state row per open
    session; its rows stream through one task, none of which are held.
    """
    timed = stream if _has_watermark(stream, time) else _timed(stream, time).withWatermark(time, delay)
    timed = timed.where(F.col(time).isNotNull())
    rows = timed.select(key, time, F.unix_micros(time).alias("__at"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("__value"))
    kind: DataType = stream.schema[key].dataType
    out = StructType().add(key, kind).add("first", "long").add("last", "long").add("n", "long").add("total", "long")
    found = rows.groupBy(key).transformWithState(statefulProcessor=Sessions(key, gap), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.select(key, F.timestamp_micros("first").alias("first_at"), F.timestamp_micros("last").alias("last_at"), "n", "total")


def _has_watermark(stream: DataFrame, time: str) -> bool:
    """Whether an operator before has set a watermark on the column."""
    return "spark.watermarkDelayMs" in str(stream._jdf.schema().apply(time).metadata().json())
