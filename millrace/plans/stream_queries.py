"""Registered queries with state: a month of events delivered in batches, and a store of conversations that batches change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..session import table
from ..sources.keyed_table import KeyedTable
from ..streaming import read
from ..streaming.stateful import LateSplit, once, run_available, sessions
from ..workspace import new_path, written
from .registry import query

HOUR = 3_600_000_000
GAP, DELAY = 2 * HOUR, 48 * HOUR
DELIVERY = "event_id long, k long, ts timestamp, cents long"
#: Batches of five days' deliveries; the month's last ones come three days late.
BATCHES = 7


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive: some three days after their time, some twice, a third of them of one key."""
    found = table(spark, sf_dir, "events")
    rows = found.select("event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    first = rows.withColumn("arrival", F.when(F.col("event_id") % 11 == 0, F.col("ts") + F.expr("INTERVAL 3 DAYS")).otherwise(F.col("ts")))
    again = first.where(F.col("event_id") % 7 == 0).withColumn("arrival", F.col("arrival") + F.expr("INTERVAL 1 DAY"))
    day = F.expr("unix_micros(arrival) - unix_micros(timestamp'2024-01-01 00:00:00')") / F.lit(24 * HOUR)
    return first.union(again).withColumn("delivery", F.floor(day / 5).cast("int")).drop("arrival")


DELIVERIES_SQL = """
r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS k, ts, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 3 DAY ELSE ts END AS arrival FROM events),
a AS (SELECT * FROM r UNION ALL SELECT event_id, k, ts, cents, arrival + INTERVAL 1 DAY FROM r WHERE event_id % 7 = 0),
d AS (SELECT event_id, k, ts, cents, CAST(floor((epoch_us(arrival) - epoch_us(TIMESTAMP '2024-01-01')) / (5 * 86400000000)) AS INTEGER) AS batch FROM a),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM d GROUP BY batch),
s AS (SELECT d.*, coalesce(epoch_us(ts) <= epoch_us(latest) - 172800000000, false) AS late FROM d JOIN m USING (batch))
"""


def split(spark: SparkSession, sf_dir: str, then: Callable[[int, LateSplit], None] = lambda number, late: None) -> LateSplit:
    """All deliveries, batch by batch, each followed by `then`; each one starts the stream again from its checkpoint."""
    arrived = new_path(spark, "deliveries")
    parts = written(deliveries(spark, sf_dir), "arrivals")
    late = LateSplit(new_path(spark, "split"), "ts", DELAY)
    for number in range(BATCHES):
        parts.where(F.col("delivery") == number).drop("delivery").write.mode("append").parquet(arrived)
        late.run(read(spark, arrived, S.StructType.fromDDL(DELIVERY), files_per_trigger=1_000_000))
        then(number, late)
    return late


@query(f"WITH {DELIVERIES_SQL} SELECT event_id, epoch_us(ts) AS moment, batch FROM s WHERE late")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side output: deliveries that came more than two days behind the latest time before their batch."""
    found = split(spark, sf_dir).late(spark, S.StructType.fromDDL(DELIVERY))
    return found.select("event_id", F.unix_micros("ts").alias("moment"), "batch")


@query(
    f"""WITH {DELIVERIES_SQL}, u AS (SELECT event_id, any_value(k) AS k, any_value(ts) AS ts, any_value(cents) AS cents FROM s WHERE NOT late GROUP BY event_id),
t AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY k ORDER BY ts)) <= 7200000000 THEN 0 ELSE 1 END AS turn FROM u),
n AS (SELECT *, sum(turn) OVER (PARTITION BY k ORDER BY ts) AS session FROM t)
SELECT k, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM n GROUP BY k, session
HAVING epoch_us(max(ts)) + 7200000000 <= (SELECT epoch_us(max(ts)) FROM u) - 172800000000"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the rows on time, each delivery once, that the watermark has closed; the stream is stopped after three batches and goes on at the end."""
    schema = S.StructType.fromDDL(DELIVERY)
    path, checkpoint = new_path(spark, "sessions"), new_path(spark, "sessions-checkpoint")

    def go_on(number: int, late: LateSplit) -> None:
        if number in (2, BATCHES - 1):
            stream = late.on_time(spark, schema, files_per_trigger=1_000_000)
            run_available(sessions(once(stream, ["event_id"], "ts", "2 days"), "k", "ts", "cents", GAP, "2 days"), path, checkpoint)

    split(spark, sf_dir, go_on)
    found = spark.read.parquet(path)
    return found.select("k", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"), "n", "total")


CONVERSATION = "session long, conv_id long, turn long, role string, text string, version long"


def changed_store(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """Conversations under three batches of upserts and one of deletes; a third of them are one session's."""
    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 3 == 0, 0).otherwise(F.col("conv_id")).alias("session"), "conv_id", "turn", "role", "text")
    store = KeyedTable(spark, new_path(spark, "conversations"), S.StructType.fromDDL(CONVERSATION), ["session", "conv_id", "turn"], "version", buckets=32)
    store.upsert(rows.withColumn("version", F.lit(2)))
    edited = rows.where(F.col("conv_id") % 4 == 0).withColumns({"text": F.concat(F.lit("edited: "), F.col("text")), "version": F.lit(3)})
    stale = rows.where(F.col("conv_id") % 5 == 0).withColumns({"text": F.lit("older"), "version": F.lit(1)})
    store.upsert(edited.unionByName(stale))
    store.delete(rows.where((F.col("conv_id") % 6 == 1) & (F.col("turn") > 1)).withColumn("version", F.lit(4)))
    more = rows.where(F.col("conv_id") % 10 == 3).withColumns({"turn": F.col("turn") + 100, "version": F.lit(5)})
    again = rows.where(F.col("conv_id") % 12 == 1).withColumn("version", F.lit(3))  # older than their delete
    store.upsert(more.unionByName(again))
    return store


STORE_SQL = """
c AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS session, conv_id, turn, role, text FROM conversations),
v AS (
  SELECT *, 2 AS version, false AS gone FROM c
  UNION ALL SELECT session, conv_id, turn, role, 'edited: ' || text, 3, false FROM c WHERE conv_id % 4 = 0
  UNION ALL SELECT session, conv_id, turn, role, 'older', 1, false FROM c WHERE conv_id % 5 = 0
  UNION ALL SELECT session, conv_id, turn, role, text, 4, true FROM c WHERE conv_id % 6 = 1 AND turn > 1
  UNION ALL SELECT session, conv_id, turn + 100, role, text, 5, false FROM c WHERE conv_id % 10 = 3
  UNION ALL SELECT session, conv_id, turn, role, text, 3, false FROM c WHERE conv_id % 12 = 1
), w AS (SELECT *, row_number() OVER (PARTITION BY session, conv_id, turn ORDER BY version DESC) AS place FROM v),
z AS (SELECT * FROM w WHERE place = 1 AND NOT gone)
"""


@query(f"WITH {STORE_SQL} SELECT session, conv_id, turn, role, md5(text) AS text_md5, CAST(version AS BIGINT) AS version FROM z")
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_store(spark, sf_dir).read().withColumn("text_md5", F.md5("text")).drop("text")


@query(f"WITH {STORE_SQL} SELECT session, count(*) AS turns, sum(length(text))::BIGINT AS chars, max(version)::BIGINT AS version FROM z GROUP BY session")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are left, with their turns."""
    rows = changed_store(spark, sf_dir).read()
    return rows.groupBy("session").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("version").alias("version"))
