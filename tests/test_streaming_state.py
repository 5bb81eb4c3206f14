"""Stateful streams: late rows, deliveries once, sessions; restarts change nothing."""

import datetime
import random

import pytest
from pyspark.sql import types as S

from millrace.streaming import read
from millrace.streaming.stateful import LateSplit, add_moment, once, run_available, sessions
from millrace.workspace import new_path

SCHEMA = S.StructType().add("id", "long").add("k", "string").add("ts", "timestamp").add("v", "long")
MINUTE = 60_000_000
START = datetime.datetime(2024, 1, 1)


def at(minute):
    return None if minute is None else START + datetime.timedelta(minutes=minute)


def put(spark, folder, found):
    spark.createDataFrame([(i, k, at(m), v) for i, k, m, v in found], SCHEMA).repartition(3).write.mode("append").parquet(folder)


def spans_by_hand(moments, gap):
    out = []
    for m, v in sorted(moments):
        if out and m - out[-1][1] <= gap:
            out[-1] = (out[-1][0], m, out[-1][2] + 1, out[-1][3] + v)
        else:
            out.append((m, m, 1, v))
    return out


def test_moments_in_any_order_make_the_same_spans():
    rng = random.Random(1)
    for _ in range(300):
        moments = [(rng.randrange(60), rng.randrange(-5, 9)) for _ in range(rng.randrange(1, 25))]
        spans = []
        for m, v in moments:
            add_moment(spans, m, v, 4)
        assert spans == spans_by_hand(moments, 4)


def batches():
    rng = random.Random(3)
    found, now = [], 0
    for b in range(4):
        rows = [(1000 * b + i, "hot" if rng.random() < 0.5 else rng.choice(["a", None]), now + rng.randrange(-80, 60), rng.choice([None, 1, 5])) for i in range(40)]
        rows += [(rows[0][0], *rows[0][1:]), (1000 * b + 500, "a", None, 1)]  # a second delivery, and a row without a time
        found.append(rows)
        now += 60
    return found


def split_by_hand(all_batches, delay):
    on_time, late, latest = [], [], None
    for b, rows in enumerate(all_batches):
        for r in rows:
            gone = r[2] is None or (latest is not None and r[2] <= latest - delay)
            (late if gone else on_time).append((b, *r))
        seen = [r[2] for r in rows if r[2] is not None]
        latest = max([*seen, *([] if latest is None else [latest])])
    return on_time, late


@pytest.mark.parametrize("restart", [True, False])
def test_late_rows_and_sessions(spark, restart):
    folder, delay, gap = new_path(spark, "arrived"), 30, 7
    split = LateSplit(new_path(spark, "split"), "ts", delay * MINUTE)
    path, checkpoint = new_path(spark, "found"), new_path(spark, "checkpoint")

    def go_on():
        stream = split.on_time(spark, SCHEMA)
        run_available(sessions(once(stream, ["id"], "ts", f"{delay} minutes"), "k", "ts", "v", gap * MINUTE, f"{delay} minutes"), path, checkpoint)

    for n, rows in enumerate(batches()):
        put(spark, folder, rows)
        split.run(read(spark, folder, SCHEMA, files_per_trigger=1000))
        if restart or n == 3:
            go_on()
    on_time, late = split_by_hand(batches(), delay)
    name = lambda rows: sorted(str((r[0], r[1], r[2], at(r[3]))) for r in rows)
    found = split.late(spark, SCHEMA).collect()
    assert len(late) > 5 and name(late) == name([(r.batch, r.id, r.k, None if r.ts is None else (r.ts - START).total_seconds() / 60) for r in found])
    unique = {r[1]: r for r in on_time}.values()
    closed = max(r[3] for r in unique) - delay
    expected = []
    for key in {r[2] for r in unique}:
        expected += [(key, at(a), at(b), n, total) for a, b, n, total in spans_by_hand([(r[3], r[4] or 0) for r in unique if r[2] == key], gap) if b + gap <= closed]
    assert sorted(map(str, expected)) == sorted(str((r.k, r.first_at, r.last_at, r.n, r.total)) for r in spark.read.parquet(path).collect())


def test_a_batch_done_again_replaces_itself(spark):
    split = LateSplit(new_path(spark, "split"), "ts", MINUTE)
    df = spark.createDataFrame([(1, "a", at(1), 1), (2, "a", at(9), 1)], SCHEMA)
    for number in (0, 1, 1):
        split.write(df, number)
    assert sorted((r.batch, r.id) for r in split.late(spark, SCHEMA).collect()) == [(1, 1)]
    assert spark.read.parquet(f"{split.path}/rows").count() == 4
    split.write(df.where("false"), 2)
    split.write(df, 3)
    assert spark.read.parquet(f"{split.path}/rows").count() == 6
