"""Sharding over fixed virtual slots.

Records hash into a fixed number of virtual slots; a slot never splits, so a
versioned slot-to-shard map is all that places a record. Bytes are summed per
slot, and rebalancing edits the map: it moves slots, never single records.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import hadoop_path, new_path, written

#: Virtual slots: the size of every map and of every aggregate that reaches the driver.
SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def record_key(id_col: str, text_col: str) -> Column:
    """What places a record; the text's checksum takes part, so records without an id spread too."""
    return F.xxhash64(F.col(id_col).cast("string"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def spread(rows: DataFrame, slots: int) -> DataFrame:
    """rows (key, number, size and more) with their virtual_slot.

    Equal records that together have more bytes than a mean slot would overfill
    theirs; each of them gets a slot by its number. Fewer than `slots` keys can
    have that much, so their table is small whatever the rows.
    """
    sums = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size").alias("bytes")).first().bytes or 0
    heavy = sums.where((F.col("n") > 1) & (F.col("bytes") > total / slots)).select("key", F.lit(True).alias("heavy"))
    met = rows.join(F.broadcast(heavy), "key", "left")  # fewer than `slots` rows
    return met.withColumn("virtual_slot", F.when(F.col("heavy"), slot_of(F.xxhash64("key", "number"), slots)).otherwise(slot_of(F.col("key"), slots))).drop("heavy")


def first_map(shards: int, slots: int = SLOTS) -> dict:
    """Version 1: slots dealt in turn."""
    return {"version": 1, "shards": shards, "slots": [s % shards for s in range(slots)]}


def rebalance(current: dict, loads: dict[int, int], shards: int | None = None) -> dict:
    """The next version of a map, with as even bytes as its slots allow.

    The first map, which knows no bytes, is dealt anew where it overfills a
    shard: largest slots first, to the lightest shard. Later maps keep slots
    where they are, but for those of shards that are gone. Then slots move one
    at a time from the fullest shard to the emptiest (new shards are empty), as
    long as that narrows the gap, so a map that is even already stays. The
    input map isn't changed.
    """
    shards = shards or current["shards"]
    place = list(current["slots"])
    held = [0] * shards
    loose: list[int] = []
    mean = sum(loads.values()) / shards
    by_load = sorted(range(len(place)), key=lambda s: (-loads.get(s, 0), s))
    fresh = current["version"] == 1
    for slot in by_load:
        to = place[slot]
        if to >= shards or fresh and loads.get(slot, 0) and held[to] + loads[slot] > mean:
            loose.append(slot)
        else:
            held[to] += loads.get(slot, 0)
    heap = [(held[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in loose:
        load, to = heapq.heappop(heap)
        place[slot] = to
        heapq.heappush(heap, (load + loads.get(slot, 0), to))
    held = [load for load, _ in sorted(heap, key=lambda x: x[1])]
    members: list[list[int]] = [[] for _ in range(shards)]
    for slot in by_load:
        members[place[slot]].append(slot)
    for _ in range(4 * len(place)):
        low, high = min(range(shards), key=held.__getitem__), max(range(shards), key=held.__getitem__)
        gap = held[high] - held[low]
        fits = [s for s in members[high] if 0 < loads.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap / 2 - loads[s]), s))
        members[high].remove(slot)
        members[low].append(slot)
        place[slot], held[high], held[low] = low, held[high] - loads[slot], held[low] + loads[slot]
    return {"version": current["version"] + 1, "shards": shards, "slots": place}


def save_map(spark: SparkSession, folder: str, slot_map: dict) -> str:
    """Stores one version of a map, in any store that Spark reaches; versions are never overwritten."""
    fs, where = hadoop_path(spark, f"{folder}/map-v{slot_map['version']:06d}.json")
    out = fs.create(where, False)
    try:
        out.write(bytearray(json.dumps(slot_map).encode()))
    finally:
        out.close()
    return where.toString()


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """A stored version of a map; the newest if none is named. Only that one is read."""
    fs, where = hadoop_path(spark, folder)
    if version is None:
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        version = max(int(n[len("map-v") : -len(".json")]) for n in names if n.startswith("map-v") and n.endswith(".json"))
    return json.loads(spark.read.text(f"{folder}/map-v{version:06d}.json", wholetext=True).first().value)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Places every row in a shard, with near equal bytes per shard.

    Returns one row per input row: id_col, size (UTF-8 bytes of the text plus
    16), text_crc32, virtual_slot, shard, slot (its place in the shard,
    gapless from 0). Bytes per virtual slot, at most `slots` numbers, come to
    the driver; the map's versions are stored in `folder`, and a newer map
    starts from the newest one there. Rows are numbered within their virtual
    slot and shifted by what the shard's earlier slots hold, so no task numbers
    a whole shard.

    A null text counts as none, null ids are told apart by their texts. Equal
    rows share a slot, unless they have more bytes than a mean slot: then their
    numbers in the scan spread them. A map in `folder` keeps its count of slots
    whatever `slots` says. Extra columns are ignored, and an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shard-maps")
    fs, where = hadoop_path(spark, folder)
    current = load_map(spark, folder) if fs.exists(where) else first_map(shards, slots)
    slots = len(current["slots"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), record_key(id_col, text_col).alias("key"), F.monotonically_increasing_id().alias("number"))
    rows = written(spread(written(rows, "shard-keys"), slots).select("id", "size", "text_crc32", "number", "virtual_slot"), "shard-rows")
    sums = {r.virtual_slot: (r.size, r.n) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    if not fs.exists(where):
        save_map(spark, folder, current)
    chosen = rebalance(current, {s: b for s, (b, _) in sums.items()}, shards)
    save_map(spark, folder, chosen)

    starts, filled = [], [0] * shards
    for slot, to in enumerate(chosen["slots"]):
        starts.append((slot, to, filled[to]))
        filled[to] += sums.get(slot, (0, 0))[1]
    schema = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("start", T.LongType())])
    places = F.broadcast(spark.createDataFrame(starts, schema))  # `slots` rows, always
    order = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size", "number")
    numbered = rows.withColumn("nth", F.row_number().over(order) - 1).join(places, "virtual_slot")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))
