"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to the bit counts of its 32 two-bit segments. Two
fingerprints that differ in d bits have counts at a Manhattan distance of d at
most, so pairs within 2 bits lie within distance 2 on that integer grid, and
two grid points within distance 2 have a grid point within distance 1 of both.
Each fingerprint goes to its own cell and the cells one step away (about 49);
fingerprints that meet in a cell are verified on their bits. No pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components

SEED = 42
#: The lower bit of each two-bit segment, as a signed 64-bit number.
LOW_BITS = 0x5555555555555555
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15


def fingerprint(text: bytes, width: int) -> int:
    """Bits set in over half of the shingles' XXH64; zero without words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[min(width, len(words)) - 1 :])), dtype="<u8", count=n)  # noqa: B905
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, COUNTED):
        counts += np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id_col, text_key (a checksum of the text) and fingerprint (64 bits as a long) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", width) for t in column), dtype=np.uint64, count=len(column))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=[id_col, "text_key", "fingerprint"])

    return docs.select(id_col, F.xxhash64(text_col).alias("text_key"), text_col).mapInArrow(run, f"`{id_col}` {id_type}, text_key long, fingerprint long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed where the segments are."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def cells(counts: Column) -> Column:
    """The grid points within one step of a point: a count of 0 or 1 may grow, a count of 1 or 2 may shrink."""

    def step(i: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (i * 2).cast("int"))
        two = F.shiftleft(one, 1)
        a = F.when(counts.bitwiseAND(two) == 0, counts.bitwiseXOR(one))  # 0 <-> 1
        b = F.when(counts.bitwiseAND(one.bitwiseOR(two)) != 0, counts.bitwiseXOR(one.bitwiseOR(two)))  # 1 <-> 2
        return F.array(a, b)

    around = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), step))
    return F.concat(F.array(counts), F.filter(around, lambda c: c.isNotNull()))


def close_pairs(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in `distance` (2 at most) bits or fewer. nodes: fingerprint, without repeats."""
    if not 0 <= distance <= 2:
        raise ValueError("the grid has cells for up to 2 differing bits")
    placed = nodes.select("fingerprint", segment_counts(F.col("fingerprint")).alias("counts")).select("fingerprint", "counts", F.explode(cells(F.col("counts"))).alias("cell"))
    placed = placed.select("cell", "fingerprint")
    # Spark takes the exploded rows for as few as the fingerprints, and would broadcast them through the driver.
    a, b = placed.hint("merge").alias("a"), placed.hint("merge").alias("b")
    # Points with equal counts share all their cells; they meet in their own only.
    once = (segment_counts(F.col("a.fingerprint")) != segment_counts(F.col("b.fingerprint"))) | (F.col("a.cell") == segment_counts(F.col("a.fingerprint")))
    near = F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= distance
    met = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fingerprint") < F.col("b.fingerprint")) & near & once)
    return met.select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"))


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints by row, and the group (the smallest fingerprint reachable) of each distinct fingerprint."""
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(rows.groupBy("fingerprint").agg(F.min(id_col).alias("first")), "nodes")
    labels = components(close_pairs(nodes.select("fingerprint"), distance)).withColumnRenamed("node", "fingerprint")
    groups = nodes.join(labels, "fingerprint", "left").select("fingerprint", "first", F.coalesce("label", "fingerprint").alias("label"))
    return rows, groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """Groups documents whose fingerprints link, directly or through others.

    Returns one row per input row: id_col, fingerprint (16 hex digits),
    component_id (the smallest id in its group). Words are runs without ASCII
    white space, A-Z lower-cased; shingles are `width` words, repeats included,
    or the whole sequence if it is shorter.

    Null and blank texts have fingerprint zero and link like any other. Null
    ids are never a component_id unless a group has no other. Equal rows get
    equal results, extra columns are ignored, an empty table gives no rows.
    """
    rows, groups = grouped(docs, id_col, text_col, width, distance)
    smallest = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    found = groups.join(smallest, "label").select("fingerprint", "component_id")
    return rows.join(found, "fingerprint").select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = 2) -> DataFrame:
    """docs with one row of each group: the one with the smallest id (null last), then the smallest text checksum; of equal rows any one."""
    rows, groups = grouped(docs, id_col, text_col, width, distance)
    return first_of_groups(docs, rows, groups.drop("first"), "fingerprint", id_col, text_col)


def first_of_groups(docs: DataFrame, rows: DataFrame, groups: DataFrame, node: str, id_col: str, text_col: str) -> DataFrame:
    """keep_one() for rows with a node and a text_key, and groups with the label of each node."""
    firsts = rows.groupBy(node).agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_key")).alias("first"))
    kept = groups.join(firsts, node).groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.id").alias("__mr_id"), F.col("first.text_key").alias("__mr_key"))
    keyed = docs.withColumn("__mr_text", F.xxhash64(text_col))
    same = keyed[id_col].eqNullSafe(F.col("__mr_id")) & (F.col("__mr_text") == F.col("__mr_key"))
    met = keyed.join(kept, same, "left_semi")
    repeats = met.withColumn("__mr_n", F.row_number().over(Window.partitionBy(id_col, "__mr_text").orderBy("__mr_text")))
    return repeats.where("__mr_n = 1").select(*docs.columns)

