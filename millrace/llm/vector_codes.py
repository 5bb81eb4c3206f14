"""Product quantization of vectors with integer codebooks.

Vectors are cut into equal consecutive parts, and each part is replaced by the
number of its nearest codebook entry. Executors turn rows into blocks of
columns, one array per component, and write them; every training round is one
`treeAggregate` over these blocks. In a task, squared distances to all entries
of a part accumulate component by component, `np.add.at` adds each part to the
sums and counts of its entry, and these tensors, whose size is the codebooks',
merge through a tree of reductions. All arithmetic is on integers, so the
order in which blocks arrive changes nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bytes of a block's components; a longer vector is a block of its own.
BLOCK_BYTES = 1 << 20


def finite(vector_col: str) -> F.Column:
    """Whether a vector is there and has neither null, infinite nor NaN components."""
    v = F.col(vector_col)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))), F.lit(False))


def whole(x: float, scale: int) -> int:
    """floor(scale * x) as a Python integer, however large."""
    return int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale)


def integers(block: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """Components as integers of 64 bits, or of any length where these could overflow."""
    if not wide:
        return np.floor(block.astype(np.float64) * scale).astype(np.int64)
    return np.array([whole(float(x), scale) for x in block.ravel()], dtype=object).reshape(block.shape)


def nearest(block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector the nearest entry, ties to the lower index, and its squared distance.

    block is (components, vectors), codebooks is (parts, entries, components of a part).
    """
    parts, entries, width = codebooks.shape
    codes = np.empty((parts, block.shape[1]), dtype=np.int64)
    errors = np.empty((parts, block.shape[1]), dtype=block.dtype)
    at = np.arange(block.shape[1])
    for p in range(parts):
        distance = np.zeros((entries, block.shape[1]), dtype=block.dtype)
        for d in range(width):
            step = block[p * width + d][None, :] - codebooks[p, :, d][:, None]
            distance += step * step
        codes[p] = distance.argmin(axis=0)
        errors[p] = distance[codes[p], at]
    return codes, errors


Totals = tuple[np.ndarray, np.ndarray]


def add_block(totals: Totals | None, block: np.ndarray, codebooks: np.ndarray) -> Totals:
    """Sums (parts, entries, components) and counts (parts, entries) with a block's parts added."""
    parts, entries, width = codebooks.shape
    sums, counts = totals or (np.zeros(codebooks.shape, dtype=block.dtype), np.zeros((parts, entries), dtype=np.int64))
    codes, _ = nearest(block, codebooks)
    for p in range(parts):
        np.add.at(counts[p], codes[p], 1)
        for d in range(width):
            np.add.at(sums[p, :, d], codes[p], block[p * width + d])
    return sums, counts


def merge(a: Totals | None, b: Totals | None) -> Totals | None:
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def blocks_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, width: int) -> DataFrame:
    """Rows of vectors of `width` components as blocks, written: ids and labels in lists, components by column as float64 bytes."""
    types = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    rows = max(1, BLOCK_BYTES // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                some = batch.slice(first, rows)
                values = some.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, width)
                offsets = pa.array([0, some.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, some.column(i)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([np.ascontiguousarray(values.T).tobytes()], pa.binary())], names=["ids", "labels", "block"])

    same = vectors.where(F.size(vector_col) == width).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    return written(same.mapInArrow(run, f"ids array<{types[id_col]}>, labels array<{types[label_col]}>, block binary"), "vector-blocks")


def train(blocks: DataFrame, codebooks: np.ndarray, width: int, rounds: int, scale: int, wide: bool) -> np.ndarray:
    """Codebooks after so many rounds of assigning all parts and averaging those of each entry; entries without parts stay."""
    each = blocks.select("block").rdd.map(lambda row: integers(np.frombuffer(row.block, dtype=np.float64).reshape(width, -1), scale, wide))
    for _ in range(rounds):
        now = codebooks
        totals = each.treeAggregate(None, lambda t, block, now=now: add_block(t, block, now), merge, depth=3)
        if totals is None:
            return codebooks
        sums, counts = totals
        used = counts > 0
        codebooks = now.copy()
        codebooks[used] = sums[used] // counts[used][:, None]
    return codebooks


def encode(blocks: DataFrame, codebooks: np.ndarray, scale: int, wide: bool, id_type: str, label_type: str) -> DataFrame:
    """id, label, code (an index in two hex digits for each part) and error, which is null beyond 63 bits."""
    width = codebooks.shape[0] * codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(codebooks.shape[1])])
        for batch in batches:
            for i in range(batch.num_rows):
                block = integers(np.frombuffer(batch.column(2)[i].as_py(), dtype=np.float64).reshape(width, -1), scale, wide)
                codes, errors = nearest(block, codebooks)
                code = ["".join(c) for c in digits[codes.T]]
                error = [int(e) if e < 1 << 63 else None for e in errors.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {id_type}, label {label_type}, code string, error long")


def codebooks_sha256(codebooks: np.ndarray) -> str:
    """Digest of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in codebooks.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (parts, entries, components of a part).

    The table has a row per kept vector: id_col, label_col, code, error (the
    sum of the parts' squared distances). Rows whose vector is null or has
    null, infinite or NaN components are dropped. The length of the vectors is
    that of the smallest id's among those that can be cut into `parts`; rows of
    another length are kept without a code and an error, and take no part in
    training. First entries are of the smallest ids, nulls last; rows of one
    id go by their components, and equal rows are entries each. With fewer rows
    there are fewer entries. An empty table gives no rows and codebooks of no
    entries. Components for which sums or distances could leave 64 bits are
    counted in integers of any length; an error beyond 63 bits is null.
    Extra columns are ignored.
    """
    found = vectors.select(*[F.col(c) for c in dict.fromkeys((id_col, label_col, vector_col))]).where(finite(vector_col))
    fit = found.where((F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0))
    order = (F.col(id_col).asc_nulls_last(), F.col(vector_col))
    head = fit.orderBy(*order).select(vector_col).limit(1).collect()
    types = [vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    names = (F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")
    if not head:
        none = found.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none.select(*names), np.zeros((parts, 0, 0), dtype=np.int64)
    width = len(head[0][0])
    same = fit.where(F.size(vector_col) == width)
    first = same.orderBy(*order).select(vector_col).limit(entries).collect()
    most = same.agg(F.max(F.array_max(F.transform(vector_col, lambda x: F.abs(x).cast("double")))).alias("most"), F.count("*").alias("n")).first()
    largest = whole(most.most, scale) + 1
    wide = max(width * (2 * largest) ** 2, most.n * largest) >= 1 << 63
    rows = [integers(np.array(r[0], dtype=np.float64), scale, wide) for r in first]
    codebooks = np.stack([r.reshape(parts, -1) for r in rows], axis=1)
    blocks = blocks_of(same, id_col, vector_col, label_col, width)
    codebooks = train(blocks, codebooks, width, rounds, scale, wide)
    coded = encode(blocks, codebooks, scale, wide, *types)
    other = found.where(F.size(vector_col) != width).select(F.col(id_col), F.col(label_col), F.lit(None).cast("string"), F.lit(None).cast("long"))
    return coded.union(other).select(*names), codebooks


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error, the errors summed over rows of an equal label, nulls together; null beyond 63 bits and where no row has an error.

    Sums are made before the shuffle and written, so the join back reads a row
    per label; Spark broadcasts them if they are small and splits a hot label's
    rows otherwise.
    """
    coded = written(coded, "codes")
    sums = coded.groupBy(F.col(label_col).alias("label_of_error")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = written(sums.select("label_of_error", F.expr("try_cast(total AS long)").alias("label_error")), "label-errors")
    return coded.join(sums, coded[label_col].eqNullSafe(sums["label_of_error"]), "left").drop("label_of_error")

