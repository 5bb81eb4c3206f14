"""Filters, limits, batches, balancing and set operations over samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..workspace import written
from .text import number_rows


def check_settings(batch_size: int = 32, workers: int = 4) -> None:
    """Raises unless a batch has rows and workers aren't negative."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if workers < 0:
        raise ValueError("workers can't be negative")


def keep_modalities(samples: DataFrame, modalities: Sequence[str]) -> DataFrame:
    """Rows of these modalities; none named: all rows."""
    return samples.where(F.col("modality").isin(list(modalities))) if modalities else samples


def first_rows(samples: DataFrame, n: int | None, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in an order; 0 or None is no limit."""
    return samples.orderBy(*order).limit(n) if n else samples


def count_by_modality(samples: DataFrame) -> DataFrame:
    return samples.groupBy("modality").agg(F.count("*").alias("n"))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows with the name and place of their source; columns that one lacks are null."""
    found = None
    for place, (name, df) in enumerate(sources.items()):
        part = df.withColumn("source_name", F.lit(name)).withColumn("source_ord", F.lit(place))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    if found is None:
        raise ValueError("no sources")
    return found


def balance(samples: DataFrame, order: Sequence[str], by: str = "modality") -> DataFrame:
    """The first rows of every group, as many as the smallest group has.

    Groups are few and large, so no window sorts a whole one: rows are numbered
    over sorted ranges, and a group's rows by what the ranges before hold of it.
    """
    ranged = written(samples.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    least = ranged.groupBy(by).agg(F.count("*").alias("__n")).agg(F.min("__n").alias("__least"))
    within = Window.partitionBy("__range", by).orderBy(*order)
    numbered = ranged.withColumn("__k", F.row_number().over(within))
    held = ranged.groupBy("__range", by).agg(F.count("*").alias("__held"))
    before = held.select("__range", by, F.coalesce(F.sum("__held").over(Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    before = before.select(F.col("__range").alias("__r"), F.col(by).alias("__by"), "__before")
    met = numbered.join(before, (F.col("__range") == F.col("__r")) & F.col(by).eqNullSafe(F.col("__by")))
    return met.join(F.broadcast(least)).where(F.col("__k") + F.col("__before") <= F.col("__least")).select(*samples.columns)


def with_batches(samples: DataFrame, batch_size: int, order: Sequence[str | Column], out: str = "batch_id") -> DataFrame:
    """Adds the number of the batch that a row is in, in a total order."""
    check_settings(batch_size)
    keys = [F.asc(c) if isinstance(c, str) else c for c in order]
    return number_rows(samples, keys, "__row").withColumn(out, F.floor(F.col("__row") / batch_size).cast("long")).drop("__row")


def iterate_batches(samples: DataFrame, batch_size: int, order: Sequence[str | Column]) -> Iterator[list[Row]]:
    """Lists of batch_size rows in an order, the last one maybe shorter; one partition at a time comes to the driver."""
    check_settings(batch_size)
    batch: list[Row] = []
    for row in samples.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == batch_size:
            yield batch
            batch = []
    if batch:
        yield batch


def source_statistics(samples: DataFrame) -> DataFrame:
    """Rows and size by source and modality with totals by source (modality null) and of all (both null). The size of all is the sum of the sources' rounded sizes."""
    mb = F.round(F.sum("size") / F.lit(1 << 20), 2)
    by = samples.groupBy("source_name", "modality").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = by.groupBy("source_name").agg(F.sum("n").alias("n"), mb.alias("size_mb"))
    total = parts.agg(F.sum("n").alias("n"), F.round(F.sum("size_mb"), 2).alias("size_mb"))
    none = F.lit(None).cast("string")
    found = by.select("source_name", "modality", "n", F.round(F.col("size") / F.lit(1 << 20), 2).alias("size_mb"))
    found = found.unionByName(parts.select("source_name", none.alias("modality"), "n", "size_mb"))
    merged = by.groupBy("modality").agg(F.sum("n").alias("n")).select(none.alias("source_name"), "modality", "n", F.lit(None).cast("double").alias("size_mb"))
    return found.unionByName(merged).unionByName(total.select(none.alias("source_name"), none.alias("modality"), "n", "size_mb"))


def distribution(samples: DataFrame) -> DataFrame:
    """Rows by source and modality."""
    return samples.groupBy("source_name", "modality").agg(F.count("*").alias("n"))


def remove_duplicates(samples: DataFrame, content: Sequence[str]) -> DataFrame:
    """Extension: one row of each content."""
    return samples.dropDuplicates(list(content))
