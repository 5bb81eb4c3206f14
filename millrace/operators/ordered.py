"""Running and lagging values along a key's order, where a key may be too large for one task.

Rows are dealt into ranges of key and order, so a key that holds a third of all
rows spans many ranges and no task holds it whole. Values are found within each
range. What the ranges before hold of the same key is carried over from a
summary: only keys that a range's border splits need one, at most two rows a
range, so that this table is small whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..workspace import written

RANGE = "__range"


def digest_of(df: DataFrame) -> Column:
    """A number of a row's contents that splits rows of equal keys over ranges. It is the same whenever a row is computed again, which a random number is not if a lost executor's rows come back in another order."""

    def hashable(kind: S.DataType) -> bool:
        if isinstance(kind, S.StructType):
            return all(hashable(f.dataType) for f in kind.fields)
        return hashable(kind.elementType) if isinstance(kind, S.ArrayType) else not isinstance(kind, S.MapType | S.VariantType)

    return F.xxhash64(F.lit(0), *[F.col(f"`{f.name}`") for f in df.schema if hashable(f.dataType)])


class Ranged:
    """A table in ranges of `keys` and `order` (columns of it; nulls first), written to the shared folder.

    Rows that are equal in both are in the order of the `ties` columns, and in
    any order where these are equal too. Rows of one key and place are split by
    their contents; only rows that are equal in all stay together. An empty
    table has no ranges.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], ties: Sequence[str] = ()):
        self.keys, self.order = list(keys), [*order, *ties]
        dealt = df.repartitionByRange(*self.keys, *self.order, digest_of(df))
        self.table = written(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")
        self.within = Window.partitionBy(RANGE, *self.keys).orderBy(*self.order)
        self._split: DataFrame | None = None

    def split_keys(self) -> DataFrame:
        """Range and keys of the keys that are in several ranges: at most two rows a range."""
        if self._split is None:
            held = self.table.groupBy(RANGE, *self.keys).agg(F.lit(1).alias("__one"))
            spans = F.count("*").over(Window.partitionBy(*self.keys))
            self._split = written(held.withColumn("__spans", spans).where("__spans > 1").select(RANGE, *self.keys), "split-keys")
        return self._split

    def carry(self, summary: Column, before: Callable[[Column, Window], Column]) -> DataFrame:
        """Of each split key and range: `before` of the summaries of the ranges before this one."""
        split = self.split_keys()
        rows = self._met(self.table, split).groupBy(RANGE, *self.keys).agg(summary.alias("__summary"))
        earlier = Window.partitionBy(*self.keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        return written(rows.select(RANGE, *self.keys, before(F.col("__summary"), earlier).alias("__carried")), "carried")

    def _met(self, df: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
        """df with the rows of small that have its range and keys, nulls alike; small has at most two rows a range, so it may be broadcast."""
        names = {c: f"__of_{c}" for c in (RANGE, *self.keys)}
        other = F.broadcast(small.withColumnsRenamed(names))
        same = F.lit(True)
        for name, of in names.items():
            same &= F.col(name).eqNullSafe(F.col(of))
        return df.join(other, same, how).drop(*names.values())

    def with_last(self, value: Column, out: str) -> DataFrame:
        """Adds the latest value that isn't null, of this row and those before it."""
        carried = self.carry(F.max_by(value, F.when(value.isNotNull(), self._place())), lambda s, w: F.last(s, ignorenulls=True).over(w))
        own = F.last(value, ignorenulls=True).over(self.within.rowsBetween(Window.unboundedPreceding, 0))
        return self._met(self.table.withColumn(out, own), carried, "left").withColumn(out, F.coalesce(out, "__carried")).drop("__carried", RANGE)

    def with_previous(self, value: Column, out: str) -> DataFrame:
        """Adds the value of the row before, null for a key's first row."""
        boxed = F.struct(value.alias("value"))
        carried = self.carry(F.max_by(boxed, self._place()), lambda s, w: F.last(s).over(w))
        found = self.table.withColumn("__before", F.lag(boxed).over(self.within))
        return self._met(found, carried, "left").withColumn(out, F.coalesce("__before", "__carried")["value"]).drop("__before", "__carried", RANGE)

    def with_running(self, value: Column, out: str) -> DataFrame:
        """Adds the sum of the values up to and with this row; nulls add nothing, and before the first value it is null."""
        carried = self.carry(F.sum(value), lambda s, w: F.sum(s).over(w))
        own = F.sum(value).over(self.within.rowsBetween(Window.unboundedPreceding, 0))
        found = self._met(self.table.withColumn("__own", own), carried, "left")
        return found.withColumn(out, F.coalesce(F.col("__own") + F.col("__carried"), "__own", "__carried")).drop("__own", "__carried", RANGE)

    def with_number(self, out: str) -> DataFrame:
        """Adds a row's number in its key, from 0."""
        carried = self.carry(F.count("*"), lambda s, w: F.sum(s).over(w))
        found = self._met(self.table.withColumn("__own", F.row_number().over(self.within) - 1), carried, "left")
        return found.withColumn(out, F.col("__own") + F.coalesce("__carried", F.lit(0))).drop("__own", "__carried", RANGE)

    def _place(self) -> Column:
        return F.struct(*self.order)
