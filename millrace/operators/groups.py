"""Several groupings in one pass, exact quantiles and the top rows of groups of any size, and multisets of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written
from .ordered import Ranged, digest_of


def summaries(df: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """Measures by each of several sets of columns in one aggregation.

    A row has the columns of all sets, null where its set lacks one, and
    `grouping`, the number that GROUPING_ID gives: a bit for each column that is
    lacking, the first column's the highest. So null values and lacking columns
    differ. Distinct counts go over two levels of hashing (value, then group),
    so that the group of all rows is no task's alone. An empty table gives no
    rows.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id().cast("int").alias("grouping"), *measures)


def totals(df: DataFrame, sets: Sequence[Sequence[str]], sums: Sequence[str], distinct: str, n: str = "n", out: str = "distinct") -> DataFrame:
    """summaries() of the number of rows (n), sums of integers (under their names) and the number of distinct values of a column (out).

    Rows are first summed by all columns and the distinct one, and only these
    sums are multiplied by the sets, so that a task's hash table has a row for
    each of them that its input holds, whatever the number of sets.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    cells = df.groupBy(*columns, F.col(distinct).alias("__distinct")).agg(F.count("*").alias("__n"), *[F.sum(c).alias(c) for c in sums])
    measures = [F.sum("__n").alias(n), *[F.sum(c).alias(c) for c in sums], F.count_distinct("__distinct").alias(out)]
    return summaries(cells, sets, measures)


def crossed(df: DataFrame, by: str, across: str, values: Sequence[str], measure: Column) -> DataFrame:
    """A row for each value of `by` with a column for each of the given values of `across`; 0 where there are no rows."""
    return df.groupBy(by).pivot(across, list(values)).agg(measure).na.fill(0, list(values))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], accuracy: int = 1000) -> DataFrame:
    """Exact quantiles of groups: keys, share, value, rank. The value at a share p is the smallest that at least p of the group's values don't exceed (of p = 0 the least).

    A sketch, merged before the shuffle, bounds each quantile from both sides;
    values below are counted, and only the few in between (a share of about
    2 / accuracy) are put in order, range by range, so no task sorts a group.
    Nulls and NaN are no values; groups without values have no rows. Null keys
    are a key.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    if df.schema[value].dataType.typeName() in ("double", "float"):
        rows = rows.where(~F.isnan("__v"))
    slack = 2.0 / accuracy
    bounds = lambda sign: F.array(*[F.lit(min(1.0, max(0.0, p + sign * slack))) for p in shares])
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("__v", bounds(-1), F.lit(accuracy)).alias("low"), F.percentile_approx("__v", bounds(1), F.lit(accuracy)).alias("high"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.count("*").alias("n"))
    def bound(i: int, p: float) -> Column:
        # At the ends the sketch's own bound could be a value inside.
        low = F.col("least") if p <= slack else F.col("low")[i]
        high = F.col("most") if p >= 1 - slack else F.col("high")[i]
        target = F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))).cast("long")
        return F.struct(F.lit(i).alias("pos"), F.lit(float(p)).alias("share"), low.alias("low"), high.alias("high"), target.alias("target"))

    of = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    bounded = written(sketch.select(*of, F.array(*[bound(i, p) for i, p in enumerate(shares)]).alias("bounds")), "quantile-bounds")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    met = rows.join(bounded, same)
    below = met.groupBy(*of).agg(F.array(*[F.count(F.when(F.col("__v") < F.col("bounds")[i]["low"], 1)) for i in range(len(shares))]).alias("below"))
    inside = F.filter("bounds", lambda b: (b["low"] <= F.col("__v")) & (F.col("__v") <= b["high"]))
    between = Ranged(met.select(*keys, "__v", F.explode(inside).alias("b")).select(*keys, "__v", "b.pos", "b.share", "b.target"), [*keys, "pos"], ["__v"]).with_number("number")
    found = between.join(below, same).where(F.col("number") + F.get("below", F.col("pos")) + 1 == F.col("target"))
    return found.select(*keys, "share", F.col("__v").alias(value), F.col("target").alias("rank"))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank", parts: int = 64) -> DataFrame:
    """The first k rows of each group in an order that should be total, with their rank from 1.

    Groups are cut into parts by their rows' contents first; each part keeps k
    rows, and at most parts * k rows of a group meet. A scan task's own rows are
    cut to k before they are shuffled.
    """
    cut = df.withColumn("__part", F.pmod(digest_of(df), F.lit(parts)))
    within = cut.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).where(F.col(out) <= k)
    return within.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k).drop("__part")


def multiset(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows that both have ("common"), each as often as the one that has it less often, or that left has more often ("more"), as often as it has more.

    One aggregation over signed counts; nulls are equal to nulls at any depth.
    Columns must be the same; maps can't be compared.
    """
    if left.columns != right.columns:
        raise ValueError("both sides need the same columns")
    if how not in ("common", "more"):
        raise ValueError(f"unknown operation {how}")
    signed = left.withColumns({"__a": F.lit(1), "__b": F.lit(0)}).unionByName(right.withColumns({"__a": F.lit(0), "__b": F.lit(1)}))
    counted = signed.groupBy(*left.columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    times = F.least("__a", "__b") if how == "common" else F.col("__a") - F.col("__b")
    return counted.withColumn("__n", times.cast("int")).where("__n > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), "__n"))).select(*left.columns)
