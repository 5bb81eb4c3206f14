"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a place in [0, 1) from a digest of its id and text, in hex
digits; the last digits tell equal rows apart. Words are summed by source and
bucket (the first digits); the bucket in which a source's budget ends is the
only one whose documents are summed by the next digits, and so on down to the
last. What a source takes is then a prefix of the digest order, found without
sorting any document, and a larger budget always takes a superset of a smaller
one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Hex digits of a place's content, and of the number that tells equal rows apart.
CONTENT, NUMBER = 12, 4
#: Digits that name a bucket, level by level: 4096 buckets, 4096 in one of these, and so on, whatever the size of the data.
LEVELS = (3, 6, CONTENT, CONTENT + NUMBER)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_weights(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by source from sizes(source, size).

    Sources in code-point order, null last, weigh `weights`, repeating. They
    share `share` times all sizes by weight; a target stops at `most` times its
    source's size, and the excess goes to the others by weight until none is
    above. That end is one level per unit of weight: sources ordered by
    most * size / weight fill up first, and the level is read off running sums
    where the next source is not filled by it (from there on levels only fall).
    The windows below run over one row per source, not over documents.

    Returns source, source_size, target. Sources without words get 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("source").isNull(), "source")
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(rest)
    sources = sources.withColumn("__level", level).withColumn("__open", F.col("__level") * F.col("__weight") <= F.col("__cap"))
    settled = F.max(F.when(F.col("__open"), F.col("__level"))).over(everything)
    return sources.withColumn("__settled", settled).select(
        "source", "source_size", F.when(F.col("__settled").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__settled") * F.col("__weight"))).alias("target")
    )


def place(id_col: str, text_col: str) -> Column:
    """A record's place, as hex digits. Equal rows differ in the last ones only, by the number that the scan gives them."""
    content = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    number = F.lower(F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0"))
    return F.concat(F.substring(content, 1, CONTENT), F.substring(number, 1, NUMBER))


def thresholds(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """What each source takes: source, source_size, target, base (times that every document is taken), last (the place up to which documents are taken once more; null: none).

    rows: source, size, place. The result has a row per source, is written and
    so of known size: Spark broadcasts it only below its threshold.
    """
    first = F.substring("place", 1, LEVELS[0])
    buckets = written(rows.groupBy("source", first.alias("bucket")).agg(F.sum("size").alias("size")), "mix-histogram")
    budgets = target_weights(buckets, weights, share, most)
    base = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    budgets = budgets.withColumn("base", base.cast("long")).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    budgets = written(budgets, "mix-budgets")

    # Of each source only the bucket in which its budget ends is summed by the next digits. At most 4096 rows a source, but
    # on the third level, where a bucket has the documents of 1 / 16 million of a source.
    edge = budgets.select("source", "rest", F.lit(0.0).alias("start"))
    for level, digits in enumerate(LEVELS):
        if level:
            near = rows.alias("r").join(edge.alias("e"), F.expr(f"r.source <=> e.source AND substring(r.place, 1, {LEVELS[level - 1]}) = e.bucket"))
            buckets = near.groupBy(F.col("r.source").alias("source"), F.substring("r.place", 1, digits).alias("bucket")).agg(F.sum("r.size").alias("size"))
        in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = buckets.withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
        met = sums.alias("c").join(edge.select("source", "rest", "start").alias("e"), F.expr("c.source <=> e.source")).select("c.source", "c.bucket", "c.size", "e.rest", (F.col("e.start") + F.col("c.before")).alias("start"))
        if level < len(LEVELS) - 1:
            edge = written(met.where("start <= rest AND start + size > rest").select("source", "rest", "start", "bucket"), "mix-edges")
    # The last one taken is the last whose middle is within the budget; if none is, those before the edge are.
    last = met.where("start + size / 2 <= rest").groupBy("source").agg(F.max("bucket").alias("last"))
    plan = budgets.alias("g").join(edge.alias("e"), F.expr("g.source <=> e.source"), "left").join(last.alias("l"), F.expr("g.source <=> l.source"), "left")
    last = F.when(F.col("g.rest") > 0, F.coalesce("l.last", "e.bucket"))
    return written(plan.select("g.source", "g.source_size", "g.target", "g.base", last.alias("last")), "mix-plan")


def copies(base: str, last: str, where: Column) -> Column:
    """How often a document is taken under its source's threshold."""
    return F.col(base) + F.coalesce(where <= F.col(last), F.lit(False)).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place(id_col, text_col).alias("place")), "mix-sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: id_col, source_col, size, source_size,
    target (its source's), copies, taken (copies * size). Every source takes
    each document floor(target / source_size) times, and documents of low
    digest once more, up to the sub-bucket that brings it nearest its target.

    Null texts (size 0) and null ids are rows like others, a null source is a
    source. Equal rows share a place but for their number in the scan, so that
    a budget can end among them: how many of them are taken is the same in
    every run. Documents without words are taken as often as any of their
    place, or not at all if their source has no words. Extra columns are
    ignored. An empty table gives an empty result.
    """
    rows = sized(docs, id_col, text_col, source_col)
    plan = thresholds(rows, weights, share, most)
    met = rows.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source"), "left")
    times = copies("p.base", "p.last", F.col("r.place"))
    out = met.select(F.col("r.id").alias(id_col), F.col("r.source").alias(source_col), "r.size", "p.source_size", "p.target", times.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: docs with every row as often as the mix takes it, with the columns of docs. Texts are not shuffled.

    Null texts, ids and sources, equal rows and an empty table as for mix();
    equal rows are numbered by the scan of docs, so how many of them a budget
    that ends among them takes may vary by a few if docs is split anew.
    """
    plan = thresholds(sized(docs, id_col, text_col, source_col), weights, share, most)
    plan = plan.select(*[F.col(c).alias(f"__mr_{c}") for c in plan.columns])
    placed = docs.withColumn("__mr_place", place(id_col, text_col))
    met = placed.join(plan, placed[source_col].eqNullSafe(F.col("__mr_source")))
    times = copies("__mr_base", "__mr_last", F.col("__mr_place"))
    return met.withColumn("__mr_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
