"""Cross-site boilerplate lines by distinct-site spread, with DataFrame functions only.

Each line's sites go into a HyperLogLog sketch; sketches merge map-side and
across the shuffle, so a line that a third of all rows hold costs a sketch per
task, not a row per occurrence. Lines whose estimate is near the threshold get
exact distinct counts; then lines of enough sites leave every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: 2**12 registers: the estimate's standard error is about 1.6 %.
LOG_REGISTERS = 12
#: Estimates this near the threshold (a share of it, and at least one site) are counted exactly; over six standard errors.
BAND = 0.1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """128 bits of a line without blanks around it, so that no two of even 10**12 lines share a key; blank lines have none."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("second"), bare).alias("b")))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Keys of the lines that at least min_sites distinct sites hold. lines: line, site; a null site is one site."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("none"))
    sites = lines.where(F.col("line").isNotNull()).select("line", F.xxhash64(site).alias("site"))
    spread = written(sites.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites")).where(F.col("sites") >= min_sites - max(1.0, BAND * min_sites)), "line-spread")
    margin = max(1.0, BAND * min_sites)
    near = spread.where(F.col("sites") <= min_sites + margin).select("line")
    exact = sites.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(F.col("sites") > min_sites + margin).select("line").union(exact.select("line"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8) -> DataFrame:
    """Removes lines that stand on at least min_sites distinct sites.

    Returns one row per input row: id_col, n_lines, n_removed, kept (the text
    without these lines). Lines end at "\\n" and are compared without blanks
    around them; blank lines stay.

    Null texts count as empty: one blank line. A null site is a site of its
    own, null ids are told apart by their texts, equal rows get equal results
    (and count once for their site), extra columns are ignored, an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).alias("site"))
    lines = rows.select("site", F.explode(lines_of(F.col("text"))).alias("line")).select(line_key(F.col("line")).alias("line"), "site")
    common = written(boilerplate(lines, min_sites), "boilerplate")
    placed = rows.select("id", F.xxhash64("text").alias("key"), F.posexplode(lines_of(F.col("text")))).select("id", "key", "pos", line_key(F.col("col")).alias("line"))
    cuts = placed.join(common, "line", "left_semi").groupBy("id", "key").agg(F.collect_set("pos").alias("cut"))
    cuts = cuts.select(F.col("id").alias("cut_id"), F.col("key").alias("cut_key"), "cut")
    keyed = rows.select("id", "text", F.xxhash64("text").alias("key"))
    met = keyed.join(cuts, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    own = lines_of(F.col("text"))
    # Positions that stay come from one set difference, so a text of many lines and many cuts takes no square of them.
    met = met.withColumn("own", own).withColumn("stay", F.when(F.col("cut").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("own") - 1), "cut")))
    kept = F.when(F.col("cut").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform("stay", lambda i: F.get("own", i)), "\n"))
    return met.select(F.col("id").alias(id_col), F.size("own").cast("long").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
