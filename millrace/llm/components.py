"""Connected components over links, in rounds that are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """Labels of linked nodes: node and label, the smallest node reachable.

    links has columns a and b; each link counts both ways, repeats are fine.
    Every round takes the smallest label among a node's neighbours and then the
    label of that label, so rounds grow with the logarithm of a chain. Nothing
    but a count of changes comes to the driver.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"), F.lit(True).alias("changed")), "labels")
    while state.where("changed").limit(1).count():
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = state.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        further = state.select(F.col("node").alias("next"), F.col("label").alias("further"))
        lower = lower.join(further, "next").select("node", F.least("next", "further").alias("next"), "label")
        state = written(lower.select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("changed")), "labels")
    return state.select("node", "label")
