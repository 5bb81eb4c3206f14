"""Cells of fingerprints never go through the driver."""

from millrace.llm import simhash


def test_cells_are_not_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("xxhash64(id) AS fingerprint").write.parquet(str(tmp_path / "nodes"))
    pairs = simhash.close_pairs(spark.read.parquet(str(tmp_path / "nodes")))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
