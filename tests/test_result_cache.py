"""What was processed before isn't processed again."""

from pyspark.sql import functions as F

from millrace.plans.result_cache import ResultCache
from millrace.workspace import new_path


def counted(spark):
    """A process that counts the rows it takes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(text):
        seen.add(1)
        return len(text)

    return seen, lambda rows: rows.withColumn("length", length("text"))


def test_second_runs_process_new_contents_only(spark):
    seen, process = counted(spark)
    path = new_path(spark, "cache")
    rows = [(1, "one"), (2, "three"), (3, "one"), (4, None), (None, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    cache = ResultCache(spark, path, "text", ("config", 1), process)
    expected = sorted((str(i), t, None if t is None else len(t)) for i, t in rows)
    read = lambda found: sorted((str(r.id), r.text, r.length) for r in found.collect())
    assert read(cache.apply(df)) == expected and seen.value == 3
    assert read(cache.apply(df)) == expected and seen.value == 3 and len(cache.runs()) == 1
    more = df.union(spark.createDataFrame([(6, "sixth"), (7, "sixth")], df.schema))
    again = ResultCache(spark, path, "text", ("config", 1), process)
    assert {r.id: r.run for r in again.apply(more).collect()} == {1: 1, 2: 1, 3: 1, 4: None, None: 1, 6: 2, 7: 2}
    assert seen.value == 4
    again.compact()
    assert len(again.runs()) == 1 and again.apply(more).count() == 7 and seen.value == 4


def test_another_configuration_is_another_cache(spark):
    seen, process = counted(spark)
    path = new_path(spark, "cache")
    df = spark.createDataFrame([(1, "one")], "id int, text string")
    for config in (1, 2):
        ResultCache(spark, path, "text", config, process).apply(df).collect()
    assert seen.value == 2


def test_empty_and_null_only_tables(spark):
    seen, process = counted(spark)
    cache = ResultCache(spark, new_path(spark, "cache"), "text", 0, process)
    df = spark.createDataFrame([(1, None)], "id int, text string")
    assert cache.apply(df.where("false")).collect() == []
    (row,) = cache.apply(df).collect()
    assert (row.id, row.length, row.run) == (1, None, None) and seen.value == 0


def test_a_run_that_died_counts_for_nothing(spark):
    _, process = counted(spark)
    cache = ResultCache(spark, new_path(spark, "cache"), "text", 0, process)
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    df.select(F.lit("key").alias("content_key"), F.lit(9).alias("length"), F.lit(1).alias("run")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{cache.path}/000001-dead")
    assert cache.runs() == []
    assert cache.apply(df).first().length == 1
