import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.functions import text as T
from millrace.functions.text import TextConfig
from millrace.operators import images, sampling
from millrace.plans.pipeline import Chain, Pipeline, PipelineConfig, content_key

PNG = images.encode_png(np.zeros((4, 4, 3), np.uint8))


@pytest.fixture
def samples(spark):
    return spark.createDataFrame([("t1", "text", "Hello World", None), ("t2", "text", "  ", None), ("i1", "image", None, PNG), ("i2", "image", None, b"x")], "id string, modality string, text string, content binary")


def test_error_handling(samples):
    skip = Pipeline(PipelineConfig()).process_all(samples)
    assert skip.keys() == {"text", "image"}
    assert [r.id for r in skip["text"].collect()] == ["t1"] and [r.id for r in skip["image"].collect()] == ["i1"]
    log = Pipeline(PipelineConfig(error_handling="log")).process_all(samples)
    assert {r.id: bool(r.error) for r in log["image"].collect()} == {"i1": False, "i2": True}
    with pytest.raises(Exception, match="blank"):
        Pipeline(PipelineConfig(error_handling="raise")).process(samples.where("modality = 'text'"), "text").collect()
    with pytest.raises(ValueError):
        Pipeline().process(samples, "audio")
    with pytest.raises(ValueError):
        PipelineConfig(error_handling="other")


def test_multimodal_rows(spark):
    rows = spark.createDataFrame([("a", "Hi there", PNG), ("b", None, b"bad")], "id string, text string, image binary")
    found = {r.id: r for r in Pipeline().process_multimodal(rows).collect()}
    assert found["a"].text_result == ["hi", "there"] and found["a"].image_result.shape == [224, 224, 3]
    assert found["b"].text_result is None and found["b"].image_result is None


def test_validity_and_keys(samples):
    pipeline = Pipeline()
    assert [r.valid for r in pipeline.validate(samples.where("modality = 'image'"), "image").orderBy("id").collect()] == [True, False]
    assert not pipeline.validate(samples, "audio").first().valid
    keyed = content_key(samples, "text", "Text")
    assert keyed.first().content_key.startswith("Text_")
    pipeline.keep(keyed)
    assert pipeline.statistics()["kept"] == 1
    pipeline.clear()
    assert pipeline.statistics()["kept"] == 0


def test_chain(spark):
    chain = Chain().add(lambda df: df.withColumn("x", F.lower(F.trim("x")))).add(lambda df, mark: df.withColumn("x", F.concat(F.lit(mark), "x")), mark="[PROCESSED] ")
    df = spark.createDataFrame([("  HELLO WORLD  ",)], "x string")
    assert chain.process(df).first().x == "[PROCESSED] hello world"
    chain.clear()
    assert chain.process(df).first().x == "  HELLO WORLD  "


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(2).write.mode("overwrite").parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    stream = streaming.read(spark, str(tmp_path / "in"), events.schema, 1)
    windowed = run(streaming.event_statistics(stream, late="365 days"), "complete", "windows")
    assert windowed.agg(F.sum("n")).first()[0] == events.count()
    cleaned = run(streaming.preprocess_stream(stream.select(F.col("event_type").alias("text")), TextConfig(unicode_form=None)), "append", "cleaned")
    assert cleaned.count() == events.count()
    counts = run(streaming.token_counts(stream.select(F.col("event_type").alias("text"))), "complete", "tokens")
    assert counts.agg(F.sum("count")).first()[0] == events.count()


def test_settings_are_refused_when_the_plan_is_made(spark):
    df = spark.createDataFrame([("a",)], "text string")
    for run in (lambda: T.tokenize(F.col("text"), "other"), lambda: Pipeline().process(df, "smell"), lambda: sampling.check_settings(0), lambda: sampling.check_settings(1, -1)):
        with pytest.raises(ValueError):
            run()
