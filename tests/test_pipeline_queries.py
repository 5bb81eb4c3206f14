"""Pipeline queries against their SQL over texts and languages that are null or blank by themselves."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.plans.pipeline import Pipeline, PipelineConfig
from millrace.plans.queries import ORACLES, QUERIES

from .oracle import check, connect

TEXTS = ("some words", None, "", " \n\t", " ", "more words")
LANGS = ("en", None, "", "fr", "only with blanks of its own")


@pytest.mark.parametrize("name", ["pipeline_errors", "pipeline_facts"])
def test_nothing_in_the_table(spark, tmp_path, name):
    rows = [(i, TEXTS[i % 6], LANGS[i % 4]) for i in range(48)] + [(101, None, LANGS[4]), (-4, "a", None), (-3, None, None), (None, None, None), (None, "a", "en")]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows]})
    pq.write_table(table, tmp_path / "documents.parquet")
    check(spark, connect(str(tmp_path)), QUERIES[name], ORACLES[name], str(tmp_path))


def test_errors_of_what_is_null_or_blank(spark):
    """The pipeline itself tells them, whatever the queries give it."""
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = Pipeline(PipelineConfig(error_handling="log")).process(rows, "text").collect()
    assert {r.id for r in found if r.error} == {1, 2, 3, 4}
