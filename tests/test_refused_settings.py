"""Every kind of setting is tried, not tokenizers alone."""

from millrace.plans.queries import ORACLES, QUERIES

from .oracle import check, connect

SF = "/root/testdata/sf0.001"


def test_all_kinds_of_settings(spark):
    found = QUERIES["refused_settings"](spark, SF).collect()
    assert {r.what for r in found} == {"tokenizer", "modality", "batch", "workers", "operations"}
    assert {r.what for r in found if r.refused} == {"tokenizer", "modality", "batch", "workers"}
    assert {r.what for r in found if not r.refused} == {"tokenizer", "modality", "batch", "workers", "operations"}


def test_sql(spark):
    check(spark, connect(SF), QUERIES["refused_settings"], ORACLES["refused_settings"], SF)
