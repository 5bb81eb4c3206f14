"""Registered queries return a row for every document, whatever its text."""

import re

from millrace.functions import text as T
from millrace.operators import text
from millrace.plans.queries import QUERIES


def test_documents_without_tokens_stay(spark, tmp_path):
    rows = [(1, "a fine a fine day"), (2, None), (3, ""), (4, " \n\t"), (5, "https://example.com/a"), (6, "day a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    encoded = {r.ord: (r.n, r.joined) for r in QUERIES["text_encode"](spark, str(tmp_path)).collect()}
    assert encoded == {1: (5, "4,5,4,5,6"), 6: (2, "6,4")} | {i: (0, "") for i in (2, 3, 4, 5)}
    decoded = {r.ord: r.joined for r in QUERIES["text_decode"](spark, str(tmp_path)).collect()}
    assert decoded == {1: "a fine a fine day", 6: "day a"} | {i: "" for i in (2, 3, 4, 5)}


def test_numbers_go_from_every_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    numbers = 0

    def expected(value):
        nonlocal numbers
        value, n = re.subn(r"\b\d+\b", " ", value.lower())
        numbers += n
        return " ".join(re.sub(r"[^\w\s]", " ", value).split())

    found = {r.doc_id: r.cleaned for r in QUERIES["text_remove_numbers"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {i: expected(t) for i, t in docs.items()}
    assert numbers > 100


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    found = text.clean(empty, config=T.TextConfig(remove_numbers=True, remove_punctuation=True))
    assert found.count() == 0 and {"doc_id", "cleaned"} <= set(found.columns)
