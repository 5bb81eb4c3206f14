"""Table functions, and CSV files of several layouts."""

import pytest

from millrace.functions import tables
from millrace.sources import storage


@pytest.fixture(autouse=True)
def known(spark):
    tables.register(spark)


def call(spark, function, text, columns="a,b"):
    df = spark.createDataFrame([(text,)], "t string")
    return [tuple(r)[1:] for r in spark.sql(f"SELECT * FROM {{df}} x, LATERAL {function}(x.t, '{columns}')", df=df).collect()]


def test_csv_records(spark):
    assert call(spark, "csv_records", '1,2\n\n"x\ny","q""r"\n3\n4,5,6\n') == [(0, "1", "2", None), (1, "x\ny", 'q"r', None), (2, None, None, "1 fields, not 2"), (3, None, None, "3 fields, not 2")]
    assert call(spark, "csv_records", None) == call(spark, "csv_records", "") == []
    ((n, a, b, error),) = call(spark, "csv_records", '"open')
    assert (n, a, b) == (0, None, None) and error


def test_json_elements(spark):
    assert call(spark, "json_elements", '[{"a": 1, "b": "x"}, 7, {"b": [1, null]}]') == [(0, "1", "x", None), (1, None, None, "no object but int"), (2, None, "[1, null]", None)]
    assert call(spark, "json_elements", '{"a": "only"}') == [(0, "only", None, None)]
    assert call(spark, "json_elements", None) == [] and call(spark, "json_elements", "[]") == []
    ((_, _, _, error),) = call(spark, "json_elements", "{")
    assert error
    with pytest.raises(Exception, match="names must differ"):
        call(spark, "json_elements", "[]", "a,a")


def test_changes(spark):
    df = spark.createDataFrame([("k", 3, None), ("k", 1, "x"), ("k", 2, "x"), ("k", 4, None), ("k", 5, "x"), (None, 1, None), (None, 2, "y")], "who string, at int, what string")
    found = spark.sql("SELECT * FROM changes(TABLE({df}), 'who', 'at', 'what')", df=df)
    assert found.columns == ["who", "at", "before", "after"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("k", 1, None, "x"), ("k", 3, "x", None), ("k", 5, None, "x"), (None, 1, None, None), (None, 2, None, "y")], key=str)
    assert spark.sql("SELECT * FROM changes(TABLE({df}), 'who', 'at', 'what')", df=df.where("false")).collect() == []


def test_csvs_of_several_layouts(spark, tmp_path):
    for name, text in (("a", "x,y\n1,one\n2,two\n"), ("b", 'y,"z z"\nthree,3.5\n'), ("c", "x,y\n,\n"), ("d", "x\n"), ("e", "")):
        (tmp_path / f"{name}.csv").write_text(text)
    paths = [f"file://{tmp_path}/{n}.csv" for n in "abcde"]
    df = storage.read_csvs(spark, [*paths, f"{tmp_path}/absent.csv"])
    assert dict(df.dtypes) == {"x": "int", "y": "string", "z z": "double"}
    assert sorted(map(str, (r.asDict() for r in df.collect()))) == sorted(map(str, [{"x": 1, "y": "one", "z z": None}, {"x": 2, "y": "two", "z z": None}, {"x": None, "y": "three", "z z": 3.5}, {"x": None, "y": None, "z z": None}]))
    typed = storage.read_csvs(spark, paths, schema="y string, x long, other date")
    assert typed.dtypes == [("y", "string"), ("x", "bigint"), ("other", "date")] and typed.count() == 4
    assert [r.path for r in storage.missing_files(spark, [*paths, f"{tmp_path}/absent.csv"]).collect()] == [f"{tmp_path}/absent.csv"]
