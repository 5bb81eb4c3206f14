"""Table functions: the records of a text as rows, and a key's rows in order with what changed.

They are polymorphic: `analyze` gives the columns by the arguments of the call.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _names(argument: AnalyzeArgument) -> list[str]:
    if not argument.isConstantExpression or not argument.value:
        raise ValueError("the columns must be a constant list of names, divided by commas")
    names = [n.strip() for n in argument.value.split(",")]
    if len(set(names)) < len(names) or {"record", "error"} & set(names):
        raise ValueError("names must differ from each other and from record and error")
    return names


def _records(names: list[str]) -> AnalyzeResult:
    kinds = StructType().add("record", IntegerType())
    for name in names:
        kinds = kinds.add(name, StringType())
    return AnalyzeResult(kinds.add("error", StringType()))


class CsvRecords:
    """csv_records(text, 'a,b,c'): a row for each record with its number from 0, or with the record's own error. Null and empty texts have no records; blank lines are none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        return _records(_names(columns))

    def eval(self, text: str | None, columns: str) -> Iterator[tuple]:
        width, n = len(columns.split(",")), 0
        reader = csv.reader((text or "").splitlines(keepends=True), strict=True)
        while True:
            try:
                record = next(reader)
            except StopIteration:
                return
            except csv.Error as error:  # the rest of the text is part of this record
                yield (n, *[None] * width, str(error))
                return
            if record:
                fits = len(record) == width
                yield (n, *record, None) if fits else (n, *[None] * width, f"{len(record)} fields, not {width}")
                n += 1


class JsonElements:
    """json_elements(text, 'a,b'): a row for each element of a JSON array (or for the one value), with the texts of these fields; elements that are no objects, and texts that are no JSON, have an error. Null texts have no rows."""

    @staticmethod
    def analyze(text: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        return _records(_names(columns))

    def eval(self, text: str | None, columns: str) -> Iterator[tuple]:
        names = [n.strip() for n in columns.split(",")]
        if text is None:
            return
        try:
            found = json.loads(text)
        except (ValueError, RecursionError) as error:
            yield (0, *[None] * len(names), str(error))
            return
        for n, element in enumerate(found if isinstance(found, list) else [found]):
            if not isinstance(element, dict):
                yield (n, *[None] * len(names), f"no object but {type(element).__name__}")
                continue
            values = [element.get(k) for k in names]
            yield (n, *[v if v is None or isinstance(v, str) else json.dumps(v) for v in values], None)


class Changes:
    """changes(TABLE(t), 'key', 'order', 'value'): for each key, the rows at which the value differs from the row before, with both; a key's rows stream by in order, and only the last value is held. The first row of a key is a change from null."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        out = StructType().add(key.value, kinds[key.value]).add(order.value, kinds[order.value]).add("before", kinds[value.value]).add("after", kinds[value.value])
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def __init__(self) -> None:
        self.seen, self.last = False, None

    def eval(self, row: Row, key: str, order: str, value: str) -> Iterator[tuple]:
        now = row[value]
        if not self.seen or now != self.last:
            yield row[key], row[order], self.last, now
        self.seen, self.last = True, now


def register(spark: SparkSession) -> None:
    """Makes csv_records, json_elements and changes known to SQL."""
    for name, made in (("csv_records", CsvRecords), ("json_elements", JsonElements), ("changes", Changes)):
        spark.udtf.register(name, udtf(made))
