"""Arrow UDFs that need no session before they are called."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of results that a task gathers before it sends them on.
HELD = 1 << 22


def arrow_udf(result: str) -> Callable[[Callable], Callable[..., Column]]:
    """Makes a function of pandas series one of columns; `result` is its type."""

    def made(run: Callable) -> Callable[..., Column]:
        @functools.wraps(run)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(run, result)(*columns)

        return call

    return made


def in_parts(columns: tuple[pa.Array, ...], one: Callable, size: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """What `one` makes of each row, in arrays of about HELD bytes: what a batch of many rows becomes is never held at once."""
    found, held = [], 0
    for i in range(len(columns[0])):
        found.append(one(*(c[i].as_py() for c in columns)))
        held += size(found[-1])
        if held >= HELD:
            yield array_of(found, kind)
            found, held = [], 0
    if found:
        yield array_of(found, kind)


def array_of(values: list, kind: pa.DataType) -> pa.Array:
    """Values, or tuples of a struct's fields, as an array."""
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    fields = [kind.field(i) for i in range(kind.num_fields)]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), fields, strict=True)], fields=fields)


def row_udf(result: str, kind: pa.DataType, one: Callable, size: Callable) -> Callable[..., Column]:
    """Makes a function of one row's values one of columns. `result` and `kind` are its type (of a struct: tuples of its fields), `size` tells the bytes of a value that it returns."""

    def of_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from in_parts((batch,), one, size, kind)

    def of_many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from in_parts(batch, one, size, kind)

    def call(*columns: Column) -> Column:
        return F.arrow_udf(of_one if len(columns) == 1 else of_many, result)(*columns)

    return call
