"""Declarative schema rules, compiled to one issues column.

Rules check typed columns (what is missing or of another type is known when
the plan is made) or JSON texts (known per row).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.arrow import arrow_udf
from . import issues as I

NAME = "schema"


class FieldType(Enum):
    STRING = "string"
    INTEGER = "integer"
    FLOAT = "float"
    BOOLEAN = "boolean"
    LIST = "list"
    DICT = "dict"
    ANY = "any"
    OBJECT = "object"
    BYTES = "bytes"
    NULL = "null"


#: Types that list items can be checked for.
ITEM_TYPES = (FieldType.STRING, FieldType.INTEGER, FieldType.FLOAT, FieldType.BOOLEAN, FieldType.DICT)


@dataclass(frozen=True)
class FieldRule:
    """What a field must be. An empty allowed_values allows everything. check is a Column predicate; python_check a function of the value that returns False, a message, or anything else if all is well."""

    name: str
    type: FieldType
    required: bool = True
    nullable: bool = False
    min_value: float | None = None
    max_value: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed_values: tuple = ()
    item_type: FieldType | None = None
    min_items: int | None = None
    max_items: int | None = None
    nested: Schema | None = None
    check: Callable[[Column], Column] | None = None
    python_check: Callable[[Any], Any] | None = None
    description: str = ""
    default: Any = None

    def __post_init__(self) -> None:
        if self.item_type is not None and self.item_type not in ITEM_TYPES:
            raise ValueError(f"items can't be checked for {self.item_type.value}")


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[FieldRule, ...] = ()
    strict: bool = False
    description: str = ""

    def add_field(self, rule: FieldRule) -> Schema:
        return replace(self, fields=(*self.fields, rule))

    def get_field(self, name: str) -> FieldRule | None:
        return next((f for f in self.fields if f.name == name), None)

    def to_struct_type(self) -> S.StructType:
        """The types of the rules, for readers; what has no type of its own is a string."""
        plain = {FieldType.STRING: S.StringType(), FieldType.INTEGER: S.LongType(), FieldType.FLOAT: S.DoubleType(), FieldType.BOOLEAN: S.BooleanType(), FieldType.BYTES: S.BinaryType()}

        def of(rule: FieldRule) -> S.DataType:
            if rule.type is FieldType.LIST:
                return S.ArrayType(plain.get(rule.item_type, S.StringType()))
            if rule.type is FieldType.DICT and rule.nested:
                return rule.nested.to_struct_type()
            return plain.get(rule.type, S.StringType())

        return S.StructType([S.StructField(f.name, of(f), f.nullable or not f.required) for f in self.fields])


@dataclass
class SchemaBuilder:
    """Builds a schema field by field; every call returns the builder."""

    name: str
    description: str = ""
    _fields: list[FieldRule] = field(default_factory=list)
    _strict: bool = False

    def _add(self, name: str, kind: FieldType, rules: dict) -> SchemaBuilder:
        self._fields.append(FieldRule(name, kind, **rules))
        return self

    def add_string(self, name: str, **rules) -> SchemaBuilder:
        return self._add(name, FieldType.STRING, rules)

    def add_integer(self, name: str, **rules) -> SchemaBuilder:
        return self._add(name, FieldType.INTEGER, rules)

    def add_float(self, name: str, **rules) -> SchemaBuilder:
        return self._add(name, FieldType.FLOAT, rules)

    def add_boolean(self, name: str, **rules) -> SchemaBuilder:
        return self._add(name, FieldType.BOOLEAN, rules)

    def add_list(self, name: str, **rules) -> SchemaBuilder:
        return self._add(name, FieldType.LIST, rules)

    def add_dict(self, name: str, nested: Schema | None = None, **rules) -> SchemaBuilder:
        return self._add(name, FieldType.DICT, {"nested": nested, **rules})

    def add_custom(self, name: str, kind: FieldType = FieldType.ANY, **rules) -> SchemaBuilder:
        return self._add(name, kind, rules)

    def set_strict(self, strict: bool = True) -> SchemaBuilder:
        self._strict = strict
        return self

    def build(self) -> Schema:
        return Schema(self.name, tuple(self._fields), self._strict, self.description)


class Typed:
    """A value whose type is a column's."""

    def __init__(self, column: Column, kind: S.DataType):
        self.column, self.kind = column, kind

    def child(self, name: str) -> Typed | None:
        if isinstance(self.kind, S.StructType) and name in self.kind.names:
            return Typed(self.column[name], self.kind[name].dataType)
        return None

    def has(self, name: str) -> Column:
        return F.lit(self.child(name) is not None)

    def names(self) -> Column:
        return F.array(*[F.lit(n) for n in self.kind.names]) if isinstance(self.kind, S.StructType) else F.array().cast("array<string>")

    def is_null(self) -> Column:
        return self.column.isNull()

    def fits(self, kind: FieldType) -> Column:
        whole = (S.ByteType, S.ShortType, S.IntegerType, S.LongType, S.BooleanType)
        fit = {
            FieldType.STRING: (S.StringType,),
            FieldType.INTEGER: whole,
            FieldType.FLOAT: (*whole, S.FloatType, S.DoubleType, S.DecimalType),
            FieldType.BOOLEAN: (S.BooleanType,),
            FieldType.LIST: (S.ArrayType,),
            FieldType.DICT: (S.StructType, S.MapType),
            FieldType.BYTES: (S.BinaryType,),
            FieldType.NULL: (S.NullType,),
        }
        if kind in (FieldType.ANY, FieldType.OBJECT):
            return F.lit(True)
        exact = isinstance(self.kind, S.DecimalType) and self.kind.scale == 0 and kind is FieldType.INTEGER
        return F.lit(exact or isinstance(self.kind, fit[kind]))

    def possible(self, kind: FieldType) -> bool:
        """Whether rules of a type can apply at all."""
        return {FieldType.STRING: isinstance(self.kind, S.StringType), FieldType.LIST: isinstance(self.kind, S.ArrayType), FieldType.DICT: isinstance(self.kind, S.StructType | S.MapType)}.get(kind, not isinstance(self.kind, S.ArrayType | S.StructType | S.MapType | S.BinaryType | S.StringType))

    def text(self) -> Column:
        simple = not isinstance(self.kind, S.ArrayType | S.StructType | S.MapType)
        return self.column.cast("string") if simple else F.to_json(self.column)

    def number(self) -> Column:
        return self.column.cast("double")

    def type_name(self) -> Column:
        return F.lit(self.kind.simpleString())

    def size(self) -> Column:
        return F.size(self.column)

    def odd_items(self, kind: FieldType) -> Column:
        """(place, text) of items of another type; null items are of no type."""
        item = Typed(F.lit(None), self.kind.elementType)
        return F.filter(F.transform(self.column, lambda x, i: F.when(x.isNull() | ~item.fits(kind), F.struct(i.alias("at"), x.cast("string").alias("text")))), lambda x: x.isNotNull())


#: Numbers that stand for those that JSON texts may have and a variant can't be parsed from.
NO_JSON = {"NaN": -1.7976931348623131e308, "Infinity": 1.7976931348623157e308, "-Infinity": -1.7976931348623157e308}


@arrow_udf("string")
def _strict_json(values: pd.Series) -> pd.Series:
    """JSON texts without repeated keys (the last one holds) and without numbers that aren't JSON; null for what is no JSON."""

    def one(v):
        try:
            return json.dumps(json.loads(v, parse_constant=NO_JSON.__getitem__))
        except (ValueError, TypeError, RecursionError):
            return None

    return values.map(one)


class Json:
    """A value inside a parsed JSON text."""

    def __init__(self, column: Column):
        self.column = column
        self.shape = F.schema_of_variant(column)

    def child(self, name: str) -> Json:
        for quote in "'\"":
            if name and quote not in name and "?" not in name:
                return Json(F.variant_get(self.column, f"$[{quote}{name}{quote}]", "variant"))
        # No path can have such a name.
        return Json(F.try_element_at(F.try_variant_get(self.column, "$", "map<string,variant>"), F.lit(name)))

    def names(self) -> Column:
        return F.when(self.shape.startswith("OBJECT"), F.array_distinct(F.coalesce(F.json_object_keys(F.to_json(self.column)), F.array().cast("array<string>"))))

    def has(self, name: str) -> Column:
        return F.coalesce(F.array_contains(self.names(), name), F.lit(False))

    def is_null(self) -> Column:
        return self.column.isNull() | F.is_variant_null(self.column)

    def fits(self, kind: FieldType) -> Column:
        if kind in (FieldType.ANY, FieldType.OBJECT):
            return F.lit(True)
        return F.coalesce(self._fits(self.shape, kind), F.lit(False))

    @staticmethod
    def _fits(shape: Column, kind: FieldType) -> Column:
        whole = (shape == "BIGINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$") | (shape == "BOOLEAN")
        return {
            FieldType.STRING: shape == "STRING",
            FieldType.INTEGER: whole,
            FieldType.FLOAT: whole | shape.startswith("DECIMAL") | (shape == "DOUBLE"),
            FieldType.BOOLEAN: shape == "BOOLEAN",
            FieldType.LIST: shape.startswith("ARRAY"),
            FieldType.DICT: shape.startswith("OBJECT"),
        }.get(kind, F.lit(False))

    def possible(self, kind: FieldType) -> bool:
        return True

    def text(self) -> Column:
        plain, number = F.coalesce(F.try_variant_get(self.column, "$", "string"), F.to_json(self.column)), self._double()
        for name, mark in NO_JSON.items():
            plain = F.when(number == mark, name).otherwise(plain)
        return plain

    def _double(self) -> Column:
        return F.when(self.shape == "DOUBLE", F.try_variant_get(self.column, "$", "double"))

    def number(self) -> Column:
        whole = F.when(self.shape == "BOOLEAN", F.try_variant_get(self.column, "$", "boolean").cast("double")).otherwise(F.try_variant_get(self.column, "$", "double"))
        return F.when(self._double() == NO_JSON["NaN"], F.lit(math.nan)).otherwise(whole)

    def type_name(self) -> Column:
        return F.lower(self.shape)

    def items(self) -> Column:
        return F.coalesce(F.try_variant_get(self.column, "$", "array<variant>"), F.array().cast("array<variant>"))

    def size(self) -> Column:
        return F.size(self.items())

    def odd_items(self, kind: FieldType) -> Column:
        return F.filter(F.transform(self.items(), lambda x, i: F.when(~F.coalesce(self._fits(F.schema_of_variant(x), kind), F.lit(False)), F.struct(i.alias("at"), F.to_json(x).alias("text")))), lambda x: x.isNotNull())


def _issue(code: str, message: Column | str, name: str, value: Column | None = None, severity: str = I.ERROR) -> Column:
    return I.issue(severity, code, message, name, value, NAME)


def _string_rules(rule: FieldRule, value: Typed | Json, name: str) -> list[tuple[Column, Column]]:
    text, n = value.text(), F.length(value.text())
    checks = []
    if rule.min_length is not None:
        checks.append((n < rule.min_length, _issue("STRING_TOO_SHORT", F.format_string("%d characters, at least %d wanted", n, F.lit(rule.min_length)), name, text)))
    if rule.max_length is not None:
        checks.append((n > rule.max_length, _issue("STRING_TOO_LONG", F.format_string("%d characters, at most %d wanted", n, F.lit(rule.max_length)), name, text)))
    if rule.pattern:
        checks.append((~text.rlike(rf"\A(?:{rule.pattern})"), _issue("PATTERN_MISMATCH", f"no match of {rule.pattern}", name, text)))
    if rule.allowed_values:
        checks.append((~text.isin(list(rule.allowed_values)), _issue("INVALID_ENUM_VALUE", F.format_string("%s is not allowed", text), name, text)))
    return checks


def _number_rules(rule: FieldRule, value: Typed | Json, name: str) -> list[tuple[Column, Column]]:
    number, text = value.number(), value.text()
    checks = []
    if rule.min_value is not None:
        checks.append((number < float(rule.min_value), _issue("VALUE_BELOW_MIN", F.format_string("%s is below %s", text, F.lit(str(rule.min_value))), name, text)))
    if rule.max_value is not None:  # Spark orders NaN above all numbers; it is above no bound
        checks.append(((number > float(rule.max_value)) & ~F.isnan(number), _issue("VALUE_ABOVE_MAX", F.format_string("%s is above %s", text, F.lit(str(rule.max_value))), name, text)))
    if rule.allowed_values:
        checks.append((~number.isin([float(v) for v in rule.allowed_values]), _issue("INVALID_ENUM_VALUE", F.format_string("%s is not allowed", text), name, text)))
    return checks


def _list_rules(rule: FieldRule, value: Typed | Json, name: str) -> Column:
    n, checks = value.size(), []
    if rule.min_items is not None:
        checks.append((n < rule.min_items, _issue("TOO_FEW_ITEMS", F.format_string("%d items, at least %d wanted", n, F.lit(rule.min_items)), name)))
    if rule.max_items is not None:
        checks.append((n > rule.max_items, _issue("TOO_MANY_ITEMS", F.format_string("%d items, at most %d wanted", n, F.lit(rule.max_items)), name)))
    found = I.collect(checks)
    if rule.item_type is None:
        return found
    kind = rule.item_type
    odd = F.transform(value.odd_items(kind), lambda x: I.issue(I.ERROR, "ITEM_TYPE_MISMATCH", f"the item is no {kind.value}", F.concat(F.lit(f"{name}["), x["at"].cast("string"), F.lit("]")), x["text"], NAME))
    return F.concat(found, odd.cast(I.ISSUES))


def _python_rule(rule: FieldRule, value: Typed | Json, name: str) -> Column:
    run = rule.python_check

    @F.pandas_udf("code string, message string")
    def judged(values: pd.Series) -> pd.DataFrame:
        def one(v):
            if v is None:
                return None, None
            try:
                found = run(v)
            except Exception as error:  # the rule's own failure is a finding
                return "CUSTOM_VALIDATOR_ERROR", str(error)
            if found is False:
                return "CUSTOM_VALIDATION_FAILED", f"{name} fails its check"
            return ("CUSTOM_VALIDATION_FAILED", found) if isinstance(found, str) else (None, None)

        return pd.DataFrame([one(v) for v in values], columns=["code", "message"], dtype=object)

    found = judged(value.column if isinstance(value, Typed) else value.text())
    return I.collect([(found["code"].isNotNull(), _issue(found["code"], found["message"], name, value.text()))])


def _field_issues(rule: FieldRule, value: Typed | Json, name: str) -> Column:
    """Issues of a field that is there: null, then type, then what the type asks for, then its own check."""
    specific = I.collect([])
    if value.possible(rule.type):
        if rule.type is FieldType.STRING:
            specific = I.collect(_string_rules(rule, value, name))
        elif rule.type in (FieldType.INTEGER, FieldType.FLOAT):
            specific = I.collect(_number_rules(rule, value, name))
        elif rule.type is FieldType.LIST:
            specific = _list_rules(rule, value, name)
        elif rule.type is FieldType.DICT and rule.nested:
            specific = issues_of(rule.nested, value, f"{name}.")
    if rule.check:
        own = rule.check(value.column if isinstance(value, Typed) else value.text())
        specific = F.concat(specific, I.collect([(~F.coalesce(own, F.lit(True)), _issue("CUSTOM_VALIDATION_FAILED", f"{name} fails its check", name, value.text()))]))
    if rule.python_check:
        specific = F.concat(specific, _python_rule(rule, value, name))
    nothing = I.collect([])
    null = nothing if rule.nullable else F.array(_issue("NULL_NOT_ALLOWED", f"{name} is null", name)).cast(I.ISSUES)
    wrong = F.array(_issue("TYPE_MISMATCH", F.concat(F.lit(f"{name}: {rule.type.value} wanted, not "), value.type_name()), name, value.text())).cast(I.ISSUES)
    return F.when(value.is_null(), null).when(~value.fits(rule.type), wrong).otherwise(specific)


def issues_of(schema: Schema, value: Typed | Json, prefix: str = "") -> Column:
    """Issues of all fields in the rules' order, then of fields that no rule names (if strict)."""
    parts = []
    for rule in schema.fields:
        name, child = prefix + rule.name, value.child(rule.name)
        missing = F.array(_issue("MISSING_REQUIRED_FIELD", f"{name} is missing", name)).cast(I.ISSUES) if rule.required else I.collect([])
        parts.append(missing if child is None else F.when(~value.has(rule.name), missing).otherwise(_field_issues(rule, child, name)))
    if schema.strict:
        known = F.array(*[F.lit(f.name) for f in schema.fields]) if schema.fields else F.array().cast("array<string>")
        unknown = F.array_sort(F.array_except(value.names(), known))
        parts.append(F.transform(unknown, lambda n: I.issue(I.WARNING, "UNKNOWN_FIELD", F.concat(n, F.lit(" is in no rule")), F.concat(F.lit(prefix), n), None, NAME)).cast(I.ISSUES))
    return F.concat(*parts) if parts else I.collect([])


def validate_columns(df: DataFrame, schema: Schema, out: str = "result", data_id: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Checks a DataFrame's columns (or some of them) as the fields of a record."""
    names = list(columns or df.columns)
    row = Typed(F.struct(*[F.col(n) for n in names]), S.StructType([df.schema[n] for n in names]))
    return _with_result(df, schema, issues_of(schema, row), out, data_id)


def validate_json(df: DataFrame, schema: Schema, json_col: str, out: str = "result", data_id: str | None = None) -> DataFrame:
    """Checks JSON texts; what isn't a JSON object is INVALID_DATA_TYPE. Of repeated keys the last one holds, and NaN and Infinity are numbers; only such texts go through Python."""
    text, strict = F.col(json_col), F.try_parse_json(json_col)
    odd = strict.isNull() & text.rlike(r"NaN|Infinity|[{\[]")
    df2 = df.withColumn("__variant", F.when(odd, F.try_parse_json(_strict_json(F.when(odd, text)))).otherwise(strict))
    value = Json(F.col("__variant"))
    bad = F.array(_issue("INVALID_DATA_TYPE", "an object is expected", "")).cast(I.ISSUES)
    found = F.when(F.coalesce(value.shape.startswith("OBJECT"), F.lit(False)), issues_of(schema, value)).otherwise(bad)
    return _with_result(df2, schema, found, out, data_id).drop("__variant")


def _with_result(df: DataFrame, schema: Schema, found: Column, out: str, data_id: str | None) -> DataFrame:
    df = df.withColumn("__issues", found)
    made = I.result(I.failed_or_partial(F.col("__issues")), F.col("__issues"), {"schema_name": F.lit(schema.name)}, NAME, F.col(data_id) if data_id else None)
    return df.withColumn(out, made).drop("__issues")
