"""Text validators: each adds a result column (see issues.result).

Other than strings are a matter of the column's type; a null text is reported
as INVALID_TYPE and fails.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf
from ..functions import quality as Q
from ..functions import text as T
from . import issues as I


@dataclass(frozen=True)
class TextLimits:
    """What texts must keep to; None is no limit."""

    min_length: int | None = None
    max_length: int | None = None
    min_words: int | None = None
    max_words: int | None = None
    min_sentences: int | None = None
    max_sentences: int | None = None
    check_profanity: bool = False
    check_harmful: bool = False
    max_special_ratio: float | None = None
    encoding: str = "utf-8"
    check_json: bool = False
    check_xml: bool = False
    languages: tuple[str, ...] | None = None
    min_readability: float | None = None
    min_unique_ratio: float = 0.3



def _not_text(validator: str) -> Column:
    return I.issue(I.ERROR, "INVALID_TYPE", "a string is expected", validator=validator)


def _finish(df: DataFrame, text_col: str, out: str, validator: str, checks: Sequence[tuple[Column, Column]], metadata: dict[str, Column], data_id: str | None) -> DataFrame:
    found = F.when(F.col(text_col).isNull(), F.array(_not_text(validator)).cast(I.ISSUES)).otherwise(I.collect(checks))
    df = df.withColumn("__issues", found)
    facts = {k: F.when(F.col(text_col).isNotNull(), v) for k, v in metadata.items()}
    made = I.result(I.failed_on_error(F.col("__issues")), F.col("__issues"), facts, validator, F.col(data_id) if data_id else None)
    return df.withColumn(out, made).drop("__issues")


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds __words, __n_words and __n_sentences, each computed once per row."""
    df = df.withColumn("__words", T.words(F.col(text_col)))
    return df.withColumn("__n_words", F.size("__words")).withColumn("__n_sentences", F.size(T.sentences(F.col(text_col))))


def validate_length(df: DataFrame, limits: TextLimits, text_col: str = "text", out: str = "result", data_id: str | None = None) -> DataFrame:
    """Characters outside the limits are errors, words warnings, sentences information."""
    name, columns = "length", df.columns
    df = measure(df, text_col).withColumn("__chars", F.length(text_col))
    checks = []
    for column, low, high, severity, low_code, high_code, field in (
        ("__chars", limits.min_length, limits.max_length, I.ERROR, "TEXT_TOO_SHORT", "TEXT_TOO_LONG", "length"),
        ("__n_words", limits.min_words, limits.max_words, I.WARNING, "TOO_FEW_WORDS", "TOO_MANY_WORDS", "word_count"),
        ("__n_sentences", limits.min_sentences, limits.max_sentences, I.INFO, "FEW_SENTENCES", "MANY_SENTENCES", "sentence_count"),
    ):
        value = F.col(column)
        if low is not None:
            checks.append((value < low, I.issue(severity, low_code, F.format_string("%s, at least %s wanted", value.cast("string"), F.lit(str(low))), field, value, name)))
        if high is not None:
            checks.append((value > high, I.issue(severity, high_code, F.format_string("%s, at most %s wanted", value.cast("string"), F.lit(str(high))), field, value, name)))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    facts = {"char_length": F.col("__chars"), "word_count": F.col("__n_words"), "sentence_count": F.col("__n_sentences"), "avg_word_length": per("__chars", "__n_words"), "avg_sentence_length": per("__n_words", "__n_sentences")}
    return _finish(df, text_col, out, name, checks, facts, data_id).select(*columns, out)


def validate_content(df: DataFrame, limits: TextLimits, text_col: str = "text", out: str = "result", data_id: str | None = None) -> DataFrame:
    """Listed words are a warning, harmful patterns an error, many special characters a warning."""
    name, columns, text = "content", df.columns, F.col(text_col)
    checks, facts = [], {}
    if limits.check_profanity:
        df = df.withColumn("__listed", Q.profanity(text))
        checks.append((F.size("__listed") > 0, I.issue(I.WARNING, "PROFANITY_DETECTED", F.format_string("%d listed words", F.size("__listed")), "content", F.array_join("__listed", ","), name)))
    if limits.check_harmful:
        df = df.withColumn("__harmful", Q.harmful(text))
        checks.append((F.col("__harmful") > 0, I.issue(I.ERROR, "HARMFUL_CONTENT", F.format_string("%d harmful patterns", F.col("__harmful")), "content", F.col("__harmful"), name)))
    if limits.max_special_ratio is not None:
        df = df.withColumn("__ratio", Q.special_ratio(text))
        facts["special_char_ratio"] = F.col("__ratio")
        checks.append((F.col("__ratio") > limits.max_special_ratio, I.issue(I.WARNING, "HIGH_SPECIAL_CHAR_RATIO", F.format_string("special characters: %.4f", F.col("__ratio")), "special_chars", F.col("__ratio"), name)))
    return _finish(df, text_col, out, name, checks, facts, data_id).select(*columns, out)


def validate_encoding(df: DataFrame, limits: TextLimits | None = None, text_col: str = "text", out: str = "result", data_id: str | None = None) -> DataFrame:
    """Control and unassigned characters are warnings; bytes that don't decode, and strings that can't be encoded, errors.

    text_col may be a string or binary column. UTF-8 is checked by built-in
    functions; other encodings need Python.
    """
    name, columns, encoding = "encoding", df.columns, (limits or TextLimits()).encoding
    canonical = codecs.lookup(encoding).name
    binary = df.schema[text_col].dataType.simpleString() == "binary"
    if canonical == "utf-8":
        good = F.is_valid_utf8(F.col(text_col)) if binary else F.lit(True)
        df = df.withColumn("__text", F.when(good, F.col(text_col).cast("string")))
    else:

        @F.pandas_udf("string")
        def decoded(values: pd.Series) -> pd.Series:
            def one(v):
                try:
                    return None if v is None else v.decode(canonical) if isinstance(v, bytes) else v.encode(canonical) and v
                except UnicodeError:
                    return None

            return values.map(one)

        df = df.withColumn("__text", decoded(F.col(text_col)))
        if not binary:
            df = df.withColumn("__text", F.when(F.col(text_col) == "", "").otherwise(F.col("__text")))
    bad = F.col(text_col).isNotNull() & F.col("__text").isNull()
    seen = F.col("__text") if binary else F.col(text_col)
    df = df.withColumn("__cc", Q.control_characters(seen)).withColumn("__cn", Q.unassigned_characters(seen))
    checks = [(bad, I.issue(I.ERROR, "ENCODING_ERROR", f"not {encoding}", validator=name))]
    if binary:
        checks.append((~bad, I.issue(I.INFO, "ENCODING_SUCCESS", f"decoded as {encoding}", validator=name)))
    checks.append((F.col("__cc") > 0, I.issue(I.WARNING, "CONTROL_CHARACTERS", F.format_string("%d control characters", F.col("__cc")), validator=name)))
    checks.append((F.col("__cn") > 0, I.issue(I.WARNING, "INVALID_UNICODE", F.format_string("%d unassigned characters", F.col("__cn")), validator=name)))
    facts = {"encoding": F.when(F.lit(not binary) | ~bad, F.lit(encoding)), "control_char_count": F.col("__cc"), "invalid_char_count": F.col("__cn")}
    return _finish(df, text_col, out, name, checks, facts, data_id).select(*columns, out)


FORMAT = "code string, detail string, kind string, size long, odd long"


def check_json(text: Column) -> Column:
    """Struct of code, detail, kind (dict, list, str, int, float, bool or NoneType) and size (keys or items).

    Built-in functions decide; only texts with NaN or Infinity, which the
    accepted dialect allows and Spark's parser doesn't, go through Python.
    """
    variant = F.try_parse_json(text)
    shape = F.schema_of_variant(variant)
    kind = (
        F.when(shape.startswith("OBJECT"), "dict")
        .when(shape.startswith("ARRAY"), "list")
        .when(shape == "STRING", "str")
        .when(shape == "BOOLEAN", "bool")
        .when(shape == "VOID", "NoneType")
        .when(text.rlike(r"[.eE]"), "float")
        .otherwise("int")
    )
    size = F.when(kind == "dict", F.size(F.array_distinct(F.json_object_keys(text)))).when(kind == "list", F.json_array_length(text))
    native = F.struct(F.when(variant.isNull(), "INVALID_JSON").otherwise("VALID_JSON").alias("code"), F.lit(None).cast("string").alias("detail"), F.when(variant.isNotNull(), kind).alias("kind"), F.when(variant.isNotNull(), size).cast("long").alias("size"), F.lit(None).cast("long").alias("odd"))
    return F.when(variant.isNull() & text.rlike(r"NaN|Infinity|[{\[]"), _lenient_json(text)).otherwise(native)


@arrow_udf(FORMAT)
def _lenient_json(values: pd.Series) -> pd.DataFrame:
    def one(v):
        try:
            found = json.loads(v)
        except (ValueError, TypeError, RecursionError) as error:
            return "INVALID_JSON", str(error), None, None, None
        return "VALID_JSON", None, type(found).__name__, len(found) if isinstance(found, dict | list) else None, None

    return _frame(values, one)


@arrow_udf(FORMAT)
def check_xml(values: pd.Series) -> pd.DataFrame:
    """Code, and the root's tag as detail."""

    def one(v):
        try:
            return "VALID_XML", ET.fromstring(v).tag, None, None, None
        except (ET.ParseError, ValueError) as error:
            return "INVALID_XML", str(error), None, None, None

    return _frame(values, one)


@arrow_udf(FORMAT)
def check_csv(values: pd.Series) -> pd.DataFrame:
    """Code, the first five rows of another width than the first as detail, the width as kind, rows as size, and how many rows are odd."""

    def one(v):
        try:
            rows = list(csv.reader(io.StringIO(v)))
        except csv.Error as error:
            return "CSV_PARSE_ERROR", str(error), None, None, None
        if not rows:
            return "EMPTY_CSV", None, None, None, None
        odd = [i for i, row in enumerate(rows) if len(row) != len(rows[0])]
        return "INCONSISTENT_CSV_COLUMNS" if odd else "VALID_CSV", ",".join(map(str, odd[:5])) or None, str(len(rows[0])), len(rows), len(odd)

    return _frame(values, one)


def _frame(values: pd.Series, one: Callable) -> pd.DataFrame:
    rows = [(None,) * 5 if v is None else one(v) for v in values]
    names = [c.split()[0] for c in FORMAT.split(", ")]
    found = pd.DataFrame(rows, columns=names)
    return found.astype({"size": "Int64", "odd": "Int64"})


#: Severities of the format codes.
FORMAT_SEVERITY = {"VALID_JSON": I.INFO, "INVALID_JSON": I.ERROR, "VALID_XML": I.INFO, "INVALID_XML": I.ERROR, "EMPTY_CSV": I.WARNING, "INCONSISTENT_CSV_COLUMNS": I.ERROR, "VALID_CSV": I.INFO, "CSV_PARSE_ERROR": I.ERROR}


def validate_format(df: DataFrame, kind: str = "json", limits: TextLimits | None = None, text_col: str = "text", out: str = "result", data_id: str | None = None) -> DataFrame:
    """Texts must be JSON, XML or CSV; the limits may ask for JSON and XML checks besides."""
    name, columns, limits = "format", df.columns, limits or TextLimits()
    wanted = [k for k, on in (("json", kind == "json" or limits.check_json), ("xml", kind == "xml" or limits.check_xml), ("csv", kind == "csv")) if on]
    checks, facts = [], {}
    for k in wanted:
        column = f"__{k}"
        df = df.withColumn(column, {"json": check_json, "xml": check_xml, "csv": check_csv}[k](F.col(text_col)))
        for code, severity in FORMAT_SEVERITY.items():
            if k.upper() in code:
                checks.append((F.col(f"{column}.code") == code, I.issue(severity, code, F.coalesce(F.col(f"{column}.detail"), F.lit(code.replace("_", " ").lower())), validator=name)))
        if k == "json":
            facts |= {"json_type": F.col("__json.kind"), "json_keys": F.when(F.col("__json.kind") == "dict", F.col("__json.size")), "json_items": F.when(F.col("__json.kind") == "list", F.col("__json.size"))}
        elif k == "xml":
            facts["xml_root_tag"] = F.when(F.col("__xml.code") == "VALID_XML", F.col("__xml.detail"))
        else:
            facts |= {"csv_rows": F.col("__csv.size"), "csv_columns": F.col("__csv.kind"), "inconsistent_rows": F.col("__csv.odd")}
    return _finish(df, text_col, out, name, checks, facts, data_id).select(*columns, out)


def validate_language(df: DataFrame, limits: TextLimits, text_col: str = "text", out: str = "result", data_id: str | None = None) -> DataFrame:
    """A language that isn't among the allowed ones is a warning."""
    name, columns = "language", df.columns
    df = df.withColumn("__language", Q.language(F.col(text_col)))
    checks = []
    if limits.languages:
        checks.append((~F.col("__language").isin(list(limits.languages)), I.issue(I.WARNING, "LANGUAGE_NOT_ALLOWED", F.format_string("%s is not allowed", F.col("__language")), "language", F.col("__language"), name)))
    return _finish(df, text_col, out, name, checks, {"detected_language": F.col("__language")}, data_id).select(*columns, out)


def validate_quality(df: DataFrame, limits: TextLimits | None = None, text_col: str = "text", out: str = "result", data_id: str | None = None) -> DataFrame:
    """Low readability (if a limit is set) and little variety of words are warnings."""
    name, columns, limits = "quality", df.columns, limits or TextLimits()
    df = df.withColumn("__low", F.lower(text_col)).withColumn("__words", T.words(F.col("__low"))).withColumn("__n_sentences", F.size(T.sentences(F.col(text_col))))
    df = df.withColumn("__n_words", F.size("__words")).withColumn("__unique", F.size(F.array_distinct("__words"))).withColumn("__syllables", Q.all_syllables(F.col("__low")))
    df = df.withColumn("__ease", Q.readability(F.col("__n_words"), F.col("__n_sentences"), F.col("__syllables")))
    some = F.col("__n_words") > 0
    df = df.withColumn("__ratio", F.when(some, F.col("__unique") / F.col("__n_words")))
    checks = []
    if limits.min_readability is not None:
        checks.append((F.col("__ease") < limits.min_readability, I.issue(I.WARNING, "LOW_READABILITY", F.format_string("readability %.2f", F.col("__ease")), "readability", F.col("__ease"), name)))
    checks.append((F.coalesce(F.col("__ratio") < limits.min_unique_ratio, F.lit(False)), I.issue(I.WARNING, "LOW_VOCABULARY_DIVERSITY", F.format_string("unique words: %.4f", F.col("__ratio")), validator=name)))
    facts = {"readability_score": F.col("__ease"), "unique_word_ratio": F.col("__ratio"), "avg_word_length": F.when(some, Q.letters_in(F.col(text_col)) / F.col("__n_words")), "unique_word_count": F.when(some, F.col("__unique")), "total_word_count": F.when(some, F.col("__n_words"))}
    return _finish(df, text_col, out, name, checks, facts, data_id).select(*columns, out)
