"""Validation issues and results as columns.

An issue is a struct; a result is a struct of status, issues, metadata (a map),
validator and the record's id. Checks are (condition, issue) pairs; the issues
whose condition holds make the result, in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities and statuses.
INFO, WARNING, ERROR, CRITICAL = "info", "warning", "error", "critical"
PASSED, FAILED, SKIPPED, PARTIAL = "passed", "failed", "skipped", "partial"

ISSUE = "struct<severity: string, message: string, field: string, value: string, validator: string, code: string, suggestion: string>"
ISSUES = f"array<{ISSUE}>"


def text_or(value: Column | str | None) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(value).cast("string")


def issue(severity: str, code: str, message: Column | str, field: Column | str | None = None, value: Column | str | None = None, validator: str | None = None, suggestion: str | None = None) -> Column:
    names = ("severity", "message", "field", "value", "validator", "code", "suggestion")
    return F.struct(*[text_or(v).alias(n) for n, v in zip(names, (severity, message, field, value, validator, code, suggestion), strict=True)])


def collect(checks: Sequence[tuple[Column, Column]]) -> Column:
    """Issues whose condition is true."""
    if not checks:
        return F.array().cast(ISSUES)
    return F.filter(F.array(*[F.when(c, i) for c, i in checks]), lambda x: x.isNotNull()).cast(ISSUES)


def serious(issues: Column) -> Column:
    return F.filter(issues, lambda i: i["severity"].isin(ERROR, CRITICAL))


def error_count(issues: Column) -> Column:
    return F.size(serious(issues))


def warning_count(issues: Column) -> Column:
    return F.size(F.filter(issues, lambda i: i["severity"] == WARNING))


def has_errors(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"].isin(ERROR, CRITICAL))


def has_warnings(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == WARNING)


def is_valid(status: Column) -> Column:
    return status == PASSED


def status_after(status: Column, issues: Column) -> Column:
    """What adding issues makes of a status: the first error turns "passed" into "partial"."""
    return F.when((status == PASSED) & has_errors(issues), PARTIAL).otherwise(status)


def failed_on_error(issues: Column) -> Column:
    """The status of validators that leave warnings alone."""
    return F.when(has_errors(issues), FAILED).otherwise(PASSED)


def failed_or_partial(issues: Column) -> Column:
    """The status of validators for which warnings count."""
    return F.when(has_errors(issues), FAILED).when(has_warnings(issues), PARTIAL).otherwise(PASSED)


def result(status: Column, issues: Column, metadata: dict[str, Column] | None = None, validator: str = "", data_id: Column | None = None) -> Column:
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    facts = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(status.alias("status"), issues.alias("issues"), facts.alias("metadata"), F.lit(validator).alias("validator"), (data_id.cast("string") if data_id is not None else F.lit(None).cast("string")).alias("data_id"))


def add_issue(current: Column, new: Column) -> Column:
    """A result with one more issue."""
    issues = F.concat(current["issues"], F.array(new)).cast(ISSUES)
    serious_one = new["severity"].isin(ERROR, CRITICAL)
    return current.withField("issues", issues).withField("status", F.when((current["status"] == PASSED) & serious_one, PARTIAL).otherwise(current["status"]))


def apply_check(current: Column, found: Column, strict: bool = False) -> Column:
    """A result after a check that may have found an issue (null: none). Strict mode turns a warning into an error after it was added, so the status stays."""
    added = add_issue(current, found)
    if strict:
        last = F.transform(added["issues"], lambda i, n: F.when((n == F.size(added["issues"]) - 1) & (i["severity"] == WARNING), i.withField("severity", F.lit(ERROR))).otherwise(i))
        added = added.withField("issues", last.cast(ISSUES))
    return F.when(found.isNull(), current).otherwise(added)


def merge(a: Column, b: Column) -> Column:
    """Two results in one: all issues, the later metadata where both have some. Without errors the first status stays; with some it is "failed" if either was, else "partial"."""
    issues = F.concat(a["issues"], b["issues"])
    status = F.when(has_errors(issues), F.when((a["status"] == FAILED) | (b["status"] == FAILED), FAILED).otherwise(PARTIAL)).otherwise(a["status"])
    own = F.map_filter(a["metadata"], lambda k, _: ~F.map_contains_key(b["metadata"], k))
    return a.withField("issues", issues).withField("status", status).withField("metadata", F.map_concat(own, b["metadata"]))


def as_json(current: Column) -> Column:
    """A result as JSON, with the derived counts."""
    issues = current["issues"]
    return F.to_json(F.struct(current["status"].alias("status"), is_valid(current["status"]).alias("is_valid"), error_count(issues).alias("error_count"), warning_count(issues).alias("warning_count"), issues.alias("issues"), current["metadata"].alias("metadata"), current["validator"].alias("validator"), current["data_id"].alias("data_id")))


def summary(df: DataFrame, issues_col: str = "issues") -> DataFrame:
    """Issues of all records by severity and code; counted before the shuffle."""
    return df.select(F.explode_outer(issues_col).alias("i")).where(F.col("i").isNotNull()).groupBy(F.col("i.severity").alias("severity"), F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


# Single checks: null where there is nothing to report.


def check_range(value: Column, least: float | None = None, most: float | None = None, field: str | None = None) -> Column:
    """Inclusive bounds; one issue at most, the lower bound first. Null and NaN pass."""
    number = value.cast("double")
    found = F.lit(None).cast(ISSUE)
    if most is not None:
        found = F.when((number > most) & ~F.isnan(number), issue(ERROR, "VALUE_ABOVE_MAX", F.format_string("%s is above %s", value.cast("string"), F.lit(str(most))), field, value)).otherwise(found)
    if least is not None:
        found = F.when(number < least, issue(ERROR, "VALUE_BELOW_MIN", F.format_string("%s is below %s", value.cast("string"), F.lit(str(least))), field, value)).otherwise(found)
    return found


def check_not_null(value: Column, field: str | None = None) -> Column:
    return F.when(value.isNull(), issue(ERROR, "NULL_VALUE", "the value is null", field))


def check_not_empty(value: Column, kind: str = "string", field: str | None = None) -> Column:
    """Falsy values: null, empty strings and arrays, zero and false."""
    tests = {"string": lambda v: F.length(v) == 0, "array": lambda v: F.size(v) == 0, "number": lambda v: v == 0, "boolean": lambda v: ~v}
    empty = tests[kind](value)
    return F.when(value.isNull() | empty, issue(ERROR, "EMPTY_VALUE", "the value is empty", field, value if kind != "array" else None))


def check_enum(value: Column, allowed: Sequence, field: str | None = None) -> Column:
    """Membership; with nothing allowed everything is an issue."""
    known = F.coalesce(value.isin(list(allowed)), F.lit(False)) if allowed else F.lit(False)
    return F.when(~known, issue(ERROR, "INVALID_ENUM_VALUE", F.format_string("%s is not allowed", value.cast("string")), field, value))


def check_pattern(value: Column, pattern: str, field: str | None = None) -> Column:
    """The pattern must match at the start."""
    return F.when(~value.rlike(rf"\A(?:{pattern})"), issue(ERROR, "PATTERN_MISMATCH", F.format_string("no match of %s", F.lit(pattern)), field, value))


def check_type(actual: str, expected: Sequence[str], field: str | None = None) -> Column:
    """A column's type is known when the plan is made."""
    return F.lit(None).cast(ISSUE) if actual in expected else issue(ERROR, "TYPE_MISMATCH", f"expected {' or '.join(expected)}, got {actual}", field)
