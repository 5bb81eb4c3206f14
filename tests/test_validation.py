import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import issues as I
from millrace.operators import schema_rules as H
from millrace.operators import text_validators as V


def result(spark, validate, value, *args, kind="string", **kwargs):
    return validate(spark.createDataFrame([(value,)], f"text {kind}"), *args, **kwargs).first().result


def codes(found):
    return [i.code for i in found.issues]


def test_length(spark):
    found = result(spark, V.validate_length, "Short", V.TextLimits(min_length=10, min_words=5, max_words=200, min_sentences=2))
    assert (found.status, codes(found)) == ("failed", ["TEXT_TOO_SHORT", "TOO_FEW_WORDS", "FEW_SENTENCES"])
    assert found.metadata["avg_word_length"] == "5.0"
    assert result(spark, V.validate_length, "", V.TextLimits()).metadata["avg_word_length"] == "0.0"
    none = result(spark, V.validate_length, None, V.TextLimits())
    assert (none.status, codes(none), none.metadata) == ("failed", ["INVALID_TYPE"], {})


def test_content(spark):
    limits = V.TextLimits(check_profanity=True, check_harmful=True, max_special_ratio=0.1)
    found = result(spark, V.validate_content, "OFFENSIVE Kill !!!", limits)
    assert (found.status, codes(found)) == ("failed", ["PROFANITY_DETECTED", "HARMFUL_CONTENT", "HIGH_SPECIAL_CHAR_RATIO"])
    assert codes(result(spark, V.validate_content, "offensive, skill", limits)) == []


def test_encoding(spark):
    assert codes(result(spark, V.validate_encoding, "a\x00b\n")) == ["CONTROL_CHARACTERS"]
    assert codes(result(spark, V.validate_encoding, bytearray(b"\xff\xfe"), kind="binary")) == ["ENCODING_ERROR"]
    assert codes(result(spark, V.validate_encoding, bytearray(b"ok"), kind="binary")) == ["ENCODING_SUCCESS"]
    latin = V.TextLimits(encoding="latin-1")
    assert codes(result(spark, V.validate_encoding, "日本", latin)) == ["ENCODING_ERROR"]
    assert codes(result(spark, V.validate_encoding, "é", latin)) == []


@pytest.mark.parametrize("text,kind,size", [('{"name": "test", "value": 123}', "dict", 2), ('{"a": 1, "a": 2}', "dict", 1), ("[1, 2, 3]", "list", 3), ('"s"', "str", None), ("1.5", "float", None), ("12", "int", None), ("true", "bool", None), ("null", "NoneType", None), ('{"a": NaN}', "dict", 1)])
def test_json(spark, text, kind, size):
    assert type(json.loads(text)).__name__ == kind
    found = result(spark, V.validate_format, text, "json")
    assert (found.status, codes(found), found.metadata["json_type"]) == ("passed", ["VALID_JSON"], kind)
    assert found.metadata.get("json_keys", found.metadata.get("json_items")) == (None if size is None else str(size))


def test_other_formats(spark):
    assert codes(result(spark, V.validate_format, "{bad", "json")) == ["INVALID_JSON"]
    found = result(spark, V.validate_format, '<a xmlns="u"><b/></a>', "xml")
    assert (codes(found), found.metadata["xml_root_tag"]) == (["VALID_XML"], "{u}a")
    assert codes(result(spark, V.validate_format, "<a><b></a>", "xml")) == ["INVALID_XML"]
    for text, code in (("", "EMPTY_CSV"), ("a,b\n1,2\n", "VALID_CSV"), ('a,b\n"x,y",2\n', "VALID_CSV"), ("a,b\n\n1,2\n", "INCONSISTENT_CSV_COLUMNS"), ("a,b\n1\n", "INCONSISTENT_CSV_COLUMNS")):
        assert codes(result(spark, V.validate_format, text, "csv")) == [code]


def test_language_and_quality(spark):
    assert codes(result(spark, V.validate_language, "привет", V.TextLimits(languages=("en",)))) == ["LANGUAGE_NOT_ALLOWED"]
    found = result(spark, V.validate_quality, "word " * 20, V.TextLimits(min_readability=101))
    assert (found.status, codes(found)) == ("passed", ["LOW_READABILITY", "LOW_VOCABULARY_DIVERSITY"])
    assert set(result(spark, V.validate_quality, "").metadata) == {"readability_score"}


def test_result_algebra(spark):
    df = spark.range(1)
    none = F.lit(None).cast(I.ISSUE)
    empty = I.result(F.lit("passed"), I.collect([]))
    warning, error = I.issue("warning", "W", "w"), I.issue("error", "E", "e")

    def status(column):
        row = df.select(column.alias("r")).first().r
        return row.status, [i.severity for i in row.issues]

    assert status(I.add_issue(empty, warning)) == ("passed", ["warning"])
    assert status(I.add_issue(empty, error)) == ("partial", ["error"])
    assert status(I.apply_check(empty, warning, strict=True)) == ("passed", ["error"])
    assert status(I.apply_check(empty, none)) == ("passed", [])
    failed = I.result(F.lit("failed"), F.array(error))
    assert status(I.merge(empty, failed))[0] == "failed"
    assert status(I.merge(empty, I.add_issue(empty, error)))[0] == "partial"
    assert status(I.merge(empty, I.add_issue(empty, warning)))[0] == "passed"
    both = I.merge(I.result(F.lit("passed"), I.collect([]), {"a": F.lit(1), "b": F.lit(1)}), I.result(F.lit("passed"), I.collect([]), {"b": F.lit(2)}))
    assert df.select(both.alias("r")).first().r.metadata == {"a": "1", "b": "2"}
    assert json.loads(df.select(I.as_json(failed).alias("j")).first().j)["error_count"] == 1


def test_single_checks(spark):
    values = spark.createDataFrame([(0, 25.0), (1, 75.0), (2, 125.0), (3, None), (4, 10.0), (5, float("nan"))], "i int, v double")
    found = values.select("i", I.check_range(F.col("v"), 20, 100)["code"].alias("c")).orderBy("i").collect()
    assert [r.c for r in found] == [None, None, "VALUE_ABOVE_MAX", None, "VALUE_BELOW_MIN", None]
    row = spark.createDataFrame([("", 0, None, "ab")], "s string, n int, z string, p string").select(
        I.check_not_empty(F.col("s"))["code"].alias("a"),
        I.check_not_empty(F.col("n"), "number")["code"].alias("b"),
        I.check_not_null(F.col("z"))["code"].alias("c"),
        I.check_enum(F.col("p"), [])["code"].alias("d"),
        I.check_pattern(F.col("p"), "b")["code"].alias("e"),
        I.check_pattern(F.col("p"), "a|x")["code"].alias("f"),
    )
    assert tuple(row.first()) == ("EMPTY_VALUE", "EMPTY_VALUE", "NULL_VALUE", "INVALID_ENUM_VALUE", "PATTERN_MISMATCH", None)


USER = (
    H.SchemaBuilder("user")
    .add_string("username", min_length=3, max_length=50)
    .add_string("email", pattern=r"[^@\s]+@[^@\s]+\.\w+$")
    .add_integer("age", min_value=0, max_value=150)
    .add_list("tags", item_type=H.FieldType.STRING, max_items=10, required=False)
    .add_boolean("is_active")
    .set_strict()
    .build()
)


def judged(spark, schema, value):
    found = H.validate_json(spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "j string"), schema, "j").first().result
    return found.status, sorted((i.code, i.field) for i in found.issues)


def test_user_record(spark):
    good = {"username": "anna", "email": "a@b.cd", "age": 30, "tags": ["x"], "is_active": True}
    assert judged(spark, USER, good) == ("passed", [])
    bad = {"username": "a", "email": "nope", "age": 200, "tags": ["t"] * 20, "unknown": 1}
    assert judged(spark, USER, bad) == ("failed", [("MISSING_REQUIRED_FIELD", "is_active"), ("PATTERN_MISMATCH", "email"), ("STRING_TOO_SHORT", "username"), ("TOO_MANY_ITEMS", "tags"), ("UNKNOWN_FIELD", "unknown"), ("VALUE_ABOVE_MAX", "age")])


def test_missing_null_and_bool_as_int(spark):
    rules = H.SchemaBuilder("r").add_integer("a", nullable=True).add_float("b", required=False).build()
    assert judged(spark, rules, {"a": None}) == ("passed", [])
    assert judged(spark, rules, {"a": True, "b": 1}) == ("passed", [])
    assert judged(spark, rules, {"b": None}) == ("failed", [("MISSING_REQUIRED_FIELD", "a"), ("NULL_NOT_ALLOWED", "b")])
    assert judged(spark, rules, {"a": "1"}) == ("failed", [("TYPE_MISMATCH", "a")])
    assert judged(spark, rules, "[1]") == ("failed", [("INVALID_DATA_TYPE", "")])
    assert judged(spark, rules, "{broken") == ("failed", [("INVALID_DATA_TYPE", "")])


def test_nested_strict_and_items(spark):
    inner = H.SchemaBuilder("inner").add_integer("n", min_value=1).set_strict().build()
    rules = H.SchemaBuilder("outer").add_dict("d", inner).add_list("l", item_type=H.FieldType.INTEGER, required=False).build()
    assert judged(spark, rules, {"d": {"n": 1, "x": 0}}) == ("partial", [("UNKNOWN_FIELD", "d.x")])
    assert judged(spark, rules, {"d": {"n": 0}, "l": [1, "a", None]}) == ("failed", [("ITEM_TYPE_MISMATCH", "l[1]"), ("ITEM_TYPE_MISMATCH", "l[2]"), ("VALUE_BELOW_MIN", "d.n")])
    with pytest.raises(ValueError):
        H.FieldRule("x", H.FieldType.LIST, item_type=H.FieldType.ANY)


def test_own_checks(spark):
    def odd(v):
        if v == "boom":
            raise RuntimeError("broken")
        return {"no": False, "msg": "a message"}.get(v, 1)

    rules = H.SchemaBuilder("c").add_custom("v", H.FieldType.STRING, python_check=odd).build()
    df = spark.createDataFrame([("no",), ("msg",), ("boom",), ("fine",)], "v string")
    found = [[(i.code, i.message) for i in r.result.issues] for r in H.validate_columns(df, rules).collect()]
    assert found == [[("CUSTOM_VALIDATION_FAILED", "v fails its check")], [("CUSTOM_VALIDATION_FAILED", "a message")], [("CUSTOM_VALIDATOR_ERROR", "broken")], []]


def test_typed_columns(spark):
    rules = H.SchemaBuilder("t").add_string("s").add_float("x", max_value=5).add_string("gone").build()
    df = spark.createDataFrame([(1, float("nan")), (2, 6.0)], "s int, x double")
    found = [[(i.code, i.field) for i in r.result.issues] for r in H.validate_columns(df, rules).collect()]
    assert found == [[("TYPE_MISMATCH", "s"), ("MISSING_REQUIRED_FIELD", "gone")], [("TYPE_MISMATCH", "s"), ("VALUE_ABOVE_MAX", "x"), ("MISSING_REQUIRED_FIELD", "gone")]]
    assert rules.to_struct_type().simpleString() == "struct<s:string,x:double,gone:string>"
