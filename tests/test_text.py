"""Cleaning and tokens by hand-derived cases and against plain Python on random Unicode."""

import re
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import quality as Q
from millrace.functions import text as T
from millrace.operators import text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("x")).first().x


def cleaned(spark, values, **config):
    rows = list(enumerate(values))
    df = text.clean(spark.createDataFrame(rows, "i int, text string"), config=T.TextConfig(**config))
    return [r.cleaned for r in df.orderBy("i").collect()]


def test_documented_example(spark):
    df = spark.createDataFrame([("Check out this link: https://example.com! Email me at test@email.com",)], "text string")
    assert text.preprocess(df, config=T.TextConfig(tokenizer="word")).first().tokens == ["check", "out", "this", "link", "email", "me", "at"]


def test_urls_end_at_hash_and_tilde(spark):
    assert cleaned(spark, ["a https://x.y/z#part b", "HTTP://X.Y b", "see http://a.b/c~d!"]) == ["a #part b", "b", "see ~d!"]
    assert cleaned(spark, ["HTTP://X.Y b"], lowercase=False) == ["HTTP://X.Y b"]
    assert cleaned(spark, ["a http://" + "x" * 200_000 + " b"]) == ["a b"]


def test_emails_phones_numbers(spark):
    assert cleaned(spark, ["mail a.b@c.de now", "x@y.c|d z"]) == ["mail now", "z"]
    assert cleaned(spark, ["id 9043395 or 555-123-4567 or +1 (555) 123-4567 or 123"]) == ["id or or or 123"]
    assert cleaned(spark, ["a1 12 b 3.5"], remove_numbers=True) == ["a1 b ."]
    assert cleaned(spark, ["snake_case, it's é!"], remove_punctuation=True) == ["snake_case it s é"]


def test_unicode(spark):
    assert cleaned(spark, ["ﬁne １２", "é"]) == ["fine 12", "é"]
    assert cleaned(spark, ["café ñ"], remove_accents=True) == ["cafe n"]
    assert cleaned(spark, ["a\x1c\x1d\x85 b\x0bc"]) == ["a b c"]


def test_lengths_count_characters(spark):
    assert cleaned(spark, ["abc", "abcdef"], min_length=4, max_length=5) == ["", "abcde"]
    df = text.preprocess(spark.createDataFrame([("ab",)], "text string"), config=T.TextConfig(min_length=3, special_tokens=True)).first()
    assert (df.too_short, df.tokens) == (True, [])


def test_tokenizers(spark):
    assert one(spark, "a. b!", lambda c: T.tokenize(c, "sentence")) == ["a", " b", ""]
    assert one(spark, " a  b ", lambda c: T.tokenize(c)) == ["a", "b"]
    with pytest.raises(ValueError):
        T.TextConfig(tokenizer="other")


def test_null_and_blank(spark):
    assert cleaned(spark, [None, "", "  "]) == [None, "", ""]
    df = spark.createDataFrame([(None,), (" ",), ("a",)], "text string")
    assert [r.x for r in df.select(T.is_valid(F.col("text")).alias("x")).collect()] == [False, False, True]


SOME = st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x24FF), max_size=60), min_size=1, max_size=30)


@settings(max_examples=8, deadline=None)
@given(SOME)
def test_whitespace_and_words_as_in_python(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string").select("i", T.words(F.col("text")).alias("w"), T.collapse_space(F.col("text")).alias("c")).orderBy("i")
    for value, row in zip(values, df.collect(), strict=True):
        assert row.w == value.split()
        assert row.c == re.sub(r"\s+", " ", value).strip()


@settings(max_examples=8, deadline=None)
@given(SOME)
def test_counts_as_in_python(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string").select("i", Q.control_characters(F.col("text")).alias("cc"), Q.special_ratio(F.col("text")).alias("r"), T.normalize(F.col("text"), "NFD").alias("d")).orderBy("i")
    for value, row in zip(values, df.collect(), strict=True):
        assert row.cc == sum(unicodedata.category(c) == "Cc" and c not in "\n\r\t" for c in value)
        assert row.d == unicodedata.normalize("NFD", value)
        assert row.r * len(value) == pytest.approx(sum(not c.isalnum() and not c.isspace() for c in value))


def test_characters_that_java_lacks(spark):
    """Every code point that Java and Python could take for something else, as U+0870 once was."""
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    column = F.col("text")
    found = spark.createDataFrame([(c,) for c in known], "text string").select("text", Q.special_ratio(column).alias("special"), T.tokenize(column, "word").alias("words"), T.remove_numbers(column).alias("numberless"), Q.unassigned_characters(column).alias("cn"), T.strip_accents(column).alias("plain")).collect()
    assert len(found) == len(known)
    for r in found:
        c, kind = r.text, unicodedata.category(r.text)
        assert r.special == (not c.isalnum() and not c.isspace()), hex(ord(c))
        assert r.words == re.findall(r"\b\w+\b", c), hex(ord(c))
        assert r.numberless == re.sub(r"\b\d+\b", " ", c), hex(ord(c))
        assert r.cn == (kind == "Cn"), hex(ord(c))
        assert r.plain == "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"), hex(ord(c))
    assert one(spark, "ࡰ", Q.special_ratio) == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeiouyAEbcxzİß \n\u2003,."), max_size=40), min_size=1, max_size=30))
def test_syllables_of_texts_are_those_of_words(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string").select("i", Q.all_syllables(F.lower("text")).alias("n"), T.words(F.col("text")).alias("words"), Q.letters_in(F.col("text")).alias("letters")).orderBy("i")
    each = df.select("i", F.explode_outer("words").alias("w")).groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("w").isNotNull(), Q.syllables(F.col("w")))), F.lit(0)).alias("n")).orderBy("i").collect()
    for row, expected, value in zip(df.collect(), each, values, strict=True):
        assert row.n == expected.n and row.letters == len("".join(value.split()))


def test_syllables_and_language(spark):
    assert [one(spark, w, Q.syllables) for w in ("cake", "cake,", "beautiful", "rhythm", "tsk")] == [1, 2, 3, 1, 1]
    cases = {"你好 world": "en", "你好世界": "zh", "مرحبا": "ar", "привет": "ru", "123": "unknown", "": "unknown", "hello": "en"}
    assert {t: one(spark, t, Q.language) for t in cases} == cases


def test_vocabulary_order_and_round_trip(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b"]), (1, ["c", "a", "<EOS>"])], "ord int, tokens array<string>")
    found = {r.token: r.id for r in text.build_vocabulary(df).collect()}
    # Ties keep the order of first occurrence; a special token in the texts keeps the later id.
    assert found == {"<PAD>": 0, "<UNK>": 1, "<BOS>": 2, "b": 4, "a": 5, "c": 6, "<EOS>": 7}
    vocabulary = text.build_vocabulary(df, min_freq=2)
    encoded = text.encode(df, vocabulary, "ord")
    assert {r.ord: r.ids for r in encoded.collect()} == {0: [4, 5, 4], 1: [1, 5, 3]}
    assert {r.ord: r.tokens for r in text.decode(encoded, vocabulary, "ord").collect()} == {0: ["b", "a", "b"], 1: ["<UNK>", "a", "<EOS>"]}
    with pytest.raises(ValueError):
        text.encode(df, vocabulary.limit(0), "ord")


@pytest.mark.parametrize("limit", [text.LOOKUP_BYTES, 0], ids=["looked up", "joined"])
def test_rows_of_equal_or_no_key_stay_apart(spark, monkeypatch, limit):
    monkeypatch.setattr(text, "LOOKUP_BYTES", limit)
    rows = [(1, ["a", "b"]), (1, ["a", "c"]), (None, ["a"]), (None, ["b", None, "zz"]), (2, []), (2, None)]
    df = spark.createDataFrame(rows, "ord long, tokens array<string>").repartition(3)
    vocabulary = text.build_vocabulary(df)
    ids = {r.token: r.id for r in vocabulary.collect()}
    found = text.encode(df, vocabulary, "ord")
    expected = [(k, [ids.get(t, 1) for t in ts or []]) for k, ts in rows]
    assert sorted(map(str, expected)) == sorted(str((r.ord, r.ids)) for r in found.collect())
    back = [(k, [t if t in ids else "<UNK>" for t in ts or []]) for k, ts in rows]
    assert sorted(map(str, back)) == sorted(str((r.ord, r.tokens)) for r in text.decode(found, vocabulary, "ord").collect())


def test_vocabulary_of_any_order(spark):
    rows = [(3, ["x", "y"]), (1, ["z", "w", "x"]), (None, ["q", "z"]), (2, ["w"])]
    # By frequency, then by first occurrence; a null order comes first.
    for kind, big in (("long", 0), ("long", 1 << 61), ("string", 0)):
        df = spark.createDataFrame([(None if k is None else str(k) if kind == "string" else k + big, t) for k, t in rows], f"ord {kind}, tokens array<string>")
        found = [r.token for r in text.build_vocabulary(df).where("id > 3").orderBy("id").collect()]
        assert found == ["z", "w", "x", "q", "y"]


def test_statistics_of_nothing(spark):
    row = text.statistics(spark.createDataFrame([], "text string")).first()
    assert (row.total_texts, row.avg_length, row.vocabulary_size) == (0, 0.0, 0)


def test_vocabulary_counts_alike_in_batches_and_in_rows(spark, monkeypatch):
    """Orders that fit into one number with a place, others, and null ones; a token that is null; few tokens at a time."""
    import random

    rng = random.Random(2)
    rows = [(rng.choice([None, i]), [rng.choice(["a", "b", "c", "dd", None, "<PAD>"]) for _ in range(rng.randrange(6))] if i % 9 else None) for i in range(80)]
    small = spark.createDataFrame(rows, "ord long, tokens array<string>").repartition(3)
    found = lambda df: sorted(map(tuple, text.build_vocabulary(df, min_freq=2).collect()))
    monkeypatch.setattr(text, "COUNTED", 7)
    assert text._place_bits(small, "tokens", "ord") == 31
    expected = found(small.select(F.col("ord").cast("double").alias("ord"), "tokens"))
    assert found(small) == expected and len(expected) > 4
    large = small.withColumn("ord", F.col("ord") + F.lit(1 << 58))
    assert text._place_bits(large, "tokens", "ord") == 3 and found(large) == expected
    assert found(small.where("false")) == found(small.where("ord < 0"))


def test_tokens_are_looked_up_in_parts(spark, monkeypatch):
    """A batch of many documents is not looked up at once, and its rows keep their own tokens."""
    rows = [(i, None if i % 5 == 0 else [f"t{(i * j) % 11}" for j in range(i % 7)]) for i in range(60)]
    df = spark.createDataFrame(rows, "ord long, tokens array<string>").coalesce(1)
    vocabulary = text.build_vocabulary(df, min_freq=2).localCheckpoint()
    sizes = lambda: df_sizes(text.encode(df, vocabulary, "ord"))
    whole = sizes()
    monkeypatch.setattr(text, "TAKEN", 10)
    assert sizes() == whole and list(map(len, (p for p, _ in text._parts(batch_of(rows), 10))))[0] < len(rows)


def df_sizes(found):
    return {r.ord: r.ids for r in found.collect()}


def batch_of(rows):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows], pa.list_(pa.string()))], names=["ord", "tokens"])
