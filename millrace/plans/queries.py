"""The registered queries over the driver's tables, each with its SQL oracle where SQL can express it; more are in the modules imported last."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tensor
from ..functions import text as T
from ..functions.arrow import row_udf
from ..operators import audio, images, issues, sampling, text, video
from ..operators import schema_rules as H
from ..operators import text_validators as V
from ..session import spread, table
from ..sources import catalog, storage
from ..workspace import discard, new_path, written
from .pipeline import Chain, Pipeline, PipelineConfig
from .registry import ORACLES, QUERIES, query

# Text.

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
CLEAN = rf"""
WITH c AS (
  SELECT doc_id, text, lang, source, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[!$-_a-z]+', ' ', 'g'),
    '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', ' ', 'g'), '(\+?1[-.\s]?)?(\(?\d{{3}}\)?[-.\s]?)?\d{{3}}[-.\s]?\d{{4}}', ' ', 'g'), '{WS}+', ' ', 'g'), ' ') AS cleaned FROM documents
)"""
WORDS = rf"list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '')"
SENTENCES = rf"len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, '[^{WS[1:]}')))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query(CLEAN + " SELECT doc_id, cleaned, len(cleaned) AS n FROM c")
def text_clean(spark, sf_dir):
    return text.clean(docs(spark, sf_dir)).select("doc_id", "cleaned", F.length("cleaned").cast("long").alias("n"))


def _tokens(spark, sf_dir, kind):
    found = text.preprocess(docs(spark, sf_dir), config=T.TextConfig(tokenizer=kind))
    return found.select("doc_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", "|").alias("joined"))


@query(CLEAN + " SELECT doc_id, CAST(len(t) AS BIGINT) AS n, coalesce(array_to_string(t, '|'), '') AS joined FROM (SELECT doc_id, list_filter(string_split(cleaned, ' '), lambda x: x <> '') AS t FROM c)")
def text_tokens_whitespace(spark, sf_dir):
    return _tokens(spark, sf_dir, "whitespace")


@query(CLEAN + r" SELECT doc_id, CAST(len(t) AS BIGINT) AS n, coalesce(array_to_string(t, '|'), '') AS joined FROM (SELECT doc_id, regexp_extract_all(cleaned, '[\p{L}\p{N}_]+') AS t FROM c)")
def text_tokens_word(spark, sf_dir):
    return _tokens(spark, sf_dir, "word")


@query(CLEAN + r" SELECT doc_id, CAST(len(t) AS BIGINT) AS n, coalesce(array_to_string(t, '|'), '') AS joined FROM (SELECT doc_id, string_split_regex(cleaned, '[.!?]+') AS t FROM c)")
def text_tokens_sentence(spark, sf_dir):
    return _tokens(spark, sf_dir, "sentence")


@query(CLEAN + " SELECT doc_id, CAST(len(t) + 2 AS BIGINT) AS n, '<BOS>' AS head, '<EOS>' AS tail, t[1] AS second FROM (SELECT doc_id, list_filter(string_split(cleaned, ' '), lambda x: x <> '') AS t FROM c)")
def text_special_tokens(spark, sf_dir):
    found = text.preprocess(docs(spark, sf_dir), config=T.TextConfig(special_tokens=True))
    return found.select("doc_id", F.size("tokens").cast("long").alias("n"), F.get("tokens", F.lit(0)).alias("head"), F.element_at("tokens", -1).alias("tail"), F.get("tokens", F.lit(1)).alias("second"))


@query(CLEAN + " SELECT doc_id, CASE WHEN len(cleaned) < 500 THEN '' ELSE substr(cleaned, 1, 512) END AS cleaned, len(cleaned) < 500 AS too_short FROM c")
def text_truncate(spark, sf_dir):
    return text.preprocess(docs(spark, sf_dir), config=T.TextConfig(min_length=500, max_length=512)).select("doc_id", "cleaned", "too_short")


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]', ' ', 'g'), '{WS}+', ' ', 'g'), ' ') AS cleaned FROM documents""")
def text_remove_punctuation(spark, sf_dir):
    config = T.TextConfig(unicode_form=None, remove_urls=False, remove_emails=False, remove_phone_numbers=False, remove_punctuation=True)
    return text.clean(docs(spark, sf_dir), config=config).select("doc_id", "cleaned")


#: Runs of word characters that are digits only become a blank.
NUMBERLESS = r"array_to_string(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: CASE WHEN regexp_full_match(x, '\p{Nd}+') THEN ' ' ELSE x END), '')"


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace({NUMBERLESS}, '[^\p{{L}}\p{{N}}_\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]', ' ', 'g'), '{WS}+', ' ', 'g'), ' ') AS cleaned FROM documents""")
def text_remove_numbers(spark, sf_dir):
    config = T.TextConfig(unicode_form=None, remove_urls=False, remove_emails=False, remove_phone_numbers=False, remove_numbers=True, remove_punctuation=True)
    return text.clean(docs(spark, sf_dir), config=config).select("doc_id", "cleaned")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' Az19 fi 2' WHEN 1 THEN text || ' ' || chr(233) ELSE text END AS nfkc, CASE doc_id % 3 WHEN 0 THEN text || ' ' || chr(65313) || chr(65370) || chr(65297) || chr(65305) || ' ' || chr(64257) || ' ' || chr(178) WHEN 1 THEN text || ' ' || chr(233) ELSE text END AS nfc FROM documents")
def text_unicode_forms(spark, sf_dir):
    """Full-width letters, a ligature and a raised digit behind a third of the texts, a decomposed accent behind another."""
    k = F.col("doc_id") % 3
    made = F.when(k == 0, F.concat("text", F.lit(" Ａｚ１９ ﬁ ²"))).when(k == 1, F.concat("text", F.lit(" é"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", T.normalize(made, "NFKC").alias("nfkc"), T.normalize(made, "NFC").alias("nfc"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def text_strip_accents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.strip_accents(F.col("text")).alias("plain"))


VOCABULARY = (
    CLEAN
    + r""", t AS (SELECT doc_id, unnest(list_filter(string_split(cleaned, ' '), lambda x: x <> '')) AS token, unnest(range(len(list_filter(string_split(cleaned, ' '), lambda x: x <> '')))) AS pos FROM c),
f AS (SELECT token, count(*) AS freq, min(struct_pack(d := doc_id, p := pos)) AS first FROM t GROUP BY token HAVING count(*) >= 2),
v AS (SELECT token, row_number() OVER (ORDER BY freq DESC, first) + 3 AS id, freq FROM f UNION ALL VALUES ('<PAD>', 0, 0), ('<UNK>', 1, 0), ('<BOS>', 2, 0), ('<EOS>', 3, 0))"""
)


def _tokenized(spark, sf_dir):
    """Tokens are used several times: written, they are computed once."""
    return written(text.preprocess(docs(spark, sf_dir)).select(F.col("doc_id").alias("ord"), "tokens"), "tokens", "zstd")


@query(VOCABULARY + " SELECT token, CAST(id AS BIGINT) AS id, CAST(freq AS BIGINT) AS freq FROM v")
def text_vocabulary(spark, sf_dir):
    return text.build_vocabulary(_tokenized(spark, sf_dir), min_freq=2)


@query(VOCABULARY + " SELECT c.doc_id AS ord, count(t.token) AS n, coalesce(string_agg(CAST(coalesce(id, 1) AS VARCHAR), ',' ORDER BY pos) FILTER (t.token IS NOT NULL), '') AS joined FROM c LEFT JOIN t ON c.doc_id = t.doc_id LEFT JOIN v ON t.token = v.token GROUP BY c.doc_id")
def text_encode(spark, sf_dir):
    tokens = _tokenized(spark, sf_dir)
    found = text.encode(tokens, text.build_vocabulary(tokens, min_freq=2), "ord")
    return found.select("ord", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("joined"))


@query(VOCABULARY + " SELECT c.doc_id AS ord, coalesce(string_agg(CASE WHEN id IS NULL THEN '<UNK>' ELSE t.token END, ' ' ORDER BY pos) FILTER (t.token IS NOT NULL), '') AS joined FROM c LEFT JOIN t ON c.doc_id = t.doc_id LEFT JOIN v ON t.token = v.token GROUP BY c.doc_id")
def text_decode(spark, sf_dir):
    tokens = _tokenized(spark, sf_dir)
    vocabulary = text.build_vocabulary(tokens, min_freq=2)
    encoded = text.encode(tokens, vocabulary, "ord")
    ids = written(encoded, "ids", "zstd")
    discard(tokens)
    if hasattr(encoded, "_millrace_path"):  # made of blocks, as the vocabulary is large
        discard(encoded)
    found = text.decode(ids, vocabulary, "ord")
    return found.select("ord", F.array_join("tokens", " ").alias("joined"))


STATISTICS = rf"""
WITH m AS (SELECT len(text) AS chars, {WORDS} AS words FROM %s WHERE text IS NOT NULL)
SELECT count(*) AS total_texts, round(coalesce(avg(chars), 0), 6) AS avg_length, CAST(coalesce(min(chars), 0) AS BIGINT) AS min_length, CAST(coalesce(max(chars), 0) AS BIGINT) AS max_length,
  round(coalesce(avg(len(words)), 0), 6) AS avg_words, CAST(coalesce(sum(chars), 0) AS BIGINT) AS total_chars, (SELECT count(DISTINCT w) FROM (SELECT unnest(words) AS w FROM m)) AS vocabulary_size FROM m"""


def _statistics(df):
    return text.statistics(df).withColumn("avg_length", F.round("avg_length", 6)).withColumn("avg_words", F.round("avg_words", 6))


@query(STATISTICS % "documents")
def text_statistics(spark, sf_dir):
    return _statistics(docs(spark, sf_dir))


@query(STATISTICS % "conversations")
def text_statistics_conversations(spark, sf_dir):
    return _statistics(table(spark, sf_dir, "conversations"))


# Validation.

LIMITS = V.TextLimits(min_length=200, max_length=20_000, min_words=60, max_words=3_000, min_sentences=5, max_sentences=400, check_profanity=True, check_harmful=True, max_special_ratio=0.05, languages=("en", "unknown"), min_readability=40.0)


def _judged(df, *facts):
    codes = F.array_join(F.transform("result.issues", lambda i: i["code"]), ",")
    return df.select("doc_id", F.col("result.status").alias("status"), codes.alias("codes"), *[F.round(F.element_at("result.metadata", k).cast("double"), 6).alias(k) for k in facts])


LENGTH = rf"""
WITH m AS (SELECT doc_id, text, len(text) AS chars, len({WORDS}) AS words, {SENTENCES} AS sentences FROM documents),
j AS (SELECT *, list_filter([CASE WHEN chars < 200 THEN 'TEXT_TOO_SHORT' END, CASE WHEN chars > 20000 THEN 'TEXT_TOO_LONG' END, CASE WHEN words < 60 THEN 'TOO_FEW_WORDS' END, CASE WHEN words > 3000 THEN 'TOO_MANY_WORDS' END,
  CASE WHEN sentences < 5 THEN 'FEW_SENTENCES' END, CASE WHEN sentences > 400 THEN 'MANY_SENTENCES' END], lambda x: x IS NOT NULL) AS codes FROM m)"""


@query(LENGTH + r"""
SELECT doc_id, CASE WHEN chars < 200 OR chars > 20000 THEN 'failed' ELSE 'passed' END AS status, coalesce(array_to_string(codes, ','), '') AS codes, CAST(chars AS DOUBLE) AS char_length, CAST(words AS DOUBLE) AS word_count, CAST(sentences AS DOUBLE) AS sentence_count,
  round(CASE WHEN words > 0 THEN chars / words ELSE 0 END, 6) AS avg_word_length, round(CASE WHEN sentences > 0 THEN words / sentences ELSE 0 END, 6) AS avg_sentence_length FROM j""")
def validate_length(spark, sf_dir):
    return _judged(V.validate_length(docs(spark, sf_dir), LIMITS), "char_length", "word_count", "sentence_count", "avg_word_length", "avg_sentence_length")


#: Texts with a listed word (as a word of its own, in any case, or with a point, which hides it), a harmful one or neither.
MARKED = "text || CASE doc_id % 7 WHEN 0 THEN ' Offensive end' WHEN 1 THEN ' offensive. end' WHEN 2 THEN ' to KILL it' WHEN 3 THEN ' badword1 bomb' WHEN 4 THEN ' skilled' ELSE '' END"


def _marked(df):
    k = F.col("doc_id") % 7
    ends = F.when(k == 0, " Offensive end").when(k == 1, " offensive. end").when(k == 2, " to KILL it").when(k == 3, " badword1 bomb").when(k == 4, " skilled").otherwise("")
    return df.withColumn("text", F.concat("text", ends))


CONTENT = rf"""
WITH m AS (SELECT doc_id, len(list_intersect(list_distinct(list_transform({WORDS}, lambda x: lower(x))), ['badword1', 'badword2', 'offensive'])) AS listed,
  regexp_matches(text, '(?i)\b(kill|murder|bomb)\b') AS harmful, CASE WHEN len(text) = 0 THEN 0 ELSE len(regexp_replace(text, '[\p{{L}}\p{{N}}\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', '', 'g')) / len(text) END AS ratio FROM (SELECT doc_id, {MARKED} AS text FROM documents)),
k AS (SELECT *, list_filter([CASE WHEN listed > 0 THEN 'PROFANITY_DETECTED' END, CASE WHEN harmful THEN 'HARMFUL_CONTENT' END, CASE WHEN ratio > 0.05 THEN 'HIGH_SPECIAL_CHAR_RATIO' END], lambda x: x IS NOT NULL) AS codes FROM m)"""


@query(CONTENT + " SELECT doc_id, CASE WHEN harmful THEN 'failed' ELSE 'passed' END AS status, coalesce(array_to_string(codes, ','), '') AS codes, round(ratio, 6) AS special_char_ratio FROM k")
def validate_content(spark, sf_dir):
    return _judged(V.validate_content(_marked(docs(spark, sf_dir)), LIMITS), "special_char_ratio")


@query(r"""
WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(1) || chr(9) || chr(127) WHEN 1 THEN chr(888) ELSE '' END AS text FROM documents),
m AS (SELECT doc_id, len(regexp_replace(text, '[^\p{Cc}]|[\n\r\t]', '', 'g')) AS cc, CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS cn FROM t)
SELECT doc_id, 'passed' AS status, concat_ws(',', CASE WHEN cc > 0 THEN 'CONTROL_CHARACTERS' END, CASE WHEN cn > 0 THEN 'INVALID_UNICODE' END) AS codes, CAST(cc AS DOUBLE) AS control_char_count, CAST(cn AS DOUBLE) AS invalid_char_count FROM m""")
def validate_encoding(spark, sf_dir):
    """Control characters behind a quarter of the texts, one that isn't assigned behind another."""
    k = F.col("doc_id") % 4
    made = docs(spark, sf_dir).withColumn("text", F.concat("text", F.when(k == 0, "\x01\t\x7f").when(k == 1, "͸").otherwise("")))
    return _judged(V.validate_encoding(made), "control_char_count", "invalid_char_count")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'passed' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'ENCODING_ERROR' ELSE 'ENCODING_SUCCESS' END AS codes FROM documents")
def validate_bytes(spark, sf_dir):
    """Texts as bytes, a third of them with one that is not UTF-8 at the end."""
    made = docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C3")))).otherwise(F.col("text").cast("binary")))
    return _judged(V.validate_encoding(made))


@query(r"""
WITH m AS (SELECT doc_id, len(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, len(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS zh, len(regexp_replace(text, '[^\x{0600}-\x{06FF}]', '', 'g')) AS ar,
  len(regexp_replace(text, '[^\x{0400}-\x{04FF}]', '', 'g')) AS ru, len(regexp_replace(text, '[^\x{00}-\x{24F}]', '', 'g')) AS latin FROM documents),
l AS (SELECT doc_id, CASE WHEN letters = 0 THEN 'unknown' WHEN zh / letters > 0.3 THEN 'zh' WHEN ar / letters > 0.3 THEN 'ar' WHEN ru / letters > 0.3 THEN 'ru' WHEN latin / letters > 0.5 THEN 'en' ELSE 'unknown' END AS language FROM m)
SELECT doc_id, 'passed' AS status, CASE WHEN language NOT IN ('en', 'unknown') THEN 'LANGUAGE_NOT_ALLOWED' ELSE '' END AS codes, language FROM l""")
def validate_language(spark, sf_dir):
    found = V.validate_language(docs(spark, sf_dir), LIMITS)
    codes = F.array_join(F.transform("result.issues", lambda i: i["code"]), ",")
    return found.select("doc_id", F.col("result.status").alias("status"), codes.alias("codes"), F.element_at("result.metadata", "detected_language").alias("language"))


@query(rf"""
WITH m AS (SELECT doc_id, {WORDS} AS words, {SENTENCES} AS s FROM documents),
n AS (SELECT *, len(words) AS w, len(list_distinct(list_transform(words, lambda x: lower(x)))) AS u, list_sum(list_transform(words, lambda x: len(x))) AS letters,
  list_sum(list_transform(words, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN ends_with(lower(x), 'e') THEN 1 ELSE 0 END))) AS syllables FROM m),
q AS (SELECT *, CASE WHEN w = 0 OR s = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (syllables / w))) END AS ease FROM n)
SELECT doc_id, 'passed' AS status, concat_ws(',', CASE WHEN ease < 40 THEN 'LOW_READABILITY' END, CASE WHEN w > 0 AND u / w < 0.3::DOUBLE THEN 'LOW_VOCABULARY_DIVERSITY' END) AS codes, round(ease, 6) AS readability_score,
  round(CASE WHEN w > 0 THEN u / w END, 6) AS unique_word_ratio, round(CASE WHEN w > 0 THEN letters / w END, 6) AS avg_word_length, CAST(CASE WHEN w > 0 THEN u END AS DOUBLE) AS unique_word_count, CAST(CASE WHEN w > 0 THEN w END AS DOUBLE) AS total_word_count FROM q""")
def validate_quality(spark, sf_dir):
    return _judged(V.validate_quality(docs(spark, sf_dir), LIMITS), "readability_score", "unique_word_ratio", "avg_word_length", "unique_word_count", "total_word_count")


@query("SELECT event_id, CASE WHEN props IS NULL THEN 'failed' WHEN json_valid(props) THEN 'passed' ELSE 'failed' END AS status, CASE json_type(props) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' END AS json_type, CAST(len(json_keys(props)) AS BIGINT) AS json_keys FROM events")
def validate_json(spark, sf_dir):
    found = V.validate_format(spread(table(spark, sf_dir, "events")), "json", text_col="props")
    fact = lambda k: F.element_at("result.metadata", k)
    return found.select("event_id", F.col("result.status").alias("status"), fact("json_type").alias("json_type"), fact("json_keys").cast("long").alias("json_keys"))


#: An event's number as JSON texts of all kinds, and as texts that are none.
JSON_KINDS = """CASE CAST(event_id % 9 AS INT) WHEN 0 THEN concat('[', k, ', 2, null]') WHEN 1 THEN CAST(k AS STRING) WHEN 2 THEN concat('"', k, '"') WHEN 3 THEN 'true' WHEN 4 THEN concat('{"k": ', k)
  WHEN 5 THEN concat('{"k": ', k, ', "k": NaN}') WHEN 6 THEN concat(k, '.5') WHEN 7 THEN 'null' ELSE props END"""


@query("""SELECT event_id, CASE event_id % 9 WHEN 4 THEN 'failed' ELSE 'passed' END AS status, CASE event_id % 9 WHEN 0 THEN 'list' WHEN 1 THEN 'int' WHEN 2 THEN 'str' WHEN 3 THEN 'bool' WHEN 5 THEN 'dict' WHEN 6 THEN 'float' WHEN 7 THEN 'NoneType' WHEN 8 THEN 'dict' END AS json_type,
CAST(CASE WHEN event_id % 9 IN (5, 8) THEN 1 END AS BIGINT) AS json_keys FROM events""")
def validate_json_kinds(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("made", F.expr(JSON_KINDS))
    fact = lambda k: F.element_at("result.metadata", k)
    return V.validate_format(spread(events), "json", text_col="made").select("event_id", F.col("result.status").alias("status"), fact("json_type").alias("json_type"), fact("json_keys").cast("long").alias("json_keys"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ITEM_TYPE_MISMATCH@items[1],ITEM_TYPE_MISMATCH@items[2],ITEM_TYPE_MISMATCH@items[3]' WHEN 1 THEN 'TOO_FEW_ITEMS@items' ELSE 'TYPE_MISMATCH@items' END AS codes, 'failed' AS status FROM events WHERE event_id % 4 > 0
UNION ALL SELECT event_id, '', 'passed' FROM events WHERE event_id % 4 = 0""")
def schema_json_items(spark, sf_dir):
    """Lists in JSON texts: items of other types, too few of them, no list, and good ones."""
    made = """CASE WHEN event_id % 4 = 0 THEN '{"items": [1, 2, 3]}' WHEN event_id % 3 = 0 THEN concat('{"items": [', event_id, ', "x", null, 2.5]}') WHEN event_id % 3 = 1 THEN '{"items": [7]}' ELSE concat('{"items": ', props, '}') END"""
    rules = H.SchemaBuilder("list").add_list("items", item_type=H.FieldType.INTEGER, min_items=2).build()
    return _schema_result(H.validate_json(spread(table(spark, sf_dir, "events").withColumn("made", F.expr(made))), rules, "made"), "event_id")


@query("SELECT page_id, CASE WHEN page_id % 4 IN (1, 3) THEN 'failed' ELSE 'passed' END AS status, CASE WHEN page_id % 4 IN (1, 3) THEN 'INVALID_XML' ELSE 'VALID_XML' END AS code, CASE page_id % 4 WHEN 0 THEN '{urn:p}page' WHEN 2 THEN 'p' || page_id END AS root FROM pages")
def validate_xml(spark, sf_dir):
    """Each page's URL in XML with a namespace, in XML without, without an end, and as it is."""
    k, escaped = F.col("page_id") % 4, F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    made = F.when(k == 0, F.concat(F.lit('<x:page xmlns:x="urn:p"><u>'), escaped, F.lit("</u></x:page>"))).when(k == 1, F.concat(F.lit("<page><u>"), escaped, F.lit("</page>")))
    made = made.when(k == 2, F.concat(F.lit("<"), name, F.lit(">"), escaped, F.lit("</"), name, F.lit(">"))).otherwise(F.col("url"))
    found = V.validate_format(table(spark, sf_dir, "pages").withColumn("made", made), "xml", text_col="made")
    return found.select("page_id", F.col("result.status").alias("status"), F.col("result.issues")[0]["code"].alias("code"), F.element_at("result.metadata", "xml_root_tag").alias("root"))


@query(None)
def validate_html_as_xml(spark, sf_dir):
    found = V.validate_format(table(spark, sf_dir, "pages"), "xml", text_col="html")
    return found.select("page_id", F.col("result.status").alias("status"), F.col("result.issues")[0]["code"].alias("code"))


@query(r"""
WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN 'EMPTY_CSV' WHEN k = 3 THEN 'INCONSISTENT_CSV_COLUMNS' ELSE 'VALID_CSV' END AS code, CASE WHEN k = 3 THEN 'failed' ELSE 'passed' END AS status,
  CAST(CASE WHEN k <> 0 THEN 3 END AS BIGINT) AS csv_rows, CAST(CASE WHEN k <> 0 THEN 3 END AS BIGINT) AS csv_columns, CAST(CASE WHEN k = 3 THEN 1 WHEN k <> 0 THEN 0 END AS BIGINT) AS inconsistent_rows FROM t""")
def validate_csv(spark, sf_dir):
    """Orders as small CSV texts: a quoted field with a comma, an odd row where the key's remainder is 3, nothing where it is 0."""
    k = F.col("o_orderkey") % 7
    rows = F.concat(F.lit("key,status,note\n"), F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_orderstatus"), F.lit(',"a, b"\n'), F.when(k == 3, "1,2\n").otherwise("1,2,3\n"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "").otherwise(rows).alias("text"))
    found = V.validate_format(made, "csv")
    fact = lambda n: F.element_at("result.metadata", n).cast("long").alias(n)
    return found.select("o_orderkey", F.col("result.issues")[0]["code"].alias("code"), F.col("result.status").alias("status"), fact("csv_rows"), fact("csv_columns"), fact("inconsistent_rows"))


@query(LENGTH + " SELECT code, CASE WHEN code LIKE 'TEXT%' THEN 'error' WHEN code LIKE 'TOO%' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM (SELECT unnest(codes) AS code FROM j) GROUP BY code")
def issue_summary(spark, sf_dir):
    return issues.summary(V.validate_length(docs(spark, sf_dir), LIMITS).select(F.col("result.issues").alias("issues")))


MERGED = LENGTH.replace("WITH m AS", "WITH m AS", 1) + "," + CONTENT.strip().removeprefix("WITH ").replace("m AS (", "m2 AS (", 1).replace("FROM m)", "FROM m2)")


@query(MERGED + """
SELECT doc_id, len(j.codes) + len(k.codes) AS n, CASE WHEN NOT (chars < 200 OR chars > 20000 OR harmful) THEN 'passed' ELSE 'failed' END AS status FROM j JOIN k USING (doc_id)""")
def result_merge(spark, sf_dir):
    both = V.validate_content(_marked(V.validate_length(docs(spark, sf_dir), LIMITS, out="a")), LIMITS, out="b")
    merged = both.withColumn("m", issues.merge(F.col("a"), F.col("b")))
    return merged.select("doc_id", F.size("m.issues").cast("long").alias("n"), F.col("m.status").alias("status"))


# Schema rules.


def _schema_result(df, key):
    codes = F.array_join(F.transform("result.issues", lambda i: F.concat(i["code"], F.lit("@"), i["field"])), ",")
    return df.select(key, F.col("result.status").alias("status"), codes.alias("codes"))


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'INVALID_ENUM_VALUE@o_orderstatus' END, CASE WHEN o_totalprice < 1000 THEN 'VALUE_BELOW_MIN@o_totalprice' END, CASE WHEN o_totalprice > 300000 THEN 'VALUE_ABOVE_MAX@o_totalprice' END,
  CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]') THEN 'PATTERN_MISMATCH@o_orderpriority' END) AS codes,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') OR o_totalprice < 1000 OR o_totalprice > 300000 OR NOT regexp_matches(o_orderpriority, '^[1-3]') THEN 'failed' ELSE 'passed' END AS status FROM orders""")
def schema_orders(spark, sf_dir):
    rules = H.SchemaBuilder("orders").add_integer("o_orderkey").add_string("o_orderstatus", allowed_values=("F", "O")).add_float("o_totalprice", min_value=1000, max_value=300_000).add_string("o_orderpriority", pattern="[1-3]").build()
    return _schema_result(H.validate_columns(table(spark, sf_dir, "orders"), rules), "o_orderkey")


@query("""
SELECT event_id, concat_ws(',', CASE WHEN CAST(props->>'k' AS BIGINT) > 50 THEN 'VALUE_ABOVE_MAX@k' END, 'MISSING_REQUIRED_FIELD@name') AS codes, 'failed' AS status FROM events""")
def schema_events_json(spark, sf_dir):
    rules = H.SchemaBuilder("props").add_integer("k", max_value=50).add_string("name").add_string("note", required=False).build()
    return _schema_result(H.validate_json(spread(table(spark, sf_dir, "events")), rules, "props"), "event_id")


#: JSON texts that only lenient parsers take: repeated keys, NaN; and arrays, other types, names with quotes.
ODD_PROPS = """CASE CAST(event_id % 6 AS INT)
  WHEN 0 THEN concat('{"k": 99, "k": ', k, '}') WHEN 1 THEN '{"k": NaN, "it''s": 5}' WHEN 2 THEN concat('[', k, ']')
  WHEN 3 THEN concat('{"k": ', k, ', "z": NaN, "it''s": 1}') WHEN 4 THEN concat('{"k": "', k, '"}') ELSE props END"""


@query("""
SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'TYPE_MISMATCH@k' WHEN 2 THEN 'INVALID_DATA_TYPE@' WHEN 4 THEN 'TYPE_MISMATCH@k'
  WHEN 3 THEN CASE WHEN k > 50 THEN 'VALUE_ABOVE_MAX@k,' ELSE '' END || 'VALUE_BELOW_MIN@it''s' ELSE CASE WHEN k > 50 THEN 'VALUE_ABOVE_MAX@k' ELSE '' END END AS codes,
  CASE WHEN event_id % 6 IN (1, 2, 3, 4) OR k > 50 THEN 'failed' ELSE 'passed' END AS status
FROM (SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events)""")
def schema_events_lenient(spark, sf_dir):
    rules = H.SchemaBuilder("props").add_integer("k", max_value=50).add_integer("it's", min_value=2, required=False).build()
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("props", F.expr(ODD_PROPS.replace("''", "\\'")))
    return _schema_result(H.validate_json(spread(events), rules, "props"), "event_id")


@query("SELECT vec_id, CASE WHEN len(embedding) > 60 THEN 'TOO_MANY_ITEMS@embedding' ELSE '' END AS codes, CASE WHEN len(embedding) > 60 THEN 'failed' ELSE 'passed' END AS status FROM embeddings")
def schema_list_items(spark, sf_dir):
    rules = H.SchemaBuilder("vectors").add_list("embedding", item_type=H.FieldType.FLOAT, min_items=1, max_items=60).build()
    return _schema_result(H.validate_columns(table(spark, sf_dir, "embeddings"), rules), "vec_id")


@query("""
SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'VALUE_BELOW_MIN@account.balance' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'INVALID_ENUM_VALUE@account.segment' END) AS codes,
  CASE WHEN c_acctbal < 0 OR c_mktsegment <> 'BUILDING' THEN 'failed' ELSE 'passed' END AS status FROM customer""")
def schema_nested(spark, sf_dir):
    account = H.SchemaBuilder("account").add_float("balance", min_value=0).add_string("segment", allowed_values=("BUILDING",)).build()
    rules = H.SchemaBuilder("customer").add_integer("c_custkey").add_dict("account", account).build()
    df = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("account"))
    return _schema_result(H.validate_columns(df, rules), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'CUSTOM_VALIDATION_FAILED@c_custkey,' ELSE '' END || 'UNKNOWN_FIELD@c_acctbal,UNKNOWN_FIELD@c_mktsegment,UNKNOWN_FIELD@c_nationkey' AS codes, CASE WHEN c_custkey % 2 = 0 THEN 'failed' ELSE 'partial' END AS status FROM customer")
def schema_strict(spark, sf_dir):
    rules = H.SchemaBuilder("customer").add_integer("c_custkey", check=lambda c: c % 2 == 1).add_string("c_name", min_length=3, max_length=50).set_strict().build()
    return _schema_result(H.validate_columns(table(spark, sf_dir, "customer"), rules), "c_custkey")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'CUSTOM_VALIDATION_FAILED@c_name' WHEN 2 THEN 'CUSTOM_VALIDATION_FAILED@c_name' WHEN 3 THEN 'CUSTOM_VALIDATOR_ERROR@c_name' ELSE '' END AS codes, CASE c_custkey % 4 WHEN 1 THEN 'c_name fails its check' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS message, CASE WHEN c_custkey % 4 > 0 THEN 'failed' ELSE 'passed' END AS status FROM customer""")
def schema_python_check(spark, sf_dir):
    """A check in Python: it passes, says no, says why, or fails itself, by the number in a customer's name."""

    def check(name):
        rest = int(name.rsplit("#", 1)[1]) % 4
        if rest == 3:
            raise RuntimeError("three")
        return "two" if rest == 2 else rest == 0

    rules = H.SchemaBuilder("customer").add_string("c_name", python_check=check).build()
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Customer#"), F.col("c_custkey").cast("string")).alias("c_name"))
    found = H.validate_columns(spread(customers), rules, columns=["c_name"])
    return _schema_result(found.withColumn("key", F.struct("c_custkey", F.get("result.issues", F.lit(0))["message"].alias("message"))), "key").select("key.*", "status", "codes")


# Sources and samples.

MODALITY = "CASE " + " ".join(f"WHEN suffix IN ({', '.join(repr(e) for e in own)}) THEN '{m}'" for m, own in catalog.EXTENSIONS.items()) + " END"


@query(rf"SELECT page_id, suffix, {MODALITY} AS modality FROM (SELECT page_id, lower(regexp_extract(url, '[^/](\.[^./]+)$', 1)) AS suffix FROM pages)")
def modality_of_url(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", catalog.extension(url).alias("suffix"), catalog.modality(url).alias("modality"))


#: Three tables as sources of samples; the modality is taken from a key, as no media files are at hand.
SAMPLES = """
WITH s AS (SELECT 'documents' AS source_name, 0 AS source_ord, CAST(doc_id AS VARCHAR) AS id, doc_id AS n, CASE WHEN doc_id % 5 = 0 THEN 'image' ELSE 'text' END AS modality, CAST(strlen(text) AS BIGINT) AS size FROM documents
UNION ALL SELECT 'pages', 1, CAST(page_id AS VARCHAR), page_id, CASE WHEN page_id % 3 = 0 THEN 'image' ELSE 'text' END, CAST(strlen(html) AS BIGINT) FROM pages
UNION ALL SELECT 'events', 2, CAST(event_id AS VARCHAR), event_id, CASE WHEN event_id % 10 = 0 THEN 'audio' ELSE 'video' END, CAST(strlen(props) AS BIGINT) FROM events)"""


def _samples(spark, sf_dir):
    def one(name, key, payload, every, yes, no):
        return table(spark, sf_dir, name).select(F.col(key).cast("string").alias("id"), F.col(key).alias("n"), F.when(F.col(key) % every == 0, yes).otherwise(no).alias("modality"), F.octet_length(payload).cast("long").alias("size"))

    return sampling.union_sources({"documents": one("documents", "doc_id", "text", 5, "image", "text"), "pages": one("pages", "page_id", "html", 3, "image", "text"), "events": one("events", "event_id", "props", 10, "audio", "video")})


@query(SAMPLES + " SELECT source_name, source_ord, id, n, modality, size FROM s")
def union_sources(spark, sf_dir):
    return _samples(spark, sf_dir)


@query(SAMPLES + " SELECT modality, count(*) AS n FROM s GROUP BY modality")
def modality_counts(spark, sf_dir):
    return sampling.count_by_modality(_samples(spark, sf_dir))


@query(SAMPLES + " SELECT source_name, id, modality FROM s WHERE modality IN ('text', 'audio')")
def filter_modalities(spark, sf_dir):
    return sampling.keep_modalities(_samples(spark, sf_dir), ("text", "audio")).select("source_name", "id", "modality")


@query(SAMPLES + " SELECT source_name, modality, count(*) AS n FROM s GROUP BY ALL")
def source_distribution(spark, sf_dir):
    return sampling.distribution(_samples(spark, sf_dir))


@query(SAMPLES + """, b AS (SELECT source_name, modality, count(*) AS n, sum(size) AS size FROM s GROUP BY ALL),
p AS (SELECT source_name, sum(n) AS n, round(sum(size) / 1048576, 2) AS size_mb FROM b GROUP BY source_name)
SELECT source_name, modality, n, round(size / 1048576, 2) AS size_mb FROM b UNION ALL SELECT source_name, NULL, n, size_mb FROM p
UNION ALL SELECT NULL, modality, sum(n), NULL FROM b GROUP BY modality UNION ALL SELECT NULL, NULL, sum(n), round(sum(size_mb), 2) FROM p""")
def source_statistics(spark, sf_dir):
    return sampling.source_statistics(_samples(spark, sf_dir))


@query(SAMPLES + ", k AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY source_ord, n) AS k FROM s) SELECT source_name, id, modality FROM k WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM s GROUP BY modality))")
def balance_modalities(spark, sf_dir):
    return sampling.balance(_samples(spark, sf_dir), ["source_ord", "n"]).select("source_name", "id", "modality")


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 32) AS BIGINT) AS batch_id FROM events")
def batch_ids(spark, sf_dir):
    return sampling.with_batches(table(spark, sf_dir, "events"), 32, ["ts", "event_id"]).select("event_id", "batch_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_samples(spark, sf_dir):
    """The feature is the limit: the first rows in an order."""
    return sampling.first_rows(table(spark, sf_dir, "orders"), 100, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("SELECT page_id, split_part(p, '/', 1) AS bucket, CASE WHEN contains(p, '/') THEN substr(p, instr(p, '/') + 1) ELSE '' END AS prefix FROM (SELECT page_id, replace(replace(replace(url, 'https://', 's3://'), 'http://', 's3://'), 's3://', '') AS p FROM pages)")
def s3_path_parse(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "s3://")
    return table(spark, sf_dir, "pages").select("page_id", storage.bucket_and_prefix(path).alias("p")).select("page_id", "p.bucket", "p.prefix")


@query("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey, NULL::INT AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
def csv_union_by_name(spark, sf_dir):
    base = new_path(spark, "csv")
    storage.write_csv(table(spark, sf_dir, "nation"), f"{base}/nation")
    storage.write_csv(table(spark, sf_dir, "region"), f"{base}/region")
    return storage.read_csvs(spark, [f"{base}/nation", f"{base}/region", f"{base}/absent"])


@query("SELECT r_regionkey, r_name FROM region")
def parquet_round_trip(spark, sf_dir):
    path = new_path(spark, "parquet")
    storage.write_parquet(table(spark, sf_dir, "region"), path)
    return storage.read_parquet(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def json_round_trip(spark, sf_dir):
    path = new_path(spark, "json")
    storage.write_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return storage.read_json(spark, path, schema="n_nationkey int, n_name string", lines=True)


# Tensors. Embeddings stand for signals and, in thousandths, for pixels.


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings"))


PIXELS = "list_transform(embedding, lambda x: abs(floor(x::DOUBLE * 1000)) % 256)"


def _pixels():
    return F.transform("embedding", lambda x: F.abs(F.floor(x.cast("double") * 1000)) % 256)


@query(f"SELECT vec_id, round(list_sum(list_transform({PIXELS}, lambda x, i: (x / 255 - [0.485, 0.456, 0.406][(i - 1) % 3 + 1]::DOUBLE) / [0.229, 0.224, 0.225][(i - 1) % 3 + 1]::DOUBLE)), 6) AS total, round(list_sum(list_transform({PIXELS}, lambda x: x / 127.5::DOUBLE - 1)), 6) AS signed FROM embeddings")
def pixel_normalize(spark, sf_dir):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    standard = tensor.normalize_pixels(_pixels(), "0-1", [0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
    return vectors(spark, sf_dir).select("vec_id", total(standard).alias("total"), total(tensor.normalize_pixels(_pixels(), "-1-1")).alias("signed"))


@query("SELECT vec_id, round(list_max(list_transform(embedding, lambda x: x::DOUBLE / p * 0.5::DOUBLE)), 6) AS high, round(list_min(list_transform(embedding, lambda x: x::DOUBLE / p * 0.5::DOUBLE)), 6) AS low FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS p FROM embeddings)")
def peak_normalize(spark, sf_dir):
    found = vectors(spark, sf_dir).select("vec_id", tensor.normalize_amplitude(F.col("embedding"), "peak", 0.5).alias("v"))
    return found.select("vec_id", F.round(F.array_max("v"), 6).alias("high"), F.round(F.array_min("v"), 6).alias("low"))


@query("SELECT vec_id, round(list_max(list_transform(embedding, lambda x: x::DOUBLE / r)), 6) AS high FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS r FROM embeddings)")
def rms_normalize(spark, sf_dir):
    found = vectors(spark, sf_dir).select("vec_id", tensor.normalize_amplitude(F.col("embedding"), "rms").alias("v"))
    return found.select("vec_id", F.round(F.array_max("v"), 6).alias("high"))


@query("SELECT vec_id, CAST(100 AS BIGINT) AS padded, CAST(20 AS BIGINT) AS cut, round(embedding[20]::DOUBLE, 6) AS last, 0.0::DOUBLE AS tail FROM embeddings")
def pad_truncate(spark, sf_dir):
    found = vectors(spark, sf_dir).select("vec_id", tensor.fix_length(F.col("embedding"), 100).alias("p"), tensor.fix_length(F.col("embedding"), 20).alias("c"))
    return found.select("vec_id", F.size("p").cast("long").alias("padded"), F.size("c").cast("long").alias("cut"), F.round(F.element_at("c", -1).cast("double"), 6).alias("last"), F.element_at("p", -1).cast("double").alias("tail"))


@query("SELECT o_orderkey, n AS n_frames, coalesce(array_to_string(list_transform(range(n), lambda i: CAST(floor(i * (total::DOUBLE / n)) AS INT)), ','), '') AS frames FROM (SELECT o_orderkey, total, least(total, 22) AS n FROM (SELECT o_orderkey, o_orderkey % 400 AS total FROM orders))")
def frame_indices(spark, sf_dir):
    config = video.VideoConfig(max_frames=22)
    clips = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 400).alias("frames"), F.lit(25.0).alias("fps"))
    found = video.select_frames(clips, config, key="o_orderkey")
    return found.select("o_orderkey", F.size("indices").cast("long").alias("n_frames"), F.array_join(F.col("indices").cast("array<string>"), ",").alias("frames"))


@query("SELECT vec_id, round(list_sum(list_transform(range(48), lambda k: (k + 1) * embedding[(k % 16) * 3 + k // 16 + 1]::DOUBLE)), 6) AS total, round(embedding[3]::DOUBLE, 6) AS swapped FROM embeddings")
def tensor_layout(spark, sf_dir):
    found = vectors(spark, sf_dir).select("vec_id", tensor.channels_first(F.slice("embedding", 1, 48), 4, 4, 3).alias("c"), tensor.swap_channels(F.slice("embedding", 1, 48)).alias("s"))
    weighted = F.aggregate(F.transform("c", lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return found.select("vec_id", F.round(weighted, 6).alias("total"), F.round(F.element_at("s", 1).cast("double"), 6).alias("swapped"))


@query(f"""
WITH f AS (SELECT label, vec_id, {PIXELS} AS grey, lag({PIXELS}) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
d AS (SELECT label, vec_id, prev IS NULL AS first, list_sum(list_transform(list_zip(grey, prev), lambda z: abs(z[1] - z[2]))) / (len(grey) * 255.0::DOUBLE) AS change FROM f)
SELECT label, vec_id, round(CASE WHEN NOT first THEN change END, 6) AS change FROM d WHERE first OR change > 0.3::DOUBLE""")
def keyframe_select(spark, sf_dir):
    found = video.keyframes(vectors(spark, sf_dir).select("label", "vec_id", _pixels().alias("grey")), "label", "vec_id", "grey")
    return found.select("label", "vec_id", F.round("change", 6).alias("change"))


@query("SELECT vec_id, CAST(len(list_filter(range(2, len(embedding) + 1), lambda i: (embedding[i] < 0) <> (embedding[i - 1] < 0))) AS BIGINT) AS crossings FROM embeddings")
def zero_crossings(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", tensor.zero_crossings(F.col("embedding")).cast("long").alias("crossings"))


@query("SELECT vec_id, CAST(len(embedding) // 4 AS BIGINT) AS n, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE + embedding[4]::DOUBLE) / 4, 6) AS first FROM embeddings")
def mono_mix(spark, sf_dir):
    found = vectors(spark, sf_dir).select("vec_id", tensor.mean_channel(F.col("embedding"), 4).alias("m"))
    return found.select("vec_id", F.size("m").cast("long").alias("n"), F.round(F.element_at("m", 1), 6).alias("first"))


# Media: files made from the embeddings.


def _media(spark, sf_dir, kind):
    def one(v):
        v = np.asarray(v, dtype=np.float64)
        grey = (np.abs(np.floor(v * 1000)) % 256).astype(np.uint8).reshape(8, 8, 1)
        if kind == "image":
            return images.encode_png(grey)
        if kind == "audio":
            return audio.encode_wav(np.sin(np.cumsum(np.repeat(0.2 + np.abs(v) / 4, 100))).astype(np.float32) * 0.5, 8000)
        return video.encode_y4m(np.stack([np.roll(grey, k, axis=0).repeat(3, axis=2) for k in range(4)]))

    made = row_udf("binary", pa.binary(), one, len)
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), made(F.col("embedding")).alias("content"))


def _checked(df, column):
    return df.select("id", F.array_join(F.col(f"{column}.shape").cast("array<string>"), "x").alias("shape"), F.round(F.aggregate(f"{column}.data", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total"), F.col(f"{column}.error").alias("error"))


@query(None)
def image_resize(spark, sf_dir):
    return _checked(images.process(_media(spark, sf_dir, "image"), images.ImageConfig(size=(16, 12), keep_aspect=True)), "image")


@query("SELECT count(*) AS total_images, 8.0::DOUBLE AS avg_width, 8 AS min_width, 8 AS max_width, 8.0::DOUBLE AS avg_height, 8 AS min_height, 8 AS max_height, '1' AS channels FROM embeddings")
def image_statistics(spark, sf_dir):
    return images.statistics(_media(spark, sf_dir, "image")).withColumn("channels", F.array_join(F.col("channels").cast("array<string>"), ","))


@query(None)
def mel_features(spark, sf_dir):
    return _checked(audio.process(_media(spark, sf_dir, "audio"), audio.AudioConfig(n_mels=40, n_fft=512, hop=256)), "audio")


@query(None)
def mfcc_features(spark, sf_dir):
    return _checked(audio.process(_media(spark, sf_dir, "audio"), audio.AudioConfig(feature="mfcc", n_mels=40, n_mfcc=13, n_fft=512, hop=256)), "audio")


@query("SELECT count(*) AS total_audio, 0.8::DOUBLE AS avg_duration, 0.8::DOUBLE AS min_duration, 0.8::DOUBLE AS max_duration, round(0.8::DOUBLE * count(*), 6) AS total_duration, '8000' AS sample_rates FROM embeddings")
def audio_statistics(spark, sf_dir):
    found = audio.statistics(_media(spark, sf_dir, "audio")).withColumn("sample_rates", F.array_join(F.col("sample_rates").cast("array<string>"), ","))
    return found.withColumn("total_duration", F.round("total_duration", 6)).withColumn("avg_duration", F.round("avg_duration", 6))


@query("SELECT vec_id AS id, CAST(2 AS BIGINT) AS n, '0,2' AS frames FROM embeddings")
def video_frames(spark, sf_dir):
    found = video.extract_frames(_media(spark, sf_dir, "video"), video.VideoConfig(max_frames=2))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("frame").cast("string"))), ",").alias("frames"))


@query(None)
def video_process(spark, sf_dir):
    return _checked(video.process(_media(spark, sf_dir, "video"), video.VideoConfig(max_frames=3, size=(8, 8), layout="cthw")), "video")


# Pipelines.


@query(CLEAN + " SELECT doc_id, 'PROCESSED ' || cleaned AS cleaned FROM c WHERE cleaned <> ''")
def chained_pipeline(spark, sf_dir):
    chain = Chain().add(text.clean).add(lambda df, mark: df.withColumn("cleaned", F.concat(F.lit(mark), "cleaned")).where(F.col("cleaned") != mark), mark="PROCESSED ")
    return chain.process(docs(spark, sf_dir)).select("doc_id", "cleaned")


@query(CLEAN + rf" SELECT doc_id, CAST(len(list_filter(string_split(cleaned, ' '), lambda x: x <> '')) AS BIGINT) AS n FROM c WHERE regexp_matches(text, '[^{WS[1:]}')")
def pipeline_text(spark, sf_dir):
    samples = docs(spark, sf_dir).withColumn("modality", F.lit("text"))
    return Pipeline(PipelineConfig(image=None)).process_all(samples)["text"].select("doc_id", F.size("tokens").cast("long").alias("n"))


@query(rf"SELECT doc_id, {SENTENCES} AS sentences, len({WORDS}) AS words FROM documents")
def text_measures(spark, sf_dir):
    found = V.measure(docs(spark, sf_dir))
    return found.select("doc_id", F.col("__n_sentences").cast("long").alias("sentences"), F.col("__n_words").cast("long").alias("words"))


# Registered on import.
from . import check_queries, file_queries, group_queries, media_queries, stream_queries, time_queries  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "check_queries", "file_queries", "group_queries", "media_queries", "stream_queries", "time_queries"]
