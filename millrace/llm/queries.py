"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_features, decontaminate, lexical_search, line_dedup, mixing, secret_scan, sharding, simhash, suffix_dedup, term_fingerprints, toxicity, url_filter, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=8)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, i, source, lines[i] AS line, trim(lines[i], ' ') AS bare
  FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), common AS (
  SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce('s' || source, 'none')) >= 8
)
SELECT doc_id, count(*) AS n_lines, count(common.bare) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.bare IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common ON l.bare = common.bare GROUP BY doc_id
"""


OP4_SQL = (
    r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)(/[^?#]*)?', ['host', 'path']) ELSE {'host': '', 'path': ''} END AS u FROM pages
), q AS (
  SELECT page_id, translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.path AS path FROM p
), e(kind, verdict, host, path) AS (VALUES
  ('rule', 'block', 'net', '/'), ('rule', 'allow', 'example.net', '/en/'), ('rule', 'block', 'example.com', '/de/'), ('rule', 'allow', 'org', '/fr/'),
"""
    + ",\n".join(f"  ('list', 'block', '{h[:-1]}', '/')" for h in url_filter.BLOCKED_HOSTS)
    + r"""
), m AS (
  SELECT page_id, kind, max_by(e.host || e.path, length(e.host || e.path)) AS entry, max_by(verdict, length(e.host || e.path)) AS verdict
  FROM q JOIN e ON (q.host = e.host OR ends_with(q.host, '.' || e.host)) AND starts_with(q.path, e.path) GROUP BY page_id, kind
)
SELECT q.page_id, q.host, q.path, r.entry AS rule, coalesce(r.verdict, l.verdict, 'allow') AS verdict, l.entry AS listed
FROM q LEFT JOIN (SELECT * FROM m WHERE kind = 'rule') r USING (page_id) LEFT JOIN (SELECT * FROM m WHERE kind = 'list') l USING (page_id)
"""
)


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features.audio_features(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(":", "n_frames", F.size("segments"), F.sha2("tensors", 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_versions(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE_RULES]))
    counts = [F.size(F.filter("spans", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(named_spans(base), 256).alias("base_sha256"), named_spans(F.col("spans")).alias("spans"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def named_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _rule_sql(rank: int, rule: secret_scan.Rule) -> str:
    """Matches of a rule and the pieces between them; a possessive run is a run, and a word's edge has a sign of its own."""
    pattern = rule.pattern.replace("{16,}+", "{16,}").replace("(?<![A-Za-z0-9_])", r"\b").replace("'", "''")
    return f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS found, list_transform(found, lambda x: len(regexp_extract(x, '{pattern}', {rule.group})) >= {rule.least}) AS counts FROM d"


OP7_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(_rule_sql(n, r) for n, r in enumerate(secret_scan.RULES))
    + r"""), e AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT doc_id, rank, kind, counts[i] AS counts, list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS start, len(found[i]) AS n FROM e),
named AS (SELECT doc_id, rank, kind, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM s WHERE counts),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
o AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS turn FROM r),
k AS (SELECT doc_id, i, sum(turn) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
s AS (SELECT doc_id, span, min(i) AS first, max(i) + 199 AS last FROM k GROUP BY doc_id, span),
p AS (SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM s),
g AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(last - first + 1) AS BIGINT) AS n_removed, string_agg(hex(b[before + 1:first - 1]), '' ORDER BY first) AS kept, max(last) AS last FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(kept || hex(b[last + 1:])) END) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12) AS place FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (ARRAY[3.0::DOUBLE, 1.0, 2.0])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), t AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), u AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM t WHERE level * weight <= cap) * weight, cap)) AS target FROM t
), b AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS base FROM u
), g AS (
  SELECT d.source, place, sum(size) AS group_size, coalesce(sum(sum(size)) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d GROUP BY d.source, place
), l AS (
  SELECT g.source, max(place) FILTER (before + group_size / 2 <= target - base * source_size) AS last FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source GROUP BY g.source
)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN target > base * source_size AND place <= coalesce(last, '') THEN 1 ELSE 0 END) AS BIGINT) AS taken, d.source
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""



def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 100 - 75 + (75 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
q AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM b) GROUP BY q, term),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, n_docs),
p AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM t JOIN f USING (term) JOIN m USING (r)),
g AS (SELECT q, r, CAST(sum(times * part) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM g JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 10
"""


def op12_term_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = vector_codes.codebooks_sha256(codebooks)
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op13_sql(rounds: int) -> str:
    """One step of assigning and averaging after another: k holds the parts' components as lists, c0, c1... the codebooks."""
    assign = "SELECT vec_id, label, p, arg_min(e, d * 16 + e) AS e, CAST(min(d) AS BIGINT) AS d FROM (SELECT k.vec_id, k.label, k.p, c.e, list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k JOIN {c} c ON k.p = c.p) GROUP BY vec_id, label, p"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({assign.format(c=f'c{n}')})")
        means = "list(CAST(floor_div AS BIGINT) ORDER BY i)"
        split = f"SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(range(1, 9)) AS i, unnest(k.x) AS x FROM a{n} a JOIN k USING (vec_id, p)) GROUP BY p, e, i"
        steps.append(f"m{n} AS MATERIALIZED (SELECT p, e, {means} AS x FROM (SELECT p, e, i, s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS floor_div FROM ({split})) GROUP BY p, e)")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (p, e))")
    return (
        """WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), k AS MATERIALIZED (SELECT vec_id, label, p, x[p * 8 + 1:p * 8 + 8] AS x FROM (SELECT *, unnest(range(8)) AS p FROM v)),
c0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM k) WHERE e < 16), """
        + ", ".join(steps)
        + f""", last AS MATERIALIZED ({assign.format(c=f"c{rounds}")}),
g AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM g, h
"""
    )


OP13_SQL = _op13_sql(vector_codes.ROUNDS)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_audio_features": op5_audio_features,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_term_fingerprints": op12_term_fingerprints,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_secret_scan": OP7_SQL, "op9_suffix_dedup": OP9_SQL, "op10_mixing": OP10_SQL, "op11_lexical_search": OP11_SQL, "op13_vector_codes": OP13_SQL}
