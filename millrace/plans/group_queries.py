"""Registered queries over groups, multisets, caches, table functions and the registry as a data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import TextConfig
from ..operators import groups, text
from ..session import table
from ..sources.samples_source import read_samples, read_written, write_samples
from ..workspace import new_path
from .file_queries import FILES, folder, name
from .registry import query
from .result_cache import ResultCache


@query(
    """WITH l AS (SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INT) AS shipped, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
SELECT CAST(GROUPING(l_returnflag) * 4 + GROUPING(l_linestatus) * 2 + GROUPING(shipped) AS INT) AS grouping, l_returnflag, l_linestatus, shipped, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, count(DISTINCT l_suppkey) AS suppliers
FROM l GROUP BY CUBE (l_returnflag, l_linestatus, shipped)"""
)
def lineitem_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("shipped"), "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    dims = ("l_returnflag", "l_linestatus", "shipped")
    sets = [[d for i, d in enumerate(dims) if not bits >> (2 - i) & 1] for bits in range(8)]
    return groups.totals(rows, sets, ["cents"], "l_suppkey", out="suppliers")


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS view, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS error FROM events GROUP BY user_id")
def event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user across types."""
    return groups.crossed(table(spark, sf_dir, "events"), "user_id", "event_type", ("click", "view", "error"), F.count(F.lit(1)))


SHARES = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


@query(
    f"""WITH l AS (SELECT CASE WHEN l_linenumber <= 3 THEN 'R' ELSE l_returnflag END AS flag, l_extendedprice AS price FROM lineitem),
r AS (SELECT flag, price, row_number() OVER (PARTITION BY flag ORDER BY price) AS rank, count(*) OVER (PARTITION BY flag) AS n FROM l),
q AS (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in SHARES)}]) AS share)
SELECT flag, share, price, rank FROM r, q WHERE rank = greatest(1, CAST(ceil(share * n) AS BIGINT))"""
)
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of prices by flag, one of which has most rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") <= 3, "R").otherwise(F.col("l_returnflag")).alias("flag"), F.col("l_extendedprice").alias("price"))
    return groups.quantiles(rows, ["flag"], "price", SHARES)


@query(
    """SELECT flag, l_orderkey, l_linenumber, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY flag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INT) AS rank
FROM (SELECT *, CASE WHEN l_linenumber <= 3 THEN 'R' ELSE l_returnflag END AS flag FROM lineitem)) WHERE rank <= 25"""
)
def top_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("flag", F.when(F.col("l_linenumber") <= 3, "R").otherwise(F.col("l_returnflag")))
    found = groups.top_rows(rows, ["flag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 25)
    return found.select("flag", "l_orderkey", "l_linenumber", "rank")


@query(
    """WITH a AS (SELECT l_partkey % 50 AS part, l_returnflag AS flag FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT l_partkey % 50 AS part, l_returnflag AS flag FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT 'common' AS side, part, flag, count(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY part, flag
UNION ALL SELECT 'more', part, flag, count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY part, flag"""
)
def multiset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and flags of odd and even lines as multisets."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("part"), F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") % 2).alias("odd"))
    odd, even = (rows.where(F.col("odd") == k).drop("odd") for k in (1, 0))
    parts = [groups.multiset(odd, even, how).withColumn("side", F.lit(how)) for how in ("common", "more")]
    return parts[0].union(parts[1]).groupBy("side", "part", "flag").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT doc_id, text, doc_id % 3 > 0 AS early FROM documents), e AS (SELECT DISTINCT text FROM d WHERE early)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN e.text IS NOT NULL THEN 1 ELSE 2 END AS run, md5(lower(d.text)) AS result FROM d LEFT JOIN e ON d.text = e.text"""
)
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a cache in which two thirds of them were processed before: `run` says when each content was."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    config = TextConfig(unicode_form=None, remove_urls=False, remove_emails=False, remove_phone_numbers=False, collapse_space=False, min_length=None, tokenizer=None)
    cache = ResultCache(spark, new_path(spark, "cache"), "text", config, lambda rows: text.clean(rows, "text", config))
    cache.apply(docs.where("doc_id % 3 > 0"))
    return cache.apply(docs).select("doc_id", "run", F.md5("cleaned").alias("result"))


@query(
    """SELECT r_regionkey, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INT) AS record, CASE WHEN n_nationkey % 5 > 0 THEN CAST(n_nationkey AS VARCHAR) END AS nation, CASE WHEN n_nationkey % 5 > 0 THEN '"' || n_name || '", ' || r_regionkey END AS name,
CASE WHEN n_nationkey % 5 = 0 THEN '1 fields, not 2' END AS error FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of a region as one CSV text, cut into its records by a lateral call; some records are too short."""
    tables.register(spark)
    nations = table(spark, sf_dir, "nation").withColumn("line", F.when(F.col("n_nationkey") % 5 == 0, F.lit("short")).otherwise(F.concat(F.col("n_nationkey").cast("string"), F.lit(',"""'), F.col("n_name"), F.lit('"", '), F.col("n_regionkey").cast("string"), F.lit('"'))))
    texts = nations.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n\n").alias("text"))
    return spark.sql("SELECT t.n_regionkey AS r_regionkey, c.record, c.nation, c.name, c.error FROM {texts} t, LATERAL csv_records(t.text, 'nation,name') c", texts=texts)


@query("SELECT event_id, 0 AS record, props->>'k' AS k, NULL AS z FROM events UNION ALL SELECT event_id, 1, NULL, CAST(event_id AS VARCHAR) FROM events")
def json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.col("props"), F.lit(', {"z": '), F.col("event_id").cast("string"), F.lit("}]")).alias("text"))
    return spark.sql("SELECT e.event_id, j.record, j.k, j.z FROM {events} e, LATERAL json_elements(e.text, 'k,z') j", events=events)


@query("SELECT user_id, ts, before, event_type AS after FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another type than their user's event before."""
    tables.register(spark)
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return spark.sql("SELECT * FROM changes(TABLE({events}), 'user_id', 'ts', 'event_type')", events=events)


@query(FILES + " SELECT source_name, name, modality, CASE WHEN modality = 'text' THEN n_name || chr(10) || chr(233) END AS text, CASE WHEN modality <> 'text' THEN size END AS n_bytes FROM (SELECT 'all' AS source_name, * FROM files WHERE modality IN ('text', 'image') UNION ALL SELECT 'sound', * FROM files WHERE modality = 'video' AND k % 2 = 1) WHERE modality <> 'image'")
def sample_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as a data source: what the options rule out is never opened; written and read again by its own writer."""
    base = folder(spark, sf_dir)
    samples = read_samples(spark, [{"name": "all", "path": base}, {"name": "sound", "path": f"{base}/odd", "modalities": ["video"]}, {"name": "gone", "path": f"{base}/absent"}], bundle_bytes="40", only_modalities='["text", "video"]')
    path = new_path(spark, "samples")
    write_samples(samples, path)
    return read_written(spark, path).select("source_name", name("id").alias("name"), "modality", "text", F.octet_length("content").cast("long").alias("n_bytes"))
