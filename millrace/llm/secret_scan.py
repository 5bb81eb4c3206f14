"""Secret scanning with an incremental blob ledger, with DataFrame functions only.

Every version of every file is addressed by the SHA-256 of its content. The
ledger holds, for each blob, the rules (with their versions) it was scanned by
and the spans found. A scan takes only blobs with a rule version that the
ledger doesn't have, and only these rules; findings then join back to all
paths and versions that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop_path, new_path, written


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group (0: all of it) has at least `least` characters. A changed rule needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}+", 0, 16),
)
#: Rules beyond them: private-key headers, prefixed service tokens and signed web tokens. What counts as a word's edge is spelled out, as Java versions differ on it.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("service", r"(?<![A-Za-z0-9_])(?:gh[pousr]_|glpat-|xox[abprs]-)[A-Za-z0-9-]{20,}", version=2),
    Rule("jwt", r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", version=2),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start: bigint, rank: int, kind: string, end: bigint>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


#: Matches that one inner step gathers: appending to an array copies it.
STEP = 256


def spans(text: Column, matches: Column, rule: Rule, rank: int) -> Column:
    """Spans (code points, end exclusive) of a rule's matches, which lie between the pieces that splitting at them leaves.

    Matches are gathered STEP at a time and these lists once more, so that a
    text of very many matches doesn't take the square of them.
    """
    size = F.length
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), matches.alias("match"))
    empty = F.array().cast(SPANS)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + size(pair["piece"])
        end = start + size(pair["match"])
        counts = size(F.regexp_extract(pair["match"], rule.pattern, rule.group)) >= rule.least if rule.group or rule.least > 1 else F.lit(True)
        span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        return F.struct(F.coalesce(end, start).cast("long").alias("at"), F.when(pair["match"].isNotNull() & counts, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def some(state: Column, pairs: Column) -> Column:
        inner = F.aggregate(pairs, F.struct(state["at"].alias("at"), empty.alias("spans")), step, lambda s: s)
        # A list of one, so that the inner result is made once and read twice.
        return F.element_at(F.transform(F.array(inner), lambda s: F.struct(s["at"].alias("at"), F.concat(state["lists"], F.array(s["spans"])).alias("lists"))), 1)

    # Lists of one keep what is read several times from being made several times.
    starts = lambda pairs: F.sequence(F.lit(1), F.size(pairs), F.lit(STEP))
    parts = lambda pairs: F.transform(starts(pairs), lambda k: F.slice(pairs, k, F.lit(STEP)))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPANS}>").alias("lists"))
    gathered = F.element_at(F.transform(F.array(found), lambda pairs: F.aggregate(parts(pairs), first, some)["lists"]), 1)
    return F.when(F.size(matches) == 0, empty).otherwise(F.flatten(gathered))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of blobs (blob, text, seen: rule keys that need no scan)."""
    pending = F.filter(F.array(*[F.lit(r.key) for r in rules]), lambda k: ~F.array_contains("seen", k))
    staged = blobs.withColumn("rules", pending).where(F.size("rules") > 0)
    none = F.array().cast("array<string>")
    for n, rule in enumerate(rules):
        matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        staged = staged.withColumn(f"m{n}", F.when(F.array_contains("rules", rule.key), matches).otherwise(none))
    found = F.concat(*[spans(F.col("text"), F.col(f"m{n}"), rule, n) for n, rule in enumerate(rules)])
    return staged.select("blob", "rules", F.array_sort(found).alias("spans"))


def known(spark: SparkSession, ledger: str) -> bool:
    fs, where = hadoop_path(spark, ledger)
    return bool(fs.exists(where))


def open_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger as it is; an empty one where there is none yet."""
    return spark.read.schema(LEDGER).parquet(ledger) if known(spark, ledger) else spark.createDataFrame([], LEDGER)


def scan_versions(versions: DataFrame, path_cols: list[str], text_col: str = "text", ledger: str | None = None, rules=RULES) -> DataFrame:
    """Scans what the ledger lacks, adds it there, and joins findings to all paths.

    versions has a row for each version of each path (path_cols name a row).
    Returns path_cols, blob (the content's SHA-256) and spans: an array of
    (start, rank, kind, end), ordered by start, then by the rules' order; code
    points, end exclusive. Without a ledger path a new one is begun.

    Null texts count as empty; empty texts are a blob without findings; equal
    rows get equal results; extra columns are ignored; an empty table gives no
    rows and adds nothing to the ledger.
    """
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    content = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.sha2(content.cast("binary"), 256)
    texts = versions.select(blob.alias("blob"), content.alias("text"))
    none = F.array().cast("array<string>")
    if known(spark, ledger):
        # Hashes alone decide what lacks a rule; of the texts only these move.
        seen = open_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        lacking = versions.select(blob.alias("blob")).distinct().join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", none))
        lacking = written(lacking.where(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), "seen")) > 0), "lacking")
        unseen = texts.join(lacking.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]).join(lacking, "blob")
    else:
        unseen = texts.dropDuplicates(["blob"]).withColumn("seen", none)
    scan(unseen, rules).write.mode("append").parquet(ledger)

    current = open_ledger(spark, ledger).select("blob", F.explode("rules").alias("key"), "spans")
    ranks = {r.key: n for n, r in enumerate(rules)}
    wanted = current.where(F.col("key").isin(list(ranks)))
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    own = wanted.select("blob", "key", F.filter("spans", lambda s: s["kind"] == kinds[F.col("key")]).alias("spans")).where(F.size("spans") > 0)
    # A rule's spans are all in one ledger row; two runs at once may have added it twice.
    once = own.groupBy("blob", "key").agg(F.first("spans").alias("spans"))
    by_blob = once.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Written: a side of its own lets Spark split the rows of a blob that very many paths hold.
    by_blob = written(by_blob, "findings")
    keyed = versions.select(*path_cols, blob.alias("blob"))
    empty = F.array().cast(by_blob.schema["spans"].dataType)
    return keyed.join(by_blob, "blob", "left").select(*path_cols, "blob", F.coalesce("spans", empty).alias("spans"))
