"""URL filtering against a memory-mapped, sorted digest array.

A list is stored as 64-bit xxHash keys in ascending order, followed by where
each key's full string lies, the strings and their verdicts. Executors map the
file and probe it by binary search over whole batches; a digest that is found
counts only if the stored string equals the probe.

A blocklist is a table. It is stored in one file for each range of digests, so
that the driver holds a range at a time; a list that is too large to lie on
every executor's disk is joined with the URLs' candidates instead.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop_path, new_path

#: The policy rules (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Names in host labels that the default list blocks, on every domain they stand under.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}/" for name in BLOCKED_NAMES for top in ("com", "net", "org"))

MAGIC = b"MRDIGST2"
SEED = 42
#: Bytes of a list's file, about, and of a list that every executor gets.
PART_BYTES, LIST_BYTES = 64 << 20, 8 << 30
ALLOW, BLOCK = 0, 1
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def pack(entries: Iterable[tuple[str, int]]) -> bytes:
    """The stored form of (string, verdict) entries; of a string given twice the last verdict holds."""
    found = dict(entries)
    keyed = sorted((xxhash.xxh64_intdigest(s.encode(), SEED), s.encode(), v) for s, v in found.items())
    lengths = sorted({len(s.encode().partition(b"/")[2]) + 1 for s in found})
    hosts = sorted({len(s.encode().partition(b"/")[0]) for s in found})
    ends = np.cumsum([0, *(len(s) for _, s, _ in keyed)], dtype=np.uint64)
    head = np.array([len(keyed), len(lengths), len(hosts), *lengths, *hosts], dtype=np.uint64)
    return b"".join((MAGIC, head.tobytes(), np.array([k for k, _, _ in keyed], dtype=np.uint64).tobytes(), ends.tobytes(), np.array([v for _, _, v in keyed], dtype=np.uint8).tobytes(), *(s for _, s, _ in keyed)))


class DigestArray:
    """A packed list, mapped from a file or given as bytes."""

    def __init__(self, source: str | bytes):
        data = np.memmap(source, dtype=np.uint8, mode="r") if isinstance(source, str) else np.frombuffer(source, dtype=np.uint8)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a digest array")
        n, m, k = (int(x) for x in data[8:32].view(np.uint64))
        at = 32
        self.path_lengths = [int(x) for x in data[at : at + 8 * m].view(np.uint64)]
        at += 8 * m
        self.host_lengths = [int(x) for x in data[at : at + 8 * k].view(np.uint64)]
        at += 8 * k
        self.keys = data[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = data[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.verdicts, self.text = data[at : at + n], data[at + n :]

    def entry(self, i: int) -> bytes:
        return self.text[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def find(self, probes: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """The entry of each probe, or -1; equal digests are told apart by the stored strings."""
        if digests is None:
            digests = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in probes), dtype=np.uint64, count=len(probes))
        first, last = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        found = np.full(len(probes), -1, dtype=np.int64)
        for i in np.flatnonzero(last > first):
            found[i] = next((j for j in range(first[i], last[i]) if self.entry(j) == probes[i]), -1)
        return found


class DigestRanges:
    """Digest arrays, each with an equal range of digests, as one. Their number is a power of two."""

    def __init__(self, parts: list[DigestArray]):
        self.parts = parts
        self.path_lengths = sorted({n for p in parts for n in p.path_lengths})
        self.host_lengths = sorted({n for p in parts for n in p.host_lengths})

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The entry of each probe, or -1, numbered over all parts."""
        digests = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in probes), dtype=np.uint64, count=len(probes))
        found, bits = np.full(len(probes), -1, dtype=np.int64), len(self.parts).bit_length() - 1
        part = (digests >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(probes), dtype=np.int64)
        for n in np.unique(part):
            mine = np.flatnonzero(part == n)
            at = self.parts[n].find([probes[i] for i in mine], digests[mine])
            found[mine] = np.where(at >= 0, at * len(self.parts) + n, -1)
        return found

    def entry(self, i: int) -> bytes:
        return self.parts[i % len(self.parts)].entry(i // len(self.parts))


def publish_table(spark: SparkSession, entries: DataFrame) -> list[str] | None:
    """Stores a table of entries (entry) in ranges of digests and returns the files' names; None if it is too large."""
    size = entries.agg(F.sum(F.octet_length("entry") + 24)).first()[0] or 0
    if size > LIST_BYTES:
        return None
    bits = max(0, (size // PART_BYTES).bit_length())
    part = F.shiftrightunsigned(F.xxhash64("entry"), 64 - bits).cast("int") if bits else F.lit(0)
    # One pass deals the entries out by range; the driver then reads one folder after another.
    path = new_path(spark, "entries")
    entries.select("entry", part.alias("part")).repartition(1 << bits, "part").write.partitionBy("part").parquet(path)
    schema, files = "entry string, part int", []
    for n in range(1 << bits):
        mine = spark.read.schema(schema).parquet(path).where(F.col("part") == n)
        files.append(publish(spark, pack((e, BLOCK) for e in mine.toArrow()["entry"].to_pylist())))
    return files


def publish(spark: SparkSession, packed: bytes) -> str:
    """Puts a packed list in the shared folder and has every executor, also a later one, fetch it; returns its file name."""
    fs, where = hadoop_path(spark, new_path(spark, "digests"))
    out = fs.create(where, False)
    try:
        for at in range(0, len(packed), 1 << 20):
            out.write(bytearray(packed[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(where).toString())
    return os.path.basename(where.toString())


def parts(url: str | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path of a URL; both empty without a "://"."""
    if url is None or "://" not in url:
        return b"", b""
    rest = url.encode("utf-8", "replace").partition(b"://")[2]
    for end in (b"#", b"?"):
        rest = rest.partition(end)[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(bytes.maketrans(UPPER, LOWER)), slash + path


def candidates(host: bytes, path: bytes, host_lengths: list[int], path_lengths: list[int]) -> list[bytes]:
    """What an entry that fits could be: the host and each domain above it that is as long as some entry's, with each prefix of the path as long as some entry's."""
    size = len(host)
    if not size:
        return []
    hosts = [host[size - n :] for n in host_lengths if n == size or (n < size and host[size - n - 1] == 46)]
    return [h + path[:n] for h in hosts for n in path_lengths if n <= len(path)]


def match(urls: list[str | None], digests: DigestArray | DigestRanges) -> list[tuple[bytes, bytes, int]]:
    """(host, path, entry) of each URL, the longest entry that fits, or -1; entries of one length can't both fit unless their hosts differ, and then the longer host wins."""
    split = [parts(u) for u in urls]
    probes, owner = [], []
    for i, (host, path) in enumerate(split):
        own = candidates(host, path, digests.host_lengths, digests.path_lengths)
        probes += own
        owner += [i] * len(own)
    best: dict[int, tuple[tuple[int, int], int]] = {}
    for i, p, e in zip(owner, probes, digests.find(probes), strict=True):
        if e >= 0:
            rank = (len(p), len(p.partition(b"/")[0]))
            if i not in best or rank > best[i][0]:
                best[i] = (rank, int(e))
    return [(h, p, best[i][1] if i in best else -1) for i, (h, p) in enumerate(split)]


def block_table(spark: SparkSession, blocked: Iterable[str] = BLOCKED_HOSTS) -> DataFrame:
    return spark.createDataFrame([(b,) for b in blocked], "entry string")


def listed_by_join(pages: DataFrame, url_col: str, entries: DataFrame) -> DataFrame:
    """Distinct URLs (__mr_url) with the entry that fits best (__mr_listed), for lists of any size: the URLs' candidates are joined with the entries."""
    length = lambda pattern: F.octet_length(F.regexp_extract("entry", pattern, 1))
    hosts, lengths = (sorted(r.n for r in entries.select(n.alias("n")).distinct().collect()) for n in (length("(?s)^([^/]*)"), length("(?s)/(.*)$") + 1))  # lengths, not entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                host, path = parts(url)
                found = {h.decode() for h in candidates(host, path, hosts, lengths) if _whole(h)}
                rows += [(url, c, len(c.encode()), len(c.encode().partition(b"/")[0])) for c in found]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("url", pa.string()), ("entry", pa.string()), ("n", pa.int64()), ("host", pa.int64())))})

    probes = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct().mapInArrow(run, "url string, entry string, n long, host long")
    best = F.max(F.struct("n", "host", "entry")).alias("best")
    return probes.join(entries.distinct(), "entry").groupBy("url").agg(best).select(F.col("url").alias("__mr_url"), F.col("best.entry").alias("__mr_listed"))


def _whole(data: bytes) -> bool:
    """Whether a prefix of a text's bytes ends between characters."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocked: DataFrame | None = None) -> DataFrame:
    """Judges every URL.

    Returns one row per input row: id_col, host, path, rule (the longest rule
    that fits, or null), verdict (the rule's; without one "block" if the
    blocklist has the host or a domain above it with a prefix of the path, else
    "allow"), listed (the blocklist entry, or null). Rules and blocklist are
    digest arrays; entries are "host/path", those of the blocklist in the
    column `entry` of a table (null entries and repeats are ignored). Only the
    two columns of pages are read.

    Null URLs and URLs without "://" have an empty host and path and are
    allowed; repeated rows are judged alike; extra columns are ignored; an
    empty table gives an empty result, an empty blocklist blocks nothing.
    """
    spark = pages.sparkSession
    entries = (block_table(spark) if blocked is None else blocked.select("entry")).where("entry IS NOT NULL")
    rule_file = publish(spark, pack((s, BLOCK if v == "block" else ALLOW) for v, s in rules))
    list_files = publish_table(spark, entries)
    rows, names = pages.select(id_col, url_col), [id_col, "host", "path", "rule", "verdict", "listed"]
    if list_files is None:
        best = listed_by_join(pages, url_col, entries)
        rows = rows.join(best, F.col(url_col) == F.col("__mr_url"), "left").select(id_col, url_col, "__mr_listed")
    id_type = pages.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruled = DigestArray(SparkFiles.get(rule_file))
        listed = None if list_files is None else DigestRanges([DigestArray(SparkFiles.get(f)) for f in list_files])
        for batch in batches:
            urls = batch.column(1).to_pylist()
            by_rule = match(urls, ruled)
            hits = batch.column(2).to_pylist() if listed is None else [listed.entry(x).decode() if x >= 0 else None for _, _, x in match(urls, listed)]
            verdicts = [("block" if ruled.verdicts[r] else "allow") if r >= 0 else ("allow" if x is None else "block") for (_, _, r), x in zip(by_rule, hits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h.decode() for h, _, _ in by_rule], pa.string()),
                    pa.array([p.decode() for _, p, _ in by_rule], pa.string()),
                    pa.array([ruled.entry(r).decode() if r >= 0 else None for _, _, r in by_rule], pa.string()),
                    pa.array(verdicts, pa.string()),
                    pa.array(hits, pa.string()),
                ],
                names=names,
            )

    return rows.mapInArrow(judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string, listed string")
