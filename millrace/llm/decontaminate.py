"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window (10 words, or a whole shorter item) is a set of word
shingles. For containment of the whole set, one shingle of each window is a
sufficient prefix: the rarest, by counts over all documents, meets the fewest
documents. Documents join on these shingles only; a pair must then pass the
length bound (the text has as many words as the window) and the positional
bounds (the window's words before and after the shingle are inside the text)
and is verified word by word.

Executors cut the benchmark into windows and make them distinct. The index goes
to all executors in blocks of bounded size; a larger benchmark takes more
blocks, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Words, class_table, mixed, powers, run_hash, steps, text_bytes
from .common import written

#: Word characters: 0-9, a-z (A-Z are lower-cased before) and everything beyond ASCII.
WORD = class_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
WINDOW, SHINGLE = 10, 3
#: Distinct windows of a block. At some 400 bytes each, a block's index is about 100 MB at most.
BLOCK_WINDOWS = 250_000


@dataclass
class Index:
    """A block of distinct windows and, once rarity is known, the shingle by which each is found."""

    texts: list[bytes] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    items: list[set[str]] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)

    def shingles(self, width: int) -> dict[int, np.ndarray]:
        """Shingle hashes of each window; a window of fewer words has one, itself."""
        return {i: run_hash(self.hashes[i], min(width, self.sizes[i])) for i in range(len(self.texts))}

    def widths(self, width: int) -> list[int]:
        return sorted({min(width, n) for n in self.sizes})


class Probe:
    """A sorted set of hashes with a bitmap before it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = max(16, int(len(self.keys) * 16 + 1).bit_length())
        self.map = np.zeros(1 << self.bits, dtype=bool)
        self.map[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes hold a key, and which."""
        at = np.flatnonzero(self.map[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def words_of(texts: list[str | None]) -> Words:
    data, starts = text_bytes(pa.array(texts, pa.string()))
    return Words(data, starts, WORD)


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct windows (window: words joined by blanks; size: words; items: ids as strings) of all items, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, words in steps_of(batches, 1):
            items, rows = batch.column(0).slice(first, last - first).to_pylist(), []
            for i, item in enumerate(items):
                begin, end = int(words.first[i]), int(words.first[i + 1])
                m = min(size, end - begin)
                rows += [(words.bytes_of(at, m), m, item) for at in range(begin, end - m + 1)] if m else []
                if len(rows) > 10_000 or i == len(items) - 1:
                    yield pa.RecordBatch.from_pydict({"window": pa.array([r[0] for r in rows], pa.binary()), "size": pa.array([r[1] for r in rows], pa.int32()), "item": pa.array([r[2] for r in rows], pa.string())})
                    rows = []

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    each = items.mapInArrow(run, "window binary, size int, item string")
    return written(each.groupBy("window", "size").agg(F.collect_set("item").alias("items")), "windows")


def window_blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int, block: int) -> Iterator[tuple[Index, bool]]:
    """The distinct windows in blocks of about `block`, one after another, and whether there are several; a block is all that the driver holds if its caller is done with it before the next."""
    windows = windows_of(benchmark, item_col, text_col, size)
    blocks = -(-windows.count() // block)
    for n in range(blocks):
        found = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == n).orderBy("window").toArrow()
        if found.num_rows:
            texts = found["window"].to_pylist()
            words = words_of([t.decode("utf-8", "surrogateescape") for t in texts])
            hashes = [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(texts))]
            yield Index(texts, found["size"].to_pylist(), [set(i) for i in found["items"].to_pylist()], hashes), blocks > 1


def steps_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, Words]]:
    for batch in batches:
        data, starts = text_bytes(batch.column(column))
        for first, last in steps(starts):
            own = starts[first : last + 1] - starts[first]
            yield batch, first, last, Words(data[starts[first] : starts[last]], own, WORD)


def within(words: Words, n: int) -> np.ndarray:
    """For each run of n words, whether it lies in one text."""
    count = max(0, len(words.begin) - n + 1)
    ok = np.ones(count, dtype=bool)
    for back in range(1, n):  # runs that begin up to n-1 words before a text's end
        bad = words.first[1:-1] - back
        ok[bad[(bad >= 0) & (bad < count)]] = False
    return ok


def rarity(docs: DataFrame, text_col: str, index: Index, width: int) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents; at most one number per shingle of the block."""
    own = index.shingles(width)
    sets = {w: np.unique(np.concatenate([own[i] for i, n in enumerate(index.sizes) if min(width, n) == w])) for w in index.widths(width)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {w: Probe(keys) for w, keys in sets.items()}
        totals = {w: np.zeros(len(p.keys), dtype=np.int64) for w, p in probes.items()}
        for _, _, _, words in steps_of(batches, 0):
            for w, probe in probes.items():
                at, key = probe.find(words.runs(w))
                totals[w] += np.bincount(key[within(words, w)[at]], minlength=len(probe.keys))
        for w, probe in probes.items():
            some = np.flatnonzero(totals[w])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(probe.keys[some].view(np.int64)), pa.array(totals[w][some])], names=["shingle", "n"])

    table = docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(table["shingle"].to_numpy().view(np.uint64).tolist(), table["n"].to_pylist(), strict=True))


def prefix_join(counts: dict[int, int], index: Index, width: int) -> dict[int, tuple]:
    """For each width: the prefix shingles, and of each the windows it stands for and how many words they have before it."""
    own, rows = index.shingles(width), []
    for i, n in enumerate(index.sizes):
        at = min(range(len(own[i])), key=lambda k: (counts.get(int(own[i][k]), 0), k))
        rows.append((min(width, n), own[i][at], i, at))
    joins = {}
    for w in index.widths(width):
        mine = sorted((p[1:] for p in rows if p[0] == w), key=lambda p: (p[0], p[1]))
        keys = np.array([p[0] for p in mine], dtype=np.uint64)
        unique, heads = np.unique(keys, return_index=True)
        joins[w] = (unique, np.append(heads, len(keys)), np.array([p[1] for p in mine]), np.array([p[2] for p in mine]))
    return joins


class Finder:
    """Finds a block's windows in runs of texts."""

    def __init__(self, index: Index, joins: dict[int, tuple]):
        self.index, self.joins = index, joins
        self.sizes = np.array(index.sizes, dtype=np.int64)
        self.whole = np.array([run_hash(h, len(h))[0] for h in index.hashes], dtype=np.uint64)
        self.probes = {w: Probe(j[0]) for w, j in joins.items()}

    def find(self, words: Words) -> tuple[np.ndarray, list[set[int]]]:
        """How many windows begin less end at each word, and the windows of each text."""
        n_docs, sizes = len(words.first) - 1, self.sizes
        doc_of = np.repeat(np.arange(n_docs), np.diff(words.first))
        delta = np.zeros(len(words.begin) + 1, dtype=np.int64)
        found: list[set[int]] = [set() for _ in range(n_docs)]
        for w, (_, heads, windows, before) in self.joins.items():
            at, key = self.probes[w].find(words.runs(w))
            # The join: each place of a prefix shingle with each window that it stands for.
            many = heads[key + 1] - heads[key]
            place = np.repeat(at, many)
            row = np.repeat(heads[key], many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
            window, start = windows[row], place - before[row]
            doc = doc_of[place]
            length = words.first[doc + 1] - words.first[doc]
            ok = (sizes[window] <= length) & (start >= words.first[doc]) & (start + sizes[window] <= words.first[doc + 1])
            window, start, doc = window[ok], start[ok], doc[ok]
            for n in np.unique(sizes[window]):
                mine = np.flatnonzero(sizes[window] == n)
                weight, total = powers(int(n) + 1)[1:], np.zeros(len(mine), dtype=np.uint64)
                for k in range(int(n)):
                    total += words.hash[start[mine] + k] * weight[k]
                for j in mine[mixed(total) == self.whole[window[mine]]]:
                    if words.bytes_of(start[j], int(n)) == self.index.texts[window[j]]:
                        delta[start[j]] += 1
                        delta[start[j] + n] -= 1
                        found[doc[j]].add(int(window[j]))
        return delta, found


def find_block(docs: DataFrame, id_col: str, text_col: str, index: Index, width: int) -> DataFrame:
    """Hits of one block: a row per document with its words, hit words and items, and a checksum of its text."""
    joins = prefix_join(rarity(docs, text_col, index, width), index, width)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index, joins)
        for batch, first, last, words in steps_of(batches, 2):
            delta, found = finder.find(words)
            hit = np.concatenate(([0], np.cumsum(np.cumsum(delta[:-1]) > 0)))
            names = [sorted({x for i in f for x in index.items[i]}) for f in found]
            # Windows don't leave their text, so a text's own sums start from nothing.
            spans = [np.flatnonzero(np.cumsum(delta[words.first[d] : words.first[d + 1]]) > 0).tolist() if f else [] for d, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(np.diff(words.first), pa.int64()), pa.array(hit[words.first[1:]] - hit[words.first[:-1]], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))],
                names=[id_col, "text_key", "n_words", "n_hit", "items", "hit_words"],
            )

    return docs.select(id_col, F.xxhash64(text_col).alias("text_key"), text_col).mapInArrow(run, f"`{id_col}` {id_type}, text_key long, n_words long, n_hit long, items array<string>, hit_words array<long>")


def drop_block(docs: DataFrame, text_col: str, index: Index, width: int) -> DataFrame:
    """docs without the rows in which a window of the block occurs."""
    joins = prefix_join(rarity(docs, text_col, index, width), index, width)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index, joins)
        for batch, first, last, words in steps_of(batches, at):
            clean = pa.array([not f for f in finder.find(words)[1]], pa.bool_())
            yield batch.slice(first, last - first).filter(clean)

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Finds benchmark windows in documents.

    Returns one row per input row: id_col, n_words, n_hit (words inside an
    occurrence of a window), items (ids, as sorted strings, of the items with
    an occurring window), hit_words (numbers of the hit words, from 0).

    Null and empty texts have no words; items without words have no window.
    Windows of items without an id count like any other, but name no item.
    Equal items are all named; equal rows get equal results.
    Extra columns are ignored. An empty benchmark gives no hits, an empty table
    no rows.
    """
    found = []
    for index, several in window_blocks(benchmark, item_col, item_text_col, window, block):
        hits = find_block(docs, id_col, text_col, index, shingle)
        # Of several blocks each is done with, here and on the executors, before the next is fetched.
        found.append(written(hits, "hits") if several else hits)
    if not found:
        found = [find_block(docs, id_col, text_col, Index(), shingle)]
    if len(found) == 1:
        return found[0].drop("text_key")
    # Several blocks: each has one row per input row. They meet by id and text; equal rows are as many as before.
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    names = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "hit_words")]
    merged = union.groupBy(id_col, "text_key", "n_words").agg(*names, (F.count("*") / len(found)).cast("int").alias("times"))
    merged = merged.withColumn("times", F.explode(F.array_repeat("times", F.col("times"))))
    return merged.select(id_col, "n_words", F.size("hit_words").cast("long").alias("n_hit"), "items", "hit_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """docs, with all columns, without the rows in which a benchmark window occurs; texts are not shuffled. Nulls and empty tables as for decontaminate."""
    for n, (index, _) in enumerate(window_blocks(benchmark, item_col, item_text_col, window, block)):
        docs = drop_block(written(docs, "decontaminated") if n else docs, text_col, index, shingle)
    return docs
