"""Ranked lexical search: term-weighted scores, summed window by window.

The index is a table with a row per window of at most 4,096 documents: the
postings of every term in it, by slot in the window, and the documents' lengths.
A scan task makes its windows of the documents it reads anyway, in the order of
their ids, so no text is shuffled. A search sends a block of queries to all
windows. A query's postings in a window are scatter-added into one array of
64-bit scores that a core's cache holds, a bitset notes the slots that were
touched, and these alone are harvested into the query's heap of best documents.
Tasks return their heaps, which meet in two steps of ranking.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import Words, class_table, steps, text_bytes
from .common import discard, written

#: Characters of terms: 0-9, a-z (A-Z are lower-cased before) and everything beyond ASCII.
TERM = class_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Documents of a window: 32 kB of scores, 512 bytes of bitset.
WINDOW = 1 << 12
#: A window ends early once its texts have so many bytes.
WINDOW_BYTES = 1 << 24
#: Distinct terms, counted by query, of a block of queries: some 40 MB in each task.
BLOCK_TERMS = 1 << 20
#: Heaps of a query meet in so many groups first.
GROUPS = 64

INDEX = "ids array<long>, lengths binary, terms binary, heads binary, slots binary, counts binary, n_docs long, n_terms long"


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, Words]]:
    """Runs of texts of bounded size with their terms."""
    for batch in batches:
        data, starts = text_bytes(batch.column(column))
        for first, last in steps(starts):
            yield batch, first, last, Words(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first], TERM)


def window_row(ids: list[int | None], lengths: np.ndarray, terms: np.ndarray, docs: np.ndarray) -> dict:
    """A row of the index: slots follow the ids, nulls last; postings are sorted by term and slot."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    slot = np.empty(len(ids), dtype=np.int64)
    slot[order] = np.arange(len(ids))
    docs = slot[docs]
    by_term = np.lexsort((docs, terms))
    terms, docs = terms[by_term], docs[by_term]
    first = np.concatenate(([True], (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])))
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(terms)))
    terms, docs = terms[at], docs[at]
    heads = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    return {
        "ids": [ids[i] for i in order],
        "lengths": lengths[order].astype(np.int64).tobytes(),
        "terms": terms[heads].tobytes(),
        "heads": np.append(heads, len(terms)).astype(np.int64).tobytes(),
        "slots": docs.astype(np.uint16).tobytes(),
        "counts": counts.astype(np.uint32).tobytes(),
        "n_docs": len(ids),
        "n_terms": int(lengths.sum()),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The index of all documents that have a term, written to the shared folder: a row per window of up to `size` documents, at most WINDOW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("lengths", "terms", "heads", "slots", "counts")], ("n_docs", pa.int64()), ("n_terms", pa.int64())])
        ids, lengths, terms, held_bytes = [], [], [], 0

        def window() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            row = window_row(ids, n, np.concatenate(terms), np.repeat(np.arange(len(ids)), n))
            for held in (ids, lengths, terms):
                held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch, first, last, words in pieces(batches, 1):
            names, n, begin = batch.column(0).slice(first, last - first).to_pylist(), np.diff(words.first), 0
            while begin < len(names):
                end = min(len(names), begin + size - len(ids))
                some = np.flatnonzero(n[begin:end]) + begin
                if len(some):
                    ids += [names[i] for i in some]
                    lengths.append(n[some])
                    terms.append(words.hash[words.first[begin] : words.first[end]])
                begin = end
                if len(ids) == size:
                    yield window()
                    held_bytes = 0
            held_bytes += len(words.data)
            if ids and held_bytes >= WINDOW_BYTES:
                yield window()
                held_bytes = 0
        if ids:
            yield window()

    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(run, INDEX), "lexical-index")


def parse_queries(queries: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Queries with a term, written: item, its distinct terms with their repeats, and a digest of both."""
    item_type = queries.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, words in pieces(batches, 1):
            found = [np.unique(words.hash[words.first[i] : words.first[i + 1]], return_counts=True) for i in range(last - first)]
            some = [i for i, (t, _) in enumerate(found) if len(t)]
            digests = [hashlib.sha256(found[i][0].tobytes() + found[i][1].tobytes()).hexdigest() for i in some]
            lists = [pa.array([found[i][k].view(np.int64) for i in some], pa.list_(pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(some, pa.int64())), pa.array(digests, pa.string()), *lists], names=["item", "digest", "terms", "times"])

    texts = queries.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return written(texts.mapInArrow(run, f"item {item_type}, digest string, terms array<long>, times array<long>"), "lexical-queries")


def document_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents have each of a block's distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                held, heads = (np.frombuffer(batch.column(k)[i].as_py(), dtype=t) for k, t in ((0, np.uint64), (1, np.int64)))
                at, query = common(held, terms)
                total[query] += heads[at + 1] - heads[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "n"])

    found = index.select("terms", "heads").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(terms), dtype=np.int64)
    counts[found["term"].to_numpy()] = found["n"].to_numpy()
    return counts


def common(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sorted arrays of distinct values at which they have the same value."""
    if not len(held) or not len(wanted):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(held) < len(wanted):
        query, at = common(wanted, held)
        return at, query
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    query = np.flatnonzero(held[at] == wanted)
    return at[query], query


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each begin on, `size` of them."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def length_part(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """8 * (100 - 75 + (75 * length * n_docs) div n_terms)."""
    if 75 * int(lengths.max()) * n_docs < 1 << 63:
        return 8 * (25 + (75 * lengths * n_docs) // n_terms)
    return np.array([8 * (25 + 75 * int(n) * n_docs // n_terms) for n in lengths], dtype=np.int64)


class Queries:
    """A block of queries: distinct terms, each query's terms by number with their repeats."""

    def __init__(self, block: pa.Table):
        self.digests = block["digest"].to_pylist()
        terms, times = (block[c].combine_chunks() for c in ("terms", "times"))
        self.first = np.append(0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        self.terms, self.numbers = np.unique(terms.flatten().to_numpy().view(np.uint64), return_inverse=True)
        self.times = times.flatten().to_numpy()
        self.weights = np.zeros(len(self.terms), dtype=np.int64)

    def weigh(self, counts: np.ndarray, n_docs: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in counts], dtype=np.int64)


class Search:
    """One task's heaps over the windows it reads."""

    def __init__(self, queries: Queries, n_docs: int, n_terms: int, k: int):
        self.queries, self.n_docs, self.n_terms, self.k = queries, n_docs, n_terms, k
        self.heaps: list[list[tuple[int, float]]] = [[] for _ in queries.digests]
        self.scores = np.zeros(WINDOW, dtype=np.int64)
        self.touched = np.zeros(WINDOW // 64, dtype=np.uint64)

    def window(self, ids: list[int | None], lengths: np.ndarray, terms: np.ndarray, heads: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> None:
        q = self.queries
        at, number = common(terms, q.terms)
        begin, size = np.zeros((2, len(q.terms)), dtype=np.int64)
        size[number] = heads[at + 1] - heads[at]
        begin[number] = np.cumsum(size[number]) - size[number]
        # Parts of all postings of the block's terms, made once and used by every query with the term.
        postings = ranges(heads[at], size[number])
        slot, tf = slots[postings].astype(np.int64), counts[postings].astype(np.int64)
        part = np.repeat(q.weights[number], size[number]) * ((1_000_000_000 * tf) // (1000 * tf + length_part(lengths, self.n_docs, self.n_terms)[slot]))
        for n, heap in enumerate(self.heaps):
            mine = q.numbers[q.first[n] : q.first[n + 1]]
            many = size[mine]
            walk = ranges(begin[mine], many)
            if not len(walk):
                continue
            where = slot[walk]
            np.add.at(self.scores, where, part[walk] * np.repeat(q.times[q.first[n] : q.first[n + 1]], many))
            np.bitwise_or.at(self.touched, where >> 6, np.uint64(1) << (where & 63).astype(np.uint64))
            self.harvest(heap, ids)

    def harvest(self, heap: list[tuple[int, float]], ids: list[int | None]) -> None:
        """Moves touched slots that are among the best so far into the heap and clears them."""
        found = np.flatnonzero(np.unpackbits(self.touched.view(np.uint8), bitorder="little"))
        scores = self.scores[found]
        self.scores[found] = 0
        self.touched[:] = 0
        best = scores >= (heap[0][0] if len(heap) == self.k else 1)
        found, scores = found[best], scores[best]
        # Slots follow the ids: of equal scores the lower slot is the better one.
        for i in np.lexsort((found, -scores))[: self.k]:
            name = ids[found[i]]
            entry = (int(scores[i]), -name if name is not None else -math.inf)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def search_block(index: DataFrame, block: pa.Table, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Best documents of each query in the block, as each task found them: digest, doc, score; and the task's group."""
    queries = Queries(block)
    queries.weigh(document_counts(index, queries.terms), n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries, n_docs, n_terms, k)
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = [np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in enumerate((np.int64, np.uint64, np.int64, np.uint16, np.uint32), 1)]
                search.window(batch.column(0)[i].as_py(), *arrays)
        rows = [(digest, None if name == -math.inf else -name, score) for digest, heap in zip(queries.digests, search.heaps) for score, name in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["digest", "doc", "score"])

    columns = index.select("ids", "lengths", "terms", "heads", "slots", "counts")
    return columns.mapInArrow(run, "digest string, doc long, score long").withColumn("part", F.spark_partition_id() % GROUPS)


def search(index: DataFrame, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 10, block: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of the index for each query: item_col, rank from 1, doc_id, score.

    Scores are above 0 and fall with the rank; of equal scores the smaller id
    comes first, null ids last. A query's repeated terms count each time.
    Queries that are null or have no terms get no rows, equal queries the same
    ones each, queries without an id or with another's like any other. Extra
    columns are ignored. An empty index gives no rows.

    Queries go to the windows in blocks of about `block` terms; the driver
    holds one, and its results are written before the next is fetched.
    """
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    parsed = parse_queries(queries, item_col, text_col)
    distinct = written(parsed.select("digest", "terms", "times").dropDuplicates(["digest"]), "lexical-distinct")
    blocks = -(-(distinct.agg(F.sum(F.size("terms"))).first()[0] or 0) // block)
    found = []
    for n in range(blocks if totals[0] else 0):
        some = distinct.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == n).toArrow()
        if some.num_rows:
            found.append(written(search_block(index, some, *totals, k), "lexical-found"))
    if not found:
        return parsed.select(F.col("item").alias(item_col), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = (F.desc("score"), F.asc_nulls_last("doc"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("digest", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy(*order))).where(F.col("rank") <= k)
    best = written(best.select("digest", "rank", F.col("doc").alias("doc_id"), "score"), "lexical-best")
    discard(distinct, *found)
    return parsed.select(F.col("item").alias(item_col), "digest").join(best, "digest").drop("digest")


def rank(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, block: int = BLOCK_TERMS, size: int = WINDOW) -> DataFrame:
    """The k best of all documents for each query, by an index that is made for this one search.

    Null texts and texts without terms are no documents. Each row of docs is a
    document of its own, so equal rows take a rank each. See search for the rest.
    """
    index = build_index(docs, id_col, text_col, size)
    found = search(index, queries, item_col, item_text_col, k, block)
    discard(index)
    return found
