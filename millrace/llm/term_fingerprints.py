"""Document fingerprints by I-Match: terms in a band of inverse document frequency, hashed over randomised lexicons.

A first pass counts in how many documents each term is. The lexicon keeps the
terms whose idf lies in the band; its lower frequency is a share of all
documents, so its size is bounded by a text's mean number of distinct terms
over that share, whatever the number of documents. A text's distinct lexicon
terms are sorted and hashed, once as a whole and once for each of several
random subsets of the lexicon. Subsets come at several rates, each a quarter of
the one before: at rates near one term of a text, a subset of two texts hashes
alike about as often as the share of terms they have in common.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import CODES, Words, mixed, powers, steps, text_bytes
from .common import written
from .lexical_search import TERM, pieces

#: Terms in 3.0 % to 0.033 % of the documents with terms: at 250 distinct terms a text, a lexicon of at most 750,000.
IDF = (3.5, 8.0)
#: A text with fewer lexicon terms is fingerprinted by all its terms.
LEAST = 4
#: Random subsets at each rate, and the rates: one in 2, 8, 32, ... terms.
SUBSETS, RATES = 32, tuple(1 << (63 - 2 * i) for i in range(6))
#: A rate tells nothing once more than this share of its subsets has terms of either text.
FULL = 0.9


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """How many documents have each term: term (its hash), n; and the number of documents with a term as that of term null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, words in pieces(batches, 0):
            _, terms = distinct_terms(words)
            found, counts = np.unique(terms, return_counts=True)
            some = int((np.diff(words.first) > 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([*found.view(np.int64).tolist(), None], pa.int64()), pa.array([*counts.tolist(), some], pa.int64())], names=["term", "n"])

    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def distinct_terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and term hash of the distinct terms of each text, sorted by both."""
    docs = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    order = np.lexsort((words.hash, docs))
    docs, terms = docs[order], words.hash[order]
    first = np.ones(len(terms), dtype=bool)
    first[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
    return docs[first], terms[first]


def band(docs: DataFrame, text_col: str, idf: tuple[float, float]) -> np.ndarray:
    """The lexicon: sorted hashes of the terms whose idf, ln(documents / documents with it), is in the band."""
    counts = written(document_frequencies(docs, text_col), "term-frequencies")
    total = counts.where("term IS NULL").agg(F.sum("n")).first()[0] or 0
    least, most = total * math.exp(-idf[1]), total * math.exp(-idf[0])
    found = counts.where(F.col("term").isNotNull() & F.col("n").between(least, most)).select("term").toArrow()
    return np.sort(found["term"].to_numpy().view(np.uint64))


def set_hashes(docs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text that has terms: its number, and a hash of its sorted terms."""
    heads = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, dtype=np.int64)
    if not len(heads):
        return heads, np.zeros(0, dtype=np.uint64)
    counts = np.diff(np.append(heads, len(docs)))
    place = np.arange(len(docs)) - np.repeat(heads, counts)
    return docs[heads], mixed(np.add.reduceat(mixed(terms) * powers(int(counts.max()))[place], heads))


class Fingerprints:
    """Fingerprints of texts: whole holds a 64-bit hash each, parts an 8-bit hash by rate and subset, 0 where the subset has no term."""

    def __init__(self, whole: np.ndarray, parts: np.ndarray):
        self.whole, self.parts = whole, parts

    def __getitem__(self, some: slice) -> Fingerprints:
        return Fingerprints(self.whole[some], self.parts[some])

    def then(self, more: Fingerprints) -> Fingerprints:
        return Fingerprints(np.concatenate((self.whole, more.whole)), np.concatenate((self.parts, more.parts)))

    def bytes(self) -> list[bytes]:
        whole = self.whole.astype(">u8").view(np.uint8).reshape(-1, 8)
        return [row.tobytes() for row in np.concatenate((whole, self.parts.reshape(len(whole), -1)), axis=1)]

    @classmethod
    def of_bytes(cls, data: list[bytes]) -> Fingerprints:
        each = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), 8 + len(RATES) * SUBSETS)
        return cls(np.ascontiguousarray(each[:, :8]).view(">u8").ravel().astype(np.uint64), each[:, 8:].reshape(len(data), len(RATES), SUBSETS))


def fingerprints(texts: list[str], lexicon: np.ndarray, least: int = LEAST) -> Fingerprints:
    """The fingerprints of texts under a lexicon; those without any term are told apart by their bytes."""
    data, starts = text_bytes(pa.array(texts, pa.large_string()))
    words = Words(data, starts, TERM)
    docs, terms = distinct_terms(words)
    at = np.minimum(np.searchsorted(lexicon, terms), max(len(lexicon) - 1, 0))
    kept = lexicon[at] == terms if len(lexicon) else np.zeros(len(terms), dtype=bool)
    few = np.bincount(docs[kept], minlength=len(texts)) < least
    kept |= few[docs]
    docs, terms = docs[kept], terms[kept]
    whole, parts = np.zeros(len(texts), dtype=np.uint64), np.zeros((len(texts), len(RATES), SUBSETS), dtype=np.uint8)
    some, hashes = set_hashes(docs, terms)
    whole[some] = hashes
    for i in np.flatnonzero(np.diff(words.first) == 0):
        whole[i] = xxhash.xxh64_intdigest(texts[i].encode())
    for s in range(SUBSETS):
        draw, inside, own = mixed(terms ^ CODES[s]), terms, docs
        for r, rate in enumerate(RATES):
            drawn = draw < np.uint64(rate)
            draw, inside, own = draw[drawn], inside[drawn], own[drawn]
            some, hashes = set_hashes(own, inside)
            parts[some, r, s] = np.maximum(hashes >> np.uint64(56), np.uint64(1))
    return Fingerprints(whole, parts)


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """An estimate of the Jaccard similarity of the terms behind two fingerprints, 1 for equal ones.

    Of subsets at rate p, a share of exp(-p * terms of either) has no term of
    either text and exp(-p * terms of only one) hashes alike; the estimate is
    over all rates that aren't full, or the last one.
    """
    either = ((a.parts != 0) | (b.parts != 0)).sum(axis=2)
    unlike = (a.parts != b.parts).sum(axis=2)
    usable = either <= FULL * SUBSETS
    usable[:, -1] |= ~usable.any(axis=1)
    most = SUBSETS - 0.5  # where all subsets have terms, there are many, but not infinitely many

    def terms(n: np.ndarray) -> np.ndarray:
        return np.where(usable, -np.log1p(-np.minimum(n, most) / SUBSETS), 0.0).sum(axis=1)

    every = terms(either)
    found = np.where(every > 0, 1 - terms(unlike) / np.where(every > 0, every, 1), 0.0)
    same = (a.whole == b.whole) & (a.parts == b.parts).all(axis=(1, 2))
    return np.where(same, 1.0, np.clip(found, 0.0, 1.0))


def edited(text: str, following: str) -> str:
    """text, its last third (rounded down) replaced by as much of the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


ROW = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def pair_rows(ids: pa.Array, texts: list[str], own: Fingerprints, lexicon: np.ndarray) -> list[pa.Array]:
    """Columns of ROW for all but the last of consecutive texts; ids are those of all but the last."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    other = fingerprints(changed, lexicon)
    return [
        ids,
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(own[:-1].bytes(), pa.binary()),
        pa.array(other.bytes(), pa.binary()),
        pa.array(likeness(own[:-1], other), pa.float64()),
        pa.array(likeness(own[:-1], own[1:]), pa.float64()),
    ]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf: tuple[float, float] = IDF) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, and how like it is to this and to the next document's.

    Returns a row per input row: id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited, near_next. The next document follows
    in descending order of ids, nulls last; after the last comes the first, so a
    single document follows itself. Rows of one id go by a checksum of their
    texts, equal rows in any order, which doesn't matter. Null texts are empty.
    Equal texts have equal fingerprints. Extra columns are ignored, an empty
    table gives no rows.

    Texts are shuffled once, into ranges of ids; a range's task compares
    neighbours as they stream by and hands the first and the last text of the
    range on, which meet in a join of a row per range.
    """
    spark = docs.sparkSession
    lexicon = band(docs, text_col, idf)
    id_type = docs.schema[id_col].dataType.simpleString()
    row_type = f"id {id_type}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        names = [*ROW, "part", "border", "text"]

        def border(kind: str, of_id: pa.Array, text: str, print_: Fingerprints) -> pa.RecordBatch:
            empty = [pa.array([None], t) for t in (pa.int64(), pa.string())]
            late = [pa.array([None], t) for t in (pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([of_id, *empty, pa.array(print_.bytes(), pa.binary()), *late, pa.array([part], pa.int32()), pa.array([kind]), pa.array([text])], names=names)

        for batch in batches:
            _, starts = text_bytes(batch.column(1))
            for first, last in steps(starts):
                some = batch.slice(first, last - first)
                ids, texts = some.column(0), [t or "" for t in some.column(1).to_pylist()]
                own = fingerprints(texts, lexicon)
                if held is None:
                    yield border("first", ids[:1], texts[0], own[:1])
                else:
                    ids, texts, own = pa.concat_arrays([held[0], ids]), [held[1], *texts], held[2].then(own)
                if len(texts) > 1:
                    n = len(texts) - 1
                    yield pa.RecordBatch.from_arrays([*pair_rows(ids[:-1], texts, own, lexicon), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
                held = ids[-1:], texts[-1], own[-1:]
        if held is not None:
            yield border("last", *held)

    def last_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = [batch.column(c)[i].as_py() for c in (1, 3)]
                own = Fingerprints.of_bytes([batch.column(c)[i].as_py() for c in (2, 4)])
                yield pa.RecordBatch.from_arrays(pair_rows(batch.column(0).slice(i, 1), texts, own, lexicon), names=list(ROW))

    order = (F.col("id").desc_nulls_last(), F.col("text_key"))
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    # The random number spreads equal rows over ranges; where they are doesn't show.
    ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, F.rand(7)).sortWithinPartitions(*order).select("id", "text")
    rows = written(ranged.mapInArrow(neighbours, f"{row_type}, part int, border string, text string"), "neighbours")
    parts = sorted(r.part for r in rows.where("border = 'first'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    last = rows.where("border = 'last'").select("id", "text", "fingerprint", "part").join(follows, "part")
    heads = rows.where("border = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    between = last.join(heads, "following").select("id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(last_pairs, row_type)
    found = rows.where("border IS NULL").select(*ROW).union(between)
    prints = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", *prints, "near_edited", "near_next")
