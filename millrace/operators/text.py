"""Text preprocessing, vocabularies and statistics over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..workspace import written
from .ordered import digest_of

#: A vocabulary of up to so many bytes goes to every executor; a larger one is joined.
LOOKUP_BYTES = 64 << 20
#: Tokens that are counted, and that are looked up, at a time.
COUNTED, TAKEN = 1 << 21, 1 << 20


def clean(df: DataFrame, text_col: str = "text", config: T.TextConfig | None = None, out: str = "cleaned") -> DataFrame:
    """Adds the cleaned text. Each step is a projection of its own, so that Spark doesn't repeat it where a later step reads it twice. Null stays null."""
    config = config or T.TextConfig()
    df = df.withColumn(out, F.col(text_col))
    for step in T.cleaning_steps(config):
        df = df.withColumn(out, step(F.col(out)))
    return df.withColumn(out, T.fit_length(F.col(out), config))


def preprocess(df: DataFrame, text_col: str = "text", config: T.TextConfig | None = None, out: str = "cleaned", tokens: str = "tokens") -> DataFrame:
    """Cleaned text, its tokens (unless the config has no tokenizer), and whether it was too short: such texts have no tokens, not even special ones."""
    config = config or T.TextConfig()
    df = clean(df, text_col, config, out)
    df = df.withColumn("too_short", F.coalesce(F.length(out) == 0, F.lit(True)) if config.min_length else F.lit(False))
    if config.tokenizer is None:
        return df
    found = T.tokenize(F.col(out), config.tokenizer)
    if config.special_tokens:
        found = T.with_special_tokens(found, config)
    return df.withColumn(tokens, F.when(F.col("too_short"), F.array().cast("array<string>")).otherwise(found))


def build_vocabulary(df: DataFrame, tokens: str = "tokens", order: str = "ord", min_freq: int = 1) -> DataFrame:
    """Tokens and ids (token, id, freq): the special tokens first, then tokens by falling frequency, ties by first occurrence in `order`.

    Tokens are counted before they are shuffled, and rows of equal order have
    the smaller place first. Special tokens in the texts
    keep the later id only, as a dictionary that is filled in this order would.
    Ranking needs a total order: the numbers come from ranges of the sorted
    vocabulary, so that no task holds all of it.
    """
    spark = df.sparkSession
    bits = _place_bits(df, tokens, order)
    if bits:
        counted = _counted_in_batches(df, tokens, order, bits).groupBy("token").agg(F.sum("freq").alias("freq"), F.min("first").alias("first"))
    else:
        # Outer, as Spark would otherwise derive a filter on the tokens and compute them twice.
        seen = df.select(F.col(order).alias("ord"), F.posexplode_outer(tokens).alias("pos", "token")).where(F.col("token").isNotNull())
        counted = seen.groupBy("token").agg(F.count("*").alias("freq"), F.min(F.struct("ord", "pos")).alias("first"))
    counted = counted.where(F.col("freq") >= min_freq)
    ranked = number_rows(counted, [F.desc("freq"), F.asc("first"), F.asc("token")], "n")
    # Written, as it is read twice.
    found = written(ranked.select("token", (F.col("n") + len(T.SPECIAL_TOKENS)).cast("long").alias("id"), "freq"), "vocabulary")
    special = spark.createDataFrame([(t, i, 0) for i, t in enumerate(T.SPECIAL_TOKENS)], "token string, id long, freq long")
    return special.join(found.select("token"), "token", "left_anti").unionByName(found)


def _place_bits(df: DataFrame, tokens: str, order: str) -> int:
    """How many bits a token's place needs beside its row's order, if both fit into one number; else 0."""
    if not isinstance(df.schema[order].dataType, S.IntegralType):
        return 0
    high, low = df.agg(F.max(order), F.min(order)).first()  # of the order alone: the tokens aren't made for it
    bits, largest = 31, max(abs(high or 0), abs(low or 0))  # an array has no more places
    if largest >= 1 << 31:
        bits = max(df.agg(F.max(F.size(tokens))).first()[0] or 0, 1).bit_length()
    return bits if largest < 1 << (62 - bits) else 0


def _counted_in_batches(df: DataFrame, tokens: str, order: str, bits: int) -> DataFrame:
    """Tokens of some rows each, with their number (freq) and their smallest place (first): tokens become rows once they are counted. A null order comes first, as it does in a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lengths in _parts(batch, COUNTED):
                yield counted(part, lengths)

    def counted(batch: pa.RecordBatch, lengths: np.ndarray) -> pa.RecordBatch:
        place = batch.column(0).cast(pa.int64())
        base = np.where(place.is_null().to_numpy(zero_copy_only=False), -(1 << 62), pc.fill_null(place, 0).to_numpy(zero_copy_only=False) << bits)
        places = np.repeat(base - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        coded = batch.column(1).flatten().dictionary_encode()
        codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        codes, places = codes[codes >= 0], places[codes >= 0]
        first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first, codes, places)
        freq = np.bincount(codes, minlength=len(first))
        return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(freq, pa.int64()), pa.array(first)], names=["token", "freq", "first"])

    return df.select(order, tokens).mapInArrow(run, "token string, freq long, first long")


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of about `most` values of the lists in the second column at a time, and the lengths of their lists."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    steps, at = np.cumsum(lengths) // most, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(steps, steps[at], "right")))
        yield batch.slice(at, end - at), lengths[at:end]
        at = end


def number_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Numbers all rows from 0 in a total order, range by range: a row's number is that in its range and the sizes of the ranges before. The ranges are written, as another run could draw them elsewhere."""
    # Rows that are equal in the order have any of their numbers, so they needn't be in one range.
    ranged = written(df.repartitionByRange(*order, digest_of(df)).withColumn("__range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__range").orderBy(*order)
    numbered = ranged.withColumn("__n", F.row_number().over(within) - 1)
    sizes = ranged.groupBy("__range").count()
    # One row per range, as many as there are shuffle partitions.
    before = sizes.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return numbered.join(before, "__range").withColumn(out, F.col("__n") + F.col("__before")).drop("__range", "__n", "__before")


def encode(df: DataFrame, vocabulary: DataFrame, key: str, tokens: str = "tokens", out: str = "ids") -> DataFrame:
    """key and the ids of its tokens in order; unknown tokens have the id of <UNK>. An empty vocabulary raises."""
    if not vocabulary.limit(1).count():
        raise ValueError("the vocabulary is empty")
    return _mapped(df, vocabulary, key, tokens, "token", "id", F.lit(1).cast("long"), out)


def decode(df: DataFrame, vocabulary: DataFrame, key: str, ids: str = "ids", out: str = "tokens") -> DataFrame:
    """key and the tokens of its ids in order; unknown ids are <UNK>."""
    return _mapped(df, vocabulary, key, ids, "id", "token", F.lit(T.SPECIAL_TOKENS[1]), out)


def _mapped(df: DataFrame, vocabulary: DataFrame, key: str, values: str, source: str, target: str, missing: Column, out: str) -> DataFrame:
    """A row for each row of df, whatever its key: the key and the values' targets in order; null values have none."""
    pairs = vocabulary.select(F.col(source).alias("__value"), F.col(target).alias("__target")).where(F.col("__value").isNotNull())
    text = "__value" if source == "token" else "__target"
    size = pairs.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    if size <= LOOKUP_BYTES:
        return _looked_up(df, pairs, key, values, missing, out)
    return _joined(df, pairs, key, values, missing, out)


def _joined(df: DataFrame, pairs: DataFrame, key: str, values: str, missing: Column, out: str) -> DataFrame:
    """_mapped() by a join: not of all values, but of the distinct ones of about TAKEN at a time, a block; what is found meets the rows of its block again, which hold places in the block for values.

    A task holds one block's targets besides a batch. Blocks are written, as
    another run could cut them otherwise.
    """
    spark = df.sparkSession
    key_type, value_type, target_type = (t.simpleString() for t in (df.schema[key].dataType, df.schema[values].dataType.elementType, pairs.schema["__target"].dataType))
    unknown = spark.range(1).select(missing.alias("m")).first().m

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each row, with places, and one for each distinct value of a block."""
        names, n = [key, "__codes", "__block", "__place", "__value"], 0
        for batch, lengths in (p for b in batches for p in _parts(b, TAKEN)):
            found = batch.column(1).flatten().dictionary_encode()
            block, n = (batch.column(2)[0].as_py() << 33) + n, n + 1
            codes = pa.ListArray.from_arrays(_ends(lengths), pc.fill_null(found.indices, -1).cast(pa.int32()))
            of = lambda size: pa.array(np.full(size, block))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, of(batch.num_rows), pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, found.dictionary.type)], names=names)
            size = len(found.dictionary)
            yield pa.RecordBatch.from_arrays([pa.nulls(size, batch.column(0).type), pa.nulls(size, codes.type), of(size), pa.array(np.arange(size, dtype=np.int32)), found.dictionary], names=names)

    schema = f"`{key}` {key_type}, __codes array<int>, __block long, __place int, __value {value_type}"
    blocks = written(df.select(key, values, F.spark_partition_id().cast("long")).mapInArrow(coded, schema), "blocks", "zstd")
    found = blocks.where("__place IS NOT NULL").join(pairs, "__value").select("__block", "__place", "__target", F.lit(None).cast(key_type).alias(key), F.lit(None).cast("array<int>").alias("__codes"))
    rows = blocks.where("__place IS NULL").select("__block", "__place", F.lit(None).cast(target_type).alias("__target"), key, "__codes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Targets of a block come before its rows.
    met = found.unionByName(rows).repartition(parts, "__block").sortWithinPartitions("__block", F.col("__place").isNull())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places, targets, known = None, [], [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if numbers[start] != block:
                    block, places, targets, known = numbers[start], [], [], None
                part = batch.slice(start, end - start)
                n = len(part) - part.column(1).null_count
                if n:
                    places.append(part.column(1).slice(0, n).to_numpy())
                    # A copy, as a slice would keep its batch.
                    targets.append(part.column(2).take(pa.array(np.arange(n))))
                part = part.slice(n)
                if not len(part):
                    continue
                if known is None:
                    at = np.concatenate([*places, np.zeros(0, dtype=np.int32)])
                    last = len(at)
                    place = np.full(int(at.max(initial=-1)) + 2, last)
                    place[at] = np.arange(last)
                    kind = part.column(2).type
                    known, places, targets = pa.concat_arrays([*targets, pa.array([unknown], kind)]), [], []
                codes = part.column(4).flatten().to_numpy()
                taken = known.take(pa.array(place[np.where((codes < 0) | (codes >= len(place)), len(place) - 1, codes)]))
                yield pa.RecordBatch.from_arrays([part.column(3), pa.ListArray.from_arrays(_ends(pc.list_value_length(part.column(4)).to_numpy()), taken)], names=[key, out])

    result = met.mapInArrow(told, S.StructType([df.schema[key], S.StructField(out, S.ArrayType(pairs.schema["__target"].dataType))]))
    result._millrace_path = blocks._millrace_path  # for discard(), once the result is written
    return result


def _ends(lengths: np.ndarray) -> pa.Array:
    """Where lists of these lengths begin and end."""
    return pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))


def _looked_up(df: DataFrame, pairs: DataFrame, key: str, values: str, missing: Column, out: str) -> DataFrame:
    """_mapped() by a table of checked size in every task: nothing is exploded or shuffled."""
    table = pairs.toArrow()
    keys, targets = (table[c].combine_chunks() for c in ("__value", "__target"))
    buffer = pa.BufferOutputStream()
    unknown = pa.array([df.sparkSession.range(1).select(missing.alias("m")).first().m], targets.type)
    with pa.ipc.new_stream(buffer, pa.schema([("keys", keys.type), ("targets", targets.type)])) as stream:
        stream.write_batch(pa.record_batch([pa.concat_arrays([keys, pa.nulls(1, keys.type)]), pa.concat_arrays([targets, unknown])], names=["keys", "targets"]))
    sent = df.sparkSession.sparkContext.broadcast(buffer.getvalue().to_pybytes())  # LOOKUP_BYTES at most
    kinds = S.StructType([df.schema[key], S.StructField(out, S.ArrayType(pairs.schema["__target"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.ipc.open_stream(sent.value).read_all()
        keys, targets = (known[c].combine_chunks() for c in ("keys", "targets"))
        last = len(keys) - 1  # the one for what is unknown
        for batch, lengths in (p for b in batches for p in _parts(b, TAKEN)):
            lists = batch.column(1)
            # Distinct values are looked up once each.
            coded = lists.flatten().cast(keys.type).dictionary_encode()
            place = pc.fill_null(pc.index_in(coded.dictionary, keys.slice(0, last)), last).to_numpy(zero_copy_only=False)
            codes = pc.fill_null(coded.indices, len(place)).to_numpy(zero_copy_only=False)
            taken = targets.take(pa.array(np.append(place, last)[codes]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(_ends(lengths), taken)], names=[key, out])

    return df.select(key, values).mapInArrow(run, kinds)


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row about raw texts: how many, average, least and most characters, average words, all characters, distinct words. Without texts all are 0.

    One pass: a text's own numbers go with its first distinct word.
    """
    measured = df.where(F.col(text_col).isNotNull()).select(F.length(text_col).cast("long").alias("chars"), T.words(F.col(text_col)).alias("words"))
    each = measured.select("chars", F.size("words").cast("long").alias("n"), F.posexplode_outer(F.array_distinct("words")).alias("pos", "word"))
    own = lambda c: F.when(F.coalesce("pos", F.lit(0)) == 0, c)
    by_word = each.groupBy("word").agg(F.count(own(F.lit(1))).alias("texts"), F.sum(own(F.col("chars"))).alias("chars"), F.min(own(F.col("chars"))).alias("least"), F.max(own(F.col("chars"))).alias("most"), F.sum(own(F.col("n"))).alias("n"))
    per = lambda c: F.coalesce(F.sum(c) / F.sum("texts"), F.lit(0.0))
    return by_word.agg(
        F.coalesce(F.sum("texts"), F.lit(0)).alias("total_texts"),
        per("chars").alias("avg_length"),
        F.coalesce(F.min("least"), F.lit(0)).alias("min_length"),
        F.coalesce(F.max("most"), F.lit(0)).alias("max_length"),
        per("n").alias("avg_words"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"),
        F.count("word").alias("vocabulary_size"),
    )
