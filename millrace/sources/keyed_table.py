"""A stored table of rows by key that batches of upserts and deletes change, without rewriting what they don't touch.

Rows lie in buckets of their keys' hash. A batch reads the buckets of its own
keys, merges them with an aggregation in which the latest version of a key wins,
and writes them to a folder of its own. A commit file, which exists from one
moment to the next, then says in which folder each bucket's rows are, so readers
see whole batches only, and a batch that dies halfway leaves nothing but unused
files. Deletes stay as marked rows, so that an older version that comes later
doesn't bring a row back.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..workspace import discard, hadoop_path, read_text, write_text, written

BUCKET, DELETED = "__bucket", "__deleted"


class KeyedTable:
    """Rows of `schema` in a folder of any store, one for each value of `keys`; `version` is the column whose largest value wins.

    A null version is older than any other. Of equal versions a batch's row
    wins over a stored one, a delete over an upsert, and then the larger row, so
    the result doesn't depend on the order of rows in a batch. Null keys are
    keys like any other. Maps can't be stored, as they have no order. One
    writer at a time: a second one fails when it commits.
    """

    def __init__(self, spark: SparkSession, path: str, schema: S.StructType, keys: Sequence[str], version: str, buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.version, self.buckets = list(keys), version, buckets

    # Commits

    def commits(self) -> list[int]:
        fs, where = hadoop_path(self.spark, f"{self.path}/commits")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit())

    def state(self, commit: int | None = None) -> dict[int, int]:
        """The commit in whose folder each bucket's rows are, as of a commit (the last one); buckets that never had rows have none."""
        if commit is None:
            found = self.commits()
            if not found:
                return {}
            commit = found[-1]
        return {int(k): v for k, v in json.loads(read_text(self.spark, f"{self.path}/commits/{commit}")).items()}

    def _commit(self, number: int, state: dict[int, int]) -> None:
        write_text(self.spark, f"{self.path}/drafts/{number}", json.dumps(state))
        fs, draft = hadoop_path(self.spark, f"{self.path}/drafts/{number}")
        _, final = hadoop_path(self.spark, f"{self.path}/commits/{number}")
        fs.mkdirs(final.getParent())
        # A rename is done or not; it fails where another writer has made this commit.
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"commit {number} was made by another writer")

    # Changes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame) -> int:
        """Rows with all columns of the schema; returns the number of the commit."""
        return self._apply(rows.select(*self.schema.names, F.lit(False).alias(DELETED)))

    def delete(self, keys: DataFrame) -> int:
        """Rows with the keys and the version of the delete; other columns are ignored."""
        others = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in {*self.keys, self.version} else F.col(f.name) for f in self.schema]
        return self._apply(keys.select(*others, F.lit(True).alias(DELETED)))

    def _apply(self, changes: DataFrame) -> int:
        # Written, so that the buckets and the merge are of the same rows.
        changes = written(changes.withColumn(BUCKET, self._bucket()), "changes")
        touched = [r[0] for r in changes.select(BUCKET).distinct().collect()]  # as many as there are buckets, at most
        state = self.state()
        number = (self.commits() or [0])[-1] + 1
        if touched:
            stored = self._stored({b: state[b] for b in touched if b in state})
            rows = stored.withColumn("__new", F.lit(False)).unionByName(changes.withColumn("__new", F.lit(True)))
            merged = rows.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(self.keys)]).agg(F.max(F.struct(self.version, "__new", DELETED, BUCKET, *[c for c in self.schema.names if c != self.version])).alias("row"))
            merged = merged.select("row.*").select(*self.schema.names, DELETED, BUCKET)
            # Rows come to a bucket's files by bucket; large ones are split, small ones put together.
            merged.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{number}")
        self._commit(number, state | {b: number for b in touched})
        discard(changes)
        return number

    # Reading

    def _stored(self, state: dict[int, int]) -> DataFrame:
        """Rows of these buckets, deleted ones marked; other buckets' files aren't opened."""
        schema = S.StructType([*self.schema.fields, S.StructField(DELETED, S.BooleanType()), S.StructField(BUCKET, S.IntegerType())])
        if not state:
            return self.spark.createDataFrame([], schema)
        found = None
        for commit in sorted(set(state.values())):
            folders = [f"{self.path}/data/{commit}/{BUCKET}={b}" for b, c in sorted(state.items()) if c == commit]
            part = self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{commit}").parquet(*folders)
            found = part if found is None else found.union(part)
        return found

    def read(self, commit: int | None = None) -> DataFrame:
        """All rows that aren't deleted, as of a commit."""
        return self._stored(self.state(commit)).where(~F.col(DELETED)).select(*self.schema.names)

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys, out of their buckets only."""
        wanted = keys.select(*self.keys).distinct()
        state = self.state()
        touched = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        stored = self._stored({b: state[b] for b in touched if b in state}).where(~F.col(DELETED)).select(*self.schema.names)
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            wanted = wanted.withColumnRenamed(k, f"__key{i}")
            same &= stored[k].eqNullSafe(F.col(f"__key{i}"))
        return stored.join(wanted, same, "left_semi")

    # Upkeep

    def forget(self, before: Column) -> int:
        """Drops deleted rows that fulfil a condition on the version, in a commit of its own; older versions of them must not come any more."""
        state, number = self.state(), (self.commits() or [0])[-1] + 1
        old = self._stored(state).where(F.col(DELETED) & before).select(BUCKET).distinct()
        touched = [r[0] for r in old.collect()]
        if touched:
            kept = self._stored({b: state[b] for b in touched}).where(~(F.col(DELETED) & F.coalesce(before, F.lit(False))))
            kept.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{number}")
            left = {r[0] for r in self.spark.read.parquet(f"{self.path}/data/{number}").select(BUCKET).distinct().collect()} if self._has_rows(number) else set()
            state = {b: c for b, c in state.items() if b not in touched} | {b: number for b in left}
        self._commit(number, state)
        return number

    def _has_rows(self, number: int) -> bool:
        fs, where = hadoop_path(self.spark, f"{self.path}/data/{number}")
        return any(s.isDirectory() for s in fs.listStatus(where))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes folders and commits that the last `keep` commits don't use; readers of older ones must be done."""
        numbers = self.commits()
        used = {c for n in numbers[-keep:] for c in self.state(n).values()}
        fs, data = hadoop_path(self.spark, f"{self.path}/data")
        if fs.exists(data):
            for status in fs.listStatus(data):
                name = status.getPath().getName()
                if name.isdigit() and int(name) not in used and int(name) <= numbers[-1]:
                    fs.delete(status.getPath(), True)
        for n in numbers[:-keep]:
            fs.delete(hadoop_path(self.spark, f"{self.path}/commits/{n}")[1], True)
