"""Processed rows by content and configuration: what was processed before isn't processed again."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import discard, hadoop_path, written
from .pipeline import content_key

KEY = "content_key"


class ResultCache:
    """A folder with a row for each content that one configuration has processed.

    `process` takes rows of content_key and the content's column, each content
    once, and returns content_key and its results. A run's rows count once its
    folder is complete, so a run that dies leaves nothing; two runs at a time
    may process a content twice, of which readers see one row.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, config: object, process: Callable[[DataFrame], DataFrame]):
        self.spark, self.column, self.process = spark, column, process
        digest = hashlib.sha256(repr(config).encode()).hexdigest()[:16]
        self.name = type(config).__name__
        self.path = f"{path.rstrip('/')}/{self.name}-{digest}"

    def runs(self) -> list[str]:
        """Folders of complete runs."""
        fs, where = hadoop_path(self.spark, self.path)
        if not fs.exists(where):
            return []
        folders = sorted(s.getPath().toString() for s in fs.listStatus(where))
        return [f for f in folders if fs.exists(hadoop_path(self.spark, f"{f}/_SUCCESS")[1])]

    def results(self) -> DataFrame | None:
        """All rows, with the number of the run that made them; None before the first run."""
        runs = self.runs()
        return self.spark.read.option("mergeSchema", "false").parquet(*runs) if runs else None

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows with their results beside them and `run`, the number of the run that processed the content.

        Keys come first: those of all rows are compared with those that are
        there, both without contents. Only contents of keys that are missing
        move to be processed. Null contents have no key and no results. Columns
        of rows must not be named like results.
        """
        keyed = content_key(rows, self.column, self.name)
        keys = keyed.where(F.col(KEY).isNotNull()).select(KEY).distinct()
        known = self.results()
        missing = written(keys if known is None else keys.join(known.select(KEY), KEY, "left_anti"), "missing-keys")
        if missing.limit(1).count():
            fresh = keyed.select(KEY, self.column).join(missing, KEY, "left_semi").groupBy(KEY).agg(F.first(self.column).alias(self.column))
            number = len(self.runs()) + 1
            self.process(fresh).drop(self.column).withColumn("run", F.lit(number)).write.parquet(f"{self.path}/{number:06d}-{uuid.uuid4().hex}")
        discard(missing)
        stored = self.results()
        if stored is None:  # no row has a content, so nothing says what results look like
            stored = self.process(keyed.select(KEY, self.column).where("false")).drop(self.column).withColumn("run", F.lit(0))
        # Written, so that Spark can split the rows of a content that very many have.
        wanted = written(stored.join(keys, KEY, "left_semi").dropDuplicates([KEY]), "cached")
        return keyed.join(wanted, KEY, "left").drop(KEY)

    def compact(self) -> None:
        """Puts all runs into one; readers of the old ones must be done."""
        runs = self.runs()
        if len(runs) > 1:
            self.results().dropDuplicates([KEY]).write.parquet(f"{self.path}/{len(runs):06d}-{uuid.uuid4().hex}")
            for run in runs:
                fs, where = hadoop_path(self.spark, run)
                fs.delete(where, True)
