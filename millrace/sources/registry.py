"""Several sources as one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from . import catalog, storage


@dataclass(frozen=True)
class LoaderConfig:
    batch_size: int = 32
    workers: int = 4
    max_samples: int | None = None
    modalities: tuple[str, ...] = catalog.DEFAULT_MODALITIES

    def __post_init__(self) -> None:
        sampling.check_settings(self.batch_size, self.workers)


@dataclass(frozen=True)
class DataSource:
    """A named source of files. Its modalities, if given, come before the loader's; weight is kept for mixing."""

    name: str
    kind: str
    path: str
    modalities: tuple[str, ...] | None = None
    weight: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in ("local", "s3"):
            raise ValueError(f"unknown kind of source {self.kind!r}")


@dataclass
class MultiSource:
    """Sources loaded together. A source that fails contributes no rows and is named in `errors`."""

    spark: SparkSession
    config: LoaderConfig = field(default_factory=LoaderConfig)
    credentials: dict[str, str] | None = None
    sources: list[DataSource] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)

    def add(self, source: DataSource) -> MultiSource:
        self.sources.append(source)
        return self

    def add_local(self, name: str, path: str, modalities: Sequence[str] | None = None, weight: float = 1.0) -> MultiSource:
        return self.add(DataSource(name, "local", path, tuple(modalities) if modalities else None, weight))

    def add_s3(self, name: str, path: str, modalities: Sequence[str] | None = None, weight: float = 1.0) -> MultiSource:
        return self.add(DataSource(name, "s3", path, tuple(modalities) if modalities else None, weight))

    def _path(self, source: DataSource) -> str:
        if source.kind == "local":
            return source.path
        if not self.credentials:
            raise ValueError("S3 sources need credentials")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for key, name in (("access_key", "fs.s3a.access.key"), ("secret_key", "fs.s3a.secret.key"), ("region", "fs.s3a.endpoint.region")):
            if key in self.credentials:
                conf.set(name, self.credentials[key])
        return source.path.replace("s3://", "s3a://", 1)

    def load_source(self, source: DataSource) -> DataFrame:
        remote = source.kind == "s3"
        return catalog.load(self.spark, self._path(source), source.modalities or self.config.modalities, self.config.max_samples, catalog.OBJECT_STORE_EXTENSIONS if remote else catalog.EXTENSIONS, remote)

    def load_all(self) -> dict[str, DataFrame]:
        """Samples by source."""
        found = {}
        for source in self.sources:
            try:
                found[source.name] = self.load_source(source)
            except Exception as error:  # one source doesn't end the others
                self.errors[source.name] = str(error)
        return found

    def load_combined(self, balance_by_modality: bool = False) -> DataFrame:
        """All samples in the order of their sources, if wanted with as many rows of each modality as the smallest has."""
        found = self.load_all()
        if not found:
            return self.spark.createDataFrame([], catalog.SAMPLE).withColumn("source_name", F.lit("")).withColumn("source_ord", F.lit(0))
        samples = sampling.union_sources(found)
        return sampling.balance(samples, ["source_ord", "id"]) if balance_by_modality else samples

    def _sized(self) -> DataFrame:
        return self.load_combined().withColumn("size", F.element_at("metadata", "size").cast("long"))

    def statistics(self) -> DataFrame:
        return sampling.source_statistics(self._sized())

    def distribution(self) -> DataFrame:
        return sampling.distribution(self.load_combined())

    def validate_all(self) -> dict[str, bool]:
        """Whether each source can be reached."""

        def reached(source: DataSource) -> bool:
            try:
                return storage.exists(self.spark, self._path(source))
            except ValueError:
                return False

        return {s.name: reached(s) for s in self.sources}
