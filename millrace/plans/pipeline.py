"""Preprocessing pipelines: one processor per modality, errors per row, and chains of functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TextConfig, is_valid
from ..operators import audio, images, text, video

MODALITIES = ("text", "image", "audio", "video")
ERROR_HANDLING = ("raise", "log", "skip")


@dataclass(frozen=True)
class PipelineConfig:
    """Configs of the modalities that are on (None: off), and what becomes of rows that fail: "raise" ends the query, "log" keeps them with their error, "skip" drops them."""

    text: TextConfig | None = field(default_factory=TextConfig)
    image: images.ImageConfig | None = field(default_factory=images.ImageConfig)
    audio: audio.AudioConfig | None = None
    video: video.VideoConfig | None = None
    error_handling: str = "skip"

    def __post_init__(self) -> None:
        if self.error_handling not in ERROR_HANDLING:
            raise ValueError(f"unknown error handling {self.error_handling!r}")


class Pipeline:
    """Processes samples (id, modality, text, content)."""

    def __init__(self, config: PipelineConfig | None = None):
        self.config = config or PipelineConfig()
        self._kept: list[DataFrame] = []

    def processor(self, modality: str):
        """The config of a modality; None if it is off or unknown."""
        return getattr(self.config, modality, None) if modality in MODALITIES else None

    def process(self, samples: DataFrame, modality: str) -> DataFrame:
        """Samples of one modality with their result and error. A modality that is off raises when the plan is made."""
        config = self.processor(modality)
        if config is None:
            raise ValueError(f"no processor for {modality!r}")
        if modality == "text":
            done = text.preprocess(samples.withColumn("__ok", is_valid(F.col("text"))), "text", config)
            done = done.withColumn("error", F.when(~F.col("__ok"), "not a text, or blank")).drop("__ok")
            return self._handled(done)
        run = {"image": images.process, "audio": audio.process, "video": video.process}[modality]
        done = run(samples, config, out=modality)
        return self._handled(done.withColumn("error", F.col(f"{modality}.error")))

    def _handled(self, done: DataFrame) -> DataFrame:
        if self.config.error_handling == "skip":
            return done.where("error IS NULL")
        if self.config.error_handling == "raise":
            return done.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(None).cast("string")))
        return done

    def process_all(self, samples: DataFrame) -> dict[str, DataFrame]:
        """Samples by modality, for all modalities that are on; each branch reads only its own rows."""
        return {m: self.process(samples.where(F.col("modality") == m), m) for m in MODALITIES if self.processor(m)}

    def process_multimodal(self, rows: DataFrame) -> DataFrame:
        """Rows with a nullable column for each modality (text, image, audio, video): adds <modality>_result, null where there is nothing or it failed."""
        for m in MODALITIES:
            if m not in rows.columns or not self.processor(m):
                continue
            if m == "text":
                done = text.preprocess(rows, "text", self.config.text, "__cleaned", "__tokens")
                result = F.col("__tokens") if self.config.text.tokenizer else F.col("__cleaned")
                rows = done.withColumn("text_result", F.when(is_valid(F.col("text")), result)).drop("__cleaned", "__tokens", "too_short")
            else:
                run = {"image": images.process, "audio": audio.process, "video": video.process}[m]
                rows = run(rows, self.processor(m), content=m, out="__done")
                rows = rows.withColumn(f"{m}_result", F.when(F.col("__done.data").isNotNull(), F.col("__done"))).drop("__done")
        return rows

    def validate(self, samples: DataFrame, modality: str, out: str = "valid") -> DataFrame:
        """Adds whether each sample can be processed; of a modality that is off none can."""
        if self.processor(modality) is None:
            return samples.withColumn(out, F.lit(False))
        checks = {
            "text": lambda: is_valid(F.col("text")),
            "image": lambda: images.header(F.col("content"))["width"].isNotNull(),
            "audio": lambda: audio.header(F.col("content"))["samples"].isNotNull(),
            "video": lambda: F.coalesce(video.header(F.col("content"))["frames"] > 0, F.lit(False)),
        }
        return samples.withColumn(out, checks[modality]())

    def keep(self, df: DataFrame) -> DataFrame:
        """Keeps a result for reuse; Spark spills what memory doesn't hold."""
        self._kept.append(df.persist())
        return self._kept[-1]

    def statistics(self) -> dict:
        return {"modalities": [m for m in MODALITIES if self.processor(m)], "error_handling": self.config.error_handling, "kept": len(self._kept)}

    def clear(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()


def content_key(df: DataFrame, column: str, processor: str, out: str = "content_key") -> DataFrame:
    """Adds a key of a processor and a content, the same in every run."""
    return df.withColumn(out, F.concat(F.lit(f"{processor}_"), F.sha2(F.col(column).cast("binary"), 256)))


class Chain:
    """Functions from DataFrame to DataFrame in order; the first that raises ends the chain."""

    def __init__(self) -> None:
        self.operations: list[tuple[Callable[..., DataFrame], dict]] = []

    def add(self, operation: Callable[..., DataFrame], **kwargs) -> Chain:
        self.operations.append((operation, kwargs))
        return self

    def process(self, df: DataFrame) -> DataFrame:
        for operation, kwargs in self.operations:
            df = df.transform(operation, **kwargs)
        return df

    def clear(self) -> None:
        self.operations.clear()
