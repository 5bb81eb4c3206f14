"""Video: frame selection, extraction, frame processing, layouts and keyframes.

Containers need a decoder, which this engine leaves as a plug-in: a function
from bytes to frames and rate. Uncompressed YUV4MPEG2 comes with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf, row_udf
from ..functions.tensor import PIXEL_RANGES, frame_indices
from . import images


@dataclass(frozen=True)
class VideoConfig:
    max_frames: int | None = None
    selection: str = "uniform"  # or random, all
    clip_seconds: float | None = None
    size: tuple[int, int] | None = (224, 224)
    keep_aspect: bool = False
    to_rgb: bool = True
    grayscale: bool = False
    normalize: bool = True  # else pixels stay bytes' values
    pixel_range: str = "0-1"
    mean: tuple[float, ...] | None = None
    std: tuple[float, ...] | None = None
    layout: str = "thwc"  # or cthw, list
    seed: int = 0


def planes_of(data: bytes) -> tuple[np.ndarray, float]:
    """Colour planes (time x 3 x height x width) and rate of a 4:4:4 YUV4MPEG2 stream."""
    head, _, rest = data.partition(b"\n")
    fields = {f[:1]: f[1:] for f in head.split()[1:]}
    width, height = int(fields[b"W"]), int(fields[b"H"])
    over, _, under = fields.get(b"F", b"25:1").partition(b":")
    if not fields.get(b"C", b"").startswith(b"444"):
        raise ValueError("only 4:4:4 streams")
    at, n, frames = len(head) + 1, width * height * 3, []
    while data.startswith(b"FRAME", at):
        at = data.index(b"\n", at) + 1
        frames.append(np.frombuffer(data, np.uint8, n, at).reshape(3, height, width))
        at += n
    if not frames:
        raise ValueError("a video without frames")
    return np.stack(frames), int(over) / int(under)


def decode_y4m(data: bytes) -> tuple[np.ndarray, float]:
    """Frames (time x height x width x RGB) and rate of a 4:4:4 YUV4MPEG2 stream."""
    planes, fps = planes_of(data)
    y, u, v = (planes[:, i].astype(np.float32) for i in range(3))
    rgb = np.stack([y + 1.402 * (v - 128), y - 0.344136 * (u - 128) - 0.714136 * (v - 128), y + 1.772 * (u - 128)], axis=-1)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8), fps


def probe_y4m(data: bytes) -> tuple[int, float, int, int]:
    planes, fps = planes_of(data)
    return len(planes), fps, planes.shape[3], planes.shape[2]


def encode_y4m(frames: np.ndarray, fps: int = 25) -> bytes:
    """RGB frames as a 4:4:4 YUV4MPEG2 stream."""
    t, h, w, _ = frames.shape
    out = [f"YUV4MPEG2 W{w} H{h} F{fps}:1 C444\n".encode()]
    for f in frames.astype(np.float32):
        r, g, b = f[..., 0], f[..., 1], f[..., 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = np.stack([y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128])
        out += [b"FRAME\n", np.clip(np.floor(planes + 0.5), 0, 255).astype(np.uint8).tobytes()]
    return b"".join(out)


#: Decoders by a format's first bytes; others can be added.
DECODERS: dict[bytes, Callable[[bytes], tuple[np.ndarray, float]]] = {b"YUV4MPEG2": decode_y4m}


#: By the same bytes, how to tell frames, rate, width and height without decoding; where there is none a video is decoded for it.
PROBES: dict[bytes, Callable[[bytes], tuple[int, float, int, int]]] = {b"YUV4MPEG2": probe_y4m}


def probe(data: bytes) -> tuple[int, float, int, int]:
    found = next((run for magic, run in PROBES.items() if data.startswith(magic)), None)
    if found:
        return found(data)
    frames, fps = decode(data)
    return len(frames), fps, frames.shape[2], frames.shape[1]


def decode(data: bytes) -> tuple[np.ndarray, float]:
    found = next((run for magic, run in DECODERS.items() if data.startswith(magic)), None)
    if found is None:
        raise ValueError("no decoder for this format")
    return found(data)


@arrow_udf("frames int, fps double, width int, height int, error string")
def header(contents: pd.Series) -> pd.DataFrame:
    """Frames, rate and size; an error where a video can't be decoded."""

    def one(data):
        try:
            return *probe(data), None
        except Exception as error:  # the row's own failure
            return None, None, None, None, str(error) or type(error).__name__

    return pd.DataFrame([one(d) for d in contents], columns=["frames", "fps", "width", "height", "error"]).astype({"frames": "Int32", "width": "Int32", "height": "Int32"})


def select_frames(df: DataFrame, config: VideoConfig, total: str = "frames", fps: str = "fps", key: str = "id", out: str = "indices") -> DataFrame:
    """Adds the frames to take; built-in functions only."""
    return df.withColumn(out, frame_indices(F.col(total), F.col(fps), config.max_frames, config.selection, config.clip_seconds, F.col(key), config.seed))


def extract_frames(df: DataFrame, config: VideoConfig | None = None, content: str = "content", key: str = "id") -> DataFrame:
    """One row per taken frame: key, ord, frame, height, width, channels, pixels (bytes). Videos that can't be decoded have none."""
    config = config or VideoConfig()
    chosen = df.select(key, content, header(F.col(content)).alias("h")).where(F.col("h.error").isNull())
    chosen = select_frames(chosen.select(key, content, "h.frames", "h.fps"), config, key=key).select(key, content, "indices")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames, _ = decode(data)
                taken = [(n, i, frames[i]) for n, i in enumerate(wanted) if i < len(frames)]
                yield pa.RecordBatch.from_pylist(
                    [{key: k, "ord": n, "frame": i, "height": f.shape[0], "width": f.shape[1], "channels": f.shape[2], "pixels": f.tobytes()} for n, i, f in taken],
                    schema=pa.schema([batch.schema.field(0), ("ord", pa.int32()), ("frame", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary())]),
                )

    return chosen.mapInArrow(run, f"`{key}` {kind}, ord int, frame int, height int, width int, channels int, pixels binary")


def process_frame(pixels: np.ndarray, config: VideoConfig) -> np.ndarray:
    """Colour (RGB goes before grey), size and range; an unknown range leaves values as they are."""
    if config.grayscale and not config.to_rgb and pixels.shape[2] == 3:
        pixels = images.luminance(pixels)[:, :, None]
    if config.size:
        pixels = images.resize(pixels, *config.size, "bilinear", config.keep_aspect)
    if config.normalize and config.pixel_range in PIXEL_RANGES:
        return images.normalize(pixels, config.pixel_range, config.mean, config.std)
    return pixels.astype(np.float32)


def process(df: DataFrame, config: VideoConfig | None = None, content: str = "content", key: str = "id", out: str = "video") -> DataFrame:
    """Adds a struct of shape, data (row-major) and error. Layout: time first, channels first, or (list) an array of frames one after another as time first."""
    config = config or VideoConfig()
    chosen = select_frames(df.withColumn("__h", header(F.col(content))).withColumn("__n", F.col("__h.frames")).withColumn("__fps", F.col("__h.fps")), config, "__n", "__fps", key, "__indices")

    def one(data: bytes | None, wanted: list[int] | None) -> tuple:
        try:
            frames, _ = decode(data)
            if not wanted:
                raise ValueError("no frames")
            stack = np.stack([process_frame(frames[i], config) for i in wanted])
            stack = np.transpose(stack, (3, 0, 1, 2)) if config.layout == "cthw" else stack
            return list(stack.shape), stack.ravel(), None
        except Exception as error:  # the row's own failure
            return None, None, str(error) or type(error).__name__

    run = row_udf(images.OUT, images.OUT_KIND, one, images.data_size)
    return chosen.withColumn(out, run(F.col(content), F.col("__indices"))).drop("__h", "__n", "__fps", "__indices")


def keyframes(frames: DataFrame, key: str = "id", order: str = "frame", grey: str = "grey", threshold: float = 0.3) -> DataFrame:
    """Rows that differ from the frame just before by more than a share of full scale, and first frames. grey: arrays of 0 to 255; a video's frames are one window."""
    before = F.lag(grey).over(Window.partitionBy(key).orderBy(order))
    change = F.aggregate(F.zip_with(grey, "__before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x) / (F.size(grey) * 255.0)
    found = frames.withColumn("__before", before).withColumn("change", F.when(F.col("__before").isNotNull(), change))
    return found.where(F.col("__before").isNull() | (F.col("change") > threshold)).drop("__before")


def statistics(df: DataFrame, content: str = "content") -> DataFrame:
    """One row: all videos, and durations, rates and sizes of those that can be decoded."""
    seconds = F.when(F.col("h.fps") > 0, F.col("h.frames") / F.col("h.fps")).otherwise(0.0)
    measured = df.select(header(F.col(content)).alias("h")).withColumn("seconds", F.when(F.col("h.error").isNull(), seconds))
    sizes = [F.coalesce(f("seconds"), F.lit(0.0)).alias(f"{n}_duration") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    size = F.when(F.col("h.error").isNull(), F.concat_ws("x", "h.width", "h.height"))
    return measured.agg(F.count("*").alias("total_videos"), *sizes, F.coalesce(F.avg("h.fps"), F.lit(0.0)).alias("avg_fps"), F.array_sort(F.collect_set(size)).alias("resolutions"))
