"""Arithmetic on arrays of numbers, row-major where they have a shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of pixel values and what they are.
PIXEL_RANGES = {"0-1": (255.0, 0.0), "-1-1": (127.5, -1.0)}


def normalize_pixels(values: Column, pixel_range: str = "0-1", mean: list[float] | None = None, std: list[float] | None = None, strict: bool = True) -> Column:
    """Scales bytes to a range and, if both are given, standardizes each channel (the last axis). An unknown range raises, or leaves values as they are if not strict."""
    if pixel_range in PIXEL_RANGES:
        scale, shift = PIXEL_RANGES[pixel_range]
        scaled = lambda x: x.cast("double") / scale + shift
    elif strict:
        raise ValueError(f"unknown pixel range {pixel_range!r}")
    else:
        scaled = lambda x: x.cast("double")
    if not (mean and std):
        return F.transform(values, lambda x: scaled(x))
    means, stds = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (mean, std))
    channel = lambda i: i % len(mean) + 1
    return F.transform(values, lambda x, i: (scaled(x) - F.element_at(means, channel(i))) / F.element_at(stds, channel(i)))


def peak(values: Column) -> Column:
    return F.array_max(F.transform(values, lambda x: F.abs(x.cast("double"))))


def rms(values: Column) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(squares / F.size(values))


def normalize_amplitude(values: Column, how: str = "peak", level: float = 1.0) -> Column:
    """Scales to a peak or root mean square; silence and other kinds of scaling leave values as they are."""
    if how not in ("peak", "rms"):
        return F.transform(values, lambda x: x.cast("double"))
    size = peak(values) if how == "peak" else rms(values)
    return F.transform(values, lambda x: F.when(size > 0, x.cast("double") / size * level).otherwise(x.cast("double")))


def fix_length(values: Column, n: int) -> Column:
    """The first n values, filled up with zeros."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0).cast("float"), n)), 1, n)


def zero_crossings(values: Column) -> Column:
    """Number of neighbours of which one is negative and the other not."""
    negative = F.transform(values, lambda x: (x < 0).cast("int"))
    pairs = F.zip_with(F.slice(negative, F.lit(2), F.greatest(F.size(negative) - 1, F.lit(0))), F.slice(negative, F.lit(1), F.greatest(F.size(negative) - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x)


def channels_first(values: Column, height: int, width: int, channels: int) -> Column:
    """Height x width x channels to channels x height x width."""
    at = lambda k: (k % (height * width)) * channels + F.floor(k / (height * width)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(height * width * channels - 1)), lambda k: F.element_at(values, at(k).cast("int")))


def swap_channels(values: Column, channels: int = 3) -> Column:
    """Blue-green-red to red-green-blue, or back."""
    at = lambda i: i - i % channels + (channels - 1 - i % channels) + 1
    return F.transform(values, lambda _, i: F.element_at(values, at(i)))


def mean_channel(values: Column, channels: int) -> Column:
    """Interleaved channels to one: their mean."""
    frames = F.floor(F.size(values) / channels).cast("int")
    frame = lambda k: F.aggregate(F.slice(values, k * channels + 1, F.lit(channels)), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), frame)).otherwise(F.array().cast("array<double>"))


def frame_indices(total: Column, fps: Column, max_frames: int | None = None, how: str = "uniform", clip_seconds: float | None = None, key: Column | None = None, seed: int = 0) -> Column:
    """Frames to take from a recording of `total` frames, ascending.

    A clip length caps the total. "all" takes every frame whatever max_frames
    says; "uniform" takes int(i * (total / n)), dividing first in doubles;
    "random" takes the frames whose digests of key and seed are smallest.
    """
    capped = F.least(total, F.floor(F.lit(float(clip_seconds)) * fps)) if clip_seconds else total
    capped = capped.cast("int")
    empty = F.array().cast("array<int>")
    every = F.when(capped > 0, F.sequence(F.lit(0), capped - 1)).otherwise(empty)
    if how == "all" or max_frames is None:
        return every
    n = F.least(capped, F.lit(max_frames))
    if how == "uniform":
        step = capped.cast("double") / n
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * step).cast("int"))).otherwise(empty)
    if how == "random":
        if key is None:
            raise ValueError("random frames need the recording's key")
        ranked = F.array_sort(F.transform(every, lambda i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("place"), i.alias("frame"))))
        return F.array_sort(F.transform(F.slice(ranked, F.lit(1), F.greatest(n, F.lit(0))), lambda r: r["frame"]))
    raise ValueError(f"unknown selection {how!r}")
