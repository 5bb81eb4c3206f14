"""Pipeline configs from YAML profiles with sections text, image, audio, video, pipeline and quality.

A key that a section lacks has the default of its config; a modality that is
not enabled is off.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TextConfig
from ..operators import audio, images, video
from .pipeline import PipelineConfig

# How profiles name features and layouts.
FEATURE_NAMES = {"raw": "raw", "spectrogram": "spectrogram", "mel_spectrogram": "mel", "mfcc": "mfcc"}


def _pair(value: Any) -> tuple | None:
    return tuple(value) if value is not None else None


def text_config(s: dict) -> TextConfig:
    return TextConfig(
        unicode_form=s.get("unicode_normalization", "NFKC") or None,
        remove_accents=s.get("remove_accents", False),
        lowercase=s.get("lowercase", True),
        remove_urls=s.get("remove_urls", True),
        remove_emails=s.get("remove_emails", True),
        remove_phone_numbers=s.get("remove_phone_numbers", True),
        remove_numbers=s.get("remove_numbers", False),
        remove_punctuation=s.get("remove_punctuation", False),
        collapse_space=s.get("remove_extra_whitespace", True),
        min_length=s.get("min_length", 1),
        max_length=s.get("max_length"),
        tokenizer=s.get("tokenizer_type", "whitespace") if s.get("tokenize", True) else None,
        special_tokens=s.get("add_special_tokens", False),
        bos=s.get("bos_token", "<BOS>"),
        eos=s.get("eos_token", "<EOS>"),
    )


def image_config(s: dict) -> images.ImageConfig:
    on = s.get("augment", False)
    return images.ImageConfig(
        size=_pair(s.get("target_size", (224, 224))) if s.get("resize", True) else None,
        method=s.get("resize_mode", "bicubic"),
        keep_aspect=s.get("maintain_aspect_ratio", False),
        to_rgb=s.get("convert_to_rgb", True),
        grayscale=s.get("grayscale", False),
        normalize=s.get("normalize_pixels", True),
        pixel_range=s.get("pixel_range", "0-1"),
        mean=_pair(s.get("mean")),
        std=_pair(s.get("std")),
        horizontal_flip=on and s.get("horizontal_flip", False),
        vertical_flip=on and s.get("vertical_flip", False),
        rotation=float(s.get("rotation_range") or 0) if on else 0.0,
        brightness=_pair(s.get("brightness_range")) if on else None,
        contrast=_pair(s.get("contrast_range")) if on else None,
        layout="chw" if s.get("output_format") == "tensor" else "hwc",
    )


def audio_config(s: dict) -> audio.AudioConfig:
    on = s.get("augment", False)
    return audio.AudioConfig(
        sample_rate=s.get("sample_rate", 16_000),
        mono=s.get("mono", True),
        trim_silence=s.get("trim_silence", True),
        silence=s.get("silence_threshold", 0.01),
        duration=s.get("duration"),
        normalize=s.get("normalization_type", "peak") if s.get("normalize_amplitude", True) else None,
        level=s.get("target_level", 1.0),
        stretch=_pair(s.get("time_stretch_range")) if on else None,
        pitch=_pair(s.get("pitch_shift_range")) if on else None,
        noise=s.get("noise_factor", 0.005) if on and s.get("add_noise", False) else None,
        feature=FEATURE_NAMES[s.get("feature_type", "mel_spectrogram")] if s.get("extract_features", True) else "raw",
        n_fft=s.get("n_fft", 2048),
        hop=s.get("hop_length", 512),
        window=s.get("win_length"),
        n_mels=s.get("n_mels", 128),
        fmin=s.get("fmin", 0.0),
        fmax=s.get("fmax"),
        n_mfcc=s.get("n_mfcc", 40),
        layout=s.get("output_format", "numpy"),
    )


def video_config(s: dict) -> video.VideoConfig:
    stacked = s.get("stack_frames", True)
    return video.VideoConfig(
        max_frames=s.get("max_frames"),
        selection=s.get("frame_sampling", "uniform"),
        clip_seconds=s.get("clip_duration"),
        size=_pair(s.get("target_size", (224, 224))) if s.get("resize_frames", True) else None,
        keep_aspect=s.get("maintain_aspect_ratio", False),
        to_rgb=s.get("convert_to_rgb", True),
        grayscale=s.get("grayscale", False),
        normalize=s.get("normalize_pixels", True),
        pixel_range=s.get("pixel_range", "0-1"),
        mean=_pair(s.get("mean")),
        std=_pair(s.get("std")),
        layout="list" if not stacked else "cthw" if s.get("output_format") == "tensor" else "thwc",
    )


def pipeline_config(profile: dict) -> PipelineConfig:
    """The pipeline of a profile; text and images are on unless it says otherwise, audio and video are not."""
    section = lambda name, default: profile.get(name) or {"enabled": default}
    made = {}
    for name, run, default in (("text", text_config, True), ("image", image_config, True), ("audio", audio_config, False), ("video", video_config, False)):
        own = section(name, default)
        made[name] = run(own) if own.get("enabled", default) else None
    return PipelineConfig(**made, error_handling=(profile.get("pipeline") or {}).get("error_handling", "skip"))


@dataclass(frozen=True)
class QualityLimits:
    """Bounds of what is kept; None is no bound."""

    text_chars: tuple[int | None, int | None] = (None, None)
    image_size: tuple[tuple[int, int] | None, tuple[int, int] | None] = (None, None)
    audio_seconds: tuple[float | None, float | None] = (None, None)
    video_frames: int | None = None
    video_seconds: float | None = None


def quality_limits(profile: dict) -> QualityLimits:
    q = profile.get("quality") or {}
    return QualityLimits((q.get("min_text_chars"), q.get("max_text_chars")), (_pair(q.get("min_image_size")), _pair(q.get("max_image_size"))), (q.get("min_audio_duration"), q.get("max_audio_duration")), q.get("min_video_frames"), q.get("max_video_duration"))


def load_profile(path: str) -> dict:
    """A YAML profile from a file of the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def _between(value, low, high):
    kept = value.isNotNull()
    if low is not None:
        kept = kept & (value >= low)
    return kept & (value <= high) if high is not None else kept


def within_limits(samples: DataFrame, limits: QualityLimits, modality: str) -> DataFrame:
    """Samples of one modality that keep the limits; what can't be decoded goes."""
    if modality == "text":
        return samples.where(_between(F.length("text"), *limits.text_chars))
    columns = samples.columns
    if modality == "image":
        seen = samples.withColumn("__h", images.header(F.col("content")))
        low, high = (x or (None, None) for x in limits.image_size)
        return seen.where(_between(F.col("__h.width"), low[0], high[0]) & _between(F.col("__h.height"), low[1], high[1])).select(*columns)
    if modality == "audio":
        seen = samples.withColumn("__h", audio.header(F.col("content")))
        return seen.where(_between(F.col("__h.samples") / F.col("__h.sample_rate"), *limits.audio_seconds)).select(*columns)
    if modality == "video":
        seen = samples.withColumn("__h", video.header(F.col("content")))
        seconds = F.when(F.col("__h.fps") > 0, F.col("__h.frames") / F.col("__h.fps")).otherwise(F.lit(0.0))
        return seen.where(_between(F.col("__h.frames"), limits.video_frames, None) & _between(seconds, None, limits.video_seconds)).select(*columns)
    raise ValueError(f"unknown modality {modality!r}")
