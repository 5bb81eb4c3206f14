"""Audio: decoding, resampling, trimming, augmenting and spectral features, in Arrow batches.

Recordings are one or more channels; a duration is along time, whatever the
number of channels.
"""

from __future__ import annotations

import functools
import io
import math
import wave
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf, row_udf

FEATURES = ("raw", "spectrogram", "mel", "mfcc")
OUT = "shape array<int>, data array<float>, sample_rate int, error string"
OUT_KIND = pa.struct([("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32())), ("sample_rate", pa.int32()), ("error", pa.string())])


@dataclass(frozen=True)
class AudioConfig:
    sample_rate: int = 16_000
    mono: bool = True
    trim_silence: bool = True
    silence: float = 0.01  # a share of the peak
    duration: float | None = None  # seconds
    normalize: str | None = "peak"
    level: float = 1.0
    stretch: tuple[float, float] | None = None
    pitch: tuple[float, float] | None = None  # semitones
    noise: float | None = None
    feature: str = "mel"
    n_fft: int = 2048
    hop: int = 512
    window: int | None = None
    n_mels: int = 128
    fmin: float = 0.0
    fmax: float | None = None
    n_mfcc: int = 40
    layout: str = "numpy"  # or tensor: a leading axis for waveforms
    seed: int = 0

    def __post_init__(self) -> None:
        if self.feature not in FEATURES or self.layout not in ("numpy", "tensor"):
            raise ValueError(f"unknown feature or layout: {self}")


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 as channels x time, and the rate."""
    with wave.open(io.BytesIO(data)) as f:
        n, width, rate, raw = f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        values = (np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32) @ np.array([1 << 8, 1 << 16, 1 << 24], dtype=np.int32)).astype(np.float32) / 2**31
    else:
        values = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    return values.reshape(-1, n).T, rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit WAV of one channel or channels x time."""
    rows = np.atleast_2d(samples)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(len(rows))
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(rows.T, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


#: Decoders by a format's first bytes; others can be added.
DECODERS: dict[bytes, Callable[[bytes], tuple[np.ndarray, int]]] = {b"RIFF": decode_wav}


def decode(data: bytes) -> tuple[np.ndarray, int]:
    found = next((run for magic, run in DECODERS.items() if data.startswith(magic)), None)
    if found is None:
        raise ValueError("no decoder for this format")
    samples, rate = found(data)
    if not samples.size or rate <= 0:
        raise ValueError("a recording without samples")
    return samples, rate


@functools.lru_cache(32)
def phases(up: int, down: int, zeros: int) -> np.ndarray:
    """Filters of a polyphase resampler: for each of `up` positions between two samples, the weights of the samples around."""
    low = min(1.0, up / down)
    half = int(np.ceil(zeros / low))
    off = np.arange(-half + 1, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    window = np.i0(12.0 * np.sqrt(np.maximum(0, 1 - (off / half) ** 2))) / np.i0(12.0)
    return (low * np.sinc(low * off) * window).astype(np.float32)


def resample(samples: np.ndarray, source: int, target: int, zeros: int = 32) -> np.ndarray:
    """Along time, by a windowed sinc that cuts at the lower rate."""
    if source == target:
        return samples
    shared = math.gcd(source, target)
    up, down = target // shared, source // shared
    bank = phases(up, down, zeros)
    half, n_out = bank.shape[1] // 2, -(-samples.shape[-1] * up // down)
    padded = np.pad(samples, [(0, 0)] * (samples.ndim - 1) + [(half - 1, half + 1)])
    around = np.lib.stride_tricks.sliding_window_view(padded, bank.shape[1], axis=-1)
    out = np.empty((*samples.shape[:-1], n_out), dtype=np.float32)
    for k in range(min(up, n_out)):  # outputs k, k + up, ... lie at the same position between samples
        first, phase = divmod(k * down, up)
        count = len(range(k, n_out, up))
        out[..., k::up] = around[..., first : first + (count - 1) * down + 1 : down, :] @ bank[phase]
    return out


def to_mono(samples: np.ndarray) -> np.ndarray:
    return samples.mean(axis=0) if samples.ndim > 1 else samples


def frame_power(samples: np.ndarray, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """Mean square of centred frames, over channels."""
    flat = np.atleast_2d(samples)
    padded = np.pad(flat, ((0, 0), (frame // 2, frame // 2)))
    return np.lib.stride_tricks.sliding_window_view(padded, frame, axis=1)[:, ::hop].astype(np.float64).__pow__(2).mean(axis=(0, 2))


def trim(samples: np.ndarray, silence: float = 0.01, hop: int = 512) -> np.ndarray:
    """Without quiet frames at both ends: those more than -20 log10(silence) dB below the loudest."""
    power = frame_power(samples, hop=hop)
    if not power.max():
        return samples[..., :0]
    loud = np.flatnonzero(10 * np.log10(np.maximum(power, 1e-10) / power.max()) > 20 * np.log10(silence))
    return samples[..., loud[0] * hop : min(samples.shape[-1], (loud[-1] + 1) * hop)]


def fix_duration(samples: np.ndarray, seconds: float, rate: int) -> np.ndarray:
    n = int(seconds * rate)
    pad = max(0, n - samples.shape[-1])
    return np.pad(samples, [(0, 0)] * (samples.ndim - 1) + [(0, pad)])[..., :n]


def normalize(samples: np.ndarray, how: str | None, level: float = 1.0) -> np.ndarray:
    """To a peak or root mean square; silence, and other kinds, stay."""
    if not samples.size:
        return samples
    size = {"peak": lambda: float(np.abs(samples).max()), "rms": lambda: float(np.sqrt(np.mean(samples.astype(np.float64) ** 2)))}.get(how or "", lambda: 0.0)()
    return samples * np.float32(level / size) if size > 0 else samples


@functools.lru_cache(8)
def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(samples: np.ndarray, n_fft: int = 2048, hop: int = 512, window: int | None = None) -> np.ndarray:
    """Spectra of centred frames, bins x frames."""
    shape = hann(window or n_fft)
    left = (n_fft - len(shape)) // 2
    shape = np.pad(shape, (left, n_fft - len(shape) - left))
    padded = np.pad(samples, (n_fft // 2, n_fft // 2))
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop] * shape, axis=1).T


def istft(spectra: np.ndarray, hop: int, length: int) -> np.ndarray:
    """The signal whose frames these spectra fit best."""
    n_fft = 2 * (spectra.shape[0] - 1)
    shape, frames = hann(n_fft), np.fft.irfft(spectra.T, n_fft, axis=1)
    out, norm = np.zeros(n_fft + hop * (len(frames) - 1)), np.zeros(n_fft + hop * (len(frames) - 1))
    for i, f in enumerate(frames):
        out[i * hop : i * hop + n_fft] += f * shape
        norm[i * hop : i * hop + n_fft] += shape**2
    out = (out / np.maximum(norm, 1e-8))[n_fft // 2 :]
    return np.pad(out, (0, max(0, length - len(out))))[:length].astype(np.float32)


def time_stretch(samples: np.ndarray, rate: float, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    """Faster (over 1) or slower at the same pitch, by a phase vocoder."""
    s = stft(samples, n_fft, hop)
    s = np.pad(s, ((0, 0), (0, 2)))
    advance = 2 * np.pi * hop * np.arange(s.shape[0]) / n_fft
    phase, out = np.angle(s[:, 0]), []
    for t in np.arange(0, s.shape[1] - 2, rate):
        i, f = int(t), t - int(t)
        out.append(((1 - f) * np.abs(s[:, i]) + f * np.abs(s[:, i + 1])) * np.exp(1j * phase))
        turn = np.angle(s[:, i + 1]) - np.angle(s[:, i]) - advance
        phase = phase + advance + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
    return istft(np.array(out).T, hop, round(len(samples) / rate))


def pitch_shift(samples: np.ndarray, rate: int, semitones: float) -> np.ndarray:
    """Higher or lower at the same length."""
    factor = 2.0 ** (semitones / 12)
    slower = time_stretch(samples, 1 / factor)
    shifted = resample(slower, max(1, round(rate * factor)), rate)
    return fix_duration(shifted, len(samples) / rate + 1e-9, rate)


def augment(samples: np.ndarray, config: AudioConfig, rng: np.random.Generator) -> np.ndarray:
    each = lambda f: f(samples) if samples.ndim == 1 else np.stack([f(c) for c in samples])
    if config.stretch:
        rate = rng.uniform(*config.stretch)
        samples = each(lambda c: time_stretch(c, rate))
    if config.pitch:
        steps = rng.uniform(*config.pitch)
        samples = each(lambda c: pitch_shift(c, config.sample_rate, steps))
    if config.noise:
        samples = samples + rng.normal(0, config.noise, samples.shape).astype(np.float32)
    return samples


def decibels(power: np.ndarray, reference: float | None = None, top: float = 80.0) -> np.ndarray:
    """Power in dB of its largest value, or of a reference, down to `top` below the largest."""
    ref = power.max() if reference is None else reference
    out = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(ref, 1e-10))
    return np.maximum(out, out.max() - top).astype(np.float32)


@functools.lru_cache(8)
def mel_filters(rate: int, n_fft: int, n_mels: int, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """Triangles of equal area on a scale that is linear to 1 kHz and logarithmic above."""
    step, knee = 200 / 3, 1000.0
    to_mel = lambda f: np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, 1e-9) / knee) / (np.log(6.4) / 27))
    to_hz = lambda m: np.where(m < knee / step, m * step, knee * np.exp((np.log(6.4) / 27) * (m - knee / step)))
    points = to_hz(np.linspace(to_mel(np.float64(fmin)), to_mel(np.float64(fmax or rate / 2)), n_mels + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (bins[None] - points[:-2, None]) / np.diff(points)[:-1, None]
    fall = (points[2:, None] - bins[None]) / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (points[2:] - points[:-2]))[:, None]


def mel_power(samples: np.ndarray, rate: int, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, fmin: float = 0.0, fmax: float | None = None, window: int | None = None) -> np.ndarray:
    return mel_filters(rate, n_fft, n_mels, fmin, fmax) @ np.abs(stft(samples, n_fft, hop, window)) ** 2


@functools.lru_cache(8)
def cosines(n_mfcc: int, n_mels: int) -> np.ndarray:
    """The orthonormal cosine transform (type 2)."""
    k, n = np.arange(n_mfcc)[:, None], np.arange(n_mels)[None]
    basis = np.sqrt(2 / n_mels) * np.cos(np.pi * k * (2 * n + 1) / (2 * n_mels))
    basis[0] /= np.sqrt(2)
    return basis


def mfcc(samples: np.ndarray, rate: int, n_mfcc: int = 40, n_fft: int = 2048, hop: int = 512, n_mels: int = 128, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """Orthonormal cosine transform (type 2) of log-mel energies. The window length isn't taken into account."""
    logs = decibels(mel_power(samples, rate, n_fft, hop, n_mels, fmin, fmax), 1.0)
    return (cosines(n_mfcc, n_mels) @ logs).astype(np.float32)


def feature(samples: np.ndarray, rate: int, config: AudioConfig) -> np.ndarray:
    if config.feature == "raw":
        return samples
    if samples.ndim > 1:
        return np.stack([feature(c, rate, config) for c in samples])
    if config.feature == "spectrogram":
        return decibels(np.abs(stft(samples, config.n_fft, config.hop, config.window)) ** 2)
    if config.feature == "mel":
        return decibels(mel_power(samples, rate, config.n_fft, config.hop, config.n_mels, config.fmin, config.fmax, config.window))
    return mfcc(samples, rate, config.n_mfcc, config.n_fft, config.hop, config.n_mels, config.fmin, config.fmax)


def all_features(samples: np.ndarray, rate: int, config: AudioConfig | None = None) -> dict[str, np.ndarray]:
    """Six features; all but the spectrogram with default frames."""
    config = config or AudioConfig()
    magnitude = np.abs(stft(samples))
    bins = np.arange(magnitude.shape[0]) * rate / 2048
    padded = np.pad(samples, (1024, 1024), mode="edge")
    signs = np.signbit(np.lib.stride_tricks.sliding_window_view(padded, 2048)[::512])
    return {
        "spectrogram": decibels(np.abs(stft(samples, config.n_fft, config.hop, config.window)) ** 2),
        "mel": decibels(mel_power(samples, rate, n_mels=config.n_mels)),
        "mfcc": mfcc(samples, rate, config.n_mfcc),
        "zcr": (signs[:, 1:] != signs[:, :-1]).mean(axis=1, keepdims=True).T.astype(np.float32) * (2047 / 2048),
        "spectral_centroid": ((bins[:, None] * magnitude).sum(axis=0) / np.maximum(magnitude.sum(axis=0), 1e-10))[None].astype(np.float32),
        "rms": np.sqrt(frame_power(samples))[None].astype(np.float32),
    }


def prepare(data: bytes, config: AudioConfig, key: int = 0) -> np.ndarray:
    """The waveform that features are taken of."""
    samples, rate = decode(data)
    samples = resample(samples, rate, config.sample_rate)
    samples = to_mono(samples) if config.mono or len(samples) == 1 else samples
    if config.trim_silence:
        samples = trim(samples, config.silence)
    if config.duration:
        samples = fix_duration(samples, config.duration, config.sample_rate)
    samples = normalize(samples, config.normalize, config.level)
    return augment(samples, config, np.random.default_rng((config.seed, key & 0x7FFFFFFFFFFFFFFF))).astype(np.float32)


def process_one(data: bytes, config: AudioConfig, key: int = 0) -> np.ndarray:
    out = feature(prepare(data, config, key), config.sample_rate, config).astype(np.float32)
    return out[None] if config.layout == "tensor" and out.ndim == 1 else out


def process(df: DataFrame, config: AudioConfig | None = None, content: str = "content", key: str = "id", out: str = "audio") -> DataFrame:
    """Adds a struct of shape, data (row-major), sample rate and error; what fails has an error and no data."""
    config = config or AudioConfig()

    def one(data: bytes | None, k: int) -> tuple:
        try:
            found = process_one(data, config, k)
            return list(found.shape), found.ravel(), config.sample_rate, None
        except Exception as error:  # the row's own failure
            return None, None, None, str(error) or type(error).__name__

    run = row_udf(OUT, OUT_KIND, one, lambda row: 0 if row[1] is None else row[1].nbytes)
    return df.withColumn(out, run(F.col(content), F.xxhash64(key)))


@arrow_udf("samples long, sample_rate int, channels int")
def header(contents: pd.Series) -> pd.DataFrame:
    """Length, rate and channels; nulls where a recording can't be decoded."""

    def one(data):
        try:
            samples, rate = decode(data)
        except Exception:  # the row's own failure
            return None, None, None
        return samples.shape[-1], rate, len(samples)

    return pd.DataFrame([one(d) for d in contents], columns=["samples", "sample_rate", "channels"]).astype({"samples": "Int64", "sample_rate": "Int32", "channels": "Int32"})


def statistics(df: DataFrame, content: str = "content") -> DataFrame:
    """One row: all recordings, and durations and rates of those that can be decoded."""
    seconds = F.col("h.samples") / F.col("h.sample_rate")
    measured = df.select(header(F.col(content)).alias("h")).withColumn("seconds", seconds)
    sizes = [F.coalesce(f("seconds"), F.lit(0.0)).alias(f"{n}_duration") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max), ("total", F.sum))]
    return measured.agg(F.count("*").alias("total_audio"), *sizes, F.array_sort(F.collect_set("h.sample_rate")).alias("sample_rates"))
