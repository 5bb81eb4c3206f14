"""Audio features of media columns.

Samples are stored as 8-bit WAV, read back, resampled by a polyphase filter,
cut into overlapping frames for log-mel energies, and segmented by energy with
hysteresis. Energies leave as Arrow record batches of fixed-shape tensors with
the time span of each.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SOURCE_RATE, RATE = 12_000, 8_000
UP, DOWN = 2, 3
FRAME, HOP, MELS = 256, 128, 24
#: Shape of each tensor: frames by mel bands.
SHAPE = (16, MELS)
#: Padding: the payload is a positive multiple of so many bytes, filled up with spaces.
UNIT, FILL = 192, b" "
#: Energy in dB of full scale at which a segment begins, and below which it ends.
BEGIN_DB, END_DB = -17.0, -18.5
#: Frames computed at a time, so that memory doesn't grow with a recording.
BLOCK = 4096
#: Resampler: inputs of a block row, taps on either side at the upsampled rate.
ROW_IN, HALF = 24, 30


def payload_of(text: bytes) -> bytes:
    return text + FILL * (-len(text) % UNIT if text else UNIT)


def store(payload: bytes, rate: int = SOURCE_RATE) -> bytes:
    """Payload as the samples of an 8-bit, one-channel WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit, one-channel WAV file."""
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit one-channel recording")
        return f.readframes(f.getnframes()), f.getframerate()


@functools.cache
def resampler() -> np.ndarray:
    """The polyphase filter as a matrix: ROW_IN inputs with their surroundings to ROW_IN * UP / DOWN outputs.

    Output k lies at input position k * DOWN / UP; each of the UP phases takes
    its own taps of a Kaiser-windowed sinc that cuts at the lower rate.
    """
    taps = np.arange(-HALF, HALF + 1)
    low = np.sinc(taps / DOWN) / DOWN * np.kaiser(2 * HALF + 1, 8.0) * UP
    edge = HALF // UP
    out = np.zeros((ROW_IN + 2 * edge, ROW_IN * UP // DOWN), dtype=np.float32)
    for k in range(out.shape[1]):
        for i in range(out.shape[0]):
            tap = k * DOWN - (i - edge) * UP
            if abs(tap) <= HALF:
                out[i, k] = low[tap + HALF]
    return out


def resample(samples: np.ndarray, first_row: int, rows: int) -> np.ndarray:
    """Outputs of some block rows of a recording; beyond its ends there is silence."""
    matrix = resampler()
    edge = (len(matrix) - ROW_IN) // 2
    begin, end = first_row * ROW_IN - edge, (first_row + rows) * ROW_IN + edge
    part = np.zeros(end - begin, dtype=np.float32)
    lo, hi = max(0, begin), min(len(samples), end)
    if hi > lo:
        part[lo - begin : hi - begin] = (samples[lo:hi].astype(np.float32) - 128.0) / 128.0
    windows = np.lib.stride_tricks.sliding_window_view(part, len(matrix))[::ROW_IN]
    return (windows @ matrix).ravel()


@functools.cache
def mel_bank() -> np.ndarray:
    """Triangles, even on the mel scale, over the bins of a frame's spectrum."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    points = 700 * (10 ** (np.linspace(mel(50.0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * RATE / FRAME
    rise = (bins[:, None] - points[None, :-2]) / (points[1:-1] - points[:-2])
    fall = (points[None, 2:] - bins[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@functools.cache
def hann() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1].astype(np.float32)


def frame_count(samples: int) -> int:
    outputs = -(-samples * UP // DOWN)
    return max(1, -(-(outputs - FRAME) // HOP) + 1)


def frames_of(samples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Log-mel energies and energy in dB of all frames, a block at a time."""
    total, per_row = frame_count(len(samples)), ROW_IN * UP // DOWN
    for first in range(0, total, BLOCK):
        n = min(BLOCK, total - first)
        begin, length = first * HOP, (n - 1) * HOP + FRAME
        row = begin // per_row
        rows = -(-(begin + length) // per_row) - row
        audio = resample(samples, row, rows)[begin - row * per_row :][:length]
        frames = np.lib.stride_tricks.sliding_window_view(audio, FRAME)[::HOP]
        spectrum = np.fft.rfft(frames * hann(), axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mel = np.log(power.astype(np.float32) @ mel_bank() + np.float32(1e-6))
        energy = 10 * np.log10(np.mean(frames * frames, axis=1) + 1e-10)
        # Steps of 1/64: differences in the last bits between machines stay out of what is stored.
        yield np.round(mel * 64) / 64, np.round(energy, 3)


def segments(energy: np.ndarray, begin_db: float = BEGIN_DB, end_db: float = END_DB) -> list[tuple[int, int]]:
    """Frame ranges that begin at begin_db or more and last until the energy is below end_db."""
    mark = np.where(energy >= begin_db, 1, np.where(energy < end_db, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0) == 1
    turns = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True)]


def pack_tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors (the last filled up with zeros) and the seconds at which each begins and ends."""
    count = -(-len(mel) // SHAPE[0])
    filled = np.zeros((count * SHAPE[0], MELS), dtype=np.float32)
    filled[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), list(SHAPE))
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), SHAPE[0] * MELS))
    first = np.arange(count) * SHAPE[0]
    last = np.minimum(first + SHAPE[0], len(mel)) - 1
    batch = pa.RecordBatch.from_arrays([tensors, pa.array(first * HOP / RATE), pa.array((last * HOP + FRAME) / RATE)], names=["tensor", "begin_s", "end_s"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """What pack_tensors stored: columns tensor, begin_s and end_s."""
    return pa.ipc.open_stream(stored).read_all()


SCHEMA = "n_bytes long, media binary, rate int, payload_sha256 string, tail_crc32 long, payload_bytes long, tensors binary, n_frames long, segments array<struct<begin_s: double, end_s: double>>"


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores texts as audio and computes features of what was stored.

    Returns one row per input row: id_col, n_bytes (UTF-8, before padding),
    media (the WAV file), and of its samples, read back: rate, payload_sha256,
    tail_crc32 (last 16 bytes), payload_bytes, tensors (see read_tensors),
    n_frames, segments (seconds).

    Null texts count as empty and are one unit of padding; equal texts give
    equal values; long texts go through in blocks; extra columns are ignored;
    an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))

    def one(text: bytes | None) -> tuple:
        text = text or b""
        media = store(payload_of(text))
        payload, rate = load(media)
        blocks = list(frames_of(np.frombuffer(payload, dtype=np.uint8)))
        mel = np.concatenate([m for m, _ in blocks])
        found = segments(np.concatenate([e for _, e in blocks]))
        seconds = [{"begin_s": a * HOP / RATE, "end_s": ((b - 1) * HOP + FRAME) / RATE} for a, b in found]
        return len(text), media, rate, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload), pack_tensors(mel), len(mel), seconds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), spans]
        names = [id_col, *(c.split()[0] for c in SCHEMA.split(", ") if not c.startswith("end_s"))]
        for batch in batches:
            texts, first = batch.column(1).cast(pa.large_binary()), 0
            while first < len(texts):  # about 4 MB of texts leave at a time
                rows, size = [], 0
                while first + len(rows) < len(texts) and size < 1 << 22:
                    rows.append(one(texts[first + len(rows)].as_py()))
                    size += len(rows[-1][1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)
                first += len(rows)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")
