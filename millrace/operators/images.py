"""Images: decoding, colour, resizing, normalizing and augmenting, in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_udf, row_udf
from ..functions.tensor import PIXEL_RANGES

FILTERS = {"nearest": 0.5, "bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}
#: Weights of red, green and blue in luminance.
LUMA = np.array([299, 587, 114], dtype=np.float64) / 1000
OUT = "shape array<int>, data array<float>, error string"
OUT_KIND = pa.struct([("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32())), ("error", pa.string())])


@dataclass(frozen=True)
class ImageConfig:
    size: tuple[int, int] | None = (224, 224)  # width, height
    method: str = "bicubic"
    keep_aspect: bool = False
    to_rgb: bool = True
    grayscale: bool = False
    normalize: bool = True  # else pixels stay bytes' values
    pixel_range: str = "0-1"
    mean: tuple[float, ...] | None = None
    std: tuple[float, ...] | None = None
    horizontal_flip: bool = False
    vertical_flip: bool = False
    rotation: float = 0.0
    brightness: tuple[float, float] | None = None
    contrast: tuple[float, float] | None = None
    layout: str = "hwc"  # or chw
    seed: int = 0

    def __post_init__(self) -> None:
        if self.method not in FILTERS or self.pixel_range not in PIXEL_RANGES or self.layout not in ("hwc", "chw"):
            raise ValueError(f"unknown method, pixel range or layout: {self}")


def decode_png(data: bytes) -> np.ndarray:
    """8-bit grey, grey-alpha, RGB, RGBA or palette PNG without interlacing, as height x width x channels."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, idat, palette, head = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNGs without interlacing")
    width, height, _, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, stride = zlib.decompress(b"".join(idat)), width * channels
    out, above = np.zeros((height, stride), dtype=np.uint8), np.zeros(stride, dtype=np.int32)
    for y in range(height):
        line = np.frombuffer(raw, dtype=np.uint8, count=stride, offset=y * (stride + 1) + 1).astype(np.int32)
        out[y] = _unfilter(raw[y * (stride + 1)], line, above, channels)
        above = out[y].astype(np.int32)
    pixels = out.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if colour == 3 and palette is not None else pixels


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line & 255
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        return (np.cumsum(line.reshape(-1, step), axis=0) & 255).ravel()
    out = line.tolist()
    up = above.tolist()
    for i, x in enumerate(out):
        a, b, c = (out[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (x + guess) & 255
    return np.array(out)


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of height x width x channels."""
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, dtype=np.uint8))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_netpbm(data: bytes) -> np.ndarray:
    """Binary grey (P5) or RGB (P6) maps of 8 bits."""
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    channels = {b"P5": 1, b"P6": 3}[data[:2]]
    if top != 255:
        raise ValueError("only 8-bit maps")
    return np.frombuffer(data, dtype=np.uint8, count=width * height * channels, offset=at + 1).reshape(height, width, channels)


#: Decoders by a format's first bytes; others can be added.
DECODERS: dict[bytes, Callable[[bytes], np.ndarray]] = {b"\x89PNG": decode_png, b"P5": decode_netpbm, b"P6": decode_netpbm}


def decode(data: bytes) -> np.ndarray:
    """Pixels of an encoded image; what no decoder knows, or is empty, raises."""
    found = next((run for magic, run in DECODERS.items() if data.startswith(magic)), None)
    if found is None:
        raise ValueError("no decoder for this format")
    pixels = found(data)
    if not pixels.size:
        raise ValueError("an image without pixels")
    return pixels


def convert(pixels: np.ndarray, to_rgb: bool, grayscale: bool) -> np.ndarray:
    """Other than RGB images become RGB; RGB images become grey if that is wanted."""
    if to_rgb and pixels.shape[2] != 3:
        colour = pixels[:, :, :3] if pixels.shape[2] == 4 else pixels[:, :, :1].repeat(3, axis=2)
        return colour
    if grayscale and pixels.shape[2] == 3:
        return luminance(pixels)[:, :, None]
    return pixels


def luminance(pixels: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(pixels.astype(np.float64) @ LUMA + 0.5), 0, 255).astype(np.uint8)


def kernel(method: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if method == "bilinear":
        return np.maximum(0, 1 - x)
    if method == "bicubic":
        a = -0.5
        return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0))
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)


def weights(method: str, source: int, target: int) -> np.ndarray:
    """target x source matrix of a separable filter, widened when it shrinks."""
    ratio = source / target
    centres = (np.arange(target) + 0.5) * ratio
    if method == "nearest":
        return np.eye(source)[np.minimum(centres.astype(int), source - 1)]
    scale = max(ratio, 1.0)
    out = kernel(method, (np.arange(source)[None, :] + 0.5 - centres[:, None]) / scale)
    return out / out.sum(axis=1, keepdims=True)


def fitted(w: int, h: int, width: int, height: int) -> tuple[int, int]:
    """The size of a w x h image that fills one side of width x height; the other is cut to whole pixels."""
    aspect = w / h
    if aspect > width / height:
        return width, max(1, int(width / aspect))
    return max(1, int(height * aspect)), height


def resize(pixels: np.ndarray, width: int, height: int, method: str = "bicubic", keep_aspect: bool = False) -> np.ndarray:
    """To width x height; keeping the aspect, the image is fitted and centred on black."""
    h, w = pixels.shape[:2]
    new_w, new_h = fitted(w, h, width, height) if keep_aspect else (width, height)
    scaled = np.einsum("yh,hwc->ywc", weights(method, h, new_h), pixels.astype(np.float64))
    scaled = np.einsum("xw,ywc->yxc", weights(method, w, new_w), scaled)
    scaled = np.clip(np.floor(scaled + 0.5), 0, 255).astype(np.uint8)
    if (new_w, new_h) == (width, height):
        return scaled
    out = np.zeros((height, width, pixels.shape[2]), dtype=np.uint8)
    y, x = (height - new_h) // 2, (width - new_w) // 2
    out[y : y + new_h, x : x + new_w] = scaled
    return out


def rotate(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """Around the centre, bicubic, black outside; neighbours beyond the border are those on it."""
    h, w = pixels.shape[:2]
    turn = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float64) + 0.5
    sx = np.cos(turn) * (x - w / 2) - np.sin(turn) * (y - h / 2) + w / 2
    sy = np.sin(turn) * (x - w / 2) + np.cos(turn) * (y - h / 2) + h / 2
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    x0, y0 = np.floor(sx - 0.5).astype(int), np.floor(sy - 0.5).astype(int)
    source, out = pixels.astype(np.float64), np.zeros(pixels.shape)
    for j in range(-1, 3):
        wy = kernel("bicubic", sy - 0.5 - (y0 + j))
        row = np.clip(y0 + j, 0, h - 1)
        for i in range(-1, 3):
            wx = kernel("bicubic", sx - 0.5 - (x0 + i))
            out += source[row, np.clip(x0 + i, 0, w - 1)] * (wx * wy)[:, :, None]
    return np.where(inside[:, :, None], np.clip(np.floor(out + 0.5), 0, 255), 0).astype(np.uint8)


def augment(pixels: np.ndarray, config: ImageConfig, rng: np.random.Generator) -> np.ndarray:
    """Flips at even odds, a turn within +-rotation, brightness and contrast within their ranges."""
    if config.horizontal_flip and rng.random() < 0.5:
        pixels = pixels[:, ::-1]
    if config.vertical_flip and rng.random() < 0.5:
        pixels = pixels[::-1]
    if config.rotation:
        pixels = rotate(pixels, rng.uniform(-config.rotation, config.rotation))
    if config.brightness:
        pixels = np.clip(pixels * rng.uniform(*config.brightness), 0, 255).astype(np.uint8)
    if config.contrast:
        grey = float(np.floor((luminance(pixels) if pixels.shape[2] == 3 else pixels).mean() + 0.5))
        pixels = np.clip(grey + (pixels.astype(np.float64) - grey) * rng.uniform(*config.contrast), 0, 255).astype(np.uint8)
    return pixels


def normalize(pixels: np.ndarray, pixel_range: str, mean=None, std=None) -> np.ndarray:
    scale, shift = PIXEL_RANGES[pixel_range]
    out = pixels.astype(np.float32) / np.float32(scale) + np.float32(shift)
    return (out - np.array(mean, np.float32)) / np.array(std, np.float32) if mean and std else out


def process_one(data: bytes, config: ImageConfig, key: int = 0) -> np.ndarray:
    pixels = convert(decode(data), config.to_rgb, config.grayscale)
    if config.size:
        pixels = resize(pixels, *config.size, config.method, config.keep_aspect)
    out = augment(pixels, config, np.random.default_rng((config.seed, key & 0x7FFFFFFFFFFFFFFF)))
    out = normalize(out, config.pixel_range, config.mean, config.std) if config.normalize else out.astype(np.float32)
    return np.transpose(out, (2, 0, 1)) if config.layout == "chw" else out


def data_size(row: tuple) -> int:
    return 0 if row[1] is None else row[1].nbytes


def process(df: DataFrame, config: ImageConfig | None = None, content: str = "content", key: str = "id", out: str = "image") -> DataFrame:
    """Adds a struct of shape, data (row-major) and error; what can't be decoded has an error and no data. Random steps depend on the row's key, not on its partition."""
    config = config or ImageConfig()

    def one(data: bytes | None, k: int) -> tuple:
        try:
            pixels = process_one(data, config, k)
            return list(pixels.shape), pixels.ravel(), None
        except Exception as error:  # the row's own failure
            return None, None, str(error) or type(error).__name__

    run = row_udf(OUT, OUT_KIND, one, data_size)
    return df.withColumn(out, run(F.col(content), F.xxhash64(key)))


@arrow_udf("width int, height int, channels int")
def header(contents: pd.Series) -> pd.DataFrame:
    """Size of each image; nulls where it can't be decoded."""

    def one(data):
        try:
            h, w, c = decode(data).shape
        except Exception:  # the row's own failure
            return None, None, None
        return w, h, c

    return pd.DataFrame([one(d) for d in contents], columns=["width", "height", "channels"]).astype("Int32")


def is_valid(df: DataFrame, content: str = "content", out: str = "valid") -> DataFrame:
    return df.withColumn(out, header(F.col(content))["width"].isNotNull())


def statistics(df: DataFrame, content: str = "content") -> DataFrame:
    """One row: all images, and sizes and channel counts of those that can be decoded."""
    sized = df.select(header(F.col(content)).alias("h"))
    sizes = [F.coalesce(f(f"h.{c}"), F.lit(0)).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return sized.agg(F.count("*").alias("total_images"), *sizes, F.array_sort(F.collect_set("h.channels")).alias("channels"))


