"""Queries over media whose answer SQL can state: solid pictures, constant and sine signals, still videos."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.arrow import row_udf
from ..operators import audio, images, video
from ..session import spread, table
from .registry import query


def _made(spark, sf_dir, one):
    """A file for each vector; `one` makes it of the vector's id."""

    made = row_udf("binary", pa.binary(), one, len)
    return spread(table(spark, sf_dir, "embeddings")).select("vec_id", F.col("vec_id").alias("id"), made(F.col("vec_id")).alias("content"))


def solid(i: int) -> bytes:
    """A grey picture of 1 to 40 by 1 to 23 pixels, in colour where the id is even; every 11th is broken."""
    if i % 11 == 0:
        return b"\x89PNG broken"
    return images.encode_png(np.full((1 + i % 23, 1 + i % 40, 1 if i % 2 else 3), 10 + i % 200, dtype=np.uint8))


SOLID = """
WITH s AS (SELECT vec_id, 1 + vec_id % 40 AS w, 1 + vec_id % 23 AS h, 10 + vec_id % 200 AS v, vec_id % 11 = 0 AS broken FROM embeddings),
f AS (SELECT *, CASE WHEN w::DOUBLE / h > 16::DOUBLE / 12 THEN 16 ELSE greatest(1, CAST(trunc(12 * (w::DOUBLE / h)) AS INT)) END AS nw, CASE WHEN w::DOUBLE / h > 16::DOUBLE / 12 THEN greatest(1, CAST(trunc(16 / (w::DOUBLE / h)) AS INT)) ELSE 12 END AS nh FROM s)"""


def _facts(df, column):
    total = F.round(F.aggregate(f"{column}.data", F.lit(0.0), lambda a, x: a + x.cast("double")), 2)
    return df.select("vec_id", F.array_join(F.col(f"{column}.shape").cast("array<string>"), "x").alias("shape"), total.alias("total"))


@query(SOLID + " SELECT vec_id, CASE WHEN NOT broken THEN '12x16x3' END AS shape, CASE WHEN NOT broken THEN round(nw * nh * 3 * v, 2)::DOUBLE END AS total FROM f")
def image_letterbox(spark, sf_dir):
    config = images.ImageConfig(size=(16, 12), method="lanczos", keep_aspect=True, normalize=False)
    return _facts(images.process(_made(spark, sf_dir, solid), config), "image")


@query(SOLID + " SELECT vec_id, CASE WHEN broken THEN NULL WHEN vec_id % 2 = 0 THEN '1x6x5' ELSE '3x6x5' END AS shape, CASE WHEN broken THEN NULL ELSE round(CASE WHEN vec_id % 2 = 0 THEN 30 ELSE 90 END * v, 2)::DOUBLE END AS total FROM f")
def image_colour_and_flips(spark, sf_dir):
    """RGB becomes grey, grey becomes RGB; flips keep what a picture adds up to."""
    config = images.ImageConfig(size=(5, 6), grayscale=True, normalize=False, horizontal_flip=True, vertical_flip=True, layout="chw")
    return _facts(images.process(_made(spark, sf_dir, solid), config), "image")


@query(SOLID + " SELECT vec_id, CASE WHEN NOT broken THEN '4x4x3' END AS shape, CASE WHEN NOT broken THEN (48 * trunc(v * 0.5))::DOUBLE END AS total FROM f")
def image_brightness(spark, sf_dir):
    config = images.ImageConfig(size=(4, 4), method="nearest", normalize=False, brightness=(0.5, 0.5), contrast=(1.0, 1.0))
    return _facts(images.process(_made(spark, sf_dir, solid), config), "image")


@query(SOLID + " SELECT vec_id, NOT broken AS valid, CASE WHEN NOT broken THEN CAST(w AS INT) END AS width, CASE WHEN NOT broken THEN CAST(h AS INT) END AS height FROM f")
def image_valid(spark, sf_dir):
    found = images.is_valid(_made(spark, sf_dir, solid)).withColumn("h", images.header(F.col("content")))
    return found.select("vec_id", "valid", "h.width", "h.height")


@query(SOLID + " SELECT count(*) AS total_images, round(avg(w) FILTER (NOT broken), 6) AS avg_width, CAST(min(w) FILTER (NOT broken) AS INT) AS min_width, CAST(max(w) FILTER (NOT broken) AS INT) AS max_width, round(avg(h) FILTER (NOT broken), 6) AS avg_height, CAST(min(h) FILTER (NOT broken) AS INT) AS min_height, CAST(max(h) FILTER (NOT broken) AS INT) AS max_height, '1,3' AS channels FROM f")
def image_sizes(spark, sf_dir):
    found = images.statistics(_made(spark, sf_dir, solid)).withColumn("channels", F.array_join(F.col("channels").cast("array<string>"), ","))
    return found.withColumn("avg_width", F.round("avg_width", 6)).withColumn("avg_height", F.round("avg_height", 6))


def tone(i: int) -> bytes:
    """A constant stereo signal of 1000 to 1399 samples at 8 kHz with 500 silent samples at both ends; every 11th is broken."""
    if i % 11 == 0:
        return b"RIFF"
    body = np.concatenate([np.zeros(500), np.full(1000 + i % 400, 0.5), np.zeros(500)])
    return audio.encode_wav(np.stack([body, body / 2]), 8000)


@query("SELECT vec_id, vec_id % 11 <> 0 AS valid, CAST(CASE WHEN vec_id % 11 <> 0 THEN 2000 + vec_id % 400 END AS BIGINT) AS samples, CASE WHEN vec_id % 11 <> 0 THEN 8000 END AS sample_rate, CASE WHEN vec_id % 11 <> 0 THEN 2 END AS channels FROM embeddings")
def audio_valid(spark, sf_dir):
    found = _made(spark, sf_dir, tone).withColumn("h", audio.header(F.col("content")))
    return found.select("vec_id", F.col("h.samples").isNotNull().alias("valid"), "h.samples", "h.sample_rate", "h.channels")


def _lengths(df):
    """Shapes and peaks only: a resampled edge rings."""
    return df.select("vec_id", F.array_join(F.col("audio.shape").cast("array<string>"), "x").alias("shape"), F.round(F.array_max("audio.data").cast("double"), 3).alias("peak"))


@query("SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN CAST(2 * (2000 + vec_id % 400) AS VARCHAR) END AS shape, CASE WHEN vec_id % 11 <> 0 THEN 0.8::DOUBLE END AS peak FROM embeddings")
def audio_resampled(spark, sf_dir):
    config = audio.AudioConfig(sample_rate=16_000, trim_silence=False, feature="raw", level=0.8)
    return _lengths(audio.process(_made(spark, sf_dir, tone), config))


@query("SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN '1x4000' END AS shape, CASE WHEN vec_id % 11 <> 0 THEN 1.0::DOUBLE END AS peak FROM embeddings")
def audio_fixed_duration(spark, sf_dir):
    config = audio.AudioConfig(sample_rate=8000, trim_silence=False, duration=0.5, feature="raw", layout="tensor")
    return _lengths(audio.process(_made(spark, sf_dir, tone), config))


@query("SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN CAST(floor((2000 + vec_id % 400) * 2 / 256) + 1 AS BIGINT) END AS frames FROM embeddings")
def audio_frames(spark, sf_dir):
    """All features have a column for each hop."""
    base = _made(spark, sf_dir, tone)
    for feature in ("spectrogram", "mel", "mfcc"):
        config = audio.AudioConfig(sample_rate=16_000, trim_silence=False, feature=feature, n_fft=512, hop=256, n_mels=20, n_mfcc=13)
        base = audio.process(base, config, out=feature)
    same = (F.col("spectrogram.shape")[1] == F.col("mel.shape")[1]) & (F.col("mel.shape")[1] == F.col("mfcc.shape")[1]) & (F.col("spectrogram.shape")[0] == 257) & (F.col("mel.shape")[0] == 20) & (F.col("mfcc.shape")[0] == 13)
    return base.select("vec_id", F.when(same, F.col("mel.shape")[1].cast("long")).alias("frames"))


@query("SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN true END AS trimmed FROM embeddings")
def audio_trimmed(spark, sf_dir):
    """Frames reach 1024 samples beyond the sound, so that no sample of it goes, and never beyond the recording."""
    found = audio.process(_made(spark, sf_dir, tone), audio.AudioConfig(sample_rate=8000, feature="raw"))
    n = F.col("audio.shape")[0]
    kept = F.aggregate("audio.data", F.lit(0), lambda a, x: a + (x > 0.99).cast("int"))
    return found.select("vec_id", ((n <= 2000 + F.col("vec_id") % 400) & (kept == 1000 + F.col("vec_id") % 400)).alias("trimmed"))


@query("SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN 'mel,mfcc,rms,spectral_centroid,spectrogram,zcr' END AS features, CASE WHEN vec_id % 11 <> 0 THEN true END AS as_wanted FROM embeddings")
def audio_all_features(spark, sf_dir):
    """Six features of a constant: nothing crosses zero, the centroid is low, the loudest frame is the constant's."""

    @F.pandas_udf("features string, as_wanted boolean")
    def six(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            try:
                samples, rate = audio.decode(data)
            except Exception:  # the row's own failure
                rows.append((None, None))
                continue
            found = audio.all_features(np.tile(samples[0][500:-500], 3), rate)
            rows.append((",".join(sorted(found)), bool(found["zcr"].max() == 0 and found["spectral_centroid"].min() < 200 and abs(found["rms"].max() - 0.5) < 0.01)))
        return pd.DataFrame(rows, columns=["features", "as_wanted"])

    return _made(spark, sf_dir, tone).withColumn("six", six(F.col("content"))).select("vec_id", "six.features", "six.as_wanted")


def still(i: int) -> bytes:
    """A grey video of 2 to 9 frames of 6 x 4 at 10 frames a second; every 11th is broken."""
    if i % 11 == 0:
        return b"YUV4MPEG2 W6 H4 F10:1 C444\nFRAME\n"
    return video.encode_y4m(np.full((2 + i % 8, 4, 6, 3), 10 + i % 200, dtype=np.uint8), 10)


@query("SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN '3x' || least(5, 2 + vec_id % 8) || 'x2x2' END AS shape, CASE WHEN vec_id % 11 <> 0 THEN (12 * least(5, 2 + vec_id % 8) * (10 + vec_id % 200))::DOUBLE END AS total FROM embeddings")
def video_tensor(spark, sf_dir):
    config = video.VideoConfig(max_frames=5, size=(2, 2), layout="cthw", normalize=False)
    return _facts(video.process(_made(spark, sf_dir, still), config), "video")


@query("SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN (2 + vec_id % 8) || 'x8x8x1' END AS shape, CASE WHEN vec_id % 11 <> 0 THEN ((2 + vec_id % 8) * 40 * (10 + vec_id % 200))::DOUBLE END AS total FROM embeddings")
def video_grey_letterbox(spark, sf_dir):
    """6 x 4 fits 8 x 8 as 8 x 5."""
    config = video.VideoConfig(selection="all", size=(8, 8), keep_aspect=True, to_rgb=False, grayscale=True, normalize=False)
    return _facts(video.process(_made(spark, sf_dir, still), config), "video")


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 11 <> 0 THEN least(4, 2 + vec_id % 8) ELSE 0 END AS BIGINT) AS n, CASE WHEN vec_id % 11 <> 0 THEN least(4, 2 + vec_id % 8) * 72 * (10 + vec_id % 200) END AS total FROM embeddings")
def video_clip_frames(spark, sf_dir):
    """Drawn from the first 0.6 seconds."""
    made = _made(spark, sf_dir, still)
    frames = video.extract_frames(made.select("id", "content"), video.VideoConfig(max_frames=4, selection="random", clip_seconds=0.6))
    pixels = F.aggregate(F.transform(F.sequence(F.lit(1), F.octet_length("pixels")), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    found = frames.where("frame < 6").groupBy("id").agg(F.count("*").alias("n"), F.sum(pixels).alias("total"))
    return made.select("vec_id").join(found, F.col("vec_id") == F.col("id"), "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n"), "total")


@query("SELECT count(*) AS total_videos, round(avg((2 + vec_id % 8) / 10.0::DOUBLE) FILTER (vec_id % 11 <> 0), 6) AS avg_duration, 0.2::DOUBLE AS min_duration, 0.9::DOUBLE AS max_duration, 10.0::DOUBLE AS avg_fps, '6x4' AS resolutions FROM embeddings")
def video_statistics(spark, sf_dir):
    found = video.statistics(_made(spark, sf_dir, still)).withColumn("resolutions", F.array_join("resolutions", ","))
    return found.withColumn("avg_duration", F.round("avg_duration", 6))


@query("SELECT vec_id, vec_id % 11 <> 0 AS valid, CASE WHEN vec_id % 11 <> 0 THEN CAST(2 + vec_id % 8 AS INT) END AS frames, CASE WHEN vec_id % 11 <> 0 THEN 10.0::DOUBLE END AS fps FROM embeddings")
def video_valid(spark, sf_dir):
    found = _made(spark, sf_dir, still).withColumn("h", video.header(F.col("content")))
    return found.select("vec_id", F.col("h.error").isNull().alias("valid"), "h.frames", "h.fps")
