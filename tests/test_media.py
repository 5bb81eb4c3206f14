"""Media by analytic signals and round trips."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrow, tensor
from millrace.operators import audio, images, video

RATE = 16_000
SINE = (0.5 * np.sin(2 * np.pi * 440 * np.arange(2 * RATE) / RATE)).astype(np.float32)


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        pixels = rng.integers(0, 256, (7, 5, channels), dtype=np.uint8)
        assert (images.decode(images.encode_png(pixels)) == pixels).all()
    assert images.decode(b"P5 2 1 255\n\x01\x02").tolist() == [[[1], [2]]]


def test_resize_keeps_constants_and_letterboxes():
    grey = np.full((40, 20, 3), 77, dtype=np.uint8)
    for method in images.FILTERS:
        assert (images.resize(grey, 9, 13, method) == 77).all()
    boxed = images.resize(grey, 30, 30, keep_aspect=True)
    assert (boxed[:, 7:22] == 77).all() and not boxed[:, :7].any() and not boxed[:, 22:].any()


def test_letterbox_sizes():
    assert images.fitted(1, 71, 224, 224) == (3, 224) and images.fitted(800, 600, 224, 224) == (224, 168)
    assert images.fitted(5000, 1, 224, 224) == (224, 1)


def test_rotation():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (9, 9, 3), dtype=np.uint8)
    assert (images.rotate(pixels, 0) == pixels).all()
    assert (images.rotate(pixels, 90) == np.rot90(pixels)).all() and (images.rotate(pixels, 180) == pixels[::-1, ::-1]).all()
    grey = np.full((40, 40, 3), 77, dtype=np.uint8)
    turned = images.rotate(grey, 30)
    assert (turned[12:28, 12:28] == 77).all() and not turned[0, 0].any()


def test_pixels_can_stay_as_they_are(spark):
    from millrace.plans import config

    df = spark.createDataFrame([(1, images.encode_png(np.full((4, 4, 3), 200, dtype=np.uint8)))], "id int, content binary")
    kept = config.image_config({"normalize_pixels": False, "target_size": [2, 2], "mean": [0.5] * 3, "std": [0.5] * 3})
    assert set(images.process(df, kept).first().image.data) == {200.0}
    assert not config.video_config({"normalize_pixels": False}).normalize and config.video_config({}).normalize


def test_colour_rules():
    rgb, grey = np.full((2, 2, 3), 100, np.uint8), np.full((2, 2, 1), 9, np.uint8)
    assert images.convert(rgb, True, True).shape == (2, 2, 1)
    assert images.convert(grey, True, True).shape == (2, 2, 3)


def test_image_operator(spark):
    png = images.encode_png(np.full((600, 800, 3), 255, dtype=np.uint8))
    df = spark.createDataFrame([(1, png), (2, b"broken"), (3, None)], "id int, content binary")
    rows = {r.id: r.image for r in images.process(df).collect()}
    assert rows[1].shape == [224, 224, 3] and max(rows[1].data) == 1.0
    assert rows[2].data is None and rows[2].error and rows[3].error
    stats = images.statistics(df).first()
    assert (stats.total_images, stats.max_width, stats.channels) == (3, 800, [3])
    assert [r.valid for r in images.is_valid(df).orderBy("id").collect()] == [True, False, False]
    config = images.ImageConfig(size=(8, 8), horizontal_flip=True, rotation=15, brightness=(0.8, 1.2), contrast=(0.8, 1.2), layout="chw", seed=5)
    twice = [images.process(df.repartition(n), config).where("id = 1").first().image for n in (1, 3)]
    assert twice[0] == twice[1] and twice[0].shape == [3, 8, 8]
    with pytest.raises(ValueError):
        images.ImageConfig(pixel_range="other")


def test_resampling_keeps_a_tone():
    for target in (8000, 22_050, 44_100):
        out = audio.resample(SINE, RATE, target)
        want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(len(out)) / target)
        assert np.abs(out - want)[target // 10 : -target // 10].max() < 0.01


def test_levels_and_lengths():
    assert np.abs(audio.normalize(SINE, "peak")).max() == pytest.approx(1)
    assert np.sqrt(np.mean(audio.normalize(SINE, "rms", 0.1) ** 2)) == pytest.approx(0.1, rel=1e-4)
    silence = np.zeros(1000, np.float32)
    assert (audio.normalize(silence, "rms") == 0).all() and len(audio.trim(silence)) == 0
    assert len(audio.fix_duration(SINE, 3.0, RATE)) == 3 * RATE and len(audio.fix_duration(SINE, 1.0, RATE)) == RATE
    padded = np.concatenate([np.zeros(RATE, np.float32), SINE, np.zeros(RATE, np.float32)])
    assert abs(len(audio.trim(padded)) - len(SINE)) < 4096


def test_features_of_a_tone():
    magnitude = np.abs(audio.stft(SINE))
    assert abs(magnitude.mean(axis=1).argmax() * RATE / 2048 - 440) < RATE / 2048
    assert audio.feature(SINE, RATE, audio.AudioConfig(n_mels=80)).shape == (80, 1 + len(SINE) // 512)
    assert audio.mfcc(SINE, RATE, 13).shape[0] == 13
    six = audio.all_features(SINE, RATE)
    assert set(six) == {"spectrogram", "mel", "mfcc", "zcr", "spectral_centroid", "rms"}
    middle = six["rms"].shape[1] // 2
    assert six["rms"][0, middle] == pytest.approx(0.5 / np.sqrt(2), rel=0.01)
    assert six["zcr"][0, middle] == pytest.approx(2 * 440 / RATE, rel=0.05)
    assert six["spectral_centroid"][0, middle] == pytest.approx(440, rel=0.05)


def test_stretch_and_pitch():
    assert len(audio.time_stretch(SINE, 2.0)) == len(SINE) // 2
    up = audio.pitch_shift(SINE, RATE, 12)
    assert len(up) == len(SINE)
    assert abs(np.abs(audio.stft(up)).mean(axis=1).argmax() * RATE / 2048 - 880) < 20


def test_audio_operator(spark):
    stereo = audio.encode_wav(np.stack([SINE, SINE]), RATE)
    df = spark.createDataFrame([(1, stereo), (2, b"mp3?")], "id int, content binary")
    rows = {r.id: r.audio for r in audio.process(df, audio.AudioConfig(n_mels=80)).collect()}
    assert rows[1].shape[0] == 80 and rows[2].error
    raw = audio.process(df, audio.AudioConfig(feature="raw", layout="tensor", trim_silence=False)).first().audio
    assert raw.shape == [1, 2 * RATE]
    stats = audio.statistics(df).first()
    assert (stats.total_audio, stats.avg_duration, stats.sample_rates) == (2, 2.0, [RATE])


def test_frame_selection(spark):
    def chosen(total, n, how="uniform", **kwargs):
        df = spark.createDataFrame([("v", total, 10.0)], "id string, frames int, fps double")
        return video.select_frames(df, video.VideoConfig(max_frames=n, selection=how, **kwargs)).first().indices

    assert chosen(30, 22) == [int(i * (30 / 22)) for i in range(22)]
    assert chosen(30, 3, clip_seconds=1.0) == [0, 3, 6]
    assert chosen(5, 3, "all") == [0, 1, 2, 3, 4] and chosen(0, 3) == []
    drawn = chosen(30, 5, "random")
    assert drawn == sorted(set(drawn)) and len(drawn) == 5 and drawn == chosen(30, 5, "random")
    assert drawn != chosen(30, 5, "random", seed=1)


def test_video_operator(spark):
    frames = np.zeros((6, 8, 8, 3), np.uint8)
    frames[3:] = 255
    data = video.encode_y4m(frames)
    assert np.abs(video.decode(data)[0].astype(int) - frames).max() <= 1
    df = spark.createDataFrame([(1, data), (2, b"mp4?")], "id int, content binary")
    rows = {r.id: r.video for r in video.process(df, video.VideoConfig(max_frames=4, size=(4, 4), layout="cthw")).collect()}
    assert rows[1].shape == [3, 4, 4, 4] and rows[2].error
    taken = video.extract_frames(df, video.VideoConfig(max_frames=3)).orderBy("frame").collect()
    assert [(r.id, r.frame) for r in taken] == [(1, 0), (1, 2), (1, 4)]
    grey = spark.createDataFrame([(1, i, [int(frames[i].mean())] * 4) for i in range(6)], "id int, frame int, grey array<int>")
    assert [r.frame for r in video.keyframes(grey).orderBy("frame").collect()] == [0, 3]
    stats = video.statistics(df).first()
    assert (stats.total_videos, stats.avg_fps, stats.resolutions) == (2, 25.0, ["8x8"])


def test_tensor_functions(spark):
    df = spark.createDataFrame([([0.0, -2.0, 1.0, 0.0],)], "v array<float>")
    assert df.select(tensor.zero_crossings(F.col("v"))).first()[0] == 2
    assert df.select(tensor.normalize_amplitude(F.col("v"))).first()[0] == [0.0, -1.0, 0.5, 0.0]
    assert df.select(tensor.normalize_amplitude(F.col("v"), "other")).first()[0] == [0.0, -2.0, 1.0, 0.0]
    assert df.select(tensor.mean_channel(F.col("v"), 2)).first()[0] == [-1.0, 0.5]
    with pytest.raises(ValueError):
        tensor.normalize_pixels(F.col("v"), "other")


def test_results_of_a_batch_go_back_in_parts():
    """A batch of many rows is never held with all that it becomes."""
    batch = pa.array([b"x"] * 1000)
    made = lambda data: ([1000], np.zeros(100_000, np.float32), None)
    parts = list(arrow.in_parts((batch,), made, images.data_size, images.OUT_KIND))
    assert sum(map(len, parts)) == 1000 and max(p.nbytes for p in parts) < 2 * arrow.HELD


def test_rows_of_several_parts(spark):
    """Rows keep their own results where these go back in parts, failures and nulls among them."""
    run = arrow.row_udf("binary", pa.binary(), lambda i: None if i % 7 == 0 else bytes(1 << 20) + str(i).encode(), lambda x: len(x or b""))
    found = {r.id: r.tail for r in spark.range(100).coalesce(1).withColumn("made", run(F.col("id"))).select("id", F.expr("CAST(substring(made, 1048577) AS STRING)").alias("tail")).collect()}
    assert found == {i: None if i % 7 == 0 else str(i) for i in range(100)}
