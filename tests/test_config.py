import numpy as np
import pytest

from millrace.operators import audio, images
from millrace.plans import config as C

PROFILE = """
text: {enabled: true, max_length: 512, add_special_tokens: true}
image: {enabled: true, mean: [0.5, 0.5, 0.5], std: [0.2, 0.2, 0.2], horizontal_flip: true, augment: false}
audio: {enabled: false}
video: {enabled: true, max_frames: 16, output_format: tensor}
pipeline: {error_handling: log}
quality: {min_text_chars: 3, max_text_chars: 5, min_image_size: [4, 4], max_image_size: [8, 8], min_audio_duration: 0.1, max_audio_duration: 1.0}
"""


def test_profiles(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "p.yaml"
    path.write_text(PROFILE)
    profile = C.load_profile(str(path))
    made = C.pipeline_config(profile)
    assert made.text.max_length == 512 and made.text.special_tokens and made.error_handling == "log"
    assert made.image.std == (0.2, 0.2, 0.2) and not made.image.horizontal_flip
    assert made.audio is None and made.video.layout == "cthw"
    default = C.pipeline_config({})
    assert default.text and default.image and default.audio is None and default.video is None

    limits = C.quality_limits(profile)
    texts = spark.createDataFrame([("ab",), ("abc",), ("abcdef",), (None,)], "text string")
    assert [r.text for r in C.within_limits(texts, limits, "text").collect()] == ["abc"]
    pixels = [images.encode_png(np.zeros((h, w, 3), np.uint8)) for h, w in ((4, 4), (3, 4), (8, 9))] + [b"bad"]
    assert C.within_limits(spark.createDataFrame([(p,) for p in pixels], "content binary"), limits, "image").count() == 1
    sounds = [audio.encode_wav(np.zeros(n), 1000) for n in (50, 500, 5000)]
    assert C.within_limits(spark.createDataFrame([(s,) for s in sounds], "content binary"), limits, "audio").count() == 1
