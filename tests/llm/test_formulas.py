"""Audio features, the network's way forward and all secret rules, each against plain Python written from its definition."""

import math
import random
import re

import numpy as np
import pytest

from millrace.llm import audio_features as A
from millrace.llm import secret_scan, toxicity


def test_audio_features_by_definition():
    """Direct sums: a Kaiser-windowed sinc at every output, a Fourier sum at every bin, triangles in mel."""
    rng = random.Random(4)
    payload = bytes(rng.choices(b"some words of text \n" + bytes(range(256)), k=192 * 6))
    x = [(b - 128) / 128 for b in payload]
    taps = np.kaiser(2 * A.HALF + 1, 8.0)
    n_out = -(-len(x) * 2 // 3)

    def output(k):
        total = 0.0
        for i in range(max(0, (k * 3 - 30) // 2 - 1), min(len(x), (k * 3 + 30) // 2 + 2)):
            tap = k * 3 - i * 2
            if abs(tap) <= 30 and 0 <= k < n_out + 200:
                u = tap / 3
                total += x[i] * (1.0 if u == 0 else math.sin(math.pi * u) / (math.pi * u)) / 3 * taps[tap + 30] * 2
        return total

    frames = max(1, math.ceil((n_out - 256) / 128) + 1)
    signal = [output(k) for k in range((frames - 1) * 128 + 256)]
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    points = [700 * (10 ** ((mel(50) + (mel(4000) - mel(50)) * j / 25) / 2595) - 1) for j in range(26)]
    got_mel, got_energy = (np.concatenate(p) for p in zip(*A.frames_of(np.frombuffer(payload, np.uint8)), strict=True))
    assert len(got_mel) == frames
    wave = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    for f in range(frames):
        own = np.array(signal[f * 128 : f * 128 + 256])
        hann = np.array([0.5 - 0.5 * math.cos(2 * math.pi * t / 256) for t in range(256)])
        power = np.abs(wave @ (own * hann)) ** 2
        for m in range(24):
            a, b, c = points[m : m + 3]
            total = sum(power[k] * max(0.0, min((k * 31.25 - a) / (b - a), (c - k * 31.25) / (c - b))) for k in range(129))
            assert got_mel[f, m] == pytest.approx(math.log(total + 1e-6), abs=0.05)
        assert got_energy[f] == pytest.approx(10 * math.log10(np.mean(own**2) + 1e-10), abs=0.02)


def test_segments_by_definition():
    rng = random.Random(8)
    for _ in range(200):
        energy = [rng.choice([-30, -19, -18.5, -18, -17, -12]) for _ in range(rng.randrange(1, 30))]
        expected, begin = [], None
        for i, e in enumerate(energy):
            if begin is None and e >= A.BEGIN_DB:
                begin = i
            elif begin is not None and e < A.END_DB:
                expected.append((begin, i))
                begin = None
        if begin is not None:
            expected.append((begin, len(energy)))
        assert A.segments(np.array(energy)) == expected


def test_network_by_definition():
    """One window after another, one number after another."""
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(50)] + ["été", "x"]
    net = toxicity.Network.new({w: i + 1 for i, w in enumerate(words[:20])}, rng.normal(0, 1, 21).astype(np.float32), rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32))
    net.p = {k: rng.normal(0, 0.4, v.shape).astype(np.float32) for k, v in net.p.items()}
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 31, 32, 33, 90)] + ["", None]
    size, sigmoid = toxicity.STATE, lambda v: 1 / (1 + np.exp(-v))

    def inputs(word):
        tri, _ = toxicity.trigrams([word])
        own = net.p["own"][net.vocabulary.get(word, 0)]
        return np.concatenate([own, net.p["chars"][tri].mean(axis=0), net.p["heads"][toxicity.heads([word])[0]].mean(axis=0)])

    def states(xs, d):
        h, out = np.zeros(size), []
        for x in xs:
            wx, uh = x @ net.p[f"W{d}"] + net.p[f"b{d}"], h @ net.p[f"U{d}"]
            z, r = sigmoid(wx[:size] + uh[:size]), sigmoid(wx[size : 2 * size] + uh[size : 2 * size])
            h = z * h + (1 - z) * np.tanh(wx[2 * size :] + r * uh[2 * size :])
            out.append(h)
        return out

    def logit(ws):
        xs = [inputs(w) for w in ws]
        both = [np.concatenate(p) for p in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        scores = np.array([np.tanh(h @ net.p["A"]) @ net.p["v"] for h in both])
        weight = np.exp(scores - scores.max())
        return (weight / weight.sum()) @ np.array(both) @ net.p["u"] + net.p["c"][0]

    got = toxicity.Scorer(net).logits(texts)
    for text, g in zip(texts, got, strict=True):
        ws = re.findall(r"[^\W_]+", (text or "").lower())
        if ws:
            windows = [ws[s : s + toxicity.WINDOW] for s in range(0, max(1, len(ws) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)]
            assert g == pytest.approx(max(logit(w) for w in windows), abs=1e-3)
    assert got[-1] == got[-2] == pytest.approx(net.p["c"][0], abs=1e-5)


def test_all_secret_rules(spark):
    rng = random.Random(7)
    parts = ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "A1b2" * 6, "xoxb-" + "12-ab" * 5, "glpat-short", "eyJ" + "a" * 12 + "." + "B_-9" * 4 + "." + "z" * 10, "AKIA" + "Z9" * 9, "deadbeef" * 3, "Token = 'abcdefghijkl0'", "pass", "é", "\n", " ", "_", "-", "x"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(120)]
    rules = [(r.kind, re.compile(r.pattern, re.A), r.group, r.least) for r in secret_scan.RULES]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_versions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()}
    kinds = set()
    for i, text in enumerate(texts):
        spans = sorted((m.start(), n, kind, m.end()) for n, (kind, pattern, group, least) in enumerate(rules) for m in pattern.finditer(text) if len(m[group]) >= least)
        assert found[i] == [(kind, a, b) for a, _, kind, b in spans], text
        kinds |= {k for _, _, k, _ in spans}
    assert kinds == {r.kind for r in secret_scan.RULES}
