"""The toxicity query against a plain loop over all windows, word by word, with the network that the labels give."""

import math
import zlib

import numpy as np

from millrace.llm import queries, toxicity
from millrace.llm.bytetext import mixed

SF = "/root/testdata/sf0.001"


def input_of(word, net):
    """A word's own vector, the mean of its trigrams' and the mean of its beginnings'."""
    data = b"\x02" + word.encode() + b"\x03"
    parts = [net.p["chars"][int(mixed(np.uint64([data[i] << 16 | data[i + 1] << 8 | data[i + 2]]))[0]) % toxicity.BUCKETS] for i in range(len(data) - 2)]
    begins = [net.p["heads"][zlib.crc32(word[:n].encode()) % toxicity.BUCKETS] for n in toxicity.HEADS]
    return np.concatenate([net.p["own"][net.vocabulary.get(word, 0)], np.mean(parts, axis=0), np.mean(begins, axis=0)]).astype(np.float64)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def states(inputs, net, d):
    size, h, out = toxicity.STATE, np.zeros(toxicity.STATE), []
    w, u, b = (net.p[f"{k}{d}"].astype(np.float64) for k in "WUb")
    for x in inputs if d == "f" else inputs[::-1]:
        p, g = x @ w + b, h @ u
        z, r = sigmoid(p[:size] + g[:size]), sigmoid(p[size : 2 * size] + g[size : 2 * size])
        n = np.tanh(p[2 * size :] + r * g[2 * size :])
        h = z * h + (1 - z) * n
        out.append(h)
    return out if d == "f" else out[::-1]


def logit(inputs, net):
    if not inputs:  # a window without words: states stay 0
        return float(net.p["c"][0])
    h = [np.concatenate(pair) for pair in zip(states(inputs, net, "f"), states(inputs, net, "b"), strict=True)]
    weight = np.array([np.tanh(x @ net.p["A"]) @ net.p["v"] for x in h])
    weight = np.exp(weight - weight.max())
    return float(sum(w * x for w, x in zip(weight / weight.sum(), h, strict=True)) @ net.p["u"] + net.p["c"][0])


def test_whole_query(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in queries.op6_toxicity(spark, SF).collect()}
    known, windows = {}, 0
    rows = docs.select("doc_id", "text").collect()
    assert found.keys() == {r.doc_id for r in rows}
    for r in rows:
        words = toxicity.WORD.findall((r.text or "").lower())
        known |= {w: input_of(w, net) for w in set(words) - known.keys()}
        inputs = [known[w] for w in words]
        best, at = -math.inf, 0
        while True:
            best = max(best, logit(inputs[at : at + toxicity.WINDOW], net))
            windows += 1
            if at + toxicity.WINDOW >= len(words):
                break
            at += toxicity.STRIDE
        score = sigmoid(best)
        assert abs(found[r.doc_id].score - score) < 1e-3
        if abs(score - 0.5) > 1e-3:
            assert found[r.doc_id].predicted == (score >= 0.5)
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert windows > len(rows)
