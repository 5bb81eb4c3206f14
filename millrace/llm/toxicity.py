"""Toxicity by a bidirectional gated recurrent network with attention pooling.

The network reads windows of words. A word comes in twice: as itself, if the
training rows have it often enough, and by its characters: the mean of its
trigrams and the mean of its beginnings of 4 to 7 characters. Windows overlap and cover the whole text; a text is as toxic as its most toxic
window. Labels are known for texts only, so training takes each text's most
toxic window so far and, as a start, the one whose words lean most to toxic
texts.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import mixed

WORD = re.compile(r"[^\W_]+")
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 24
#: Sizes: a word's own vector, that of its trigrams and of its beginnings each, a direction's state, attention, and buckets of character runs.
OWN, CHARS, STATE, ATTEND, BUCKETS = 8, 8, 12, 8, 1 << 15
#: Lengths of the beginnings.
HEADS = (4, 5, 6, 7)
#: Training reads at most so many labelled texts of each class, those of the smallest digests of their ids.
SAMPLE = 2500
#: Words with vectors of their own: in at least 3 training texts, and the most frequent of these.
LEAST_TEXTS, VOCABULARY = 3, 30_000
#: Passes, windows of a batch (fewer when there are few texts, for enough steps), and the rate.
EPOCHS, BATCH, RATE = 10, (32, 256), 0.01
#: Windows scored at a time, and words whose inputs a scorer keeps.
SCORED, KEPT = 2048, 100_000
#: Folds: rows of fold 0 are held out.
FOLDS = 5


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all words, one after another, and where each word's begin."""
    coded = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(c) for c in coded])
    starts = np.cumsum(lengths) - lengths
    codes = data.copy()
    codes[:-2] = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    inside = np.ones(len(data), dtype=bool)
    inside[starts + lengths - 1] = inside[starts + lengths - 2] = False
    return (mixed(codes[inside]) % np.uint64(BUCKETS)).astype(np.int64), np.cumsum(lengths - 2) - (lengths - 2)


def heads(words: list[str]) -> np.ndarray:
    """Buckets of each word's beginnings; of a shorter word, its whole."""
    return np.array([[zlib.crc32(w[:n].encode()) % BUCKETS for n in HEADS] for w in words], dtype=np.int64).reshape(-1, len(HEADS))


def characters(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """trigrams() and heads() of many words, some at a time to keep memory low."""
    tri, starts, begin, total = [], [], [], 0
    for at in range(0, len(words), step):
        t, s = trigrams(words[at : at + step])
        tri.append(t.astype(np.int32))
        starts.append(s + total)
        begin.append(heads(words[at : at + step]).astype(np.int32))
        total += len(t)
    return np.concatenate(tri), np.concatenate(starts), np.concatenate(begin)


def window_starts(n: int) -> range:
    """Where windows begin; the last one reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


@dataclass
class Network:
    """Parameters by name, and the words with vectors of their own (0: none)."""

    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]

    @classmethod
    def new(cls, vocabulary: dict[str, int], lean: np.ndarray, head_lean: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        size, wide = OWN + 2 * CHARS, 2 * STATE
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        p = {"own": draw(len(vocabulary) + 1, OWN, scale=0.05), "chars": draw(BUCKETS, CHARS, scale=0.05), "heads": draw(BUCKETS, CHARS, scale=0.05)}
        p["own"][:, 0], p["heads"][:, 0] = lean, head_lean
        for d in "fb":
            p |= {f"W{d}": draw(size, 3 * STATE, scale=size**-0.5), f"U{d}": draw(STATE, 3 * STATE, scale=STATE**-0.5), f"b{d}": np.zeros(3 * STATE, np.float32)}
        p |= {"A": draw(wide, ATTEND, scale=wide**-0.5), "v": draw(ATTEND, scale=0.3), "u": draw(wide, scale=wide**-0.5), "c": np.full(1, -1.0, np.float32)}
        return cls(p, vocabulary)

    def inputs(self, own: np.ndarray, tri: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(starts, len(tri)))
        chars = np.add.reduceat(self.p["chars"][tri], starts, axis=0) / counts[:, None]
        return np.concatenate([self.p["own"][own], chars.astype(np.float32), self.p["heads"][begin].mean(axis=1)], axis=1)

    def direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States over time of projected inputs x (time, windows, 3 * STATE). mask: 1 where there is a word; elsewhere the state stays."""
        h = np.zeros((x.shape[1], STATE), np.float32)
        out, kept = np.empty((x.shape[0], x.shape[1], STATE), np.float32), []
        weights = self.p[f"U{d}"]
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            g = h @ weights
            zr = 0.5 + 0.5 * np.tanh(0.5 * (x[t, :, : 2 * STATE] + g[:, : 2 * STATE]))
            z, r, inner = zr[:, :STATE], zr[:, STATE:], g[:, 2 * STATE :]
            n = np.tanh(x[t, :, 2 * STATE :] + r * inner)
            move = (1 - z) * mask[t][:, None]
            if keep:
                kept.append((t, h, z, r, n, inner, move))
            h = h + move * (n - h)
            out[t] = h
        return out, kept

    def forward(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows, and what the way back needs."""
        hf, kf = self.direction("f", xf, mask, keep)
        hb, kb = self.direction("b", xb, mask, keep)
        h = np.concatenate([hf, hb], axis=2)
        a = np.tanh(h @ self.p["A"])
        s = a @ self.p["v"] + np.where(mask > 0, np.float32(0), np.float32(-1e4))
        e = np.exp(s - s.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tw,twh->wh", alpha, h)
        return pooled @ self.p["u"] + self.p["c"][0], (h, a, alpha, pooled, kf, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, delta: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients by name, and of the inputs x (time, windows, OWN + 2 * CHARS). delta: of the logits."""
        h, a, alpha, pooled, kf, kb = kept
        g = {"u": delta @ pooled, "c": np.array([delta.sum()], np.float32)}
        dpool = delta[:, None] * self.p["u"]
        dh = alpha[:, :, None] * dpool
        dalpha = np.einsum("wh,twh->tw", dpool, h)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tw,twa->a", ds, a)
        da = ds[:, :, None] * self.p["v"] * (1 - a * a)
        g["A"] = np.einsum("twh,twa->ha", h, da)
        dh = dh + da @ self.p["A"].T
        dx = np.zeros_like(x)
        for d, steps, part in (("f", kf, dh[:, :, :STATE]), ("b", kb, dh[:, :, STATE:])):
            w, u = self.p[f"W{d}"], self.p[f"U{d}"]
            gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * STATE, np.float32)
            back = np.zeros((x.shape[1], STATE), np.float32)
            for t, before, z, r, n, inner, move in reversed(steps):
                back = back + part[t]
                dn = back * move * (1 - n * n)
                dz = -back * (n - before) * mask[t][:, None] * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                dp = np.concatenate([dz, dr, dn], axis=1)
                gu += before.T @ dg
                gw += x[t].T @ dp
                gb += dp.sum(axis=0)
                dx[t] += dp @ w.T
                back = back * (1 - move) + dg @ u.T
            g |= {f"W{d}": gw, f"U{d}": gu, f"b{d}": gb}
        return g, dx


class _Ids(dict):
    """Numbers words as they are first seen."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (in the texts one after another) and text of every window."""
    begins = np.cumsum(lengths) - lengths
    first, owner = [], []
    for i, n in enumerate(lengths):
        own = np.array(window_starts(int(n)))
        first.append(begins[i] + own)
        owner.append(np.full(len(own), i))
    return np.concatenate(first), np.concatenate(owner)


class Scorer:
    """Scores texts; inputs of words that it has met are kept, up to KEPT words."""

    def __init__(self, network: Network):
        self.network, self.ids = network, _Ids()
        self.table = {d: np.zeros((1024, 3 * STATE), np.float32) for d in "fb"}

    def _learn(self) -> None:
        new, net = self.ids.new, self.network
        if not new:
            return
        own = np.array([net.vocabulary.get(w, 0) for w in new])
        x = net.inputs(own, *characters(new))
        for d in "fb":
            rows, at = self.table[d], len(self.ids) - len(new)
            if len(rows) < len(self.ids):
                self.table[d] = rows = np.concatenate([rows, np.zeros((max(len(rows), len(self.ids) - len(rows)), 3 * STATE), np.float32)])
            rows[at : len(self.ids)] = x @ net.p[f"W{d}"] + net.p[f"b{d}"]
        self.ids.new = []

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest logit of each text's windows; a text without words has one window without words."""
        if len(self.ids) > KEPT:
            self.__init__(self.network)
        words = [WORD.findall((t or "").lower()) for t in texts]
        flat = np.fromiter((self.ids[w] for ws in words for w in ws), dtype=np.int64)
        self._learn()
        lengths = np.array([len(w) for w in words])
        first, owner = windows_of(lengths)
        ends = np.cumsum(lengths)[owner]
        best = np.full(len(texts), -np.inf)
        flat = np.append(flat, 0)
        for at in range(0, len(first), SCORED):
            place = first[at : at + SCORED] + np.arange(WINDOW)[:, None]
            mask = place < ends[at : at + SCORED]
            ids = np.where(mask, flat[np.minimum(place, len(flat) - 1)], 0)
            found, _ = self.network.forward(self.table["f"][ids], self.table["b"][ids], mask.astype(np.float32))
            np.maximum.at(best, owner[at : at + SCORED], found)
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64), -40, 40)))


def summed(to: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by where they go."""
    return np.stack([np.bincount(to, rows[:, k], n) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network fitted to labelled texts. The same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    # A word is kept once; texts are numbers from here on.
    ids = _Ids()
    read_texts = [np.fromiter((ids[w] for w in WORD.findall((t or "").lower())), dtype=np.int32) for t in texts]
    del texts
    if not len(ids):
        return Network.new({}, np.zeros(1, np.float32), np.zeros(BUCKETS, np.float32), seed)
    tri, starts, begin = characters(ids.new)
    counts = np.diff(np.append(starts, len(tri)))
    seen, by_head = np.zeros((2, len(ids))), np.zeros((2, BUCKETS))
    for numbers, label in zip(read_texts, y, strict=True):
        own = np.unique(numbers)
        seen[int(label > 0), own] += 1
        by_head[int(label > 0), np.unique(begin[own])] += 1
    clean, toxic = seen
    often = (clean + toxic).astype(np.int64)
    chosen = sorted(np.flatnonzero(often >= LEAST_TEXTS).tolist(), key=lambda i: (-often[i], ids.new[i]))[:VOCABULARY]
    vocabulary = {ids.new[n]: i + 1 for i, n in enumerate(chosen)}
    n1, n0 = max(1.0, float(y.sum())), max(1.0, float(len(y) - y.sum()))

    def leaning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How much more often in toxic texts, in logarithms; nearer to nothing the fewer texts there are."""
        return np.clip((np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))) * (a + b) / (a + b + 4) / 2, -2, 2).astype(np.float32)

    lean = np.append(np.float32(0), leaning(toxic[chosen], clean[chosen]))
    head_lean = leaning(by_head[1], by_head[0])
    net = Network.new(vocabulary, lean, head_lean, seed)
    own = np.zeros(len(ids), dtype=np.int64)
    own[chosen] = np.arange(1, len(chosen) + 1)
    lengths = np.array([len(t) for t in read_texts])
    flat = np.append(np.concatenate(read_texts), np.int32(0))
    del read_texts, clean, toxic, seen, often, ids

    def looked_up(unique: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of some words, of which `known` are themselves, and their trigrams."""
        firsts = np.cumsum(counts[unique]) - counts[unique]
        parts = tri[np.repeat(starts[unique] - firsts, counts[unique]) + np.arange(counts[unique].sum())]
        return net.inputs(known, parts, firsts, begin[unique]), parts

    first, owner = windows_of(lengths)
    ends = np.cumsum(lengths)[owner]

    def read(some: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of some windows, and where there are words. All windows at once would take too much memory."""
        place = first[some][:, None] + np.arange(WINDOW)
        mask = place < ends[some][:, None]
        return np.where(mask, flat[np.minimum(place, len(flat) - 1)], np.int32(0)), mask

    start = np.maximum(lean[own], head_lean[begin].mean(axis=1))
    logit = np.empty(len(first), dtype=start.dtype)  # to begin with: the two words that lean most
    for at in range(0, len(first), SCORED):
        grid, mask = read(slice(at, at + SCORED))
        logit[at : at + SCORED] = np.sort(start[grid] * mask, axis=1)[:, -2:].sum(axis=1)
    balance = np.where(y > 0, min(4.0, n0 / n1), 1.0).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    bounds = np.searchsorted(owner, np.arange(len(lengths) + 1))
    for epoch in range(epochs):
        if epoch % 2:  # the windows that count are chosen anew every other time
            scored = []
            for at in range(0, len(first), SCORED):
                grid, mask = read(slice(at, at + SCORED))
                unique, inverse = np.unique(grid.T, return_inverse=True)
                x, _ = looked_up(unique, own[unique])
                inverse, m = inverse.reshape(WINDOW, -1), mask.T.astype(np.float32)
                scored.append(net.forward((x @ net.p["Wf"] + net.p["bf"])[inverse], (x @ net.p["Wb"] + net.p["bb"])[inverse], m)[0])
            logit = np.concatenate(scored)
        top = np.array([bounds[i] + int(np.argmax(logit[bounds[i] : bounds[i + 1]])) for i in range(len(lengths))])
        other = np.array([rng.integers(bounds[i], bounds[i + 1]) for i in range(len(lengths)) if not y[i]], dtype=np.int64)
        picked = rng.permutation(np.concatenate([top, other]))
        batch = min(max(BATCH[0], len(picked) // 24), BATCH[1])
        for at in range(0, len(picked), batch):
            rows = picked[at : at + batch]
            grid, mask = read(rows)
            g, m = grid.T, mask.T.astype(np.float32)
            unique, inverse = np.unique(g, return_inverse=True)
            inverse = inverse.reshape(g.shape)
            known = np.where(rng.random(len(unique)) < 0.1, 0, own[unique])  # now and then a word is known by its characters only
            x, parts = looked_up(unique, known)
            x = x[inverse]
            logits, kept = net.forward(x @ net.p["Wf"] + net.p["bf"], x @ net.p["Wb"] + net.p["bb"], m, keep=True)
            chance = 1 / (1 + np.exp(-logits))
            delta = ((chance - y[owner[rows]]) * balance[owner[rows]] / len(rows)).astype(np.float32)
            grads, dx = net.gradients(x, m, delta, kept)
            du = summed(inverse.ravel(), dx.reshape(-1, OWN + 2 * CHARS), len(unique))
            grads["own"] = summed(known, du[:, :OWN], len(net.p["own"]))
            grads["chars"] = summed(parts, np.repeat(du[:, OWN : OWN + CHARS] / counts[unique][:, None], counts[unique], axis=0), BUCKETS)
            grads["heads"] = summed(begin[unique].ravel(), np.repeat(du[:, OWN + CHARS :] / len(HEADS), len(HEADS), axis=0), BUCKETS)
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in net.p.items():
                a, b = moments[k]
                a += 0.1 * (grads[k] - a)
                b += 0.001 * (grads[k] * grads[k] - b)
                v -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Network:
    """Trains on at most `sample` labelled texts of each class outside the held-out fold, in one task of an executor. Of several texts of an id one is read, that of the least checksum."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0)).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    place = F.xxhash64(F.col(id_col).cast("string"))
    parts = [known.where(F.col("__label") == label).orderBy(place, id_col).limit(sample) for label in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample rows of two numbers at most
    rows = docs.select(id_col, text_col).join(picked, id_col).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col("__label").cast("int").alias("label"))
    # However many rows an id has, one of them goes on from each task, and one from all.
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("place"), "text")).alias("one")).select("id", "one.text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({(i, t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        found.sort(key=lambda r: zlib.crc32(r[0].encode()))
        net = train([t for _, t, _ in found], [y for _, _, y in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.p, net.vocabulary))], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return Network(*pickle.loads(made[0].model)) if made else train([], [])


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", out: str = "score", keep: bool = False) -> DataFrame:
    """id_col and the score (0 to 1) of every row; with keep all columns of docs besides.

    Null and empty texts are scored as a window without words, texts of any
    length by all their windows, equal texts alike.
    """
    names = docs.columns if keep else [id_col, text_col]
    kept = [n for n in names if keep or n != text_col]
    frozen = docs.sparkSession.sparkContext.broadcast(pickle.dumps((network.p, network.vocabulary)))  # at most VOCABULARY words
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*pickle.loads(frozen.value)))
        for batch in batches:
            texts = batch.column(names.index(text_col))
            sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts, first = np.cumsum(sizes) // (1 << 20), 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(cuts, cuts[first], "right")))
                found = scorer.scores(texts.slice(first, last - first).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)).slice(first, last - first) for n in kept), pa.array(found)], names=[*kept, out])
                first = last

    return docs.select(*names).mapInArrow(run, f"{kinds}, `{out}` double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Learns from labels and scores every document.

    Returns one row per input row: id_col, held_out (crc32 of the id mod 5 is 0:
    its label is never read), score, predicted (1 from 0.5 on). Null labels and
    labels without a document are ignored, of several labels of an id the
    largest counts; a null id is held out. Without labels scores come from an
    untrained network. Extra columns are ignored, empty tables give no rows.
    """
    network = fit(docs, labels, id_col, text_col, label_col, sample)
    return score(docs, network, id_col, text_col).select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """docs, with all columns, without the rows that score 0.5 or more; texts are not shuffled."""
    scored = score(docs, fit(docs, labels, id_col, text_col, label_col, sample), id_col, text_col, out="__mr_score", keep=True)
    return scored.where("__mr_score < 0.5").select(*docs.columns)
