"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if some string of LENGTH bytes that covers it also starts
elsewhere. Sorting all suffixes of a large corpus is not needed for that:

* Every window of LENGTH bytes has an anchor, the leftmost of its least-hashed
  strings of GRAM bytes. Equal windows have equal anchors at equal places, so
  only windows whose anchor occurs more than once can repeat. Neighbouring
  windows with one anchor form a run, about one for each 80 bytes; runs are
  counted by anchor, and most drop out here.
* Runs of the other anchors go where their anchor goes, with all bytes of their
  windows. Equal ones that meet in a task on the way repeat as a whole; one of
  them goes on.
* There the suffixes that begin at the anchors are merge-sorted. Prefix
  polynomial hashes and a binary search over lengths give two suffixes' common
  extension in eight steps. Then bytes are compared: those that sorted
  neighbours are said to share, the next one, which must put them in order, and
  all of a window that is to count. If hashes have misled, bytes alone decide.
* An anchor in a great many surroundings (the border of a passage that everyone
  quotes) would gather too much in one task. Its runs are cut into pieces of
  CHUNK windows, which go where the bytes that all windows of a piece share
  go, and if these still gather too much, into single windows. The same sort
  takes them; only where it happens differs.

Rows are told apart by their id and two checksums of their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import BASE, CODES, mixed, powers, steps, text_bytes
from .common import discard, written

LENGTH, GRAM = 200, 40
#: Window starts of a long text that are hashed at a time.
PIECE = 1 << 21
#: What more rows than this would go to in one place is cut finer: runs into pieces of CHUNK windows, these into windows.
HOT, CHUNK = 2000, 16
#: Windows sorted at a time (whole anchors), and bytes of texts or surroundings that a task remembers to find equal ones.
SORTED, HELD = 1 << 19, 1 << 25
INVERSE = pow(BASE, -1, 1 << 64)


class Prefixes:
    """Prefix polynomial hashes of a byte array: the hash of any part in one step."""

    _powers = _inverses = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Prefixes._powers) < n + 1:
            Prefixes._powers = powers(n + 1)
            inverse = np.full(n + 1, INVERSE, dtype=np.uint64)
            inverse[0] = 1
            Prefixes._inverses = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(CODES[data] * Prefixes._powers[:n], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Hashes of all parts of a length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * Prefixes._inverses[:n] if n > 0 else np.zeros(0, dtype=np.uint64)

    def at(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * Prefixes._inverses[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass
class Runs:
    """Runs of windows with one anchor: text, first and last window (in the text), anchor, and where the text lies in data."""

    data: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    begin: np.ndarray
    grams: np.ndarray
    shift: int

    def surroundings(self, i: int) -> bytes:
        """All bytes of a run's windows."""
        at = int(self.begin[i] + self.first[i]) - self.shift
        return self.data[at : at + int(self.last[i] - self.first[i]) + LENGTH].tobytes()

    def place(self, i: int) -> int:
        """The anchor's place after the run's first window."""
        at = int(self.begin[i] + self.first[i]) - self.shift
        return int(np.argmax(self.grams[at : at + LENGTH - GRAM + 1] == self.anchor[i]))


def runs_of(data: np.ndarray, starts: np.ndarray, shift: int = 0) -> Runs:
    """Runs of texts that lie one after another in data. shift: data begins so many bytes into a single text."""
    grams = mixed(Prefixes(data).all(GRAM))
    long = np.flatnonzero(np.diff(starts) >= LENGTH)
    none = np.zeros(0, dtype=np.int64)
    if not len(long):
        return Runs(data, none, none, none, np.zeros(0, dtype=np.uint64), none, grams, shift)
    least = sliding_min(grams, LENGTH - GRAM + 1)
    turn = np.zeros(len(least) + 1, dtype=bool)
    turn[1:-1] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    turn[starts[long]] = True
    valid = np.zeros(len(least) + 1, dtype=np.int8)
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, starts[long + 1] - LENGTH + 1, -1)
    at = np.flatnonzero(turn[:-1] & (np.cumsum(valid[:-1]) > 0))
    text = np.searchsorted(starts, at, "right") - 1
    end = np.minimum(np.append(at[1:], len(data)) - 1, starts[text + 1] - LENGTH)
    begin = starts[text]
    return Runs(data, text, at - begin + shift, end - begin + shift, least[at], begin, grams, shift)


def pieces(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, Runs]]:
    """Runs of all texts, some at a time, and the number of the first text; a long text comes in pieces, each with the bytes that its last windows need."""
    for first, last in steps(starts, PIECE):
        own = data[starts[first] : starts[last]]
        if len(own) <= 2 * PIECE:
            yield first, runs_of(own, starts[first : last + 1] - starts[first])
        else:
            for shift in range(0, max(1, len(own) - LENGTH + 1), PIECE):
                part = own[shift : shift + PIECE + LENGTH - 1]
                yield first, runs_of(part, np.array([0, len(part)]), shift)


def lcp(p: Prefixes, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common extension of suffixes, up to `most` bytes, by binary search."""
    low, high = np.zeros(len(x), dtype=np.int64), most.astype(np.int64)
    for _ in range(LENGTH.bit_length()):
        middle = (low + high + 1) >> 1
        same = p.at(x, middle) == p.at(y, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


class Suffixes:
    """Suffixes by where they begin and how long they are (LENGTH at most); what ends sorts before what goes on."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.data, self.begin, self.length, self.p = data, begin, np.minimum(length, LENGTH), Prefixes(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return lcp(self.p, self.begin[x], self.begin[y], np.minimum(self.length[x], self.length[y]))

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; `ties` where they are equal."""
        common = self.common(x, y)
        over = common >= np.minimum(self.length[x], self.length[y])
        off = np.where(over, 0, common)
        by_end = np.where(self.length[x] == self.length[y], ties, self.length[x] < self.length[y])
        return np.where(over, by_end, self.data[self.begin[x] + off] < self.data[self.begin[y] + off])


def suffix_sort(suffixes: Suffixes, group: np.ndarray) -> np.ndarray:
    """Order of suffixes within their groups (in ascending order already): a merge sort of all groups at once.

    Runs of 1, 2, 4, ... suffixes merge in pairs: a suffix's place in the pair
    is its place in its own run and, by binary search, in the other.
    """
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(heads, len(group)))
    head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    order, width, most = np.arange(len(group)), 1, int(sizes.max())
    here = np.arange(len(group)) - head
    while width < most:
        live = np.flatnonzero(size > width)
        place = here[live]
        pair = place // (2 * width) * (2 * width)
        left = place - pair < width
        other = np.where(left, pair + width, pair)
        low = np.minimum(other, size[live])
        high = np.maximum(np.minimum(other + width, size[live]), low)
        base, mine = low.copy(), order[live]
        while len(i := np.flatnonzero(low < high)):
            middle = (low[i] + high[i]) >> 1
            theirs = order[head[live[i]] + middle]
            # From the left, equals stay first; from the right, after them.
            up = suffixes.before(theirs, mine[i], ~left[i])
            low[i] = np.where(up, middle + 1, low[i])
            high[i] = np.where(up, high[i], middle)
        to = np.where(left, place, pair + (place - pair - width)) + low - base
        moved = order.copy()
        moved[head[live] + to] = order[live]
        order, width = moved, width * 2
    return order


def repeated(contexts: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """Which windows of each (anchor number, anchor place, bytes) repeat among those of the same anchor. Anchors in ascending order.

    Equal surroundings are sorted once, and all their windows repeat. The
    suffixes that begin at the anchors are sorted within their anchor. A window
    that begins s bytes before its anchor equals another if both suffixes agree
    on LENGTH - s bytes, which neighbours in the sorted order do in stretches,
    and the s bytes before have one hash; then all bytes are compared.
    """
    classes: dict[tuple[int, int, bytes], int] = {}
    own = np.array([classes.setdefault(c, len(classes)) for c in contexts])
    times = np.bincount(own)
    anchor = np.array([a for a, _, _ in classes])
    rivals = np.bincount(anchor)[anchor] > 1
    kept = [c for c, wanted in zip(classes, rivals, strict=True) if wanted]
    alike = iter(_windows(kept) if kept else [])
    marked = [next(alike) if wanted else None for wanted in rivals]
    sizes = [len(c) - LENGTH + 1 for _, _, c in classes]
    found = [np.ones(n, dtype=bool) if t > 1 else m if m is not None else np.zeros(n, dtype=bool) for n, t, m in zip(sizes, times, marked, strict=True)]
    return [found[i] for i in own]


class Misled(Exception):
    """Hashes were equal where bytes are not."""


def sorted_as_shown(suffixes: Suffixes, order: np.ndarray, inner: np.ndarray, shared: np.ndarray) -> None:
    """Raises unless bytes prove the order: neighbours (order[inner - 1], order[inner]) share what they are said to, and differ in order after it."""
    x, y, n = order[inner - 1], order[inner], shared
    heads = np.cumsum(n) - n
    off = np.arange(int(n.sum())) - np.repeat(heads, n)
    data, begin, length = suffixes.data, suffixes.begin, suffixes.length
    if (data[np.repeat(begin[x], n) + off] != data[np.repeat(begin[y], n) + off]).any():
        raise Misled
    over = n >= np.minimum(length[x], length[y])
    at = np.where(over, 0, n)
    if not np.where(over, length[x] <= length[y], data[begin[x] + at] < data[begin[y] + at]).all():
        raise Misled


def _windows(classes: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The windows of distinct surroundings that repeat in others of their anchor."""
    try:
        return _by_sort(classes)
    except Misled:
        return _by_bytes(classes)


def _by_bytes(classes: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The same without hashes, one window after another."""
    count: dict[tuple[int, bytes], int] = {}
    for a, _, c in classes:
        for i in range(len(c) - LENGTH + 1):
            count[a, c[i : i + LENGTH]] = count.get((a, c[i : i + LENGTH]), 0) + 1
    return [np.array([count[a, c[i : i + LENGTH]] > 1 for i in range(len(c) - LENGTH + 1)]) for a, _, c in classes]


def _by_sort(classes: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    lengths = np.array([len(c) for _, _, c in classes])
    data = np.frombuffer(b"".join(c for _, _, c in classes), dtype=np.uint8)
    begin = np.cumsum(lengths) - lengths
    anchor, place = np.array([a for a, _, _ in classes]), np.array([p for _, p, _ in classes])
    suffixes = Suffixes(data, begin + place, lengths - place)
    order = suffix_sort(suffixes, anchor)
    anchor, place, begin, windows = anchor[order], place[order], begin[order], (lengths - LENGTH + 1)[order]
    # What each suffix shares with the one before in its anchor; nothing at an anchor's first.
    shared = np.full(len(order), -1, dtype=np.int64)
    inner = np.flatnonzero(anchor[1:] == anchor[:-1]) + 1
    shared[inner] = suffixes.common(order[inner], order[inner - 1])
    sorted_as_shown(suffixes, order, inner, shared[inner])
    hits: list[tuple[np.ndarray, np.ndarray, int]] = []
    for s in range(int(place.max()) + 1):
        have = np.flatnonzero((place >= s) & (place - s < windows))
        stretch = np.cumsum(shared < LENGTH - s)[have]
        have, stretch = _repeating(have, stretch)
        if not len(have):
            continue
        before = suffixes.p.at(begin[have] + place[have] - s, np.full(len(have), s))
        by = np.lexsort((before, stretch))
        same = (stretch[by][1:] == stretch[by][:-1]) & (before[by][1:] == before[by][:-1])
        a, b = have[by[:-1][same]], have[by[1:][same]]
        if len(a):
            hits.append((a, b, s))
    marks = [np.zeros(n, dtype=bool) for n in windows]
    for a, b, low, high in _pairs(hits):
        # Windows from s = high down to low lie one after another in both; bytes decide.
        n = high - low + LENGTH
        x, y = begin[a] + place[a] - high, begin[b] + place[b] - high
        if (data[x : x + n] != data[y : y + n]).any():
            raise Misled
        for i in (a, b):
            marks[i][place[i] - high : place[i] - low + 1] = True
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return [marks[i] for i in back]


def _repeating(have: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without those that are alone in their stretch."""
    if len(have) < 2:
        return have[:0], stretch[:0]
    same = stretch[1:] == stretch[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return have[keep], stretch[keep]


def _pairs(hits: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Neighbours (a, b) and the ranges of s over which they met without a gap."""
    if not hits:
        return
    a, b = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
    s = np.repeat([h[2] for h in hits], [len(h[0]) for h in hits])
    by = np.lexsort((s, b, a))
    a, b, s = a[by], b[by], s[by]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    yield from zip(a[first].tolist(), b[first].tolist(), s[first].tolist(), s[last].tolist(), strict=True)


def ranges_of(marked: np.ndarray, first: int) -> list[int]:
    """First and last of each stretch of marked windows, one after another."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))) + first
    turns[1::2] -= 1
    return turns.tolist()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (as it is, and as a string), text and two checksums of the text with different seeds; null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("string").alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))


def anchors(docs: DataFrame) -> DataFrame:
    """Anchors that occur more than once, and whether they are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, runs in pieces(*text_bytes(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(runs.anchor.view(np.int64))], names=["anchor"])

    counted = docs.select("text").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    return written(counted.where("n > 1").select("anchor", (F.col("n") > HOT).alias("hot")), "anchors")


class Recent:
    """Values by the bytes that they were met with lately, up to HELD bytes."""

    def __init__(self):
        self.met: dict = {}
        self.size = 0

    def find(self, key, data: bytes, value):
        """The value that these were met with; None the first time, when `value` is kept."""
        found = self.met.get((key, data))
        if found is None:
            if self.size > HELD:
                self.__init__()
            self.met[key, data] = value
            self.size += len(data) + 256
        return found


def occurrences(docs: DataFrame) -> DataFrame:
    """Anchor, text (its checksums) and number of every run; of equal texts that a task meets in a short time only the first has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Recent()
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            fresh = np.fromiter((met.find(None, t.as_py(), True) is None for t in column), dtype=bool, count=len(column))
            k1, k2 = (batch.column(i).to_numpy()[fresh] for i in (1, 2))
            count: dict[int, int] = {}
            for first, runs in pieces(*text_bytes(column.filter(pa.array(fresh)))):
                text = runs.text + first
                heads = np.searchsorted(text, text)
                nth = np.arange(len(text)) - heads
                if runs.shift:
                    nth += count[first]
                if len(text):
                    count[int(text[-1])] = int(nth[-1]) + 1
                elif not runs.shift:
                    count[first] = 0
                yield pa.RecordBatch.from_arrays([pa.array(runs.anchor.view(np.int64)), pa.array(k1[text]), pa.array(k2[text]), pa.array(nth.astype(np.int32))], names=["anchor", "k1", "k2", "nth"])

    return docs.select("text", "k1", "k2").mapInArrow(run, "anchor long, k1 long, k2 long, nth int")


FOUND = "id string, k1 long, k2 long, route long, at int, place int, bytes binary, ranges array<int>, kind string"
RANGES = "id string, k1 long, k2 long, ranges array<int>"
#: Kinds of rows: stretches that repeat; surroundings to be sorted; those of hot anchors, to be cut.
KNOWN, PLAIN, CUT = "known", "plain", "cut"


class _Out:
    """Rows to send on, a batch at a time. row: id, k1, k2 of a document."""

    KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.string())
    NAMES = ("id", "k1", "k2", "route", "at", "place", "bytes", "ranges", "kind")

    def __init__(self):
        self.rows: list[tuple] = []
        self.spans: dict[tuple, list[int]] = {}
        self.size = 0
        self.recent = Recent()

    def known(self, row: tuple, first: int, last: int) -> None:
        """A document's stretches go on as one row; those that touch are one."""
        own = self.spans.setdefault(row, [])
        if own and own[-2] <= first <= own[-1] + 1:
            own[-1] = max(own[-1], last)
        elif own and own[-2] <= last + 1 <= own[-1] + 1:
            own[-2] = min(own[-2], first)
        else:
            own += [first, last]

    def add(self, row: tuple, route: int, at: int, place: int, data: bytes, kind: str = PLAIN) -> None:
        """Surroundings that begin at `at`; all windows of equal ones repeat, and one of them goes on."""
        own = [row, at]
        first = self.recent.find((route, place), data, own)
        if first is None:
            self.rows.append((*row, route, at, place, data, None, kind))
            self.size += len(data)
            return
        for some in (first, own):
            if some:
                self.known(some[0], some[1], some[1] + len(data) - LENGTH)
        first.clear()  # it is known now

    def take(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) + len(self.spans) > least or self.size > least << 10:
            self.rows += [(*row, None, None, None, None, own, KNOWN) for row, own in self.spans.items()]
            self.spans = {}
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), self.KINDS, strict=True)], names=list(self.NAMES))
            self.rows, self.size = [], 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def surroundings(met: DataFrame) -> DataFrame:
    """Rows (FOUND) of texts with their runs whose anchors occur more than once. met: id, text, k1, k2, runs (nth and hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, texts = _Out(), Recent()
        for batch in batches:
            ids, k1s, k2s, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            data, starts = text_bytes(batch.column(1))
            for n, row in enumerate(zip(ids, k1s, k2s, strict=True)):
                own = data[starts[n] : starts[n + 1]]
                if len(own) < LENGTH:  # only if checksums collide
                    continue
                this = [row]
                first = texts.find(None, own.tobytes(), this)
                if first is not None:  # a whole copy
                    for some in (first, this):
                        if some:
                            out.known(some[0], 0, len(own) - LENGTH)
                    first.clear()
                    continue
                hot = {r["nth"]: r["hot"] for r in wanted[n].as_py()}
                total = 0
                for _, runs in pieces(own, np.array([0, len(own)])):
                    for i in range(len(runs.text)):
                        kind = hot.get(total + i)
                        if kind is not None:
                            out.add(row, _signed(int(runs.anchor[i])), int(runs.first[i]), runs.place(i), runs.surroundings(i), CUT if kind else PLAIN)
                    total += len(runs.text)
                yield from out.take(4000)
        yield from out.take()

    return met.select("id", "text", "k1", "k2", "runs").mapInArrow(run, FOUND)


def cut_finer(found: DataFrame) -> DataFrame:
    """Surroundings cut into pieces of `chunk` windows at most, by how far these begin before the anchor; where chunk is null they stay whole.

    A piece goes where the bytes go that all such windows share: from the
    beginning of the nearest to the end of the farthest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for batch in batches:
            for i, k1, k2, route, at, place, data, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (i, k1, k2)
                if chunk is None:
                    out.add(row, route, at, place, data)
                    continue
                low = place - (len(data) - LENGTH)  # windows begin from `place` down to `low` bytes before the anchor
                for near in range(low // chunk * chunk, place + 1, chunk):
                    far = near + chunk - 1
                    first, last = place - min(far, place), place - max(near, low)
                    to = xxhash.xxh3_64_intdigest(data[place - near : place - far + LENGTH], near)
                    out.add(row, _signed(to), at + first, place - first, data[first : last + LENGTH])
            yield from out.take(4000)
        yield from out.take()

    return found.select("id", "k1", "k2", "route", "at", "place", "bytes", "chunk").mapInArrow(run, FOUND)


def stretches(found: DataFrame) -> DataFrame:
    """Stretches of windows that repeat (RANGES). found: surroundings, those of a route together and sorted by it."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting: list[tuple] = []  # id, k1, k2, route, at, place, bytes

        def sort() -> None:
            numbers: dict[int, int] = {}
            named = [(numbers.setdefault(w[3], len(numbers)), w[5], w[6]) for w in waiting]
            for (i, k1, k2, _, at, _, _), marked in zip(waiting, repeated(named), strict=True):
                if marked.any():
                    out.append((i, k1, k2, ranges_of(marked, at)))
            waiting.clear()

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORTED and waiting[-1][3] != row[3]:
                    sort()
                    size = 0
                waiting.append(row)
                size += len(row[6]) - LENGTH + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "k1", "k2", "ranges"])
                out.clear()
        if waiting:
            sort()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "k1", "k2", "ranges"])

    return found.select("id", "k1", "k2", "route", "at", "place", "bytes").mapInArrow(run, RANGES)


def cut(met: DataFrame, id_col: str, id_type: str) -> DataFrame:
    """Removes what the stretches cover. met: own, text, ranges (arrays of arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(1).cast(pa.large_binary()), batch.column(2)
            rows, first, size = [], 0, 0
            for i in range(len(texts)):
                text = texts[i].as_py()
                n, own, spans = len(text), ranges[i].as_py(), []
                if own:
                    cover = np.zeros(n + 1, dtype=np.int32)
                    flat = np.array([x for r in own for x in r], dtype=np.int64).reshape(-1, 2)
                    np.add.at(cover, flat[:, 0], 1)
                    np.add.at(cover, flat[:, 1] + LENGTH, -1)
                    spans = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0])))).tolist()
                kept = b"".join(text[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], n], strict=True))
                rows.append((n, n - len(kept), spans, kept))
                size += n
                if size > 1 << 22 or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True))], names=[id_col, "n_bytes", "n_removed", "spans", "kept"])
                    rows, first, size = [], i + 1, 0

    return met.select("own", "text", "ranges").mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_removed long, spans array<long>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte that a string of 200 bytes covers which also starts elsewhere, in the same or another document.

    Returns one row per input row: id_col, n_bytes, n_removed, spans (first and
    end of each maximal removed stretch, one after another), kept (the other
    bytes; a cut may split a character).

    Null texts are empty; texts under 200 bytes stay; equal texts of 200 bytes
    or more go as a whole, all copies; rows with equal ids or none are told
    apart by their texts; extra columns are ignored; an empty table gives no
    rows.
    """
    rows = keyed(docs, id_col, text_col)
    kinds = anchors(rows)
    runs = occurrences(rows).join(kinds, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("nth", "hot")).alias("runs"))
    found = written(surroundings(rows.join(runs.hint("shuffle_hash"), ["k1", "k2"])), "surroundings")
    discard(kinds)
    plain, known = found.where(F.col("kind") == PLAIN), found.where(F.col("kind") == KNOWN)
    hot = found.where(F.col("kind") == CUT)
    if hot.limit(1).count():
        cuts = written(cut_finer(hot.withColumn("chunk", F.lit(CHUNK))), "pieces")
        some = cuts.where(F.col("kind") == PLAIN)
        # Written, so that its size is known: one row for each HOT of `some` at most.
        much = written(some.groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("route", F.lit(1).alias("chunk")), "much")
        finer = written(cut_finer(some.join(much, "route", "left")), "windows")
        plain = plain.unionByName(finer.where(F.col("kind") == PLAIN))
        known = known.unionByName(cuts.where(F.col("kind") == KNOWN)).unionByName(finer.where(F.col("kind") == KNOWN))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = stretches(plain.repartition(parts, "route").sortWithinPartitions("route"))
    ranges = known.select("id", "k1", "k2", "ranges").unionByName(sorted_rows)
    ranges = ranges.groupBy(F.col("id").alias("r_id"), F.col("k1").alias("r_k1"), F.col("k2").alias("r_k2")).agg(F.collect_set("ranges").alias("ranges"))
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("k1") == F.col("r_k1")) & (F.col("k2") == F.col("r_k2"))
    return cut(rows.join(ranges.hint("shuffle_hash"), same, "left"), id_col, docs.schema[id_col].dataType.simpleString())
