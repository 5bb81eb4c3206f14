"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import audio_features, decontaminate, line_dedup, mixing, secret_scan, sharding, simhash, suffix_dedup, toxicity, url_filter

from .test_near_duplicates import brute_force

LONG = "some words and more words go on and on here " * 30_000
CLASH = ("id", "size", "slot", "shard", "score", "fingerprint", "text_key", "line", "pos", "key", "blob", "spans", "k1", "n", "copies", "b1", "virtual_slot", "held_out", "site", "label", "count", "value")
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "a"),
    (1, "one two three four five six seven eight nine ten eleven", "a"),
    (2, None, "a"),
    (None, "one two three four five six seven eight nine ten eleven", None),
    (None, None, None),
    (3, "", "b"),
    (4, " \n\t ", ""),
    (5, LONG, "b"),
    (6, LONG, None),
    (7, "Ünïcödé ☃ \U0001f600 text, password = 'abcdefghijklmnop' here", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "two three four five six seven eight nine ten eleven"), (2, "snow MAN"), (3, None), (4, "..."), (None, "one two"), (5, "ünïcödé"), (5, "ÜNÏCÖDÉ")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("item", F.lit("x"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (1, None), (2, 1), (7, 1), (99, 1), (None, 1)], "doc_id long, toxic int").withColumn("label", F.lit("x"))


OPERATORS = {
    "decontaminate": lambda d, b, l: decontaminate.decontaminate(d, b),
    "simhash": lambda d, b, l: simhash.near_duplicates(d),
    "line_dedup": lambda d, b, l: line_dedup.remove_boilerplate(d),
    "audio": lambda d, b, l: audio_features.audio_features(d),
    "toxicity": lambda d, b, l: toxicity.toxicity(d, l),
    "secrets": lambda d, b, l: secret_scan.scan_versions(d, ["doc_id"]),
    "sharding": lambda d, b, l: sharding.shard(d),
    "suffixes": lambda d, b, l: suffix_dedup.remove_repeats(d),
    "mixing": lambda d, b, l: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, benchmark, labels, name):
    found = OPERATORS[name](docs, benchmark, labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, benchmark, labels, name):
    none = F.lit(False)
    assert OPERATORS[name](docs.where(none), benchmark.where(none), labels.where(none)).collect() == []


@pytest.mark.parametrize("name", ["decontaminate", "toxicity"])
def test_empty_other_table(docs, benchmark, labels, name):
    assert len(OPERATORS[name](docs, benchmark.where(F.lit(False)), labels.where(F.lit(False))).collect()) == len(ROWS)


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.where("doc_id IS NOT NULL").collect()}


def test_decontamination(docs, benchmark):
    found = by_id(decontaminate.decontaminate(docs, benchmark), "n_words", "n_hit", "items")
    # Only A-Z are lower-cased: "ÜNÏCÖDÉ" as an item stays another word. The item without an id hits "one two" and has no name.
    assert found == {1: (11, 11, ["1"]), 2: (0, 0, []), 3: (0, 0, []), 4: (0, 0, []), 5: (300_000, 0, []), 6: (300_000, 0, []), 7: (7, 0, [])}
    blocks = decontaminate.decontaminate(docs, benchmark, block=1)
    assert by_id(blocks, "n_words", "n_hit", "items") == found and blocks.count() == len(ROWS)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "6", "7", "None"]


def test_simhash_groups(docs):
    found = by_id(simhash.near_duplicates(docs), "component_id")
    assert found[1] == (1,) and found[2] == found[3] == found[4] == (2,) and found[5] == found[6] == (5,)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7]


def test_close_pairs_are_all_found(spark):
    import random

    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(60)} | {0, (1 << 64) - 1, 3, 2, 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    for distance in (0, 1, 2):
        pairs = {(r.a, r.b) for r in simhash.close_pairs(nodes, distance).collect()}
        assert pairs == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance}
    with pytest.raises(ValueError):
        simhash.close_pairs(nodes, 3)


def test_components_of_chains(spark):
    from millrace.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (100, 101), (7, 3)], "a long, b long")
    found = {r.node: r.label for r in components(links).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_line_removal(spark):
    rows = [(i, f"own line {i}\n  shared  \n\nlast", f"s{i % 9}") for i in range(9)] + [(50, "shared", None), (51, "shared", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(1))
    found = by_id(line_dedup.remove_boilerplate(docs, min_sites=9), "n_lines", "n_removed", "kept")
    assert found[0] == (4, 2, "own line 0\n") and found[50] == (1, 1, "")
    assert by_id(line_dedup.remove_boilerplate(docs, min_sites=10), "n_removed")[0] == (1,)
    assert by_id(line_dedup.remove_boilerplate(docs, min_sites=11), "n_removed")[0] == (0,)


def test_many_lines_and_many_secrets_take_no_square(spark):
    """1e5 lines of which half go, and 1e5 secrets in one text: seconds, where a square would take minutes."""
    import time

    begin = time.perf_counter()
    lines = "\n".join(f"shared {i}" if i % 2 else f"own {i}" for i in range(100_000))
    docs = spark.createDataFrame([(d, lines.replace("own", f"own {d}"), f"s{d}") for d in range(4)], "doc_id long, text string, source string")
    found = by_id(line_dedup.remove_boilerplate(docs, min_sites=4), "n_lines", "n_removed", "kept")
    assert found[3][:2] == (100_000, 50_000) and found[3][2] == "\n".join(f"own 3 {i}" for i in range(0, 100_000, 2))
    text = "token=abcdefghijkl é\n" * 100_000
    spans = secret_scan.scan_versions(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first().spans
    assert [(s.start, s.end) for s in spans] == [(21 * i, 21 * i + 18) for i in range(100_000)]
    assert time.perf_counter() - begin < 60


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?q#f", "https://example.net?en/", "http://sub.net/", "http://net", "https://x.example.com/de/1", "http://fr.org/fr/", None, "", "no scheme", "http://m.free-bets.example.org/en/1", "://e.net/a", "http://éxample.org/ü#://net/", "http:///path"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert found == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        1: ("example.net", "", None, "allow"),
        2: ("sub.net", "/", "net/", "block"),
        3: ("net", "", None, "allow"),
        4: ("x.example.com", "/de/1", "example.com/de/", "block"),
        5: ("fr.org", "/fr/", "org/fr/", "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("m.free-bets.example.org", "/en/1", None, "block"),
        10: ("e.net", "/a", "net/", "block"),
        11: ("éxample.org", "/ü", None, "allow"),
        12: ("", "/path", None, "allow"),
    }
    assert url_filter.filter_urls(pages.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("way", [{}, {"PART_BYTES": 64}, {"LIST_BYTES": 0}], ids=str)
def test_blocklists_in_ranges_and_by_join(spark, monkeypatch, way):
    for name, value in way.items():
        monkeypatch.setattr(url_filter, name, value)
    entries = [f"h{i}.com/" for i in range(40)] + ["h7.com/x/", "x.h8.com/", "é.org/ü", "com/long/", None, "h7.com/"]
    urls = [f"http://h{i}.com/" for i in range(50)] + ["http://a.h7.com/x/y", "http://x.h8.com/", "http://é.org/üb", "http://z.com/long/" + "p" * 100_000, None, "h7.com/", "http://h7.com/x/", "http://h7.com/x/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("entry", F.lit("x")).withColumn("listed", F.lit("y"))
    found = {r.page_id: (r.listed, r.verdict) for r in url_filter.filter_urls(pages, blocked=spark.createDataFrame([(e,) for e in entries], "entry string"), rules=()).collect()}
    wanted = {i: (f"h{i}.com/", "block") if i < 40 else (None, "allow") for i in range(50)}
    wanted |= {50: ("h7.com/x/", "block"), 51: ("x.h8.com/", "block"), 52: ("é.org/ü", "block"), 53: ("com/long/", "block"), 54: (None, "allow"), 55: (None, "allow"), 56: ("h7.com/x/", "block"), 57: ("h7.com/x/", "block")}
    assert found == wanted
    nothing = url_filter.filter_urls(pages, blocked=spark.createDataFrame([], "entry string"), rules=()).collect()
    assert len(nothing) == len(urls) and {r.verdict for r in nothing} == {"allow"}


def test_digest_collisions_are_told_apart():
    packed = url_filter.DigestArray(url_filter.pack([("a.com/", 1), ("b.com/", 0), ("c.com/x/", 1)]))
    import numpy as np

    key = packed.keys[0]
    assert packed.find([packed.entry(0), b"other"], np.array([key, key], dtype=np.uint64)).tolist() == [0, -1]


def test_audio_round_trip(docs):
    found = by_id(audio_features.audio_features(docs), "n_bytes", "payload_bytes", "payload_sha256", "n_frames")
    assert found[2][:2] == (0, 192) and found[2][2] == hashlib.sha256(b" " * 192).hexdigest()
    data = LONG.encode()
    assert found[5][:2] == (len(data), -(-len(data) // 192) * 192) and found[5] == found[6]
    stored = audio_features.audio_features(docs).where("doc_id = 7").first().tensors
    tensors = audio_features.read_tensors(stored)
    assert tensors.column("tensor").chunk(0).to_numpy_ndarray().shape[1:] == audio_features.SHAPE
    assert tensors.column("end_s")[0].as_py() > tensors.column("begin_s")[0].as_py()


def test_audio_blocks_and_hysteresis():
    import numpy as np

    samples = np.frombuffer((LONG * 2).encode(), dtype=np.uint8)
    whole = list(audio_features.frames_of(samples))
    assert len(whole) > 1
    block = audio_features.BLOCK
    try:
        audio_features.BLOCK = 1 << 20
        once = list(audio_features.frames_of(samples))
    finally:
        audio_features.BLOCK = block
    assert np.allclose(np.concatenate([m for m, _ in whole]), once[0][0], atol=1 / 32)
    assert audio_features.segments(np.array([-30, -16, -18, -18, -19, -16, -18]), -17, -18.5) == [(1, 4), (5, 7)]
    assert audio_features.segments(np.array([-18, -18]), -17, -18.5) == []


def test_resampler_keeps_tones():
    import numpy as np

    t = np.arange(12_000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / 12_000)).round().astype(np.uint8)
    out = audio_features.resample(tone, 0, 500)
    assert abs(np.abs(np.fft.rfft(out)).argmax() - 1000) <= 1


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([("p", 1, "token = abcdefghijklmnop"), ("q", 1, "plain"), ("r", 1, None)], "path string, version int, text string")
    scan = lambda df, **k: {(r.path, r.version): [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_versions(df, ["path", "version"], ledger=ledger, **k).collect()}
    assert scan(first) == {("p", 1): [("assign", 0, 24)], ("q", 1): [], ("r", 1): []}
    assert spark.read.parquet(ledger).count() == 3
    second = first.union(spark.createDataFrame([("s", 2, "token = abcdefghijklmnop"), ("q", 2, "AKIA" + "A" * 16)], first.schema))
    assert scan(second)[("s", 2)] == [("assign", 0, 24)]
    assert spark.read.parquet(ledger).count() == 4  # one new blob
    newer = (*secret_scan.RULES, secret_scan.Rule("word", "plain"))
    assert scan(second, rules=newer)[("q", 1)] == [("word", 0, 5)]
    rows = spark.read.parquet(ledger).collect()
    assert len(rows) == 8 and sum(r.rules == ["word@1"] for r in rows) == 4  # the new rule only, on all blobs


def test_secret_spans_count_code_points(docs):
    spans = secret_scan.scan_versions(docs, ["doc_id"]).where("doc_id = 7").first().spans
    text = ROWS[-1][1]
    start = text.index("password")
    assert [(s.kind, s.start, s.end) for s in spans] == [("assign", start, text.index("' here"))]


def test_shards(docs, spark, tmp_path):
    rows = sharding.shard(docs, shards=3).collect()
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.doc_id: r.text_crc32 for r in rows}[7] == zlib.crc32(ROWS[-1][1].encode())
    folder = f"file://{tmp_path}/maps"
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    before = {r.doc_id: r.shard for r in sharding.shard(many, 10, folder=folder).collect()}
    again = {r.doc_id: r.shard for r in sharding.shard(many, 10, folder=folder).collect()}
    assert before == again and sharding.load_map(spark, folder)["version"] == 3
    grown = {r.doc_id: r.shard for r in sharding.shard(many, 11, folder=folder).collect()}
    moved = sum(before[i] != grown[i] for i in before)
    assert 0 < moved < 3000 * 0.25  # not everything is dealt anew
    assert sharding.load_map(spark, folder, 1)["slots"] == [s % 10 for s in range(sharding.SLOTS)]


def test_suffix_sort_is_a_sort():
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000, dtype=np.uint8)
    begin = rng.choice(3900, 500)
    group = np.sort(rng.integers(0, 9, 500))
    length = np.minimum(len(data) - begin, 150)
    order = suffix_dedup.suffix_sort(suffix_dedup.Suffixes(data, begin, length), group)
    assert (group[order] == group).all()
    for g in range(9):
        own = [data[begin[i] : begin[i] + length[i]].tobytes() for i in order[group == g]]
        assert own == sorted(own)


def test_equal_rows_spread_over_shards(spark):
    rows = [(7, "same " * 20)] * 20_000 + [(None, "none")] * 3000 + [(i, "w" * (i % 200)) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    loads, slots = {}, {}
    for r in sharding.shard(docs, 40).collect():
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(loads.values()) / 40
    assert len(loads) == 40 and max(loads.values()) - mean <= 300 and mean - min(loads.values()) <= 300
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_stored_map_keeps_its_slots(spark, tmp_path):
    folder = f"file://{tmp_path}/maps"
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    before = {r.doc_id: r.shard for r in sharding.shard(docs, 5, slots=64, folder=folder).collect()}
    assert {r.doc_id: r.shard for r in sharding.shard(docs, 5, folder=folder).collect()} == before
    assert len(sharding.load_map(spark, folder)["slots"]) == 64


def test_mix_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 4] if i % 10 else "a") for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        size, target, taken = by.get(r.source, (r.source_size, r.target, 0))
        by[r.source] = (size, target, taken + r.taken)
    total = sum(s for s, _, _ in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * total)
    for size, target, taken in by.values():
        assert abs(taken - target) <= 7 and target <= 2 * size + 1e-6
    weights = {"a": 3, "b": 1, "c": 2, None: 3}
    level = max(t / weights[s] for s, (_, t, _) in by.items())
    for s, (size, target, _) in by.items():
        assert target == pytest.approx(min(2 * size, level * weights[s]))
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    larger = {r.doc_id: r.copies for r in mixing.mix(docs, share=1.8).collect()}
    assert all(larger[r.doc_id] >= r.copies for r in rows)  # budgets nest


def test_mix_of_rows_without_ids_and_of_equal_rows(spark):
    rows = [(i if i % 2 else None, "w " * (1 + i % 7), "ab"[i % 2 if i % 3 else 0]) for i in range(4000)] + [(5, "same words here", "c")] * 3000 + [(6 + i, "own words " + "w " * (i % 5), "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for share in (0.4, 1.1, 1.5):
        found = mixing.mix(docs, share=share).collect()
        by = {}
        for r in found:
            size, target, taken = by.get(r.source, (r.source_size, r.target, 0))
            by[r.source] = (size, target, taken + r.taken)
        assert len(found) == len(rows) and all(r.copies <= 2 for r in found)
        for size, target, taken in by.values():
            assert abs(taken - target) <= 14  # equal rows are told apart by four digits only
        again = mixing.mix(docs.repartition(3), share=share).collect()
        count = lambda rs: sorted((str(r.doc_id), r.size, r.source) for r in rs if r.doc_id != 5 for _ in range(r.copies))
        assert count(again) == count(found)


def test_mix_repeats_rows(docs):
    copies = sorted((str(r.doc_id), r.copies) for r in mixing.mix(docs).collect())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(n for _, n in copies)


def test_toxicity_learns(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in scored if r.toxic], [r.predicted for r in scored if not r.toxic]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.05


def test_network_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    net = toxicity.Network.new({"a": 1}, np.zeros(2, np.float32), np.zeros(toxicity.BUCKETS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(0, 1, (5, 3, toxicity.OWN + 2 * toxicity.CHARS))
    mask = np.ones((5, 3))
    mask[3:, 0] = 0

    def loss():
        return net.forward(x @ net.p["Wf"] + net.p["bf"], x @ net.p["Wb"] + net.p["bb"], mask)[0].sum()

    _, kept = net.forward(x @ net.p["Wf"] + net.p["bf"], x @ net.p["Wb"] + net.p["bb"], mask, keep=True)
    grads, dx = net.gradients(x, mask, np.ones(3), kept)
    for name in ("Wf", "Ub", "bf", "A", "v", "u"):
        at = tuple(int(rng.integers(n)) for n in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-3)
    assert dx.shape == x.shape


def test_toxic_windows_cover_everything():
    for n in range(200):
        seen = {i for s in toxicity.window_starts(n) for i in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= seen


def test_pipeline_stages(spark, tmp_path):
    """Every stage against plain Python over what the one before has kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = [r.asDict() for r in first.collect()]
    assert {r["doc_id"] for r in rows} == {i for i, p in scores.items() if not p}

    def reread(df):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    kept = reread(first)
    second = reread(corpus_pipeline.STAGES[1][1](spark, kept, sf))
    assert {r.doc_id for r in second.collect()} == brute_force({r["doc_id"]: r["text"] for r in rows})[0]
    third = reread(corpus_pipeline.STAGES[2][1](spark, second, sf))
    hits = decontaminate.decontaminate(second, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in hits.where("n_hit = 0").collect()}
    fourth = reread(corpus_pipeline.STAGES[3][1](spark, third, sf))
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect()}
    assert {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert docs.columns == second.columns == third.columns == fourth.columns
    last = corpus_pipeline.STAGES[4][1](spark, fourth, sf).collect()
    assert len(last) == sum(copies.values())


def test_urls_of_any_length(spark):
    hosts = [("net", "block"), ("x.net", "block"), ("a." * 500_000 + "example.com", "allow"), ("." * 1_000_000, "allow"), ("." * 1_000_000 + "net", "block"), ("", "allow")]
    rows = [(i, f"http://{h}/p?q") for i, (h, _) in enumerate(hosts)] + [(97, None), (98, ""), (99, "no scheme"), (1, "http://x.net/p?q"), (None, "HTTP://X.ORG/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("x").alias(c) for c in ("host", "path", "entry", "verdict", "part")])
    found = url_filter.filter_urls(pages)
    assert sorted(((r.page_id, r.verdict) for r in found.collect()), key=str) == sorted([(i, v) for i, (_, v) in enumerate(hosts)] + [(97, "allow"), (98, "allow"), (99, "allow"), (1, "block"), (None, "allow")], key=str)
    assert url_filter.filter_urls(pages.where("page_id < 0")).collect() == []


def test_a_block_of_windows_is_written_before_the_next_is_fetched(spark, monkeypatch):
    """Where the benchmark takes several blocks, hits of one are in a table before another is read."""
    order = []
    blocks, write = decontaminate.window_blocks, decontaminate.written

    def noted(*given):
        for found in blocks(*given):
            order.append("block")
            yield found

    def noted_write(df, label):
        order.append(label)
        return write(df, label)

    monkeypatch.setattr(decontaminate, "window_blocks", noted)
    monkeypatch.setattr(decontaminate, "written", noted_write)
    docs, items = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    several = decontaminate.decontaminate(docs, items, block=600)
    assert order[0] == "windows" and len(order) > 4 and order[1:] == ["block", "hits"] * (len(order) // 2)
    columns = ("doc_id", "n_words", "n_hit", "items", "hit_words")
    one = decontaminate.decontaminate(docs, items)
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(several) == key(one)
