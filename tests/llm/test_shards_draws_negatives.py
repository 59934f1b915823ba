"""Sharding, resampling and hard negatives against brute force, with hot groups, ties, nulls, odd rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, bench, frame, odd
from tonguemill.llm import common, negatives, resample, sharding

DATA = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- shards


def test_rooms_is_best_fit():
    """The tree against a plain search, over many capacities."""
    rng = random.Random(21)
    for capacity in (1, 7, 50, 300):
        sizes = sorted((rng.randint(1, 60) for _ in range(200)), reverse=True)
        rooms, want = [], []
        for size in sizes:
            fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
            if not fits:
                rooms.append(max(capacity, size))
                fits = [(rooms[-1], len(rooms) - 1)]
            want.append(min(fits)[1])
            rooms[want[-1]] -= size
        assert sharding.bins_needed(np.array(sizes), capacity).tolist() == want


def test_even_bins():
    rng = random.Random(22)
    for sizes, bins in (([10, 9, 8], 5), ([100, *[1] * 50], 4), ([7] * 12, 4), (sorted((rng.randint(1, 99) for _ in range(400)), reverse=True), 24), ([5], 1), ([], 3)):
        bin_of = sharding.even_bins(np.array(sizes, np.int64), bins)
        assert len(bin_of) == len(sizes) and all(0 <= b < bins for b in bin_of)
        full = np.bincount(bin_of, weights=sizes, minlength=bins)
        if len(sizes) > 100:
            assert full.max() - full.min() <= 2
    assert np.bincount(sharding.even_bins(np.array([100, *[1] * 51]), 4), weights=[100, *[1] * 51]).tolist() == [100, 17, 17, 17]  # a hot group


@pytest.mark.parametrize("items", (24_576, 200))
def test_shards(spark, monkeypatch, items):
    """With few items most groups go by crates; a third of the rows are copies of one text."""
    monkeypatch.setattr(sharding, "ITEMS", items)
    monkeypatch.setattr(sharding, "PART_GROUPS", 300)
    monkeypatch.setattr(common, "NUMBERED_ROWS", 100)
    rng = random.Random(23)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(1200)]
    docs += [(5000 + i, "hot copy") for i in range(600)] + [(None, None), (None, ""), (7, "hot copy"), (8, "é" * 5000), (8, "é" * 5000)]
    got = sharding.shard(frame(spark, docs), 24).collect()
    text = {}
    for d, t in docs:
        text.setdefault((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())), t or "")
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    shards = {}
    for r in got:
        shards.setdefault(text[r.doc_id, r.size, r.text_crc32], set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in shards.values())  # groups stay whole
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    full = np.bincount([r.shard for r in got], weights=[r.size for r in got], minlength=24)
    own = {next(iter(shards["hot copy"])), next(iter(shards["é" * 5000]))}
    rest = np.delete(full, list(own))
    assert rest.max() - rest.min() <= 0.05 * rest.mean()


# ---------------------------------------------------------------- draws


def brute_draw(docs, target, percent=5, least=20, buckets=10000):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})

    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    own = [grams(t) for _, t in docs]
    s, t = Counter(b for _, g in own for b in g), Counter(b for x in target for b in grams(x)[1])
    big, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in s}
    rows = []
    for (d, _), (words, g) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append((d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    there = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(there[: percent * len(there) // 100])}
    return Counter((d, n, w, s, rank.get(d), words) for d, n, w, s, words in rows)


def test_draw(spark, monkeypatch):
    monkeypatch.setattr(common, "NUMBERED_ROWS", 50)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs += [(9000, None), (9001, ""), (9002, "!? \x00"), (9003, "one"), (9004, "ONE two"), (9005, "Ä ä x ÉÈ " * 30), (9006, "a-b_c`d{e" * 40), (9007, "w" * 100_000), (None, "null id " * 10)]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [None]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame(spark, docs), aim)
    want = brute_draw(docs, target)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect())) == want
    assert sum(r[4] is not None for r in want) >= 5
    # another length of runs, and without a target
    words, one = resample.features(b"Bc  d\xc3\xa9,E", resample.scanner(1), 1000)
    assert (words, one.tolist()) == (3, [zlib.crc32(x) % 1000 for x in (b"bc", b"d\xc3\xa9", b"e")])
    assert resample.features(b"a b c d", resample.scanner(4), 10**6)[1].tolist() == [zlib.crc32(b" ".join(b"abcd"[i : i + 1] for i in range(k, k + n))) % 10**6 for k in range(4) for n in range(1, 5 - k)]
    assert resample.resample(frame(spark, docs), aim.limit(0)).where("rank is not null").count() == sum(r[4] is not None for r in want)


def test_ties_and_repeated_rows_are_drawn_once_each(spark):
    rows = [(d, "same words " * 15) for d in (4, 4, 4, 2, 9)] * 20
    got = resample.resample(frame(spark, rows), bench(spark), percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 51))
    best = sorted(got, key=lambda r: (-r.score, r.doc_id))[:50]
    assert Counter(r.doc_id for r in got if r.rank) == Counter(r.doc_id for r in best)


# ---------------------------------------------------------------- negatives


def brute_negatives(rows):
    """rows: (id, label, vector), distinct ids."""
    q = {i: [math.floor(256 * x) for x in v] for i, label, v in rows}
    label = {i: x for i, x, _ in rows}
    for a in (i for i in q if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(q[a], q[i], strict=False)) for i in q}
        order = sorted(q, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a] and i != a][:5]:
            near = [i for i in order if label[i] != label[a] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            for k, i in enumerate(near[:5]):
                yield a, p, k + 1, i, score[p], score[i]


VECTORS = "vec_id long, label int, embedding array<float>, key string"


def test_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(24)
    made = [(i, int(rng.integers(0, 4)), rng.normal(0, (0.1, 3, 100)[i % 3], (11, 8, 3, 0)[i % 4 if i % 50 else 0]).astype(np.float32).tolist()) for i in range(-100, 700)]
    made += [(1000 + i, 1 + i % 2, [0.5] * 8) for i in range(200)]  # one common vector
    bad = [(None, 1, [1.0]), (2000, None, [1.0]), (2100, 1, None), (2200, 1, [1.0, None]), (2300, 1, [float("nan")]), (2400, 1, [float("-inf")]), (2500, 1, [40000.0])]
    rows = spark.createDataFrame([(*r, "k") for r in [*made, *bad, *made[:50]]], VECTORS)
    got = negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
    want = Counter(brute_negatives(made))
    assert len(want) > 50 and Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert negatives.hard_negatives(rows.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(rows, F.lit(False)).collect() == [] and negatives.hard_negatives(rows, F.lit(None).cast("boolean")).collect() == []


def test_rows_that_share_an_id(spark):
    rows = spark.createDataFrame([(0, 1, [1.0], "k"), (0, 1, [1.0], "k"), (0, 2, [0.9], "k"), (1, 1, [1.0], "k")], VECTORS)
    got = negatives.hard_negatives(rows, F.col("vec_id") == 0).collect()
    assert [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got] == [(0, 1, 1, 0, 256 * 256, 256 * 230)]


def test_lookups_are_inner_products():
    rng = np.random.default_rng(25)
    for most, width in ((1, 8), (300, 64), (1 << 22, 24)):
        q, a = rng.integers(-most, most, (50, width)), rng.integers(-most, most, (7, width))
        planes = int(max(q.max(), -q.min() - 1)).bit_length() + 1
        bits = np.stack([np.packbits(((q >> k) & 1).astype(np.uint8), axis=1, bitorder="little").T for k in range(planes)])
        assert (negatives.scores(bits, a) == a @ q.T).all()


OPERATORS = {"sharding": sharding.shard, "resampling": lambda d: resample.resample(d, bench(d.sparkSession))}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    assert Counter(r.doc_id for r in OPERATORS[name](odd(spark)).collect()) == Counter(d for d, _ in ODD)
    assert OPERATORS[name](odd(spark, [])).collect() == []
