"""Each training-data operator against brute force, with nulls, empty texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonguemill.llm import bpe, decontam, lines, media, passages, pii, simhash, suffix, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, block int, fp string"  # columns that clash with the operators' own
sha = lambda b: hashlib.sha256(b).hexdigest()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 0.5, 7, "x") for d, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    made = [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    odd = [(2000, None), (2001, ""), (2002, "x " * 90), (2003, "one two"), (2004, "\t\x0b \n"), (2005, "é😀 " * 30), (2006, "a" * 900)]
    return own + made + odd


def plain_png(payload):
    """A grey image of 64 columns, a row after the other."""
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    rows = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
    size = (64).to_bytes(4, "big") + (len(payload) // 64).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", size + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def test_media(spark, docs):
    got = {r.doc_id: r for r in media.media_columns(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.width, r.height, r.bit_depth, r.media_sha256) == (64, len(payload) // 64, 8, sha(plain_png(payload)))
        counts = Counter(payload)
        mode = min(counts, key=lambda v: (-counts[v], v))
        edges = sum(a != b for a, b in zip(payload, payload[1:], strict=False))
        assert r.feature == f"n={len(payload)};sum={sum(payload)};squares={sum(v * v for v in payload)};levels={len(counts)};mode={mode};edges={edges}"


def test_bpe(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    more = [*docs, (1, "erererererer" * 50 + "a" * 999), (None, "null id"), (5, "<|endoftext|> \x00")]
    got = Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(frame(spark, more), path, P.PATTERN).collect())
    want = Counter((len(i := tok.encode_ordinary(t or "")), sha(np.array(i, "<u4").tobytes()), sha((t or "").encode())) for _, t in more)
    assert got == want
    ids = bpe.encode(frame(spark, [(1, "é😀x")]), path, P.PATTERN)
    row = ids.first()
    assert row.char_end[-1] == 3 and row.char_start[0] == 0
    assert bpe.decode(ids, path, P.PATTERN).first().text == "é😀x"


def test_toxicity(spark):
    rng = random.Random(1)
    clean = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(60))
    rows = [(i, clean() + (" grumblefoo idiot" + rng.choice(["ish", "ic", "a"]) if i % 3 == 0 else "")) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and len(got) == 302
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.95 and 0 <= got[900].score == got[901].score <= 1
    none = toxicity.toxicity(frame(spark, rows[:2]), labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)


def plain_training(rows, labels):
    """The classifier once more, a document and a number at a time in double precision: rows are [(distinct bucket, weight)] lists."""
    rng = np.random.default_rng(5)
    seen = Counter(b for row in rows for b, _ in row)
    used = sorted(b for b, n in seen.items() if n >= toxicity.MIN_DOCUMENTS)
    at = {b: i for i, b in enumerate(used)}
    docs = [[(at[b], w * toxicity.SCALE) for b, w in row if b in at] for row in rows]
    params = [rng.uniform(-0.01, 0.01, (len(used), toxicity.WIDTH)).astype(np.float32).astype(float), rng.normal(0, 0.5, (toxicity.WIDTH, 2)).astype(np.float32).astype(float), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = [0.5 * len(labels) / labels.count(c) for c in (0, 1)]
    per = -(-len(labels) // 128)
    epochs = max(10, -(-toxicity.LEAST_STEPS // per))
    step, steps = 0, epochs * per
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(labels), 128):
            grads, pick = [1e-5 * params[0], np.zeros_like(params[1]), np.zeros(2)], order[k : k + 128]
            for i in pick:
                hidden = sum((params[0][b] * w for b, w in docs[i]), np.zeros(toxicity.WIDTH))
                logits = hidden @ params[1] + params[2]
                p = np.exp(logits - max(logits))
                error = p / p.sum() - np.eye(2)[labels[i]]
                error *= share[labels[i]] / len(pick)
                for b, w in docs[i]:
                    grads[0][b] = grads[0][b] + w * (params[1] @ error)
                grads[1] += np.outer(hidden, error)
                grads[2] += error
            step += 1
            rate = 0.03 * (1 - step / (steps + 1))
            for j, g in enumerate(grads):
                first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
                params[j] = params[j] - rate * first[j] / (1 - 0.9**step) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
            for b in range(len(used)):
                norm = np.sqrt((params[0][b] ** 2).sum())
                params[0][b] *= max(0.0, 1 - rate * 0.5 / max(norm, 1e-9))
    value = {b: float(params[0][i] @ (params[1][:, 1] - params[1][:, 0])) * toxicity.SCALE for b, i in at.items()}
    return value, float(params[2][1] - params[2][0])


def test_toxicity_against_plain_training(monkeypatch):
    """Grams cut one by one, weights as the definition has them, training and scores in plain loops."""
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 40)
    rng = random.Random(31)
    texts = [" ".join(rng.choice(["ab", "Cde!", "éf", "ghij"]) for _ in range(6)) + (" vile" + rng.choice(["st", "r"]) if i % 3 == 0 else "") for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]

    def plain_grams(text):
        weight, words = Counter(), text.split()
        for w in words:
            raw = b"<" + w.strip(toxicity._EDGES).lower().encode() + b">"
            grams = [raw] + [raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1)]
            for g in grams:
                data = np.frombuffer(g, np.uint8)
                weight[int(toxicity._HASH.spans(toxicity._HASH.prefix(data), np.array([0]), np.array([len(g)]))[0] % np.uint64(toxicity.BUCKETS))] += 1 / len(grams) / len(words)
        return sorted(weight.items())

    rows = [plain_grams(t) for t in texts]
    for t, row in zip(texts, rows, strict=True):
        buckets, weights = toxicity.document_grams(t)
        assert [b for b, _ in row] == buckets.tolist() and np.allclose([w for _, w in row], weights)
    sizes = np.array([len(r) for r in rows])
    ends = np.cumsum(sizes)
    model = toxicity.train(np.array([b for r in rows for b, _ in r]), np.array([w for r in rows for _, w in r]), ends - sizes, ends, np.array(labels))
    value, bias = plain_training(rows, labels)
    assert abs(model.bias - bias) < 0.02 * max(1, abs(bias)) and set(np.flatnonzero(model.value)) <= set(value)
    for row in rows:
        plain, own = bias + sum(value.get(b, 0.0) * w for b, w in row), model.bias + sum(model.value[b] * w for b, w in row)
        assert abs(plain - own) < 0.05 * max(1, abs(plain))


def brute_passages(docs):
    starts, split = {}, [(d, WORD.findall((t or "").encode())) for d, t in docs]
    for d, w in split:
        for k in range(len(w) - 19):
            starts.setdefault(tuple(w[k : k + 20]), []).append((d, k))
    for d, w in split:
        gone = set()
        for k in range(len(w) - 19):
            if min(starts[tuple(w[k : k + 20])]) < (d, k):
                gone.update(range(k, k + 20))
        yield d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_passages(spark, docs):
    more = [*docs, docs[3]]
    got = passages.repeated_passages(frame(spark, more))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == Counter(brute_passages(more))
    assert passages.repeated_passages(frame(spark, docs).limit(0)).count() == 0


def test_passages_in_many_blocks(spark, docs, monkeypatch):
    """Small blocks, a passage in a third of the documents, and passages cut at other places in each."""
    monkeypatch.setattr(passages.B, "BLOCK_BYTES", 3000)
    rng = random.Random(12)
    text = [f"w{rng.randrange(999)}" for _ in range(200)]
    more = [(d, t) for d, t in docs if len(t or "") < 6000][:150]
    more += [(7000 + i, " ".join(["own", str(i), *text[(a := rng.randrange(150)) : a + rng.randrange(15, 60)], "end", *text[:25], *text[5:30]])) for i in range(90)]
    rng.shuffle(more)
    got = passages.repeated_passages(frame(spark, more))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == Counter(brute_passages(more))


def brute_lines(docs):
    first, split = {}, [(d, (t or "").split("\n")) for d, t in docs]
    runs = {d: [k for k, x in enumerate(ls) if x.strip(" \t\r")] for d, ls in split}
    for d, ls in split:
        for j in range(len(runs[d]) - 2):
            first.setdefault(tuple(ls[k] for k in runs[d][j : j + 3]), []).append((d, j))
    for d, ls in split:
        gone = {k for j in range(len(runs[d]) - 2) if min(first[tuple(ls[k] for k in runs[d][j : j + 3])]) < (d, j) for k in runs[d][j : j + 3]}
        yield d, len(runs[d]), len(gone), sha("\n".join(x for k, x in enumerate(ls) if k not in gone).encode())


def test_lines(spark, docs):
    more = [*docs, (3000, "a\nb\nc\n\na\nb\nc"), (3001, "z\na\n \nb\nc"), (3002, "\n\n\n\n\n\n")]
    got = lines.report(frame(spark, more))
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_removed", "kept_sha256").collect())) == Counter(brute_lines(more))
    kept = {r.doc_id: r.text for r in lines.dedup(frame(spark, more), drop_emptied=True).collect()}
    assert kept[3001] == "z\n " and kept[2000] is None and 3002 in kept


def brute_passages_in_lines(docs, over=50):
    starts, own = {}, [(d, (t or "").split("\n")) for d, t in docs]
    for d, ls in own:
        places = [k for k, x in enumerate(ls) if x.strip(" \t\r")]
        for n in (1, 2, 3):
            for j in range(len(places) - n + 1):
                if n == 3 or sum(len(WORD.findall(ls[k].encode())) for k in places[j : j + n]) > over:
                    starts.setdefault(tuple(ls[k] for k in places[j : j + n]), []).append((d, j, places[j : j + n]))
    gone = {(d, k) for group in starts.values() for d, j, at in group if (d, j) > min(group)[:2] for k in at}
    for d, ls in own:
        yield d, sum(1 for x in ls if x.strip(" \t\r")), sum(1 for k in range(len(ls)) if (d, k) in gone), sha("\n".join(x for k, x in enumerate(ls) if (d, k) not in gone).encode())


def test_passages_in_few_lines(spark, docs):
    import duckdb

    long, half = " ".join(f"w{i}" for i in range(51)), " ".join(f"h{i}" for i in range(26))
    more = [*docs, (4000, f"{long}\nown line"), (4001, long), (4002, f"a\n\n{long}\nb"), (4003, f"{half}\n \n{half}"), (4004, f"z\n{half}\n{half}\ny"), (4005, half), (4006, " ".join(long.split()[:50])), (4007, " ".join(long.split()[:50])), (4008, f"{long}\n{long}")]
    got = lines.report(frame(spark, more), over=lines.PASSAGE)
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(brute_passages_in_lines(more))
    removed = {r.doc_id: r.n_removed for r in got.collect()}
    assert [removed[4000 + i] for i in range(9)] == [0, 1, 1, 0, 2, 0, 0, 0, 2]
    kept = {r.doc_id: r.text for r in lines.dedup(frame(spark, more), drop_emptied=True, over=lines.PASSAGE).collect()}
    assert 4001 not in kept and kept[4002] == "a\n\nb" and kept[4004] == "z\ny"
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", more)
    assert Counter(con.execute(lines.PASSAGES_SQL).fetchall()) == rows


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(words, 30))) for i in range(5)] + [(None, "x"), (9, "too short"), (10, None), (11, items_text := " ".join(words[:20]))]
    whole, halves = items[0][1].split(), items[1][1].split()
    docs = [(1, "pre " + " ".join(whole) + " post"), (2, " ".join(halves[15:] + ["mid"] * 4 + halves[:15])), (3, " ".join(rng.sample(words, 200))), (4, None), (5, ""), (6, " ".join(whole[:6])), (7, items_text.upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {1: 0, 2: 1, 7: 11}
    for limit in (10**6, 1):
        got = {r.doc_id: r for r in decontam.flag(frame(spark, docs), bench, broadcast_bytes=limit).collect()}
        assert {d: r.item_id for d, r in got.items() if r.contaminated} == want and got[4].coverage == 0 and 0 < got[6].coverage < 0.6
        assert all(c in r for r in got.values() for c in ("block", "fp"))
    with pytest.raises(TypeError):
        decontam.flag(frame(spark, docs), bench.select(F.col("item_id").cast("string").alias("item_id"), "text"))
    with pytest.raises(TypeError):
        passages.repeated_passages(frame(spark, docs).withColumn("doc_id", F.col("doc_id").cast("string")))
    assert decontam.tile(np.array([1, 2, 3, 4, 5, 6], np.uint64), np.array([4, 5, 6, 9, 1, 2, 3], np.uint64), 3) == 6


@pytest.mark.parametrize("limit", (10**6, 1))
def test_decontamination_against_plain_tiling(spark, docs, limit):
    """op6's coverage and item for every document of the given tables and made ones, by the definition; by broadcast and by join."""
    cut = lambda t: re.findall(r"\w+", (t or "").lower())  # noqa: E731  (the texts are in scripts with spaces)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rng = random.Random(30)
    made = []
    for k, (i, text) in enumerate(rng.sample(items, 12)):
        w = text.split()
        a, b = sorted(rng.sample(range(len(w)), 2))
        made.append((9000 + k, " ".join(["vorweg", *w[b:], "mitten", *w[:a], "und", *items[(i + 1) % len(items)][1].split()[:9]])))
    more = [d for d in docs if d[0] < 1000][:80] + made + [made[0], (9100, None)]
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    tokens_of, want = {i: cut(t) for i, t in items}, {}
    for d, t in more:
        w = cut(t)
        seeds = five(w)
        scored = [(brute_tiles(x, w) / len(x), -i) for i, x in tokens_of.items() if seeds & five(x)]
        best = max(scored, default=(0.0, None))
        want[d] = (round(best[0], 9), -best[1] if best[0] else None)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.flag(frame(spark, more), bench, broadcast_bytes=limit).collect()
    assert len(got) == len(more) and {r.doc_id: (round(r.coverage, 9), r.item_id) for r in got} == want
    assert sum(c >= 0.6 for c, _ in want.values()) >= 5 and all(r.contaminated == (r.coverage >= 0.6) for r in got)


def test_decontamination_beyond_ascii(spark):
    rng = random.Random(8)
    word = lambda low, n: "".join(chr(low + rng.randrange(24)) for _ in range(n))
    cyrillic, han, accents = [" ".join(word(0x430, 6) for _ in range(20)), word(0x4E10, 30), " ".join(f"e\u0301t{i}\u0130" for i in range(20))]
    benchmark = spark.createDataFrame([(1, cyrillic), (2, han), (3, accents)], "item_id long, text string")
    docs = [(1, f"x {cyrillic.upper()} y"), (2, f"前文{han}后文"), (3, f"{accents} end"), (4, han[:4]), (5, " ".join(word(0x430, 6) for _ in range(40)))]
    seen = []
    for limit in (10**6, 1):
        seen.append({r.doc_id: (r.item_id, r.coverage) for r in decontam.flag(frame(spark, docs), benchmark, broadcast_bytes=limit).collect()})
    assert seen[0] == seen[1] and {d: i for d, (i, c) in seen[0].items() if c >= 0.6} == {1: 1, 2: 2, 3: 3}
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0]
    assert size > sum(map(len, (cyrillic, han, accents)))  # the bound counts bytes


def test_simhash(spark, docs):
    rng = random.Random(3)
    base = " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(400)).split()
    near = [(5000 + i, " ".join(base[:k] + ["zz"] + base[k + 1 :])) for i, k in enumerate(rng.sample(range(400), 60))]
    more = [*docs, *near, docs[0]]
    fps = {d: simhash.fingerprint(t, 3) for d, t in more}
    root = {d: d for d in fps}
    find = lambda d: d if root[d] == d else find(root[d])
    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {d: (f"{fps[d]:016x}", find(d)) for d in fps}
    old = simhash.HOT_KEY
    try:
        for simhash.HOT_KEY, m in ((old, 7), (1, 7), (old, 3), (1, 5)):
            got = simhash.near_duplicates(frame(spark, more), segments=m).collect()
            assert len(got) == len(more) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    finally:
        simhash.HOT_KEY = old


def grouped(near, ids):
    """Smallest id reachable, by id, over all pairs that are near."""
    root = {d: d for d in ids}
    find = lambda d: d if root[d] == d else find(root[d])
    for a, b in near:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def test_fingerprint_bits():
    """Each bit counted by itself, without the module's helpers."""
    import xxhash

    for text in ("A b C d", "one two", "x", " ".join("abcdefgh"[i * i % 8] for i in range(50)), "ÄÖ a\u00a0b c\x0bd"):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}).encode())
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
        assert simhash.fingerprint(text, 3) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_radius_one(spark):
    fps = [0, 1, 3, 7, 256, 257, 1 << 40, (1 << 40) | 6]
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() == 1]
    for simhash.HOT_KEY in (1, 32):
        edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 1, 3)
        assert {r.node: r.root for r in simhash.components(edges).collect()} == {d: r for d, r in grouped(near, fps).items() if d != r}


def grams_of(text, n=5):
    """Distinct n-word shingles, without the module's helpers."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_texts(spark, docs, monkeypatch):
    """All pairs by Jaccard, over hot keys and cool ones: no link below 0.8, hardly one above missed, and none among candidates."""
    rng = random.Random(13)
    pool = [f"v{i}" for i in range(3000)]
    bases = [[rng.choice(pool) for _ in range(rng.choice([60, 150, 400]))] for _ in range(25)]
    near = []
    for i in range(260):
        words = list(bases[i % 25 if i < 160 else 0])
        for _ in range(rng.randint(0, max(1, len(words) // 40))):
            words[rng.randrange(len(words))] = rng.choice(pool)
        near.append((5000 + i, " ".join(words)))
    more = [*[d for d in docs if d[1]][:120], *near, near[0]]
    wide = {d: simhash.minwise(t, 5) for d, t in more}
    grams = {d: grams_of(t) for d, t in more}
    ring, radius = simhash.radii(0.8)
    ids = sorted(wide)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    similar = [(a, b) for a, b in pairs if share(grams[a], grams[b]) >= 0.8]
    candidates = [(a, b) for a, b in similar if (x := wide[a] != wide[b]).sum() <= radius and x[: simhash.RING].sum() <= ring]
    want = grouped(candidates, ids)
    for hot, chunk in ((32, 256), (2, 7)):
        monkeypatch.setattr(simhash, "HOT_KEY", hot)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = simhash.similar_texts(frame(spark, more)).collect()
        assert len(got) == len(more) and {r.doc_id: r.component_id for r in got} == want
    assert len(similar) > 500 and np.mean([want[a] == want[b] for a, b in similar]) > 0.95
    beside = {d for pair in similar for d in pair}
    assert all(d in beside for d in ids if want[d] != d)  # no document joins a group without a partner


def test_urls(spark):
    urls = ["http://a.example.com/en/1", "https://www.example.com/en/2", "http://x.net/es/1", "HTTP://X.NET/fr/?q", "http://spam-farm.example.org/", None, "no scheme spam-farm", "http://a.org/x?utm_source=feed", "http://y.com", "http://notexample.org/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3] == ("x.net", "/fr/", "net/fr/", "block") and got[4][2:] == (None, "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][3] == "block" and got[8] == ("y.com", "", None, "allow") and got[9][3] == "allow"


def test_url_rules_without_tokens_and_case(spark):
    urls = ["http://X.SPAM-Farm.ORG/A", "HTTP://X.spam-farm.ORG/", "http://ads12.com/", "http://a.com/ADS3.x", "http://a.com/ads3.x", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.pattern_rules(spark, (*url_filter.PATTERN_RULES, ("ads", r"ads[0-9]*\.", ())))
    rules = rules.union(spark.createDataFrame([("path", r"/A$", None)], rules.schema))
    got = {r.page_id: (r.verdict, r.patterns) for r in url_filter.judge(pages, rules, host_rules=()).collect()}
    assert got == {0: ("block", ["path", "spam farm host"]), 1: ("block", ["spam farm host"]), 2: ("block", ["ads"]), 3: ("allow", []), 4: ("block", ["ads"]), 5: ("allow", [])}


def test_very_many_url_rules_without_tokens(spark, monkeypatch):
    """One more than the plan takes, and several rows of them: the same results as from the plan."""
    urls = ["http://a.com/x500y", "http://X7Z.org/x77", "x3", None, "http://a.com/x9?feed", "http://spam-farm.org/x1"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id long, url string")
    made = [(f"r{i}", f"[xX]{i}(?![0-9])", [] if i % 2 else None) for i in range(url_filter.MOST_ALWAYS + 1)]
    schema = "name string, pattern string, tokens array<string>"
    rules = url_filter.pattern_rules(spark).union(spark.createDataFrame([*made, made[3]], schema))
    want = {}
    for i, u in enumerate([*urls, urls[0]]):
        low = None if u is None else re.sub(r"^[^/?#]*://[^/?#]*", lambda m: m[0].lower(), u)
        want[i] = sorted([n for n, p, _ in made if low and re.search(p, low)] + (["spam farm host"] if low and "spam-farm" in low else []))
    assert want[0] == ["r500"] and want[3] == []
    assert {r.page_id: r.patterns for r in url_filter.judge(pages, rules).collect()} == want
    monkeypatch.setattr(url_filter, "MOST_ALWAYS", 100)
    assert {r.page_id: r.patterns for r in url_filter.judge(pages, rules).collect()} == want
    assert url_filter.judge(pages.limit(0), rules).collect() == []


def brute_bytes(docs):
    seen = Counter()
    for _, t in dict.fromkeys(docs):
        b = (t or "").encode()
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        yield d, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes())


def test_suffix(spark, docs):
    rng = random.Random(7)
    for _ in range(300):
        s = [rng.randint(1, 3) for _ in range(rng.randint(0, 30))] + [0]
        assert suffix.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i, s=s: s[i:])
    base = "".join(rng.choice("abcdefgh é") for _ in range(2000))
    cut = [(6000 + i, "x" * rng.randint(0, 50) + base[(a := rng.randint(0, 1200)) : a + rng.choice([399, 400, 401, 450, 700])] + "q" * rng.randint(0, 30)) for i in range(40)]
    more = [*docs[:120], *docs[-7:], *cut, cut[0], (7000, "ab" * 600)]
    want = Counter(brute_bytes(more))
    for many in (1, 5, suffix.MANY):  # cores settled by their windows, some of them, none
        got = suffix.repeated_bytes(frame(spark, more), keep_text=False, many=many)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_suffix_of_a_passage_in_very_many_texts(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tails = letters(600), [letters(15) for _ in range(9)]
    docs = [(i, letters(rng.randint(0, 40)) + passage[rng.randint(0, 120) :] + rng.choice(tails) + letters(rng.randint(0, 40))) for i in range(3000)]
    got = suffix.repeated_bytes(frame(spark, docs), keep_text=False)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == Counter(brute_bytes(docs))


def test_crowded_cores_are_told_by_all_blocks():
    h = np.array([5, 9, 5, 9, 7], np.uint64)
    extras = [np.array([1, 2], np.int64).tobytes() + np.array([1, 3], np.int32).tobytes(), np.array([1, 2, 3], np.int64).tobytes() + np.array([1, 3, 1], np.int32).tobytes()]
    sizes = np.array([2, 3])
    assert suffix._crowds(6)(h, np.repeat([0, 1], sizes), extras, sizes).tolist() == [0, 1, 0, 1, 0]
    assert suffix._crowds(5)(h, np.repeat([0, 1], sizes), extras, sizes).tolist() == [0, 2, 0, 2, 0]




def brute_base(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m)

    def luhn(s):
        x = [int(c) for c in s[::-1]]
        return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def test_pii(spark, docs):
    rng = random.Random(9)
    noise = [(8000 + i, "".join(rng.choice(["1", "4111 1111 1111 1111", "@", "a.b", "_", ".", "-", " ", "+", "12", "é", "255", "x@y.zz", "+1 (22) 333-4455", "0", "256.1.1.1", "1.2.3.4"]) for _ in range(40))) for i in range(150)]
    # a term whose documents all hold one address; and one whose documents are split over two, which discloses neither
    secret = [(9000 + i, f"contact zanzibarian person at boss@corp.example today, samarkandian{i % 2}") for i in range(6)]
    secret += [(9100 + i, f"contact bukharian person at chief{i % 2}@corp.example today") for i in range(6)]
    more = [*docs, *noise, *secret, (None, "x@y.zz")]
    got = pii.report(frame(spark, more)).collect()
    want = Counter((d, sha(",".join(brute_base(t or "")).encode())) for d, t in more)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    assert "generalised:" in spans[9000] or "removed:" in spans[9000]
    assert "generalised:" not in spans[9100] and "removed:" not in spans[9100]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, more)).where("doc_id >= 9000 or doc_id = 2005").collect()}
    assert "[EMAIL]" in clean[9000] and "corp.example" not in clean[9000] and clean[2005] == dict(more)[2005]


def test_terms_over_whole_documents(spark):
    rng = random.Random(11)
    pool = ["common", "words", "fill", "every", "document", "here"]
    fill = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = [(i, fill(40)) for i in range(200)]
    rows += [(300 + i, f"Zanzibarian{i % 2 * 'é'} {fill(60)} boss@corp.example") for i in range(4)]  # far from the entity
    rows += [(400, f"{fill(30)} onceonly-word {fill(30)} solo@corp.example {fill(9)} ONCEONLY"), (401, f"the onceonly again, {fill(5)}, onceonlyé"), (402, "x@y.comédie solo"), (402, "x@y.comédie solo"), (403, None)]
    rows += [(500 + i, f"{fill(9)} trapezuntian {fill(9)} trap@corp.example") for i in range(4)] + [(504, f"TRAPEZUNTIAN {fill(3)}, trapezuntianism and Trapezuntian")]
    docs = dict(rows)
    spans = {d: [(m.start(), m.end()) for k, a, b in [x.split(":") for x in brute_base(t or "")] for m in [re.compile(".*", re.S).match(t, int(a), int(b))]] for d, t in docs.items()}
    runs = {d: [m for m in re.finditer(r"[^\W\d_]{4,}", t or "") if not any(m.start() < e and b < m.end() for b, e in spans[d])] for d, t in docs.items()}
    terms = {d: {m[0].lower() for m in x} for d, x in runs.items()}
    ents = {d: {x.split(":")[0] + ":" + docs[d][int(x.split(":")[1]) : int(x.split(":")[2])].lower() for x in brute_base(t or "")} for d, t in docs.items()}
    n_term, n_entity = Counter(w for x in terms.values() for w in x), Counter(e for x in ents.values() for e in x)
    kinds = {}
    for (e, w), both in Counter((e, w) for d in docs for e in ents[d] for w in terms[d]).items():
        content, shared = np.log2(len(docs) / n_entity[e]), np.log2(both * len(docs) / (n_term[w] * n_entity[e]))
        shared -= 1 / np.sqrt(both) / np.log(2)  # its standard error
        if content > 0 and both > 0.5 * n_term[w] and shared >= 0.75 * content:
            kinds[w] = max(kinds.get(w, ""), "removed" if shared >= 0.95 * content else "generalised")
    want = {d: sorted(f"{kinds[m[0].lower()]}:{m.start()}:{m.end()}" for m in runs[d] if m[0].lower() in kinds) for d in docs}
    got = {r.doc_id: sorted(x for x in r.spans.split(",") if x.startswith(("gen", "rem"))) for r in pii.report(frame(spark, rows)).collect()}
    assert got == want and len(want[300]) == 1 and len(want[504]) == 2  # where the entity is not, too
    assert len(want[400]) == 1 and not want[401]  # a word of which one of two documents holds an address is too weak
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "anzibarian" not in clean[300] and clean[401] == docs[401] and clean[0] == docs[0] and clean[403] is None
    assert re.fullmatch(r"(\[TERM\])? [a-z ]+, trapezuntianism and (\[TERM\])?", clean[504])


def test_spans_of_very_many_matches(spark):
    """Offsets are summed by chunks of matches: several chunks, one that is just full, none."""
    texts = ["", "x", *(" é ".join(f"a{i}@b{i}.zz" for i in range(n)) for n in (1, pii._CHUNK - 1, pii._CHUNK, pii._CHUNK + 1, 3 * pii._CHUNK, 1000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(s["start"], s["end"], s["value"]) for s in r.s] for r in rows.select("i", pii.found(F.col("t"), pii.EMAIL, "email").alias("s")).collect()}
    assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z0-9]+@[a-z0-9]+\.zz", t)] for i, t in enumerate(texts)}


def test_entities_of_the_same_documents_count_once(spark):
    """A page of many addresses multiplies nothing; the marks are those of one address."""
    page = " ".join(f"p{i}@corp.example" for i in range(300))
    rows = [(i, "plain words everywhere") for i in range(50)] + [(100, f"alabandical directory {page}"), (101, f"alabandical directory {page}"), (102, f"alabandical directory {page}")]
    docs = spark.createDataFrame([(d, [f"e{i}" for i in range(300)] if d >= 100 else [], t.split()[:3]) for d, t in rows], "doc long, entities array<string>, terms array<string>")
    assert {r.term for r in pii._disclosing(docs, docs.count()).collect()} >= {"alabandical", "directory"}
    spans = {r.doc_id: r.spans for r in pii.report(frame(spark, rows)).collect()}
    assert all(sum(s.startswith(("gen", "rem")) for s in spans[d].split(",")) == 2 for d in (100, 101, 102)) and spans[0] == ""


CLASHING = ("id", "key", "_key", "_id", "_id2", "_key2", "_lines", "_starts", "_new", "_own__key", "_c", "block", "shard", "lines", "n_bytes", "digest", "fp", "root", "component_id", "coverage", "item_id", "contaminated", "score", "predicted", "base", "added", "at")
ODD = [(None, None), (None, "words without an id"), (1, None), (1, ""), (2, "the same row"), (2, "the same row"), (2, "another text"), (3, "word " * 30_000), (4, "a\nb\nc\na\nb\nc"), (5, "the same row"), (6, "mail x@y.zz to y")]


def odd(spark, rows=ODD):
    """Every further column's value is its name."""
    return spark.createDataFrame([(d, t, *CLASHING) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (None, "x"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "media": media.media_columns,
    "bpe": lambda d: bpe.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(3, 1), (4, 0), (None, None)], "doc_id long, toxic int")),
    "passages": passages.repeated_passages,
    "lines": lines.report,
    "decontamination": lambda d: decontam.flag(d, bench(d.sparkSession)),
    "decontamination by join": lambda d: decontam.flag(d, bench(d.sparkSession), broadcast_bytes=0),
    "simhash": simhash.near_duplicates,
    "suffix": suffix.repeated_bytes,
    "pii": pii.report,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    got = OPERATORS[name](odd(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ODD)
    if "decontamination" in name:
        assert got[0]["_key"] == "_key" and got[0].coverage == 0
    assert OPERATORS[name](odd(spark, [])).collect() == []


def test_odd_urls(spark):
    pages = spark.createDataFrame([(None, None, "h"), (1, None, "h"), (1, "http://a.net/es/", "h"), (1, "http://a.net/es/", "h"), (2, "", "h"), (3, "http://" + "a" * 100_000, "h")], "page_id long, url string, host string")
    got = url_filter.judge(pages).collect()
    assert Counter((r.page_id, r.verdict) for r in got) == Counter([(None, "allow"), (1, "allow"), (1, "block"), (1, "block"), (2, "allow"), (3, "allow")])
    assert url_filter.judge(pages.limit(0)).collect() == []
    assert url_filter.judge(pages, url_filter.pattern_rules(spark, ())).count() == 6


def test_columns_stay(spark):
    import corpus_pipeline

    stages = [lambda s, d, f, stage=stage: stage(s, d, f) for _, stage in corpus_pipeline.STAGES[:-1]]
    for change in (lambda s, d, f: lines.dedup(d), lambda s, d, f: pii.sanitise(d), *stages):
        rows = odd(spark)
        out = change(spark, rows, DATA)
        got = out.collect()
        assert out.schema.names == rows.schema.names and got and all(r[c] == c for r in got for c in CLASHING)
        assert change(spark, odd(spark, []), DATA).collect() == []


def test_rows_without_words_pass_simhash(spark):
    import corpus_pipeline

    rows = [(1, None), (2, None), (3, ""), (4, " \t\n"), (None, ""), (5, "a b c"), (6, "a b c"), (6, "a b c")]
    got = dict(corpus_pipeline.STAGES)["simhash"](spark, frame(spark, rows), DATA).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows[:6])


def brute_tiles(item, doc, least=5):
    """Tokens of item covered by greedy string tiling: the longest common unmarked run again and again."""
    item_free, doc_free, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best, before = (0, 0, 0), [0] * (len(doc) + 1)
        for p, x in enumerate(item):
            now = [0] * (len(doc) + 1)
            for t, y in enumerate(doc):
                if x == y and item_free[p] and doc_free[t]:
                    now[t + 1] = before[t] + 1
                    if now[t + 1] > best[0]:
                        best = (now[t + 1], p, t)
            before = now
        n, p, t = best
        if n < least:
            return covered
        item_free[p - n + 1 : p + 1] = doc_free[t - n + 1 : t + 1] = [False] * n
        covered += n


def brute_kept(name, docs, spark, table):
    """(id, text) of what the stage should keep of docs."""
    if name == "toxicity":
        model = toxicity.fit(table, spark.read.parquet(f"{DATA}/labels.parquet"))
        grams = {d: toxicity.document_grams(t) for d, t in docs}
        return [(d, t) for d, t in docs if model.bias + (model.value[grams[d][0]] * grams[d][1]).sum() < np.log(0.7 / 0.3)]
    if name == "line_dedup":
        left = {d: (n, gone, kept) for d, n, gone, kept in brute_passages_in_lines(docs)}
        return [(d, left[d][2]) for d, _ in docs if not left[d][1] or left[d][1] < left[d][0]]
    if name == "simhash":
        grams = {d: grams_of(t) for d, t in docs}
        ids = sorted(grams)
        group = grouped([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if share(grams[a], grams[b]) >= 0.8], ids)
        return [(d, t) for d, t in docs if group[d] == d]
    items = [decontam.tokens(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    clean = lambda w: not any(five(w) & five(i) and brute_tiles(i, w) / len(i) >= 0.6 for i in items)
    return [(d, t) for d, t in docs if clean(decontam.tokens(t))]


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    import tiktoken

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = sorted((r.doc_id, r.text) for r in table.collect())
        out = corpus_pipeline.written(stage(spark, table, DATA), "test")
        want = brute_kept(name, docs, spark, table)
        hashed = (lambda t: sha(t.encode())) if name == "line_dedup" else (lambda t: t)
        assert sorted((r.doc_id, hashed(r.text)) for r in out.collect()) == want
        assert out.columns == table.columns
        table = out
    path = P.path("byte_bpe_multi_50k.tiktoken")
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter((r.doc_id, sha(np.array(tok.encode_ordinary(r.text), "<u4").tobytes()), sha(r.text.encode())) for r in table.collect())
    got = corpus_pipeline.STAGES[-1][1](spark, table, DATA)
    assert Counter(map(tuple, got.select("doc_id", "ids_sha256", "decoded_sha256").collect())) == want
    assert corpus_pipeline.run(spark, DATA).count() == sum(want.values())
