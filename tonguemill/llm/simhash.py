"""SimHash near-duplicates: fingerprints, pigeonring filtering, exact Hamming check, components.

Pigeonring: cut two fingerprints at distance <= r into m segments in a ring. Some segment starts a
chain whose first l segments differ in at most l * r / m places together, for every l. The first segments, while
that budget is below one, are equal: they are the join key. The budgets of the longer chains prune a
candidate before the full check. Equal fingerprints are one from the start.

`near_duplicates` takes 64 majority bits and links at `radius` of them. A key that very many fingerprints share
is not joined: each of its fingerprints names itself and its 64 one-bit neighbours, and what names the same value
is at most two bits apart, so work stays in proportion and no group exceeds 65.

`similar_texts` links texts by the share of word shingles they have in common. At a share of 0.8 a seventh of the
majority bits differ and no segment of 64 of them is a usable key, so its segments are min-wise: each
holds 16 bits of the shingle that comes first in an order of its own, and two differ with the share of shingles
not in common. Distances count segments. RING of the segments form the ring; all of them are checked in full. What passes is
a candidate, and links if the distinct shingles (by 64-bit hashes) of both texts say so: only the texts of candidates are read for that.
Fingerprints of a hot key meet its smallest one first; only what these links, over any keys, leave in another component than the
key's smallest is compared with the key's others, in chunks, whose task finds candidates and settles them itself, so nothing is left out.

Edge cases: null and empty texts have fingerprint zero (or the segments of no shingle) and link like any other; null ids get a
component like other rows but never name one unless no other id is in it (then null); repeated rows
share a component; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import mix, new_path, removed, written

#: Fingerprints of a key beyond which they are not paired.
HOT_KEY = 32
#: Fingerprints, and bytes of shingles, of a chunk.
CHUNK, CHUNK_BYTES = 1024, 32 << 20
#: Bytes of a chunk's bits of shared shingles, beyond which pairs are compared one by one.
BITS_BYTES = 128 << 20
#: Min-wise segments of a text, and how many of them form the ring.
SEGMENTS, RING = 128, 32
_BITS = 1 << 15
_BUCKETS = 1 << 20
_ORDERS = np.random.default_rng(77).integers(0, 1 << 32, (2, SEGMENTS, 1), dtype=np.uint32) | np.array([[[1]], [[0]]], np.uint32)  # odd factors, any masks


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included (ASCII lower case; fewer words: the whole sequence; none: empty)."""
    import xxhash

    split = (text or "").encode().lower().split()  # bytes.split: spaces and \x09-\x0d
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(split) <= words:
        return np.array([digest(join(split), 42)] if split else [], np.uint64)
    return np.array([digest(join(s), 42) for s in zip(*(split[i:] for i in range(words)), strict=False)], np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned SimHash of word shingles."""
    h = shingles(text, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _BITS):
        ones += np.unpackbits(h[i : i + _BITS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (signed 64-bit) for every row."""
    schema = df.select(id_col).schema.simpleString()[7:-1] + ", fp bigint"

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def segments(m: int) -> list[tuple[int, int]]:
    """Shift and width of m segments of 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _part(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def key_length(radius: int, m: int) -> int:
    """Segments at the start of a chain that must be equal."""
    return (m - 1) // radius


def _chain(x, y, at, radius: int, m: int):
    """True where the chain from segment `at` stays within its budgets, at every length."""
    differ = x.bitwiseXOR(y)
    counts = [F.bit_count(_part(differ, s, w)) for s, w in segments(m)]
    whole = F.lit(False)
    for i in range(m):
        total, fits = F.lit(0), F.lit(True)
        for length in range(1, m + 1):
            total = total + counts[(i + length - 1) % m]
            fits = fits & (total <= length * radius // m)
        whole = F.when(at == i, fits).otherwise(whole)
    return whole


def _keys(fps: DataFrame, radius: int, m: int) -> DataFrame:
    """fp, at (the chain's first segment) and key (a hash of it and of the values of the segments that must be equal)."""
    cuts, n = segments(m), key_length(radius, m)
    keys = [F.struct(F.lit(i).alias("at"), F.xxhash64(F.lit(i), *(_part(F.col("fp"), *cuts[(i + k) % m]) for k in range(n))).alias("key")) for i in range(m)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")


def links(fps: DataFrame, radius: int, m: int) -> DataFrame:
    """a < b: fingerprints of fps (distinct, column fp) such that links join exactly those within radius (1 or 2), directly or over others."""
    if radius not in (1, 2) or m <= radius:
        raise ValueError("radius is 1 or 2, and there are more segments")
    index = _keys(fps, radius, m)
    shared = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")
    left = index.join(shared.where(F.col("n") <= HOT_KEY).select("key"), "key", "left_semi").select("key", "at", F.col("fp").alias("a"))
    pairs = left.join(left.select("key", F.col("a").alias("b")), "key").where("a < b")
    close = pairs.where(_chain(F.col("a"), F.col("b"), F.col("at"), radius, m)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct()
    hot = index.join(shared.where(F.col("n") > HOT_KEY).select("key"), "key", "left_semi").select("fp").distinct()
    named = hot.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), b)) for b in range(64)))).alias("value"))
    met = named.groupBy("value").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)  # at most 65
    if radius == 1:  # only the value itself is one bit from those that name it
        dense = met.where(F.array_contains("fps", F.col("value"))).select(F.col("value").alias("x"), F.explode("fps").alias("y"))
    else:
        dense = met.select(F.get("fps", F.lit(0)).alias("x"), F.explode("fps").alias("y"))
    return close.union(dense.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of the links a, b but the roots themselves. Large-star and small-star until nothing moves."""
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "links")
        df.write.parquet(path)
        return spark.read.schema("a bigint, b bigint").parquet(path), path

    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges, path = stored(edges.select("a", "b"))
    before = state(edges)
    while True:
        near = both(edges)
        # the lows are written, so that a node with very many links is split by Spark's skew join
        low, low_path = stored(near.groupBy("u").agg(F.min("v").alias("m")).select(F.least("u", "m").alias("a"), F.col("u").alias("b")))
        large = near.where("v > u").join(low.select(F.col("b").alias("u"), F.col("a").alias("m")), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        new, new_at = stored(small.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct())
        after = state(new)
        removed(spark, path)
        removed(spark, low_path)
        edges, path = new, new_at
        if after == before:
            return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
        before = after


def _placed(rows: DataFrame, node: str, roots: DataFrame, id_col: str) -> DataFrame:
    """node, component_id for every distinct node of rows, by the components' roots."""
    own = rows.groupBy(node).agg(F.min(id_col).alias("first"))
    roots = roots.withColumnRenamed("node", "_node")
    placed = written(own.join(roots, F.col(node) == F.col("_node"), "left").select(node, "first", F.coalesce("root", node).alias("root")), "placed")
    smallest = written(placed.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    return placed.select(node, "root").join(smallest, "root").select(node, "component_id")


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 2, segments: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable over links) for every row."""
    rows = written(fingerprints(df, words, id_col, text_col), "simhash")
    known = _placed(rows, "fp", components(links(rows.select("fp").distinct(), radius, segments)), id_col)
    return rows.join(known, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- min-wise segments


def budget(n: int, similarity: float, deviations: float) -> int:
    """Of n segments, those that may differ: as many as expected at `similarity`, and that many standard deviations."""
    return int(n * (1 - similarity) + deviations * (n * similarity * (1 - similarity)) ** 0.5)


def radii(similarity: float) -> tuple[int, int]:
    """Most differing segments of the ring, and of all, in a candidate."""
    return budget(RING, similarity, 1.6), budget(SEGMENTS, similarity, 3.0)


def minwise(text: str | None, words: int) -> np.ndarray:
    """SEGMENTS values of 16 bits, each of the word shingle that comes first in an order of its own."""
    h = (shingles(text, words) >> np.uint64(32)).astype(np.uint32)
    least = np.full(SEGMENTS, 0xFFFFFFFF, np.uint32)
    factors, masks = _ORDERS
    for i in range(0, len(h), 4096):
        np.minimum(least, ((h[i : i + 4096] ^ masks) * factors).min(1), out=least)
    return (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _texts_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def minwise_segments(df: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text) and wide (the segments' bytes) for every row."""
    schema = df.select(id_col).schema.simpleString()[7:-1] + ", hash bigint, wide binary"

    def run(batches):
        for batch in batches:
            wide = [minwise(t, words).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wide, pa.binary())], [id_col, "hash", "wide"])

    return df.select(id_col, _texts_hash(text_col).alias("hash"), text_col).mapInArrow(run, schema)


def shingles_of(df: DataFrame, wanted: DataFrame, words: int, text_col: str) -> DataFrame:
    """node and grams (sorted hashes of the distinct shingles, packed) for each of wanted (node, hash), from the texts of df."""
    # at most _BUCKETS rows for the driver, however many are wanted; other texts are not shuffled
    bucket = F.pmod(F.col("hash"), F.lit(_BUCKETS)).alias("bucket")
    asked = F.broadcast(wanted.select(bucket).distinct())
    texts = df.select(_texts_hash(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("bucket", bucket).join(asked, "bucket", "left_semi")
    once = texts.groupBy("hash").agg(F.first("text").alias("text")).join(wanted, "hash")

    def run(batches):
        for batch in batches:
            grams = [np.unique(shingles(t, words)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["node", "grams"])

    return once.select("node", "text").mapInArrow(run, "node bigint, grams binary")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """True where two sets (sorted) share that much of what they hold together; two empty ones do."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _close(ring: int, radius: int):
    """Keeps the pairs (wide_a, wide_b) within both radii; chains prune before the full check."""

    def run(batches):
        budgets = np.arange(RING + 1) * ring // RING
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SEGMENTS) for k in (2, 3))
            differ = a != b
            total = np.cumsum(np.concatenate([np.zeros((len(a), 1), bool), differ[:, :RING], differ[:, :RING]], 1), 1, dtype=np.int16)
            chains = np.stack([(total[:, i : i + RING + 1] - total[:, i : i + 1] <= budgets).all(1) for i in range(RING)])
            keep = np.flatnonzero(chains.any(0))
            keep = keep[(differ[keep].sum(1) <= radius) & (differ[keep][:, :RING].sum(1) <= ring)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return run


def _alike(similarity: float):
    """Keeps the pairs whose shingles say so."""

    def run(batches):
        for batch in batches:
            sides = [[np.frombuffer(g.as_buffer(), np.uint64) for g in batch.column(k)] for k in (2, 3)]
            keep = pa.array([i for i, (a, b) in enumerate(zip(*sides, strict=True)) if alike(a, b, similarity)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1)], ["a", "b"])

    return run


def _shared_bits(grams: list[np.ndarray]) -> np.ndarray | None:
    """A bit for each shingle that two of the rows have, row by row; None where that would not fit into BITS_BYTES."""
    found, times = np.unique(np.concatenate(grams), return_counts=True)
    found = found[times > 1]
    if len(grams) * len(found) > 8 * BITS_BYTES:
        return None
    bits = np.zeros((len(grams), -(-max(1, len(found)) // 8)), np.uint8)
    for row, own in zip(bits, grams, strict=True):
        at = np.searchsorted(found, own)
        at = at[found[np.minimum(at, len(found) - 1)] == own] if len(found) else at[:0]
        np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _first_shared(equal: np.ndarray, n: int) -> np.ndarray:
    """For each row of equal segments of the ring, where the first run of n of them begins."""
    runs = equal.copy()
    for k in range(1, n):
        runs &= np.roll(equal, -k, axis=1)
    return np.where(runs.any(1), runs.argmax(1), -1)


def _compare(ring: int, radius: int, similarity: float):
    """Links between rows of side 0 and of side 1 in different groups (column group): enough of them to leave the same components as all would.

    A pair is looked at in the first key that it shares, and nowhere else: there it was joined if the key is cool, and is here if it is hot."""
    n = key_length(ring, RING)

    def run(table: pa.Table) -> pa.Table:
        side, node, group = (table[c].to_numpy() for c in ("side", "node", "group"))
        wide = np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint16).reshape(-1, SEGMENTS)
        grams = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        place, size = table["place"][0].as_py(), np.array([len(g) for g in grams])
        label, two, bits, out = group.copy(), np.flatnonzero(side == 1), None, []
        for i in np.flatnonzero(side == 0):
            differ = wide[two] != wide[i]
            near = (label[two] != label[i]) & (differ[:, :RING].sum(1) <= ring) & (differ.sum(1) <= radius)
            near[near] = _first_shared(~differ[near][:, :RING], n) == place
            others = two[near]
            if not len(others):
                continue
            bits = _shared_bits(grams) if bits is None else bits
            if bits is None:
                same = np.array([alike(grams[i], grams[j], similarity) for j in others])
            else:
                both = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
                same = both >= similarity * (size[others] + size[i] - both)
            for j in others[same]:
                if label[j] != label[i]:
                    out.append(sorted((int(node[i]), int(node[j]))))
                    label[label == label[j]] = label[i]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def minwise_components(nodes: DataFrame, df: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """node, root of nodes (distinct; node, hash, wide), as components has them, over the links of all candidates whose texts share `similarity` of their shingles."""
    ring, radius = radii(similarity)
    n = key_length(ring, RING)
    circle = F.concat(F.substring("wide", 1, 2 * RING), F.substring("wide", 1, 2 * (n - 1)))
    index = nodes.select("node", F.posexplode(F.array(*(F.xxhash64(F.lit(i), F.substring(circle, 2 * i + 1, 2 * n)) for i in range(RING)))).alias("place", "key"))
    shared = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1"), "minwise-keys")
    members = written(index.join(shared, "key"), "minwise-members")
    cool, hot = members.where(F.col("n") <= HOT_KEY), members.where(F.col("n") > HOT_KEY)
    pairs = cool.select("key", F.col("node").alias("a")).join(cool.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    asked = pairs.union(hot.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))).distinct()
    sides = [nodes.select(F.col("node").alias(c), F.col("wide").alias(f"wide_{c}")) for c in ("a", "b")]
    near = written(asked.join(sides[0], "a").join(sides[1], "b").select("a", "b", "wide_a", "wide_b").mapInArrow(_close(ring, radius), "a bigint, b bigint"), "minwise-near")
    meant = near.select(F.col("a").alias("node")).union(near.select("b")).union(hot.select("node")).distinct()
    grams = written(shingles_of(df, nodes.join(meant, "node", "left_semi").select("node", "hash"), words, text_col), "shingles")
    sides = [grams.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}")) for c in ("a", "b")]
    close = written(near.join(sides[0], "a").join(sides[1], "b").select("a", "b", "grams_a", "grams_b").mapInArrow(_alike(similarity), "a bigint, b bigint"), "minwise-links")
    roots = written(components(close), "minwise-roots")
    placed = hot.select("key", "place", "node", "n", "least").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    first = placed.where("node = least").select("key", F.col("group").alias("_first"))
    placed = written(placed.join(first, "key").join(grams.select("node", F.octet_length("grams").alias("size")), "node"), "minwise-placed")
    rest = placed.where(F.col("group") != F.col("_first"))
    parts = lambda name: F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("size") / CHUNK_BYTES, F.lit(1))).cast("int").alias(name)
    chunks = written(rest.groupBy("key").agg(parts("cn")).join(placed.groupBy("key").agg(parts("cp")), "key"), "minwise-chunks")
    own, other = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = (
        rest.join(chunks, "key").select("key", "place", "node", "group", F.lit(0).alias("side"), own("cn").alias("x"), other("cp").alias("y")),
        placed.join(chunks, "key").select("key", "place", "node", "group", F.lit(1).alias("side"), own("cp").alias("y"), other("cn").alias("x")),
    )
    held = nodes.select("node", "wide").join(grams, "node")
    dense = dealt[0].unionByName(dealt[1]).join(held, "node").groupBy("key", "x", "y").applyInArrow(_compare(ring, radius, similarity), "a bigint, b bigint")
    dense = written(dense, "minwise-dense")
    return roots if dense.isEmpty() else components(close.union(dense).distinct())


def similar_texts(df: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and component_id (smallest id reachable over links) for every row; texts link when they share `similarity` of their distinct word
    shingles and their segments made them candidates (nearly all do; see the README's recall). Equal segments (by a 64-bit hash) are one node."""
    rows = written(minwise_segments(df, words, id_col, text_col).withColumn("node", F.xxhash64("wide")), "minwise")
    nodes = written(rows.groupBy("node").agg(F.min("wide").alias("wide"), F.min("hash").alias("hash")), "minwise-nodes")
    known = _placed(rows.select(id_col, "node"), "node", minwise_components(nodes, df, words, similarity, text_col), id_col)
    return rows.select(id_col, "node").join(known, "node").select(id_col, "component_id")
