"""Benchmark decontamination by greedy string tiling.

Tokens are runs of word characters, lower case; in scripts written without spaces each character is one. A document and a benchmark item that share a seed
(SEED consecutive tokens) are tiled: running Karp-Rabin finds the longest common runs of tokens that no
tile covers yet, the longest are marked first, and the search length shrinks until SEED. The share of the item's
tokens under tiles is its coverage, whatever order they stand in, so reordered passages count too.
A document is contaminated when an item's coverage reaches COVERAGE.

The benchmark is broadcast only while its texts take at most BROADCAST_BYTES; beyond that, seeds
are joined by shuffle and only documents and items that share one meet. Both ways cut and compare tokens alike.

Edge cases: null and empty texts and items, and items shorter than SEED tokens, match nothing
(coverage 0, item null); ties in coverage go to the smallest item id; item ids are integers (others raise before a job starts), null ones are ignored;
repeated items and rows and null document ids do no harm; extra columns stay; empty tables work.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import mix, put_back, row_key, set_aside, whole_numbers, written

SEED = 5
COVERAGE = 0.6
ADDED = ("coverage", "item_id", "contaminated")
#: Most bytes of benchmark text that are broadcast (a worker holds some ten times as much for tokens and seeds).
BROADCAST_BYTES = 24 << 20
#: Scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_SINGLE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_SINGLE}]|[^\W{_SINGLE}]+")
_P = 0x9E3779B97F4A7C15 | 1
_BUCKETS = 1 << 20


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every n consecutive ids (uint64)."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(_P) + ids[i : i + len(h)]
    return mix(h)


def _free_runs(marked: np.ndarray, n: int) -> np.ndarray:
    """True where n unmarked tokens start."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[n:] == total[: len(total) - n]


def _matches(item, doc, item_marked, doc_marked, length):
    """(length, item start, document start) of the maximal common unmarked runs of at least `length`, by running hashes."""
    starts = defaultdict(list)
    for p, (h, free) in enumerate(zip(gram_hashes(item, length).tolist(), _free_runs(item_marked, length), strict=True)):
        if free:
            starts[h].append(p)
    hashes, free = gram_hashes(doc, length), _free_runs(doc_marked, length)
    wanted = np.flatnonzero(free & np.isin(hashes, np.array(list(starts), np.uint64)))
    out = []
    for t in wanted.tolist():
        for p in starts[int(hashes[t])]:
            if p and t and item[p - 1] == doc[t - 1] and not item_marked[p - 1] and not doc_marked[t - 1]:
                continue  # goes on to the left: found from there
            n, most = 0, min(len(item) - p, len(doc) - t)
            while n < most and item[p + n] == doc[t + n] and not item_marked[p + n] and not doc_marked[t + n]:
                n += 1
            if n >= length:
                out.append((n, p, t))
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> int:
    """Tokens of item under tiles: longest matches first, none overlapping, each of at least `least` tokens."""
    item_marked, doc_marked = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    length = max(least, min(len(item), 16))
    while True:
        found = _matches(item, doc, item_marked, doc_marked, length) if length <= min(len(item), len(doc)) else []
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        occluded = False
        for n, p, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if item_marked[p : p + n].any() or doc_marked[t : t + n].any():
                occluded = True
                continue
            item_marked[p : p + n] = doc_marked[t : t + n] = True
        if occluded:
            continue  # what is left of an overlapped match may still be long enough
        if length == least:
            return int(item_marked.sum())
        length = max(least, length // 2)


class Benchmark:
    """Items as token numbers, and which items hold each seed."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items, pairs = {}, []
        for item, text in items:
            words = tokens(text)
            if item is None or len(words) < SEED:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            where = (item, len(self.items))
            self.items[where] = ids
            pairs += [(h, where) for h in set(gram_hashes(ids, SEED).tolist())]
        self.seeds = np.unique(np.array([h for h, _ in pairs], np.uint64))
        self.holders = defaultdict(list)
        for h, where in pairs:
            self.holders[h].append(where)

    def best(self, text: str | None, only: set | None = None) -> tuple[float, int | None]:
        """Highest coverage of an item in text, and that item."""
        find = self.vocabulary.get
        words = tokens(text)
        ids = np.fromiter((find(w, 0) for w in words), np.uint64, len(words))
        if not len(self.seeds) or len(ids) < SEED:
            return 0.0, None
        hashes = gram_hashes(ids, SEED)
        hits = np.unique(hashes[self.seeds[np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)] == hashes])
        at = {where for h in hits.tolist() for where in self.holders[h]}
        scored = [(tile(self.items[w], ids) / len(self.items[w]), -w[0]) for w in at if only is None or w[0] in only]
        coverage, item = max(scored, default=(0.0, None))
        return coverage, None if item is None else -item


def _flag(df: DataFrame, make, text_col: str) -> DataFrame:
    keep = [c for c in df.columns if c.lower() not in ADDED]
    schema = df.select(*keep).schema.add("coverage", "double").add("item_id", "long").add("contaminated", "boolean")
    place = keep.index(text_col)

    def run(batches):
        benchmark = make()
        for batch in batches:
            found = [benchmark.best(t) for t in batch.column(place).to_pylist()]
            extra = (pa.array([c for c, _ in found], pa.float64()), pa.array([i for _, i in found], pa.int64()), pa.array([c >= COVERAGE for c, _ in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*keep, "coverage", "item_id", "contaminated"])

    return df.select(*keep).mapInArrow(run, schema)


def _seeds_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, _key, seed: distinct seeds, hashed over word hashes that need no common vocabulary."""
    rows = df.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))

    def run(batches):
        import xxhash

        for batch in batches:
            seeds = []
            for text in batch.column(2).to_pylist():
                words = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in tokens(text)], np.uint64)
                seeds.append(np.unique(gram_hashes(words, SEED)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seeds, pa.list_(pa.int64()))], ["_id", "_key", "seeds"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _key bigint, seeds array<bigint>").select("_id", "_key", F.explode("seeds").alias("seed"))


def _flag_by_join(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For benchmarks beyond the bound: documents and items meet over shared seeds; a document's text travels once, and meets its items in a group of its own."""
    df, own = set_aside(df, ADDED)
    keep = {c: n for c, n in own.items() if c.lower() not in ADDED}
    id_col, text_col = own[id_col], own[text_col]
    items = benchmark.select("item_id", "text").where("item_id is not null")
    item_seeds = _seeds_of(items, "item_id", "text").select(F.col("_id").alias("item_id"), F.col("_key").alias("item_key"), "seed")
    doc = F.xxhash64("_id", "_key")
    pairs = written(_seeds_of(df, id_col, text_col).join(item_seeds, "seed").select("_id", "_key", "item_id", "item_key").distinct(), "leak-pairs")
    item_texts = items.select(F.col("item_id").alias("item2"), row_key(F.col("item_id"), F.col("text")).alias("item_key2"), F.col("text").alias("item_text")).dropDuplicates(["item2", "item_key2"])
    asked = pairs.join(item_texts, (F.col("item_id") == F.col("item2")) & (F.col("item_key") == F.col("item_key2"))).select(doc.alias("doc"), "_id", "_key", "item_id", "item_text")
    # only texts that meet an item are shuffled: at most _BUCKETS rows are broadcast to tell them
    bucket = F.pmod(F.col("doc"), F.lit(_BUCKETS)).alias("bucket")
    texts = df.select(F.xxhash64(F.col(id_col), row_key(F.col(id_col), F.col(text_col))).alias("doc"), F.col(text_col).alias("doc_text")).withColumn("bucket", bucket)
    texts = texts.join(F.broadcast(pairs.select(doc.alias("doc")).select(bucket).distinct()), "bucket", "left_semi").groupBy("doc").agg(F.first("doc_text").alias("doc_text"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(text: pa.Table, met: pa.Table) -> pa.Table:
        if not (text.num_rows and met.num_rows):
            return pa.table({"_id": met["_id"].slice(0, 0), "_key": met["_key"].slice(0, 0), "item_id": pa.array([], pa.int64()), "coverage": pa.array([], pa.float64())})
        coverage, item = Benchmark(list(zip(met["item_id"].to_pylist(), met["item_text"].to_pylist(), strict=True))).best(text["doc_text"][0].as_py())
        return pa.table({"_id": met["_id"].slice(0, 1), "_key": met["_key"].slice(0, 1), "item_id": pa.array([item], pa.int64()), "coverage": pa.array([coverage], pa.float64())})

    scored = texts.select("doc", "doc_text").groupBy("doc").cogroup(asked.groupBy("doc")).applyInArrow(run, f"_id {kind}, _key bigint, item_id bigint, coverage double")
    best = scored.where("coverage > 0").select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), F.col("coverage").alias("_c"), F.col("item_id").alias("_i"))
    rows = df.withColumn("_key", row_key(F.col(id_col), F.col(text_col))).join(best, F.col(id_col).eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), "left")
    coverage = F.coalesce("_c", F.lit(0.0))
    found = rows.withColumns({"coverage": coverage, "item_id": F.col("_i"), "contaminated": coverage >= COVERAGE})
    return put_back(found, keep | {c: c for c in ADDED})


def flag(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with coverage (highest of an item), item_id (that item) and contaminated, which replace columns so named in any case."""
    spark = df.sparkSession
    whole_numbers(benchmark, "item_id")
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    if size > broadcast_bytes:
        return _flag_by_join(df, benchmark, id_col, text_col)
    items = sorted((r.item_id, r.text or "") for r in benchmark.select("item_id", "text").where("item_id is not null").distinct().toLocalIterator())
    shipped = spark.sparkContext.broadcast(items)  # at most broadcast_bytes, counted above
    return _flag(df, lambda: Benchmark(shipped.value), text_col)
