"""Hard negatives by exact integer scores, computed with the Four Russians' tables.

Components become floor(256 * x). Eight of a candidate's components at a time give a byte for each bit plane of their two's
complement; an anchor's table holds, for every byte, the sum of those of its eight components that the byte selects. A score is then
the sum over planes and groups of looked-up sums, shifted by the plane: adding from the top plane down, doubled from each to the next, so
no product is formed and nothing is rounded.

Candidates are dealt by hash to blocks of about BLOCK rows, packed once into bit planes; anchors, the stated query set, to blocks of
ANCHORS. Each pair of blocks is one group of a cogroup, and gives an anchor at most `positives` rows, later at most `negatives` rows an
(anchor, positive) pair; a second ranking over all blocks leaves the first ones. Scores are computed twice, since the interval for
negatives is known only once an anchor's positives are.

Edge cases: rows with a null id, label or vector, or a null, non-finite or, in absolute value, 32,768 or larger component take no part; repeated rows
count once; rows that share an id but differ otherwise are different rows, and as anchors their results stand side by side; the
shorter of two vectors counts as padded with zeros; ties go by smaller id; extra columns are ignored; an anchor without
positives, or a positive whose interval holds nobody, gives no row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonguemill.llm.common import written

BLOCK, ANCHORS = 8192, 1024
#: Anchors whose tables are looked up together.
_TOGETHER = 64
_PACKED = "block int, size int, width int, planes int, bits binary, ids binary, keys binary, labels binary"


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, padded with zeros to a multiple of eight."""
    length = pc.list_value_length(vectors).to_numpy()
    width = max(8, -(-int(length.max(initial=0)) // 8) * 8)
    out = np.zeros((len(length), width), np.int64)
    flat = pc.list_flatten(vectors).to_numpy()
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _packed(table: pa.Table) -> pa.Table:
    """One row of a block: its rows by id, their components as bit planes (plane, group of eight, row)."""
    table = table.sort_by([("id", "ascending"), ("key", "ascending")])
    q = _matrix(table["vector"])
    planes = int(max(q.max(initial=0), -q.min(initial=0) - 1)).bit_length() + 1
    bits = np.stack([np.packbits(((q >> k) & 1).astype(np.uint8), axis=1, bitorder="little").T for k in range(planes)])
    ids, keys, labels = (table[c].to_numpy().tobytes() for c in ("id", "key", "label"))
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "size": pa.array([len(q)], pa.int32()), "width": pa.array([q.shape[1]], pa.int32()), "planes": pa.array([planes], pa.int32()), "bits": [bits.tobytes()], "ids": [ids], "keys": [keys], "labels": [labels]})


def tables(anchors: np.ndarray) -> np.ndarray:
    """Sums over the subsets of each eight components (group, byte, anchor)."""
    n, width = anchors.shape
    own = anchors.reshape(n, width // 8, 8).transpose(1, 2, 0)
    out = np.zeros((width // 8, 1, n), anchors.dtype)
    for d in range(8):
        out = np.concatenate([out, out + own[:, d : d + 1]], axis=1)
    return out


def scores(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products (anchor, candidate) of candidates given as bit planes with anchors of the same width."""
    planes, groups, n = bits.shape
    most = int(np.abs(anchors).max(initial=0)) * (groups * 8) << planes
    sums = tables(anchors.astype(np.int32 if most < 1 << 31 else np.int64))
    out, looked = np.zeros((n, len(anchors)), sums.dtype), np.empty((n, len(anchors)), sums.dtype)
    for k in range(planes - 1, -1, -1):
        out += out
        for g in range(groups):
            np.take(sums[g], bits[k, g], axis=0, out=looked, mode="clip")
            if k == planes - 1:  # the sign's plane
                out -= looked
            else:
                out += looked
    return np.ascontiguousarray(out.T)


class _Block:
    """A packed block of candidates, and its scores against anchors."""

    def __init__(self, table: pa.Table):
        row = {c: table[c][0].as_py() for c in table.column_names}
        self.width = row["width"]
        self.bits = np.frombuffer(row["bits"], np.uint8).reshape(row["planes"], self.width // 8, row["size"])
        self.ids, self.keys, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "keys", "labels"))

    def against(self, anchors: pa.Table):
        """For each anchor: its place, its scores."""
        q = _matrix(anchors["vector"])[:, : self.width]
        q = np.pad(q, ((0, 0), (0, self.width - q.shape[1])))
        for i in range(0, len(q), _TOGETHER):
            for j, own in enumerate(scores(self.bits, q[i : i + _TOGETHER])):
                yield i + j, own


def _first(score: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Of the places `among` (ascending), the first `most` by score, then place."""
    own = score[among]
    if len(among) > most:  # what ties with the last one stays until the sort
        keep = own >= np.partition(own, len(own) - most)[len(own) - most]
        among, own = among[keep], own[keep]
    return among[np.argsort(-own, kind="stable")[:most]]


def _best(most: int):
    """An anchor's best candidates of its label in a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score")}
        if left.num_rows and right.num_rows:
            block = _Block(left)
            of = {label: np.flatnonzero(block.labels == label) for label in np.unique(block.labels).tolist()}
            ids, keys, labels = (right[c].to_numpy() for c in ("id", "key", "label"))
            for a, score in block.against(right):
                among = of.get(int(labels[a]), np.zeros(0, np.int64))
                among = among[(block.ids[among] != ids[a]) | (block.keys[among] != keys[a])]
                found = _first(score, among, most)
                for c, values in zip(out, (np.full(len(found), ids[a]), np.full(len(found), keys[a]), block.ids[found], block.keys[found], score[found].astype(np.int64)), strict=True):
                    out[c].append(values)
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in out.items()})

    return run


def _within(most: int):
    """An anchor's first candidates of other labels with a score of 0.8 to 1 of each positive's, in a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score", "negative_id", "negative_key", "negative_score")
        rows = []
        if left.num_rows and right.num_rows:
            block = _Block(left)
            ids, keys, labels, asked = right["id"].to_numpy(), right["key"].to_numpy(), right["label"].to_numpy(), right["positives"].to_pylist()
            for a, score in block.against(right):
                least = [-(-4 * p["score"] // 5) for p in asked[a]]
                among = np.flatnonzero((block.labels != labels[a]) & (score >= min(least)) & (score <= max(p["score"] for p in asked[a])))
                among = among[np.argsort(-score[among].astype(np.int64), kind="stable")]
                down = -score[among].astype(np.int64)
                for p, low in zip(asked[a], least, strict=True):
                    first = np.searchsorted(down, -p["score"])
                    for x in among[first : first + most]:
                        if score[x] >= low:
                            rows.append((ids[a], keys[a], p["id"], p["key"], p["score"], block.ids[x], block.keys[x], score[x]))
        columns = np.array(rows, np.int64).reshape(-1, len(names)).T
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=True)})

    return run


def hard_negatives(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: of each anchor (rows where `anchor` holds) and each of its
    first `positives` rows of its label, the first `negatives` rows of other labels that score 0.8 to 1 times as much."""
    x = F.col("vector")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < 32768, F.lit(False)))).distinct()
    key = F.xxhash64("label", "vector")
    rows = written(rows.select("id", key.alias("key"), "label", F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vector"), "asks"), "vectors")
    n, asked = rows.count(), rows.where("asks").count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-asked // ANCHORS))
    dealt = lambda m: F.pmod(F.xxhash64("id", "key"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    packed = written(rows.select("id", "key", "label", "vector", dealt(blocks).alias("block")).groupBy("block").applyInArrow(_packed, _PACKED), "planes")
    packed = packed.withColumn("group", each(groups)).groupBy("block", "group")
    anchors = rows.where("asks").select("id", "key", "label", "vector", dealt(groups).alias("group"))

    schema = "anchor_id bigint, anchor_key bigint, positive_id bigint, positive_key bigint, positive_score bigint"
    best = packed.cogroup(anchors.withColumn("block", each(blocks)).groupBy("block", "group")).applyInArrow(_best(positives), schema)
    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    best = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= positives)
    asking = best.groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_key").alias("key"), F.col("positive_score").alias("score"))).alias("positives"))
    asking = written(anchors.join(asking, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))).drop("anchor_id", "anchor_key"), "asking")

    schema += ", negative_id bigint, negative_key bigint, negative_score bigint"
    found = packed.cogroup(asking.withColumn("block", each(blocks)).groupBy("block", "group")).applyInArrow(_within(negatives), schema)
    order = Window.partitionBy("anchor_id", "anchor_key", "positive_id", "positive_key").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
