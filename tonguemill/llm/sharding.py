"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are one group, which no shard boundary cuts. Groups enter, largest first, the bin in
which they leave the least room; the bins' rooms are kept in a balanced tree (a treap), so each step costs the logarithm of their number.
`bins_needed` opens bins of a fixed capacity as it goes; `even_bins` has a given number of bins, whose capacity is an even share, so that they come
out near equal.

At scale it works in two levels. Groups are pre-aggregated by text hash. Those that hold one in ITEMS of all bytes or rows stand for
themselves; there are at most 2 * ITEMS of them. The rest is dealt by hash to parts of about PART_GROUPS groups, and each part packs its own
into crates of one ITEMS-th of all bytes. One task then packs the large groups and the crates, of which there are some 3 * ITEMS and one more a part,
into the shards: it sees sizes, never rows. A group larger than an even share gets a shard to itself, and the others share what is left,
so a hot group makes its own shard large and no other.

Edge cases: null texts have no bytes and are one group with empty ones; ids may be null and repeat, each row has its own slot; equal sizes
go by hash; texts with one 64-bit hash (by chance, if they differ) go together, which breaks no law; extra columns are
ignored; an empty table gives an empty result; shards without rows do not appear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import numbered, written

#: Crates that the corpus would fill, and groups of a part.
ITEMS, PART_GROUPS = 24_576, 50_000
#: Bytes of a row besides its text.
ROW_BYTES = 8


class Rooms:
    """The bins by (room, number) in a treap, whose nodes are the bins themselves."""

    def __init__(self):
        self.room, self.left, self.right, self.rank, self.root = [], [], [], [], -1

    def add(self, room: int) -> int:
        """A new bin."""
        node = len(self.room)
        self.room.append(room)
        self.left.append(-1)
        self.right.append(-1)
        self.rank.append(node * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)  # in place of chance, so that a retry gives the same
        self._insert(node)
        return node

    def tightest(self, size: int) -> int:
        """The bin with the least room that is enough, -1 if none has."""
        node, best = self.root, -1
        while node >= 0:
            if self.room[node] >= size:
                node, best = self.left[node], node
            else:
                node = self.right[node]
        return best

    def roomiest(self) -> int:
        node = self.root
        while self.right[node] >= 0:
            node = self.right[node]
        return node

    def fill(self, node: int, size: int) -> None:
        self._remove(node)
        self.room[node] -= size
        self._insert(node)

    def _before(self, a: int, b: int) -> bool:
        return (self.room[a], a) < (self.room[b], b)

    def _merge(self, a: int, b: int) -> int:
        """One tree of two, all of whose bins in a come before those in b."""
        if a < 0 or b < 0:
            return max(a, b)
        if self.rank[a] > self.rank[b]:
            self.right[a] = self._merge(self.right[a], b)
            return a
        self.left[b] = self._merge(a, self.left[b])
        return b

    def _split(self, tree: int, node: int) -> tuple[int, int]:
        """The bins of tree before node, and the others."""
        if tree < 0:
            return -1, -1
        if self._before(tree, node):
            self.right[tree], rest = self._split(self.right[tree], node)
            return tree, rest
        first, self.left[tree] = self._split(self.left[tree], node)
        return first, tree

    def _hang(self, parent: int, node: int, new: int) -> None:
        """Puts new where node hangs below parent."""
        if parent < 0:
            self.root = new
        elif self.left[parent] == node:
            self.left[parent] = new
        else:
            self.right[parent] = new

    def _insert(self, node: int) -> None:
        parent, at = -1, self.root
        while at >= 0 and self.rank[at] >= self.rank[node]:
            parent, at = at, self.left[at] if self._before(node, at) else self.right[at]
        self.left[node], self.right[node] = self._split(at, node)
        if parent < 0:
            self.root = node
        elif self._before(node, parent):
            self.left[parent] = node
        else:
            self.right[parent] = node

    def _remove(self, node: int) -> None:
        parent, at = -1, self.root
        while at != node:
            parent, at = at, self.left[at] if self._before(node, at) else self.right[at]
        self._hang(parent, node, self._merge(self.left[node], self.right[node]))


def bins_needed(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size (given largest first), in as few bins of the capacity as best fit opens; larger ones get bins of their own."""
    rooms, out = Rooms(), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = rooms.tightest(size)
        out[i] = node = rooms.add(max(capacity, size)) if node < 0 else node
        rooms.fill(node, size)
    return out


def even_bins(sizes: np.ndarray, bins: int) -> np.ndarray:
    """One of `bins` for each size (given largest first): those above an even share of what is left get one each; the others are packed by best fit at the
    capacity of an even share, and what then fits nowhere, which is small as it comes late, goes where most room is."""
    own, total = 0, int(sizes.sum())
    while own < min(bins - 1, len(sizes)) and int(sizes[own]) * (bins - own) >= total:
        total -= int(sizes[own])
        own += 1
    rooms, out = Rooms(), np.arange(len(sizes))
    for _ in range(bins - own):
        rooms.add(total // (bins - own))
    for i, size in enumerate(sizes[own:].tolist(), own):
        node = rooms.tightest(size)
        node = rooms.roomiest() if node < 0 else node
        rooms.fill(node, size)
        out[i] = own + node
    return out


def _crates(capacity: int):
    """Packs a part's groups (part, key, bytes) into crates."""

    def run(table: pa.Table) -> pa.Table:
        key, size, part = (table[c].to_numpy() for c in ("key", "bytes", "part"))
        order = np.lexsort((key, -size))
        crate = bins_needed(size[order], capacity)
        return pa.table({"key": key[order], "crate": part.astype(np.int64) << 32 | crate, "bytes": size[order]})

    return run


def _shards(bins: int):
    """Packs items (own: a group by itself, item, bytes) into shards; all of them come to this one task."""

    def run(batches):
        there = list(batches)
        if not there:
            return
        table = pa.Table.from_batches(there)
        own, item, size = (table[c].to_numpy() for c in ("own", "item", "bytes"))
        order = np.lexsort((item, own, -size))
        shard = even_bins(size[order], bins)
        yield from pa.table({"own": own[order], "item": item[order], "shard": shard.astype(np.int32)}).to_batches()

    return run


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """rows (with key, size) and shard: groups by key, whole."""
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    count, total, n = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    large = (F.col("bytes") * ITEMS >= total) | (F.col("n") * ITEMS >= n)
    part = F.pmod(F.xxhash64("key"), F.lit(-(-count // PART_GROUPS) or 1)).cast("int")
    crates = written(groups.where(~large).select("key", "bytes", part.alias("part")).groupBy("part").applyInArrow(_crates(max(1, total // ITEMS)), "key bigint, crate bigint, bytes bigint"), "crates")
    items = groups.where(large).select(F.lit(True).alias("own"), F.col("key").alias("item"), "bytes")
    items = items.unionByName(crates.groupBy("crate").agg(F.sum("bytes").alias("bytes")).select(F.lit(False).alias("own"), F.col("crate").alias("item"), "bytes"))
    known = written(items.coalesce(1).mapInArrow(_shards(shards), "own boolean, item bigint, shard int"), "shards")
    # large groups, among them all that many rows share, are looked up in a broadcast of at most 2 * ITEMS rows
    own = known.where("own").select(F.col("item").alias("_key"), F.col("shard").alias("_own"))
    met = rows.join(F.broadcast(own), F.col("key") == F.col("_key"), "left").drop("_key")
    small = crates.select("key", "crate").join(known.where("not own").select(F.col("item").alias("crate"), "shard"), "crate").select("key", "shard")
    alone = met.where("_own is not null").withColumnRenamed("_own", "shard")
    return alone.unionByName(met.where("_own is null").drop("_own").join(small, "key"))


def shard(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law (bytes), shard (from 0), slot (from 0 within the shard, by id) and grown_shard (null) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("_place"))
    rows = written(placed(written(rows, "rows"), shards), "placed")
    number = numbered(rows, [F.col("shard"), F.col("_id").asc_nulls_last(), F.col("key"), F.col("_place")], within="shard")
    return number.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
