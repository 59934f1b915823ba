"""Corpus-wide lookups of window hashes, in packed form.

Documents are dealt by hash to blocks of about BLOCK_BYTES of text. A block hashes what it asks about, packs its
distinct hashes by shard (dealt by a second hash) into one binary value a shard, and each shard
answers for all blocks at once. A hash that very many documents share reaches its shard once a
block, so no key is hot; answers are codes in the order of the block's sorted hashes, which the block
makes again from its text, so hashes are sent one way only. Shards and blocks grow in number, not in size,
with the input (a single longer text makes one longer block).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import row_key

BLOCK_BYTES, SHARD_BYTES = 2 << 20, 32 << 20
ASKED = "shard int, block int, hashes binary, extra binary"
ANSWER = "block int, level int, shard int, codes binary"


def blocks(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """block, id, text of every row, and the number of shards."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n, shards = max(least, -(-size // BLOCK_BYTES)), max(-(-least // 2), -(-size // SHARD_BYTES))
    block = F.pmod(row_key(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")
    return df.select(block.alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), int(shards)


def pieces(table: pa.Table, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Row numbers and texts (UTF-8; null: empty) of a block, in groups of about `most` bytes."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(table["text"]):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        if rows and size + len(raw) > most:
            yield np.array(rows), texts
            rows, texts, size = [], [], 0
        rows.append(i)
        texts.append(raw)
        size += len(raw)
    if rows:
        yield np.array(rows), texts


class Asked:
    """What a block asks about: distinct hashes, each with its shard and an int64 (smallest of its occurrences' values, or their number)."""

    def __init__(self, hashes: list[np.ndarray], second: list[np.ndarray], values: list[np.ndarray], how: str):
        h, s, v = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, second, values))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.hashes, self.second = h[first], s[order][first]
        v = v[order]
        if how == "count":
            self.values = np.diff(np.concatenate([first, [len(h)]]))
        else:
            self.values = np.minimum.reduceat(v, first) if len(h) else np.zeros(0, np.int64)

    def shards(self, n: int) -> np.ndarray:
        return (self.second % np.uint64(n)).astype(np.int64)

    def table(self, block: int, n: int, extra: Callable[[np.ndarray], bytes]) -> pa.Table:
        """One row for each shard asked."""
        shard = self.shards(n)
        order = np.argsort(shard, kind="stable")  # hashes stay sorted within a shard
        cuts = np.searchsorted(shard[order], np.arange(n + 1))
        rows = [(s, block, self.hashes[p].tobytes(), extra(p)) for s in np.unique(shard) if len(p := order[cuts[s] : cuts[s + 1]])]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["shard", "block", "hashes", "extra"])

    def codes(self, n: int, answers: dict[int, bytes]) -> np.ndarray:
        """The answers' codes (uint8), for each hash."""
        out, shard = np.zeros(len(self.hashes), np.uint8), self.shards(n)
        for s in np.unique(shard):
            out[shard == s] = np.frombuffer(answers[int(s)], np.uint8)
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that are all among those asked."""
        return np.searchsorted(self.hashes, hashes)


def answered(table: pa.Table, level: int) -> dict[int, bytes]:
    """Codes by shard of one level, from a block's answers."""
    return {s: c for lv, s, c in zip(table["level"].to_pylist(), table["shard"].to_pylist(), table["codes"].to_pylist(), strict=True) if lv == level}


def answers(level: int, decide: Callable[[np.ndarray, np.ndarray, list[bytes], np.ndarray], np.ndarray]):
    """A shard's work: decide(all hashes, block of each, extras of each block, number of each block's hashes) -> uint8 codes."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        sizes = np.array([len(p) for p in parts])
        codes = decide(np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), table["extra"].to_pylist(), sizes)
        ends = np.cumsum(sizes)
        cut = [codes[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
        n = len(parts)
        return pa.table([table["block"], pa.array([level] * n, pa.int32()), table["shard"], pa.array(cut, pa.binary())], names=["block", "level", "shard", "codes"])

    return run


def both(one: pa.Table, two: pa.Table, shards: int) -> pa.Table:
    """Two kinds of questions together: the second's shards come behind the first's."""
    import pyarrow.compute as pc

    moved = pc.add(two["shard"], pa.scalar(shards, pa.int32()))
    return pa.concat_tables([one, two.set_column(0, "shard", moved)])


def answers_of_both(shards: int, one: Callable, two: Callable):
    """The work of a shard of either kind."""
    import pyarrow.compute as pc

    def run(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < shards:
            return one(table)
        return two(table.set_column(table.schema.get_field_index("shard"), "shard", pc.subtract(table["shard"], pa.scalar(shards, pa.int32()))))

    return run


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts h, and the group number of each sorted entry."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    return order, np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool))


def recurring(h: np.ndarray, block: np.ndarray, extras: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """1 where a hash occurs twice: in two blocks, or (extra: a flag byte each) twice in its own."""
    twice = np.concatenate([np.frombuffer(x, np.uint8) for x in extras])
    order, group = groups(h)
    times = np.bincount(group, weights=1 + twice[order])
    out = np.zeros(len(h), np.uint8)
    out[order] = times[group] > 1
    return out
