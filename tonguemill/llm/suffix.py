"""Repeated byte strings of LENGTH: suffix grouping over the places that hashes cannot settle.

Every LENGTH-byte window selects an anchor among its first starts (the smallest hash of GRAM bytes), so
equal windows select equal anchors.

1. Coarse anchors (of COARSE + 1 starts): the LENGTH - COARSE bytes behind an anchor lie in each of its windows. Where
   they occur once, none of the windows around the anchor repeats.
2. Fine anchors (of FINE + 1 starts) of what is left: the core, LENGTH - FINE bytes behind the anchor, with the
   FINE bytes on either side, is a context. A context that occurs twice repeats in all its windows.
3. Contexts that occur once though their core does not are where repeats begin and end. They are
   written as strings with the core as one symbol, and each shard sorts the suffixes of its strings by
   linear grouping: a window repeats when its suffix shares FINE + 1 symbols with a neighbour's.
4. All contexts of a core are sorted together, so a core with more than MANY (a passage in very many documents, with
   other text around it in each) is not sorted: hashes of its windows, dealt by themselves, are counted instead.

The suffix array is built by grouping (`suffix_array`): groups of suffixes with equal Lyndon prefixes are
processed in descending order along previous-smaller pointers, and a second pass emits each
group's order, without renaming or recursion.

Only contexts go to the suffix array, not whole texts: in Python it costs a few microseconds a symbol.

Edge cases: null and empty texts have no bytes; matches never cross documents; rows equal in id and
text are one document; rows that share only an id are different ones; null ids work as any id; extra columns are ignored; empty tables
give empty results. Two strings count as equal when 64-bit hashes and their shards (dealt by a second hash) agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonguemill.llm import blocks as B
from tonguemill.llm.common import PrefixHash, mix, window_minima

LENGTH, GRAM, COARSE, FINE = 400, 16, 100, 20
#: Contexts of a core, counted once a block, beyond which they are not sorted.
MANY = 1024
_ONE, _TWO = PrefixHash(31), PrefixHash(32, 0xD6E8FEB86659FD93)
_RECORD = 8 + 1 + 2 + 2 * FINE


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s in ascending order; the last symbol is smaller than all others and unique."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    _, begin, size_of = np.unique(s[sa], return_index=True, return_counts=True)
    size = np.zeros(n, np.int64)
    size[begin] = size_of
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(begin, size_of)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    sa, group, place, size = sa.tolist(), group.tolist(), place.tolist(), size.tolist()
    prev = [-1] * n
    end = n - 1
    while end >= 0:  # groups in descending order
        start = group[sa[end]]
        members = sa[start : end + 1] if end == start else sorted(sa[start : end + 1])
        counts: dict[int, int] = {}
        for i in members:  # nearest suffix to the left in a lower group; those of this group point on
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            most = max(counts.values())
            levels: list[list[int]] = [[] for _ in range(most + 1)]
            for j, c in counts.items():
                levels[c].append(j)
            for c in range(most, 0, -1):  # with more pointers: higher
                moved: dict[int, int] = {}
                for j in levels[c]:
                    g = group[j]
                    m = moved.get(g, 0)
                    last = g + size[g] - 1 - m  # to the end of its group
                    p, other = place[j], sa[last]
                    sa[p], sa[last] = other, j
                    place[other], place[j] = p, last
                    moved[g] = m + 1
                for g, m in moved.items():
                    new = g + size[g] - m
                    if m < size[g]:
                        for k in range(new, new + m):
                            group[sa[k]] = new
                        size[g] -= m
                        size[new] = m
        end = start - 1
    out, free, done = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
    return np.array(out, np.int64)


def repeats(keys: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Of distinct contexts (core's key, bytes before it, bytes behind): bit t is set where another context
    of the key has the same last t bytes before and first FINE - t behind."""
    n = len(keys)
    _, core = np.unique(keys, return_inverse=True)
    lengths = np.array([len(a) + len(b) + 2 for a, b in zip(left, right, strict=True)])
    ends = np.cumsum(lengths)
    symbols = np.ones(int(ends[-1]) + 1, np.int64)  # 1 ends a string, 0 ends all
    symbols[-1] = 0
    begins = ends - lengths
    behind = np.array([len(a) for a in left])
    body = np.ones(len(symbols), bool)
    body[begins + behind] = body[ends - 1] = body[-1] = False
    symbols[begins + behind] = 300 + core
    symbols[body] = np.frombuffer(b"".join(a + b for a, b in zip(left, right, strict=True)), np.uint8).astype(np.int64) + 2
    sa = suffix_array(symbols)
    owner = np.repeat(np.arange(n), lengths)
    sa = sa[sa < len(owner)]
    own = owner[sa]
    before = (begins + behind)[own] - sa  # symbols before the core: the suffix starts t bytes ahead of it
    sa = sa[(before >= 0) & (before <= FINE) & (sa + FINE + 1 < ends[own])]
    out = np.zeros(n, np.int64)
    if len(sa) > 1:
        windows = symbols[sa[:, None] + np.arange(FINE + 1)]
        same = (windows[1:] == windows[:-1]).all(1)
        hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = sa[hit]
        np.bitwise_or.at(out, owner[at], 1 << ((begins + behind)[owner[at]] - at))
    return out


class _Bytes:
    """A group of texts in one buffer, with the windows that stay within a text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        fits = np.maximum(sizes - LENGTH + 1, 0)
        self.at = np.arange(fits.sum()) + np.repeat(self.begins - (np.cumsum(fits) - fits), fits)  # starts of windows
        self.prefix = _ONE.prefix(self.data)
        self.two = None
        self.grams = _ONE.grams(self.prefix, GRAM) if len(self.at) else None

    def anchors(self, reach: int, at: np.ndarray) -> np.ndarray:
        return window_minima(self.grams, reach + 1)[at] if len(at) else at

    def hashes(self, start, end) -> np.ndarray:
        return _ONE.spans(self.prefix, start, end)

    def second(self, start, end) -> np.ndarray:
        if self.two is None:
            self.two = _TWO.prefix(self.data)
        return _TWO.spans(self.two, start, end)


def _distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows without those equal in id and text, and for every row the place of its equal."""
    seen: dict = {}
    back = np.array([seen.setdefault((i.as_py(), t.as_py()), len(seen)) for i, t in zip(table["id"], table["text"], strict=True)], np.int64)
    return table.take(pa.array(np.unique(back, return_index=True)[1])), back


def _runs(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors and the place of each one's; anchors of ascending windows ascend, so nothing is sorted."""
    begins = np.diff(anchors, prepend=-1) != 0
    return anchors[begins], np.cumsum(begins) - 1


def _coarse(table: pa.Table) -> tuple[B.Asked, list]:
    """What the block asks about, and for each group of texts: rows, texts, bytes, the windows' anchors by place, the anchors' hashes."""
    groups, second = [], []
    for rows, texts in B.pieces(table):
        own = _Bytes(texts)
        a, back = _runs(own.anchors(COARSE, own.at))
        groups.append((rows, texts, own, back, own.hashes(a, a + LENGTH - COARSE)))
        second.append(own.second(a, a + LENGTH - COARSE))
    hashes = [g[4] for g in groups]
    return B.Asked(hashes, second, [np.zeros(len(h), np.int64) for h in hashes], "count"), groups


class _Fine:
    """Fine anchors of the windows that coarse anchors leave, and the contexts and cores that the block asks about."""

    def __init__(self, table: pa.Table, shards: int, found: pa.Table):
        coarse, groups = _coarse(table)
        again = coarse.codes(shards, B.answered(found, 1)) == 1
        self.groups, contexts, keys, second, core_second = [], [], [], [], []
        for rows, texts, own, back, known in groups:
            at = own.at[again[coarse.find(known)][back]] if len(known) else own.at
            anchor, of = _runs(own.anchors(FINE, at))
            core_end = anchor + LENGTH - FINE
            text = np.searchsorted(own.ends, anchor, side="right")
            left, right = np.maximum(anchor - FINE, own.begins[text]), np.minimum(core_end + FINE, own.ends[text])
            key = own.hashes(anchor, core_end)
            context = mix(key ^ mix(own.hashes(left, right) + ((anchor - left) * 64 + right - core_end).astype(np.uint64)))
            self.groups.append((rows, texts, own, at, of, anchor, left, right, context))
            contexts.append(context)
            keys.append(key)
            second.append(own.second(left, right))
            core_second.append(own.second(anchor, core_end))
        self.contexts = B.Asked(contexts, second, [k.view(np.int64) for k in keys], "least")  # a context's value is its core's key
        self.times = B.Asked(contexts, second, contexts, "count").values
        self.cores = B.Asked(keys, core_second, [c.view(np.int64) for c in contexts], "least")  # a core's value is one of its contexts
        of_core = self.cores.find(self.contexts.values.view(np.uint64))
        self.of_core, self.variety = of_core, np.bincount(of_core, minlength=len(self.cores.hashes))

    def ask(self, block: int, shards: int) -> pa.Table:
        contexts = self.contexts.table(block, shards, lambda p: (self.times[p] > 1).astype(np.uint8).tobytes())
        return B.both(contexts, self.cores.table(block, shards, lambda p: self.cores.values[p].tobytes() + self.variety[p].astype(np.int32).tobytes()), shards)

    def status(self, shards: int, found: pa.Table) -> None:
        """Of each context: whether it occurs twice; whether those of its core are sorted; whether their windows decide."""
        self.twice = self.contexts.codes(shards, B.answered(found, 2)) == 1
        core = self.cores.codes(shards, B.answered(found, 3))[self.of_core]
        self.open, self.crowded = np.flatnonzero(core == 1), core == 2

    def windows(self) -> tuple[B.Asked, list]:
        """What the block asks about the windows of crowded cores, and for each group which windows those are and their hashes."""
        hashes, second, groups = [], [], []
        for _, _, own, at, of, _, _, _, context in self.groups:
            here = np.flatnonzero(self.crowded[self.contexts.find(context)][of]) if len(at) else np.zeros(0, np.int64)
            start = at[here]
            hashes.append(own.hashes(start, start + LENGTH))
            second.append(own.second(start, start + LENGTH) if len(start) else start.astype(np.uint64))
            groups.append(here)
        return B.Asked(hashes, second, [np.zeros(len(h), np.int64) for h in hashes], "count"), [*zip(groups, hashes, strict=True)]


def _crowds(many: int):
    """Of each core: 0 with one context, 1 with several, 2 with more than `many` (each block's counted apart)."""

    def decide(h, block, extras, sizes) -> np.ndarray:
        least = np.concatenate([np.frombuffer(x[: 8 * n], np.int64) for x, n in zip(extras, sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(x[8 * n :], np.int32) for x, n in zip(extras, sizes, strict=True)])
        order, group = B.groups(h)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        several = np.maximum.reduceat(counts[order], first) > 1
        several |= np.minimum.reduceat(least[order], first) != np.maximum.reduceat(least[order], first)
        out = np.zeros(len(h), np.uint8)
        out[order] = np.where(several, np.where(total > many, 2, 1), 0)[group]
        return out

    return decide


def _records(fine: _Fine) -> dict[int, bytes]:
    """By place among the contexts, of those to be sorted: key, whether it occurs twice, sizes and bytes."""
    out: dict[int, bytes] = {}
    flag = np.zeros(len(fine.contexts.hashes), bool)
    flag[fine.open] = True
    for _, _, own, _, _, anchor, left, right, context in fine.groups:
        places = fine.contexts.find(context)
        for k in np.flatnonzero(flag[places]).tolist():
            place = int(places[k])
            if place not in out:
                a, b = own.data[left[k] : anchor[k]].tobytes(), own.data[anchor[k] + LENGTH - FINE : right[k]].tobytes()
                out[place] = fine.contexts.values[place].tobytes() + bytes([int(fine.twice[place]), len(a), len(b)]) + a.ljust(FINE, b"\0") + b.ljust(FINE, b"\0")
    return out


def _sort_shard(h, block, extras, sizes) -> np.ndarray:
    """Bits of `repeats` for each context of a shard, as four bytes; cores of which every context occurs twice are not sorted."""
    records = np.frombuffer(b"".join(extras), np.uint8).reshape(-1, _RECORD)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    records = records[first]
    keys = np.ascontiguousarray(records[:, :8]).view(np.int64).ravel()
    _, core = np.unique(keys, return_inverse=True)
    places = np.flatnonzero((np.bincount(core, weights=records[:, 8] == 0) > 0)[core])
    bits = np.zeros(len(records), np.uint32)
    if len(places):
        records = records[places]
        raw = [r.tobytes() for r in records[:, 11:]]
        left = [r[:n] for r, n in zip(raw, records[:, 9].tolist(), strict=True)]
        right = [r[FINE : FINE + n] for r, n in zip(raw, records[:, 10].tolist(), strict=True)]
        bits[places] = repeats(keys[places], left, right)
    return bits[back]


def _open_contexts(fine: _Fine) -> B.Asked:
    core = fine.of_core[fine.open]
    return B.Asked([fine.contexts.hashes[fine.open]], [fine.cores.second[core]], [fine.open], "least")


def _cut(table: pa.Table, shards: int, found: pa.Table, keep_text: bool) -> pa.Table:
    whole, (table, back) = table, _distinct(table)
    fine = _Fine(table, shards, found)
    fine.status(shards, found)
    bits = np.zeros(len(fine.twice), np.int64)
    if len(fine.open):
        asked, answers = _open_contexts(fine), B.answered(found, 4)
        shard = asked.shards(shards)
        for s in np.unique(shard):
            bits[asked.values[shard == s]] = np.frombuffer(answers[int(s)], np.uint32)
    bits[fine.twice] = (1 << (FINE + 1)) - 1
    asked, crowded = fine.windows()
    again = asked.codes(shards, B.answered(found, 5)) == 1
    out: list = [None] * len(table)
    for (rows, texts, own, at, of, anchor, _, _, context), (here, hashes) in zip(fine.groups, crowded, strict=True):
        mask = bits[fine.contexts.find(context)]
        hits = (mask[of] >> (anchor[of] - at)) & 1 == 1 if len(at) else np.zeros(0, bool)
        hits[here] |= again[asked.find(hashes)]
        hit = at[hits]
        change = np.zeros(len(own.data) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + LENGTH, -1)
        cover = np.cumsum(change[:-1]) > 0
        for row, raw, b, e in zip(rows.tolist(), texts, own.begins.tolist(), own.ends.tolist(), strict=True):
            gone = cover[b:e]
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            kept = own.data[b:e][~gone].tobytes() if spans else raw
            out[row] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
    columns = list(zip(*(out[i] for i in back), strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table([whole["id"], *map(pa.array, columns, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, many: int = MANY) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and (if keep_text) the remaining bytes, for every row."""
    docs, shards = B.blocks(df, id_col, text_col)

    def ask_coarse(key, table):
        asked, _ = _coarse(_distinct(table)[0])
        return asked.table(key[0].as_py(), shards, lambda p: (asked.values[p] > 1).astype(np.uint8).tobytes())

    def ask_fine(key, table, found):
        return _Fine(_distinct(table)[0], shards, found).ask(key[0].as_py(), shards)

    def ask_open(key, table, found):
        fine = _Fine(_distinct(table)[0], shards, found)
        fine.status(shards, found)
        records, contexts, (windows, _) = _records(fine), _open_contexts(fine), fine.windows()
        strings = contexts.table(key[0].as_py(), shards, lambda p: b"".join(records[int(i)] for i in contexts.values[p]))
        return B.both(strings, windows.table(key[0].as_py(), shards, lambda p: (windows.values[p] > 1).astype(np.uint8).tobytes()), shards)

    own = docs.groupBy("block")
    coarse = own.applyInArrow(ask_coarse, B.ASKED).groupBy("shard").applyInArrow(B.answers(1, B.recurring), B.ANSWER)
    fine = own.cogroup(coarse.groupBy("block")).applyInArrow(ask_fine, B.ASKED).groupBy("shard").applyInArrow(B.answers_of_both(shards, B.answers(2, B.recurring), B.answers(3, _crowds(many))), B.ANSWER)
    both = coarse.unionByName(fine)
    settled = own.cogroup(both.groupBy("block")).applyInArrow(ask_open, B.ASKED).groupBy("shard").applyInArrow(B.answers_of_both(shards, B.answers(4, _sort_shard), B.answers(5, B.recurring)), B.ANSWER)
    kind = docs.schema["id"].dataType.simpleString()
    out = own.cogroup(both.unionByName(settled).groupBy("block")).applyInArrow(lambda key, table, found: _cut(table, shards, found, keep_text), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("id", id_col)
    return out if keep_text else out.drop("kept")
