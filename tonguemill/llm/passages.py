"""Repeated passages of WINDOW words: sharded Aho-Corasick automata over confirmed recurring phrases.

1. Seeds: of each window's WINDOW - SEED + 1 runs of SEED words the one with the smallest hash; equal windows
   have equal seeds, and a seed that occurs once rules out the windows around it.
2. Confirming: whole windows around recurring seeds are looked up; a window is confirmed when its word
   sequence occurs again anywhere, and the answer says whether another block has it under a smaller id.
3. The confirmed passages of a block are compiled into its own automaton (pyahocorasick): phrases of
   WINDOW words, end to end along each passage and along each part of it that starts earlier elsewhere or does not.
   Every document of the block is streamed through it, and the occurrences that it finds decide what goes: each
   one's words, unless it is the first of all.

The automata are sharded with the documents: a block's automaton holds just the phrases that its
documents can contain, so one pass over each text locates every occurrence and work grows with the
input, not with its square.

Edge cases: null and empty texts have no words; rows with equal id and text, or only equal ids, are
not earlier than each other; a null id sorts before all; words are byte runs without the six ASCII white-space bytes
and are compared exactly; extra columns are ignored; empty tables give empty results. Ids are integers.
Two windows count as equal when 64-bit hashes and their shards (dealt by a second hash) agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonguemill.llm import blocks as B
from tonguemill.llm.common import PrefixHash, whole_numbers, window_minima

WINDOW, SEED = 20, 8
_NULL_ID = np.iinfo(np.int64).min
_ONE, _TWO = PrefixHash(21), PrefixHash(22, 0xD6E8FEB86659FD93)


class _Words:
    """Words of a group of texts: one buffer of space-joined words, a line feed between texts."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.lines = [b" ".join(w) for w in self.words]
        data = np.frombuffer(b"\n".join(line for line in self.lines if line), np.uint8)
        gaps = np.flatnonzero((data == 0x20) | (data == 0x0A))
        self.start = np.concatenate([[0], gaps + 1]) if len(data) else np.zeros(0, np.int64)
        self.end = np.concatenate([gaps, [len(data)]]) if len(data) else np.zeros(0, np.int64)
        counts = np.array([len(w) for w in self.words], np.int64)
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.first = np.cumsum(counts) - counts
        self.one, self.two = _ONE.prefix(data), None
        self.data = data

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return _ONE.spans(self.one, self.start[at], self.end[at + n - 1])

    def second(self, at: np.ndarray, n: int) -> np.ndarray:
        if self.two is None:
            self.two = _TWO.prefix(self.data)
        return _TWO.spans(self.two, self.start[at], self.end[at + n - 1])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word number of every window's first word, and of its seed's."""
        n = len(self.text)
        if n < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seeds = window_minima(self.hashes(np.arange(n - SEED + 1), SEED), WINDOW - SEED + 1)
        at = np.flatnonzero(self.text[: n - WINDOW + 1] == self.text[WINDOW - 1 :])
        return at, seeds[at]


def _seeds(table: pa.Table) -> B.Asked:
    hashes, second = [], []
    for _, texts in B.pieces(table):
        words = _Words(texts)
        seeds = np.unique(words.windows()[1])
        hashes.append(words.hashes(seeds, SEED))
        second.append(words.second(seeds, SEED))
    return B.Asked(hashes, second, [np.zeros(len(h), np.int64) for h in hashes], "count")


def _ids(table: pa.Table) -> np.ndarray:
    return table["id"].cast(pa.int64()).fill_null(int(_NULL_ID)).to_numpy()


def _candidates(table: pa.Table, shards: int, found: dict[int, bytes]):
    """For each group of texts: its rows, words, the windows around recurring seeds, their hashes; and what the block asks about them."""
    seeds = _seeds(table)
    again = seeds.codes(shards, found) == 1
    ids = _ids(table)
    groups, second, values = [], [], []
    for rows, texts in B.pieces(table):
        words = _Words(texts)
        at, seed = words.windows()
        known, back = np.unique(seed, return_inverse=True)
        at = at[again[seeds.find(words.hashes(known, SEED))][back]] if len(known) else at
        h = words.hashes(at, WINDOW)
        groups.append((rows, words, at, h))
        second.append(words.second(at, WINDOW))
        values.append(ids[rows][words.text[at]])
    return ids, groups, B.Asked([g[3] for g in groups], second, values, "least")


def _earlier(h, block, extras, sizes) -> np.ndarray:
    """Bit 0: another block has the window in a document of a smaller id. Bit 1: another block has it."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in extras])
    order, group = B.groups(h)
    least = np.minimum.reduceat(ids[order], np.flatnonzero(np.diff(group, prepend=-1)))
    out = np.zeros(len(h), np.uint8)
    out[order] = (least[group] < ids[order]) | ((np.bincount(group)[group] > 1).astype(np.uint8) << 1)
    return out


def _cover(confirmed: np.ndarray, at: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Of sorted windows `at`, those confirmed, thinned to phrases that lie end to end along each run of equal `later`, its last one included."""
    at, later = at[confirmed], later[confirmed]
    if not len(at):
        return at
    begins = np.concatenate([[True], (np.diff(at) != 1) | (later[1:] != later[:-1])])
    run = np.cumsum(begins) - 1
    from_begin = at - at[begins][run]
    return at[(from_begin % WINDOW == 0) | np.concatenate([begins[1:], [True]])]


def _locate(table: pa.Table, shards: int, answers: pa.Table, keep_text: bool) -> pa.Table:
    import ahocorasick

    ids, groups, asked = _candidates(table, shards, B.answered(answers, 1))
    code = asked.codes(shards, B.answered(answers, 2))
    elsewhere, again = code & 1 == 1, code & 2 == 2
    places = [asked.find(h) for _, _, _, h in groups]
    again |= np.bincount(np.concatenate(places) if places else np.zeros(0, np.int64), minlength=len(again)) > 1
    automaton = ahocorasick.Automaton()
    for (rows, words, at, _), place in zip(groups, places, strict=True):
        row = rows[words.text[at]]
        order = np.lexsort((at, row, place))
        first_here = np.ones(len(at), bool)
        first_here[order[1:]] = (np.diff(place[order]) != 0) | (np.diff(row[order]) != 0)
        later = elsewhere[place] | (ids[row] > asked.values[place]) | ~first_here
        for w in _cover(again[place], at, later).tolist():
            t = words.text[w]
            k = w - words.first[t]
            phrase = b" " + b" ".join(words.words[t][k : k + WINDOW]) + b" "
            automaton.add_word(phrase.decode("latin-1"), int(place[np.searchsorted(at, w)]))
    out = []
    if len(automaton):
        automaton.make_automaton()
    for rows, words, _, _ in groups:
        for t, (row, line, own) in enumerate(zip(rows.tolist(), words.lines, words.words, strict=True)):
            gone = np.zeros(len(own) + 1, np.int64)
            hits = list(automaton.iter(f" {line.decode('latin-1')} ")) if len(automaton) and len(own) >= WINDOW else []
            if hits:
                stop, place = np.array(hits, np.int64).T
                base = words.first[t]
                ends = words.end[base : base + len(own)] - words.start[base]
                at = np.searchsorted(ends, stop - 1) - WINDOW + 1
                repeats = np.ones(len(place), bool)
                repeats[np.unique(place, return_index=True)[1]] = False  # occurrences come in order
                at = at[elsewhere[place] | (ids[row] > asked.values[place]) | repeats]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WINDOW, -1)
            cover = np.cumsum(gone[:-1]) > 0
            kept = b" ".join(w for w, g in zip(own, cover.tolist(), strict=True) if not g) if cover.any() else line
            out.append((row, len(own), int(cover.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None))
    out.sort()
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([table["id"], pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and (if keep_text) the kept words joined by spaces, for every row."""
    whole_numbers(df, id_col)
    docs, shards = B.blocks(df, id_col, text_col)

    def ask_seeds(key, table):
        asked = _seeds(table)
        return asked.table(key[0].as_py(), shards, lambda p: (asked.values[p] > 1).astype(np.uint8).tobytes())

    def ask_windows(key, table, found):
        _, _, asked = _candidates(table, shards, B.answered(found, 1))
        return asked.table(key[0].as_py(), shards, lambda p: asked.values[p].astype(np.int64).tobytes())

    def locate(key, table, found):
        return _locate(table, shards, found, keep_text)

    own = docs.groupBy("block")
    seeds = own.applyInArrow(ask_seeds, B.ASKED).groupBy("shard").applyInArrow(B.answers(1, B.recurring), B.ANSWER)
    windows = own.cogroup(seeds.groupBy("block")).applyInArrow(ask_windows, B.ASKED).groupBy("shard").applyInArrow(B.answers(2, _earlier), B.ANSWER)
    kind = docs.schema["id"].dataType.simpleString()
    out = own.cogroup(seeds.unionByName(windows).groupBy("block")).applyInArrow(locate, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_col) if keep_text else out.withColumnRenamed("id", id_col).drop("kept")
