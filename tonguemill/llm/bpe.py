"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a tiktoken rank file given by path. Text becomes bytes, each byte becomes one
printable character (the usual byte-to-character table), and BPE runs on those characters; decoding
reverses the table, so characters that were split over tokens come back whole.

Rank files order merges by the rank of the merged token alone, while the library orders them by
pair. Both agree unless two overlapping pairs give the same token, which needs a periodic stretch
(w w and w's first byte again); only such pieces are merged by rank here, in Python.

Edge cases: a null text counts as empty; an empty text has no tokens. Very long texts, repeated rows
and extra columns need no care: rows are handled one by one and only the named columns are read.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers before it starts anew.
CACHE_PIECES = 250_000
#: Longer pieces are not remembered.
CACHE_PIECE_CHARS = 64
_PERIODIC = re.compile(r"((.).*?)\1\2", re.S)


def byte_characters() -> list[str]:
    """Character of each byte: itself where printable, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def merges_by_rank(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens that makes a token, in the order of the token made."""
    out = []
    for token in sorted(ranks, key=ranks.__getitem__):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
        out += sorted((c for c in cuts if c[0] in ranks and c[1] in ranks), key=lambda c: (ranks[c[0]], ranks[c[1]]))
    return out


class ByteBPE:
    """Encoder and decoder of one rank file; build it once in a worker (see `codec`)."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.ranks = read_ranks(path)
        chars = byte_characters()
        self.to_byte = {c: b for b, c in enumerate(chars)}
        spell = lambda token: "".join(chars[b] for b in token)
        vocab = {spell(token): rank for token, rank in self.ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=[(spell(a), spell(b)) for a, b in merges_by_rank(self.ranks)], ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = regex.compile(pattern)
        tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for word, rank in vocab.items():  # the byte table, reversed
            tokens[rank] = bytes(self.to_byte[c] for c in word)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.known: dict[str, bytes] = {}

    def by_rank(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.ranks[p] for p in parts if p is not None]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids (little-endian uint32) of each piece."""
        out: dict[str, bytes] = {}
        plain = []
        for p in pieces:
            raw = p.encode()
            if len(raw) > 256 or _PERIODIC.search(raw.decode("latin-1")):
                out[p] = np.array(self.by_rank(raw), "<u4").tobytes()
            else:
                plain.append(p)
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, words = np.array(got.ids, "<u4"), np.array(got.word_ids)
            cut = np.searchsorted(words, np.arange(len(part) + 1))
            out.update((p, ids[cut[k] : cut[k + 1]].tobytes()) for k, p in enumerate(part))
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; pieces new to the batch go through the library together."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        cut = [self.pieces.findall(t) for t in texts]
        got = self.learn(list(set().union(*cut) - self.known.keys()))
        known = self.known
        known.update((p, ids) for p, ids in got.items() if len(p) <= CACHE_PIECE_CHARS)
        find = lambda p: known[p] if p in known else got[p]
        long = any(len(p) > CACHE_PIECE_CHARS for p in got)
        return [np.frombuffer(b"".join(map(find if long else known.__getitem__, pieces)), "<u4") for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, whole: a character split over tokens is joined again. Unknown ids raise."""
        ids = np.asarray(ids, np.int64)
        if len(ids) == 0:
            return b""
        if ids.min() < 0 or ids.max() >= len(self.length) or not self.length[ids].all():
            raise ValueError("an id is not in the vocabulary")
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character that each token touches; tokens that share a split character overlap."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length[np.asarray(ids, np.int64)])
        if len(ends) == 0:
            return ends, ends
        return char[ends - self.length[np.asarray(ids, np.int64)]], char[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, and the character offsets of each token (char_start, char_end), a row for each input row."""
    schema = df.select(id_col).schema.simpleString()[7:-1] + ", ids array<int>, char_start array<int>, char_end array<int>"

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = bpe.encode_batch(texts)
            spans = [bpe.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            columns = [[x.astype(np.int32) for x in ids], *([s[k].astype(np.int32) for s in spans] for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], [id_col, "ids", "char_start", "char_end"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id, raw (the decoded bytes) and text (null where the bytes are not whole UTF-8); null ids count as none."""
    schema = df.select(id_col).schema.simpleString()[7:-1] + ", raw binary, text string"

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            raws = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            texts = []
            for r in raws:
                try:
                    texts.append(r.decode())
                except UnicodeDecodeError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary()), pa.array(texts, pa.string())], [id_col, "raw", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each whole text in one pass: id, n_tokens, ids_sha256, decoded_sha256, n_split.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers; n_split counts the tokens
    that begin inside a character.
    """
    schema = df.select(id_col).schema.simpleString()[7:-1] + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_split bigint"

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            rows = []
            for ids in bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                raw = bpe.decode(ids)
                first = np.frombuffer(raw, np.uint8)[np.cumsum(n := bpe.length[ids]) - n] if len(ids) else np.zeros(0, np.uint8)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), int(((first & 0xC0) == 0x80).sum())))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:3]), pa.array(columns[3], pa.int64())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
