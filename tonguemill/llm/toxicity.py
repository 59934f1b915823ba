"""Toxicity: embeddings of words' character n-grams, averaged, into a linear softmax; trained jointly in numpy.

A word's vector is the mean of the embeddings of its n-grams (bytes of `<word>`, 3 to 5 long, and the
whole), hashed into buckets; a document's vector is the mean of its words' vectors times a fixed
scale. Misspellings that training never saw share n-grams with words that it did see.

Both classes weigh the same in the loss, and every step shrinks each embedding as a group, so n-grams that
tell nothing end at zero instead of remembering single documents.

The model is linear above the embeddings, so after training each bucket has one number (its
embedding times the difference of the class weights) and scoring sums those over the whole text.

Training takes a bounded sample of labelled rows (TRAIN_POSITIVE + TRAIN_NEGATIVE documents, chosen by
a hash of the id); it is fitted in one task from hashed counts, never from all rows. A row brings at most BUCKETS numbers of 8 bytes,
2 MB, however long its text; sampled rows of usual length bring some 15 KB.

Edge cases: null and empty texts have no words and get the score of the bias alone; no usable label
of one class gives a constant score (the share of toxic labels, 0 without labels); null ids score
like any other but are never trained on; an id labelled both ways counts as toxic; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemill.llm.common import PrefixHash

#: Most labelled rows that training takes.
TRAIN_POSITIVE, TRAIN_NEGATIVE = 1500, 4500
BUCKETS, WIDTH, SCALE = 1 << 18, 4, 64.0
GRAMS = (3, 4, 5)
#: Buckets in fewer documents of the sample get no embedding.
MIN_DOCUMENTS = 5
#: Small samples are gone through more often, up to this many steps.
LEAST_STEPS = 600
THRESHOLD = 0.7
#: Words that a worker remembers before it starts anew.
CACHE_WORDS = 200_000
_EDGES = ".,;:!?\"'()[]{}<>*#$%&@~`|/\\-_=+^…“”‘’«»¿¡"
_HASH = PrefixHash(11)
#: Numbers that training counts at once.
_PART = 1 << 20


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, and the index of its word."""
    raw = [b"<" + w.strip(_EDGES).lower().encode("utf-8", "replace") + b">" for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    end = np.cumsum(size)
    prefix = _HASH.prefix(np.frombuffer(b"".join(raw), np.uint8))
    owner = np.repeat(np.arange(len(raw)), size)
    at = np.arange(len(owner))
    buckets, owners = [_HASH.spans(prefix, end - size, end)], [np.arange(len(raw))]
    for n in GRAMS:
        start = at[at + n <= end[owner]]
        buckets.append(_HASH.spans(prefix, start, start + n))
        owners.append(owner[start])
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def document_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, which sum to 1 (none for no words)."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    often = np.bincount([distinct[w] for w in words], minlength=len(distinct))
    buckets, owners = word_grams(list(distinct))
    weight = (often / np.bincount(owners, minlength=len(distinct)))[owners] / len(words)
    found, where = np.unique(buckets, return_inverse=True)
    return found, np.bincount(where, weights=weight)


@dataclass
class Model:
    """Logit of a text: bias + the mean over its words of the mean of `value` over the word's buckets."""

    value: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        buckets, owners = word_grams(words)
        return np.bincount(owners, self.value[buckets], len(words)) / np.bincount(owners, minlength=len(words))


def train(buckets: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.03, decay: float = 1e-5, shrink: float = 0.5, seed: int = 5) -> Model:
    """Document i has buckets[starts[i] : ends[i]], their weights, and labels[i]. Embeddings and softmax learn together by Adam."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = min(max(float(labels.mean()) if len(labels) else 0.0, 1e-4), 1 - 1e-4)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    balance = 0.5 * len(labels) / np.bincount(labels, minlength=2)
    rng = np.random.default_rng(seed)
    seen = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(buckets), _PART):  # bincount widens what it counts
        seen += np.bincount(buckets[k : k + _PART], minlength=BUCKETS)
    used = np.flatnonzero(seen >= MIN_DOCUMENTS)  # a document has a bucket once
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    dense = place[buckets]
    keep = dense >= 0
    before = np.zeros(len(keep) + 1, np.int64 if len(keep) >= 1 << 31 else np.int32)
    np.cumsum(keep, out=before[1:])
    starts, ends = before[starts].astype(np.int64), before[ends].astype(np.int64)
    del before
    dense, weights = dense[keep], weights[keep].astype(np.float32, copy=False)
    del keep
    params = [rng.uniform(-0.01, 0.01, (len(used), WIDTH)).astype(np.float32), rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(labels) // batch)))
    step, steps = 0, epochs * -(-len(labels) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(labels), batch):
            pick = order[k : k + batch]
            index = np.concatenate([np.arange(starts[i], ends[i]) for i in pick])
            owner = np.repeat(np.arange(len(pick)), ends[pick] - starts[pick])
            ids, w = dense[index], weights[index] * np.float32(SCALE)
            embedding, softmax, bias = params
            hidden = np.stack([np.bincount(owner, embedding[ids, d] * w, len(pick)) for d in range(WIDTH)], 1)
            logits = hidden @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= balance[labels[pick], None] / len(pick)
            back = p @ softmax.T
            grads = [np.stack([np.bincount(ids, back[owner, d] * w, len(used)) for d in range(WIDTH)], 1) + decay * embedding, hidden.T @ p, p.sum(0)]
            step += 1
            now = rate * (1 - step / (steps + 1))
            for i, g in enumerate(grads):
                g = g.astype(np.float32)
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - now * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            norm = np.sqrt((params[0] ** 2).sum(1, keepdims=True))
            params[0] *= np.maximum(0, 1 - now * shrink / np.maximum(norm, 1e-9)).astype(np.float32)
    embedding, softmax, bias = params
    value = np.zeros(BUCKETS)  # buckets never seen say nothing
    value[used] = embedding @ (softmax[:, 1] - softmax[:, 0]) * SCALE
    return Model(value, float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """buckets, weights, label of the bounded sample; rows whose crc32(id) mod 3 is 1 are held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % 3 != 1)).groupBy("_id").agg(F.max("_label").alias("_label"))
    order = F.xxhash64("_id", F.lit("sample"))
    pick = known.where("_label = 1").orderBy(order, "_id").limit(TRAIN_POSITIVE).unionByName(known.where("_label = 0").orderBy(order, "_id").limit(TRAIN_NEGATIVE))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(pick), "_id")  # at most TRAIN_POSITIVE + TRAIN_NEGATIVE rows

    def run(batches):
        for batch in batches:
            found = [document_grams(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())), batch.column(2)], ["id", "buckets", "weights", "label"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_text", F.col("_label").cast("int").alias("_label")).mapInArrow(run, f"id {kind}, buckets array<int>, weights array<float>, label int")


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    """Trains on the bounded sample, in one task; the driver gets the finished numbers of the buckets."""

    def run(batches):
        parts = [b for b in batches if len(b)]
        model = train(*_NOTHING)
        if parts:
            flat = [np.concatenate([b.column(k).flatten().to_numpy() for b in parts]) for k in (1, 2)]
            sizes = np.concatenate([b.column(1).value_lengths().to_numpy() for b in parts]).astype(np.int64)
            ids, labels = ([v for b in parts for v in b.column(k).to_pylist()] for k in (0, 3))
            parts.clear()
            ends = np.cumsum(sizes)
            order = np.array([i for i in sorted(range(len(ids)), key=ids.__getitem__) if sizes[i]], np.int64)  # rows come in any order
            model = train(*flat, (ends - sizes)[order], ends[order], np.array(labels)[order])
        yield pa.RecordBatch.from_arrays([pa.array([model.value.astype(np.float32)], pa.list_(pa.float32())), pa.array([model.bias], pa.float64())], ["value", "bias"])

    found = training_rows(docs, labels, **columns).repartition(1).mapInArrow(run, "value array<float>, bias double").toArrow()
    if not len(found):
        return train(*_NOTHING)
    return Model(found["value"].combine_chunks()[0].values.to_numpy().astype(np.float64), found["bias"][0].as_py())


#: No rows to train on.
_NOTHING = (np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
_remembered: dict = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, and `score` and `predicted`, which replace columns so named in any case."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model.value.astype(np.float32), model.bias))  # BUCKETS numbers, whatever the input
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    place = keep.index(text_col)

    def run(batches):
        value, bias = shipped.value
        own = Model(value, bias)
        if _remembered.get("of") != (bias, float(value.sum())):
            _remembered.clear()
            _remembered.update(of=(bias, float(value.sum())), words={})
        known = _remembered["words"]
        for batch in batches:
            split = [(t or "").split() for t in batch.column(place).to_pylist()]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = list(set().union(*split) - known.keys())
            for k in range(0, len(new), 50_000):
                part = new[k : k + 50_000]
                known.update(zip(part, own.words(part).tolist(), strict=True))
            means = np.array([sum(map(known.__getitem__, w)) / len(w) if w else 0.0 for w in split])
            scores = 1 / (1 + np.exp(-np.clip(means + bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every document, by a model fitted on the rows that are not held out."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = score(docs.select(id_col, text_col), model, id_col, text_col)
    return scored.select(id_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
