"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of PASSAGE_WORDS tokens. A passage is encoded from the mean hashed
embedding of its tokens' shapes and a few measured shares; gated attention, learned from document
labels alone, weighs the passages, and the weighted sum of their encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import byte_set, crc_rest, row_of_batch, sigmoid, span_hashes, table, text_blocks, training_rows, weighted, word_places

PASSAGE_WORDS = 64
BUCKETS, HIDDEN, GATE = 512, 16, 8
#: Labelled documents that the model is fitted on, of each label at most.
SAMPLE_DOCS = 1500
EPOCHS, RATE = 12, 0.02
THRESHOLD = 0.5
TOKEN_BYTES = ~byte_set((0x09, 0x0D), (0x20, 0x20))
#: Letters in lower case become `a`, in upper case `A`, digits `0`, bytes above ASCII `a`; signs stay.
SHAPE = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
SIGN = byte_set((0x21, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
UPPER, DIGIT = byte_set((0x41, 0x5A)), byte_set((0x30, 0x39))
#: Share of signs, upper case and digits among bytes; tokens like the one before; tokens per distinct hash; mean token length; fullness.
SHARES = 7


@dataclass
class Model:
    embed: np.ndarray  # (BUCKETS, HIDDEN)
    share: np.ndarray  # (SHARES, HIDDEN)
    bias: np.ndarray
    tanh_gate: np.ndarray  # (HIDDEN, GATE)
    sigm_gate: np.ndarray
    attend: np.ndarray  # (GATE,)
    out: np.ndarray  # (HIDDEN,)
    out_bias: float


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token buckets, n tokens' passage offsets, (passages, SHARES) and the n + 1 passage offsets of the texts."""
    starts, ends, cuts = word_places(data, at, TOKEN_BYTES)
    n_words = np.diff(cuts)
    n_pass = -(-n_words // PASSAGE_WORDS)
    of = np.concatenate([[0], np.cumsum(n_pass)])
    first = np.repeat(cuts[:-1], n_pass) + PASSAGE_WORDS * (np.arange(of[-1]) - np.repeat(of[:-1], n_pass))
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, SHARES), np.float32), of
    edge = np.append(first, len(starts))
    token = span_hashes(weighted(data), starts, ends)
    shape = (span_hashes(weighted(SHAPE[data]), starts, ends) % np.uint64(BUCKETS)).astype(np.int32)
    size = np.diff(edge)
    long = ends - starts
    n_bytes = np.add.reduceat(long, first)
    shares = np.zeros((len(first), SHARES), np.float32)
    for k, kind in enumerate((SIGN, UPPER, DIGIT)):
        run = np.concatenate([[0], np.cumsum(kind[data])])
        shares[:, k] = np.add.reduceat(run[ends] - run[starts], first) / n_bytes
    again = np.zeros(len(token))
    again[1:] = token[1:] == token[:-1]
    again[first] = 0
    shares[:, 3] = np.add.reduceat(again, first) / size
    who = np.repeat(np.arange(len(first)), size)
    order = np.lexsort((token, who))
    fresh = np.ones(len(token))
    fresh[1:] = (token[order][1:] != token[order][:-1]) | (who[order][1:] != who[order][:-1])
    shares[:, 4] = np.add.reduceat(fresh, first) / size
    shares[:, 5] = np.minimum(n_bytes / size, 40) / 10
    shares[:, 6] = size / PASSAGE_WORDS
    return shape, edge, shares, of


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in one order whatever the number of rows: a passage's numbers don't depend on those beside it."""
    out = x[:, :1] * w[0]
    for k in range(1, len(w)):
        out = out + x[:, k : k + 1] * w[k]
    return out


def encode(model: Model, shape: np.ndarray, edge: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tanh encodings of all passages and their attention energies."""
    mean = np.add.reduceat(model.embed[shape], edge[:-1], axis=0) / np.diff(edge)[:, None]
    h = np.tanh(mean + times(shares, model.share) + model.bias)
    return h, times(np.tanh(times(h, model.tanh_gate)) * sigmoid(times(h, model.sigm_gate)), model.attend[:, None])[:, 0]


def bag_scores(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of whole texts; one without tokens is scored on an all-zero representation."""
    shape, edge, shares, of = passages(data, at)
    n = len(at) - 1
    bag = np.zeros((n, HIDDEN))
    full = np.flatnonzero(np.diff(of))
    if len(full):
        h, energy = encode(model, shape, edge, shares)
        size = np.diff(of)[full]
        e = np.exp(energy - np.repeat(np.maximum.reduceat(energy, of[:-1][full]), size))
        total = np.add.reduceat(e, of[:-1][full])
        bag[full] = np.add.reduceat(h * (e / np.repeat(total, size))[:, None], of[:-1][full], axis=0)
    return sigmoid(times(bag, model.out[:, None])[:, 0] + model.out_bias)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, HIDDEN)), rng.normal(0, 0.5, (SHARES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, HIDDEN), 0.0)
    if not len(texts):
        return model
    bags = [passages(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:3] for t in texts]
    weight = {y: len(labels) / (2 * max(1, (labels == y).sum())) for y in (0, 1)}
    names = ("embed", "share", "bias", "tanh_gate", "sigm_gate", "attend", "out", "out_bias")
    first = {k: np.zeros_like(getattr(model, k), dtype=float) for k in names}
    second = {k: np.zeros_like(getattr(model, k), dtype=float) for k in names}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for group in np.array_split(order, max(1, len(order) // 16)):
            grad = {k: np.zeros_like(getattr(model, k), dtype=float) for k in names}
            for t in group:
                shape, edge, shares = bags[t]
                if not len(shape):
                    continue
                h, energy = encode(model, shape, edge, shares)
                u, v = np.tanh(h @ model.tanh_gate), sigmoid(h @ model.sigm_gate)
                a = np.exp(energy - energy.max())
                a /= a.sum()
                bag = a @ h
                d = (sigmoid(bag @ model.out + model.out_bias) - labels[t]) * weight[int(labels[t])]
                grad["out"] += d * bag
                grad["out_bias"] += d
                d_bag = d * model.out
                d_a = h @ d_bag
                d_e = a * (d_a - a @ d_a)
                d_u, d_v = d_e[:, None] * model.attend * v * (1 - u * u), d_e[:, None] * model.attend * u * v * (1 - v)
                grad["attend"] += d_e @ (u * v)
                grad["tanh_gate"] += h.T @ d_u
                grad["sigm_gate"] += h.T @ d_v
                d_h = a[:, None] * d_bag + d_u @ model.tanh_gate.T + d_v @ model.sigm_gate.T
                d_z = d_h * (1 - h * h)
                grad["share"] += shares.T @ d_z
                grad["bias"] += d_z.sum(axis=0)
                size = np.diff(edge)
                counts = np.bincount(shape * len(size) + np.repeat(np.arange(len(size)), size), minlength=BUCKETS * len(size)).reshape(BUCKETS, -1)
                grad["embed"] += counts @ (d_z / size[:, None])
            step += 1
            rate = RATE / (1 + 0.2 * epoch)
            for k in names:
                g = grad[k] / len(group)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                setattr(model, k, getattr(model, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8))
    model.embed, model.share = model.embed.astype(np.float32), model.share.astype(np.float32)
    return model


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, sample_docs: int = SAMPLE_DOCS) -> Model:
    rows = training_rows(documents, labels, label, folds, held, sample_docs)
    return fit([r["text"].encode() for r in rows], np.array([r["_label"] for r in rows]))


def score_quality(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row's whole text.

    Null, empty and blank texts are bags without passages and get the score of a zero representation. Repeated rows each get their row; no column but doc_id and text is read.
    """
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches, most=1 << 19):
            yield pa.record_batch([row_of_batch(rows, "doc_id"), pa.array(bag_scores(shared.value, data, at), pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_rest(F.col("doc_id"), 3) == 1, F.lit(False))
    return score_quality(spark, docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
