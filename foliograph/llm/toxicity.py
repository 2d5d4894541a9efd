"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of five hashed embeddings: of the word, and of its first 4, 5, 6 and 7 bytes. Filters
of 1, 2 and 3 words run over the whole text, each keeps its largest response (max pooling after a
ReLU), and a logistic layer weighs those. The language of a text is guessed from hashed word counts
alone, and the raw probability is bent so that the threshold calibrated for that language comes to
lie at THRESHOLD.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import LOWER, crc_rest, row_of_batch, sigmoid, span_hashes, table, text_blocks, training_rows, weighted, word_places

BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 12, 8, (1, 2, 3), (4, 5, 6, 7)
#: Labelled documents that the model is fitted on, of each label at most.
SAMPLE_DOCS = 1200
EPOCHS, RATE, DECAY = 6, 0.08, 1e-4
#: Share of a text's words left out of each training step.
DROPPED = 0.3
#: A score of at least this much is toxic.
THRESHOLD = 0.7
#: Documents of a language that a threshold of its own needs; others share one.
LEAST_CALIBRATION = 30


@dataclass
class Model:
    embed: np.ndarray  # (BUCKETS, DIM)
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    langs: np.ndarray  # (BUCKETS, languages): log-odds of a word bucket
    cut: np.ndarray  # by language


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of its prefixes, (words, 5), and n + 1 word offsets."""
    starts, ends, cuts = word_places(data, at)
    sums = weighted(LOWER[data])
    ids = [span_hashes(sums, starts, ends)]
    ids += [span_hashes(sums, starts, np.minimum(starts + k, ends)) + np.uint64(k * 0x51ED270B) for k in PREFIXES]
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in ids], axis=1), cuts


def _pooled(model: Model, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest responses of all filters over one text's word vectors, and where they stand. A text shorter than a filter has response 0 there."""
    best, where = [], []
    for w, f, b in zip(WIDTHS, model.filters, model.bias, strict=True):
        if len(x) < w:
            best.append(np.zeros(FILTERS))
            where.append(np.full(FILTERS, -1))
            continue
        y = sum(x[o : len(x) - w + 1 + o] @ f[o] for o in range(w)) + b
        i = y.argmax(axis=0)
        top = y[i, np.arange(FILTERS)]
        best.append(np.maximum(top, 0))
        where.append(np.where(top > 0, i, -1))
    return np.concatenate(best), where


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Model:
    """texts: bucket rows of whole texts. A fifth of the rows calibrates the thresholds and takes no part in fitting."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.02, (BUCKETS, DIM)), [rng.normal(0, 0.4, (w, DIM, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0, np.zeros((BUCKETS, 1)), np.array([THRESHOLD]),
    )
    if not len(texts):
        return model
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    weight = {y: len(used) / (2 * max(1, (labels[used] == y).sum())) for y in (0, 1)}
    sq_embed, sq_f, sq_out = np.full((BUCKETS, 1), 1e-2), [np.full_like(f, 1e-2) for f in model.filters], np.full_like(model.out, 1e-2)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.3 * epoch)
        for t in rng.permutation(used):
            ids = texts[t][rng.random(len(texts[t])) >= DROPPED]
            x = model.embed[ids].sum(axis=1)
            v, where = _pooled(model, x)
            g = (sigmoid(v @ model.out + model.out_bias) - labels[t]) * weight[int(labels[t])]
            d = g * model.out
            sq_out += (g * v) ** 2
            model.out -= rate * (g * v / np.sqrt(sq_out) + DECAY * model.out)
            model.out_bias -= 0.1 * rate * g
            for k, w in enumerate(WIDTHS):
                dk, f = d[k * FILTERS : (k + 1) * FILTERS], model.filters[k]
                on = np.flatnonzero((where[k] >= 0) & (dk != 0))
                if not len(on):
                    continue
                for o in range(w):
                    at = where[k][on] + o
                    to_filter = dk[on] * x[at].T
                    to_word = (dk[on] * f[o][:, on]).T
                    sq_f[k][o][:, on] += to_filter**2
                    f[o][:, on] -= rate * to_filter / np.sqrt(sq_f[k][o][:, on])
                    for j in range(ids.shape[1]):
                        np.add.at(sq_embed, ids[at, j], (to_word**2).mean(axis=1, keepdims=True))
                        np.add.at(model.embed, ids[at, j], -rate * to_word / np.sqrt(sq_embed[ids[at, j]]))
                model.bias[k][on] -= 0.1 * rate * dk[on]
    names = sorted({x for x in langs if x})
    if names:
        counts = np.full((BUCKETS, len(names)), 0.05)
        for t in used:
            if langs[t]:
                np.add.at(counts[:, names.index(langs[t])], texts[t][:, 0], 1)
        model.langs = np.log(counts / counts.sum(axis=0))
    for a in ("embed", "langs"):
        setattr(model, a, getattr(model, a).astype(np.float32))
    table = taps(model)
    both = [judged(model, table, texts[t], np.array([0, len(texts[t])])) for t in held]
    raw, tongue = np.array([r[0] for r, _ in both]), np.array([t[0] for _, t in both], int)
    shared = _threshold(raw, labels[held])
    model.cut = np.array([_threshold(raw[tongue == k], labels[held][tongue == k]) if (tongue == k).sum() >= LEAST_CALIBRATION else shared for k in range(model.langs.shape[1])])
    return model


def _threshold(raw: np.ndarray, label: np.ndarray) -> float:
    """Midway in the gap below the cut of fewest errors on calibration rows (balanced by label); ties to the widest gap, then the highest cut."""
    if not len(raw) or label.min() == label.max():
        return THRESHOLD
    values = np.unique(np.append(raw, [0.02, 0.98]))
    cuts = (values[:-1] + values[1:]) / 2
    share = max(1, (label == 0).sum()) / max(1, (label == 1).sum())
    wrong = [((raw >= c) & (label == 0)).sum() + ((raw < c) & (label == 1)).sum() * min(1.0, share) for c in cuts]
    best = min(range(len(cuts)), key=lambda i: (wrong[i], -(values[i + 1] - values[i]), -cuts[i]))
    return float(np.clip(cuts[best], 0.05, 0.95))


def bend(raw: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The same order within a language, with its threshold at THRESHOLD."""
    return np.clip(np.where(raw < cut, THRESHOLD * raw / cut, THRESHOLD + (1 - THRESHOLD) * (raw - cut) / (1 - cut)), 0, 1)


def taps(model: Model) -> np.ndarray:
    """What a bucket adds to each filter at each of its places, (BUCKETS, places * FILTERS): filters are linear in the embeddings, so they can be applied to the table first."""
    return model.embed @ np.concatenate([f[o] for f in model.filters for o in range(len(f))], axis=1).astype(np.float32)


def responses(model: Model, table: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Max-pooled filter responses of many texts at once, (texts, filters). Sums are taken element by element in one order, so a text's responses don't depend on the texts beside it."""
    n = len(cuts) - 1
    out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    if not len(ids):
        return out
    x = table[ids[:, 0]]
    for j in range(1, ids.shape[1]):
        x += table[ids[:, j]]
    place = 0
    for k, (w, b) in enumerate(zip(WIDTHS, model.bias, strict=True)):
        long = np.flatnonzero(np.diff(cuts) >= w)
        if len(long):
            y = x[: len(x) - w + 1, place : place + FILTERS].copy()
            for o in range(1, w):
                y += x[o : len(x) - w + 1 + o, place + o * FILTERS : place + (o + 1) * FILTERS]
            # even places: where a text's windows begin; odd: where its last window ended
            edges = np.stack([cuts[long], cuts[long + 1] - w + 1], axis=1).ravel()
            edges = edges[:-1] if edges[-1] >= len(y) else edges
            out[long, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(y, edges, axis=0)[::2] + b, 0)
        place += w * FILTERS
    return out


def judged(model: Model, table: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and guessed languages of many texts."""
    found = responses(model, table, ids, cuts)
    total = np.full(len(found), model.out_bias, np.float64)
    for k, w in enumerate(model.out.tolist()):
        total += found[:, k] * w
    tongue, full = np.zeros(len(found), np.int64), np.flatnonzero(np.diff(cuts))
    if len(full):
        tongue[full] = np.add.reduceat(model.langs[ids[:, 0]].astype(np.float64), cuts[:-1][full], axis=0).argmax(axis=1)
    return sigmoid(total), tongue


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, sample_docs: int = SAMPLE_DOCS) -> Model:
    rows = training_rows(documents, labels, label, folds, held, sample_docs, ("text", "lang"))
    texts = []
    for r in rows:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        texts.append(features(data, np.array([0, len(data)]))[0])
    return fit(texts, np.array([r["_label"] for r in rows]), [r["lang"] for r in rows])


def score_toxicity(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and lang_guess (0.., by which threshold) of every row's whole text.

    Null, empty and wordless texts get the score of a text on which no filter responds. Repeated rows each get their row; no column but doc_id and text is read.
    """
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]):
        model, table = shared.value, taps(shared.value)
        for rows, data, at in text_blocks(batches, most=1 << 19):
            raw, tongue = judged(model, table, *features(data, at))
            yield pa.record_batch([row_of_batch(rows, "doc_id"), pa.array(bend(raw, model.cut[tongue]), pa.float64()), pa.array(tongue, pa.int64())], ["doc_id", "score", "lang_guess"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, lang_guess long")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_rest(F.col("doc_id"), 3) == 1, F.lit(False))
    return score_toxicity(spark, docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
