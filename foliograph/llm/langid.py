"""Language ID by prediction by partial matching.

For every language a tree of byte contexts of up to ORDER bytes is counted on sample texts and then
frozen. A byte seen c times after a context that was seen n times, followed by d different bytes,
costs -log2(c / (n + d)) bits; an unseen byte costs the escape, -log2(d / (n + d)) bits, and is
coded from the next shorter context, at last from the uniform 1/256. The language whose tree gives
the whole text the shortest code is predicted.

The trees of all languages share their nodes, so a text is scored by one walk: node tables map
(node, older byte) to a longer context and (node, byte) to the code length under every language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import SAMPLE_CHARS, crc_rest, row_of_batch, table, text_blocks

ORDER = 3
#: Documents of each language that the trees are counted on, at most.
SAMPLE_DOCS = 400
#: A context seen fewer times than this in all languages together is not kept.
LEAST_CONTEXT = 8
#: The posterior counts at most so many bytes of evidence, lest every score be 1.
EVIDENCE_BYTES = 100
UNKNOWN = "und"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def _folded() -> np.ndarray:
    """ASCII letters in lower case, other ASCII as a blank, UTF-8's bytes above as they are."""
    fold = np.full(256, 32, np.int64)
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    return fold


FOLD = _folded()


@dataclass
class Trees:
    """symbol: byte to symbol (0: the blank that also stands before a text; the last: never seen). child: (node, symbol) to the node with an older symbol more, 0 for none; node 1 has no context. cost: bits by (node * symbols + symbol, language)."""

    langs: list[str]
    symbols: int
    symbol: np.ndarray
    child: np.ndarray
    cost: np.ndarray


def grow(texts: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST_CONTEXT) -> Trees:
    langs = sorted(texts)
    seen = np.zeros(256, bool)
    folded = {}
    for lang in langs:
        folded[lang] = FOLD[np.frombuffer((b" " * order).join([b"", *texts[lang]]), np.uint8)]
        seen[np.unique(folded[lang])] = True
    seen[32] = False
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    s = int(seen.sum()) + 2
    symbol = symbol[FOLD]
    symbol[~seen[FOLD] & (FOLD != 32)] = s - 1
    coded = {lang: np.where(seen[v], np.cumsum(seen)[v], 0).astype(np.int64) for lang, v in folded.items()}

    child = [np.zeros(s, np.int64), np.zeros(s, np.int64)]
    cost = [np.zeros((s, len(langs))), np.full((s, len(langs)), 8.0)]
    level = {0: 1}  # a context as a number in base s, older symbols in higher places: its node
    for k in range(order + 1):
        found: dict[int, dict] = {}
        for j, lang in enumerate(langs):
            v = coded[lang]
            if len(v) <= order:
                continue
            key = np.zeros(len(v) - order, np.int64)
            for back in range(k, 0, -1):
                key = key * s + v[order - back : len(v) - back]
            pairs, n = np.unique(key * s + v[order:], return_counts=True)
            cuts = np.flatnonzero(np.diff(pairs // s, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
                found.setdefault(int(pairs[a] // s), {})[j] = (pairs[a:b] % s, n[a:b])
        here = {}
        for key, by in sorted(found.items()):
            parent = level.get(key % s ** (k - 1)) if k else 1
            if parent is None or k and sum(int(n.sum()) for _, n in by.values()) < least:
                continue
            bits = cost[parent].copy()
            for j, (which, n) in by.items():
                all_n, kinds = n.sum(), len(n)
                bits[:, j] += -np.log2(kinds / (all_n + kinds))
                bits[which, j] = -np.log2(n / (all_n + kinds))
            if k:
                child[parent][key // s ** (k - 1)] = here[key] = len(child)
                child.append(np.zeros(s, np.int64))
                cost.append(bits)
            else:
                cost[1], here[key] = bits, 1
        level = here
    return Trees(langs, s, symbol, np.stack(child).astype(np.int32).ravel(), np.concatenate(cost).astype(np.float32))


def code_lengths(trees: Trees, data: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Bits of every text under every language."""
    n, s = len(at) - 1, trees.symbols
    out = np.zeros((n, len(trees.langs)))
    if not len(data):
        return out
    sizes = np.diff(at)
    place = np.arange(len(data)) + order * np.repeat(np.arange(1, n + 1), sizes)
    padded = np.zeros(len(data) + order * (n + 1), np.int32)
    padded[place] = trees.symbol[data]
    node = np.ones(len(data), np.int32)
    deep = node
    for back in range(1, order + 1):
        deep = trees.child[deep * s + padded[place - back]]
        np.maximum(node, deep, out=node)
    bits = trees.cost[node * s + padded[place]]
    full = np.flatnonzero(sizes)
    out[full] = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.float64)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Counts the trees on at most sample_docs documents of each language (the least xxhash64(doc_id)); rows without text, language or doc_id and texts of more than SAMPLE_CHARS characters teach nothing.

    Languages are few, so their counts are broadcast. Without a column lang nothing is learned.
    """
    if "lang" not in documents.columns:
        return grow({})
    own = documents.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    counts = own.groupBy("lang").agg(F.count("*").alias("n"))  # a row by language
    # the least hashes of a language lie below twice their expected share of all, so that no task ranks all documents of a large language
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    few = own.select("doc_id", "lang").join(F.broadcast(counts), "lang").filter((F.col("n") <= 4 * sample_docs) | (place < 2 * sample_docs / F.col("n") + 100 / F.col("n")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = few.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample_docs).select("doc_id").distinct()
    rows = own.join(F.broadcast(ids), "doc_id").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return grow(texts)


def judged(trees: Trees, rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language (or `und`), score and bits by byte of every text of a block."""
    sizes = np.diff(at)
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    letters = letters[at[1:]] - letters[at[:-1]]
    text = row_of_batch(rows, "text")
    known = np.array([bool(trees.langs) and (n > 0 or (size > 0 and has_letter(text[i].as_py()))) for i, (n, size) in enumerate(zip(letters, sizes, strict=True))], bool)
    if not trees.langs:
        return np.full(len(sizes), UNKNOWN, object), np.zeros(len(sizes)), np.zeros(len(sizes))
    bits = code_lengths(trees, data, at)
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(best)), best]
    weight = np.minimum(sizes, EVIDENCE_BYTES) / np.maximum(sizes, 1)
    odds = np.exp2(-(bits - least[:, None]) * weight[:, None]).sum(axis=1)
    names = np.array(trees.langs, object)[best]
    return np.where(known, names, UNKNOWN), np.where(known, 1 / odds, 0.0), np.where(known, least / np.maximum(sizes, 1), 0.0)


def identify(spark: SparkSession, documents: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score (the posterior of lang_pred under equal priors) and bits_per_byte of every row's whole text.

    A null, empty or letterless text is `und` with score 0; so is every text if nothing was learned.
    Equal code lengths: the first language by name. Repeated rows each get their row; columns besides doc_id and text are ignored.
    """
    model = spark.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            lang, sure, bits = judged(model.value, rows, data, at)
            yield pa.record_batch([row_of_batch(rows, "doc_id"), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_known(spark: SparkSession, documents: DataFrame, trees: Trees, least_score: float = 0.35) -> DataFrame:
    """The rows whose language is identified with least_score at least, in the same columns; a null lang takes the identified one. A table without lang is filtered alike."""
    model = spark.sparkContext.broadcast(trees)

    def keep(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            lang, sure, _ = judged(model.value, rows, data, at)
            place = rows.schema.get_field_index("lang")
            if place >= 0:
                rows = rows.set_column(place, rows.schema.field(place), pc.coalesce(rows.column(place), pa.array(lang, rows.schema.field(place).type)))
            yield rows.filter(pa.array((lang != UNKNOWN) & (sure >= least_score)))

    return documents.mapInArrow(keep, documents.schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_rest(F.col("doc_id"), 5) == 0, F.lit(False))
    trees = train(docs.filter(~held))
    return identify(spark, docs, trees).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")
