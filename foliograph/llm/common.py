"""What the text operators share: Arrow text blocks, vectorised words, sampling for training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of numpy works on; a longer text is a step of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of_batch(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES):
    """Yields (rows, bytes of their texts end to end, n + 1 offsets); a null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = pc.fill_null(row_of_batch(batch, text), "")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, places, values = column.buffers()
        at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
    # workers live on between tasks; what the last batch took need not
    pa.default_memory_pool().release_unused()


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    kept = np.zeros(256, bool)
    for low, high in ranges:
        kept[low : high + 1] = True
    return kept


#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text with A-Z in lower case.
WORD_BYTES = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: A-Z to a-z, any other byte as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: For bytes.translate(): words in lower case, all else a blank.
WORD_TABLE = bytes(int(LOWER[b]) if WORD_BYTES[b] else 32 for b in range(256))


def word_places(data: np.ndarray, at: np.ndarray, inside: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and n + 1 word offsets by text. No word runs from one text into the next."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    kept = inside[data]
    before, after = np.empty_like(kept), np.empty_like(kept)
    before[0], before[1:] = False, kept[:-1]
    after[-1], after[:-1] = False, kept[1:]
    heads = at[:-1][at[:-1] < len(data)]
    before[heads] = False
    after[at[1:-1][at[1:-1] > 0] - 1] = False
    starts, ends = np.flatnonzero(kept & ~before), np.flatnonzero(kept & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, of: int = _ODD) -> np.ndarray:
    """of ** 0 .. of ** (n - 1), modulo 2 ** 64."""
    if of not in _powers or len(_powers[of]) < n:
        made = np.full(max(n, 1024), of, np.uint64)
        made[0] = 1
        _powers[of] = np.cumprod(made, dtype=np.uint64)
    return _powers[of][:n]


def sums_before(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of [start, end) of a sequence whose weighted prefix sums are given, the same wherever they stand."""
    h = (sums[ends] - sums[starts]) * powers(len(sums), _INVERSE)[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def weighted(values: np.ndarray) -> np.ndarray:
    """Prefix sums for span_hashes."""
    return sums_before((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it as long as df has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def crc_rest(column: Column, of: int) -> Column:
    """crc32 of a value as text, modulo `of`; null for null."""
    return F.crc32(column.cast("string")) % F.lit(of)


def least_ids(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The ids of least xxhash64 of the rows, `most` at most. They lie below twice their share of all hashes, so only few ids leave the tasks, whatever the number of tasks."""
    n = rows.count()
    ids = rows.select(column)
    if n > 4 * most:
        ids = rows.filter(F.xxhash64(column) / F.lit(2.0**64) + 0.5 < (2 * most + 100) / n).select(column)
    return ids.distinct().orderBy(F.xxhash64(column), column).limit(most)


#: Characters of a text that a model is fitted on, at most: a bound on what a sample of so many rows takes in bytes.
SAMPLE_CHARS = 100_000


def training_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, columns: tuple[str, ...] = ("text",)) -> list:
    """At most `most` labelled rows for each of the labels 0 and 1, those of least xxhash64(doc_id); a doc_id labelled twice counts with its larger label.

    Only ids and labels are ranked; the chosen ids, at most 2 * most, are then looked up among the documents. Texts of more than SAMPLE_CHARS characters teach nothing.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & (crc_rest(F.col("doc_id"), folds) != held))
        .groupBy("doc_id").agg(F.max("_label").alias("_label"))
    )
    chosen = [least_ids(known.filter(F.col("_label") == y), "doc_id", most).withColumn("_label", F.lit(y)) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    rows = documents.select("doc_id", *columns).join(F.broadcast(ids), "doc_id").filter(F.length("text") <= SAMPLE_CHARS)
    return sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
