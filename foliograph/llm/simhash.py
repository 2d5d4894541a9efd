"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints at most two bits apart share at least six of their eight positional bytes. Posting
lists of a single byte (8 x 256 lists) would hold n / 256 fingerprints each and tally n * n / 64
pairs, so the index keeps the lists' intersections for four byte positions at a time: of the byte
pairs 01, 23, 45 and 67 two at least are whole, which makes six lists for each fingerprint and
loses no pair. For each pair that meets in a list the shared positional bytes are tallied, pairs
with six or more are retained, and their bits are compared.

A list of more than LONG_LIST fingerprints is not paired up: each of its members stands under
itself and its 32 one-bit changes in the bytes that the list leaves open. Two members that stand
under a same value are two bits apart at most, and any two that are so meet there; each is linked
to the least of them, so links grow with members, not with pairs, and components come out the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import row_of_batch, table, text_blocks
from foliograph.llm.graph import components, saved

SHINGLE = 3
RADIUS = 2
SEED = 42
LEAST_SHARED = 8 - RADIUS
LONG_LIST = 64
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 of every k-word shingle; bytes.split() splits at the blanks \\x20 and \\x09-\\x0D."""
    words = text.translate(_LOW).split()
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)]


def majority(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half the hashes of [cut, next cut); 0 where there are none."""
    out = np.zeros((len(cuts) - 1, 64), bool)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, cuts[:-1][full], axis=0, dtype=np.int32)
        out[full] = 2 * ones > np.diff(cuts)[full][:, None]
    return np.packbits(out, axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row's whole text; null, empty and blank texts have fingerprint zero."""

    def of(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            each = [shingle_hashes(data[a:b].tobytes(), k) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            flat = np.fromiter((h for x in each for h in x), np.uint64, cuts[-1])
            yield pa.record_batch([row_of_batch(rows, "doc_id"), pa.array(majority(flat, cuts))], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, fp long")


def _mask(groups: tuple[int, ...]) -> int:
    m = sum(0xFFFF << (16 * g) for g in groups)
    return m - (1 << 64) if m >> 63 else m


#: The four byte positions that each of the six lists of a fingerprint fixes.
LISTS = [_mask(g) for g in combinations(range(4), 2)]


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes are the same."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit((0xFF << (8 * i)) - (1 << 64 if i == 7 else 0))) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links between different fingerprints (column fp, distinct) that have the components of all pairs at most RADIUS bits apart. Every link is such a pair."""
    lists = F.explode(F.array(*[F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(LISTS)]))
    postings = prints.select("fp", lists.alias("x")).select("fp", "x.*")
    sizes = postings.groupBy("list", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = saved(postings.join(sizes, ["list", "key"]))
    short = met.filter(F.col("n") <= LONG_LIST)
    a, b = short.select("list", "key", F.col("fp").alias("u")), short.select("list", "key", F.col("fp").alias("v"))
    pairs = a.join(b, ["list", "key"]).filter("u < v").filter(shared_bytes(F.col("u"), F.col("v")) >= LEAST_SHARED)
    near = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")

    free = F.array(*[F.array(*[F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(64) if not (m >> i) & 1]) for m in LISTS])
    changes = F.concat(F.array(F.lit(0).cast("long")), F.element_at(free, F.col("list") + 1))
    under = met.filter(F.col("n") > LONG_LIST).select("list", "fp", F.explode(changes).alias("bit")).select("list", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
    least = under.groupBy("list", "value").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = under.join(least, ["list", "value"]).filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(starred).distinct()


def near_duplicates(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of at most RADIUS bits, its own included) of every row.

    Rows of one fingerprint, thus exact copies, are one node from the start. Texts without words link to each other and to any print of at most two bits.
    Null doc_ids don't count for the smallest unless there is no other. Repeated rows each get their row.
    """
    docs = saved(fingerprints(documents, k))
    prints = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("fp")))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.filter(F.col("fp") != F.col("root")).join(ids, "root").select("fp", "component_id")
    classes = classes.unionByName(ids.select(F.col("root").alias("fp"), "component_id"))
    return docs.join(classes, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
