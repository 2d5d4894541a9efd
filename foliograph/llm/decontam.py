"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over all training windows.

Every window of N words of every item is hashed and the hash set goes to the executors. Items of more
than MAX_WINDOWS windows are dealt over several such sets, a larger item in pieces, which look at the documents one
after the other; of each only the texts that it hits are written. A window of a document whose hash is in
the set is compared word by word before it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import LOWER, WORD_TABLE, free_name, row_of_batch, span_hashes, table, text_blocks, weighted, word_places
from foliograph.llm.graph import saved

N = 10
#: Windows of test items that are broadcast at once (about 520 bytes each in a worker), about; larger items are divided.
MAX_WINDOWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def item_windows(words: list[bytes], n: int = N) -> set[tuple[bytes, ...]]:
    """All windows of n consecutive words; all words as one window if they are fewer, but not none."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class WindowSet:
    """Windows of the items: sorted hashes by window length, and the exact words with their items."""

    def __init__(self, items: list[tuple], n: int = N):
        self.items: dict[tuple[bytes, ...], set] = {}
        for item_id, text in items:
            for w in item_windows(words_of((text or "").encode()), n):
                self.items.setdefault(w, set()).add(item_id)
        self.hashes: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        by: dict[int, list] = {}
        for w in self.items:
            by.setdefault(len(w), []).append(self.hash(w))
        for size, found in by.items():
            self.hashes[size] = np.unique(np.array(found, np.uint64))
            self.bits[size] = np.zeros(1 << 22, bool)
            self.bits[size][self.hashes[size] >> np.uint64(42)] = True

    @staticmethod
    def hash(window: tuple[bytes, ...]) -> int:
        data = np.frombuffer(b" ".join(window), np.uint8)
        starts, ends, _ = word_places(data, np.array([0, len(data)]))
        h = span_hashes(weighted(LOWER[data]), starts, ends)
        return int(span_hashes(weighted(h), np.array([0]), np.array([len(h)]))[0])

    def scan(self, data: np.ndarray, at: np.ndarray):
        """(word offsets of the texts, verified hits): a hit is (text, first word, words, window)."""
        starts, ends, cuts = word_places(data, at)
        hits = []
        if len(starts):
            low = LOWER[data]
            sums = weighted(span_hashes(weighted(low), starts, ends))
            for size, known in self.hashes.items():
                if len(starts) < size:
                    continue
                first = np.arange(len(starts) - size + 1)
                h = span_hashes(sums, first, first + size)
                near = np.flatnonzero(self.bits[size][h >> np.uint64(42)])
                near = near[known[np.minimum(np.searchsorted(known, h[near]), len(known) - 1)] == h[near]]
                text = np.searchsorted(cuts, near, "right") - 1
                for i, k in zip(near.tolist(), text.tolist(), strict=True):
                    if i + size <= cuts[k + 1]:
                        window = tuple(low[starts[j] : ends[j]].tobytes() for j in range(i, i + size))
                        if window in self.items:
                            hits.append((k, i - int(cuts[k]), size, window, (int(starts[i]), int(ends[i + size - 1]))))
        return cuts, hits


def words_in(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER_AZ, LOWER_AZ), F.lit(WORD), 0)


def in_pieces(benchmark: DataFrame, n: int, most: int) -> DataFrame:
    """item_id, piece, text, windows: items in pieces of at most `most` windows, so that every window lies in one piece; an item of fewer than n words is one piece."""
    words = benchmark.select("item_id", words_in("text").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)), F.lit(most))
    pieces = words.select("item_id", F.size("w").alias("size"), "w", F.posexplode(starts).alias("piece", "at"))
    text = F.array_join(F.slice("w", F.col("at") + 1, F.lit(most + n - 1)), " ")
    return pieces.select("item_id", "piece", text.alias("text"), F.greatest(F.lit(1), F.least(F.lit(most), F.col("size") - n + 1 - F.col("at"))).alias("windows"))


#: Hits by text: first word, words, items, and the bytes of the text.
HITS = "array<struct<first:int,size:int,ids:array<string>,a:int,b:int>>"
HITS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.string())), ("a", pa.int32()), ("b", pa.int32())]))


def hits_of(items: WindowSet, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, list[dict]]]:
    """Word offsets of the texts, and the hits (see HITS) of those that have some."""
    cuts, hits = items.scan(data, at)
    by: dict[int, list[dict]] = {}
    for k, first, size, window, (a, b) in hits:
        ids = [None if x is None else str(x) for x in items.items[window]]
        by.setdefault(k, []).append({"first": first, "size": size, "ids": ids, "a": a - int(at[k]), "b": b - int(at[k])})
    return cuts, by


def searched(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, n: int, max_windows: int):
    """Documents and a function of (rows, data, at) of their text blocks that gives what hits_of() gives for all items.

    Several sets are looked up one after the other, and what is written of each are the texts that it hits, by their SHA-256, with the hits; in the end the documents get them in a column of their own, in one join.
    """
    pieces = in_pieces(benchmark, n, max_windows)
    parts = -(-(pieces.agg(F.sum("windows")).first()[0] or 0) // max_windows)

    def shared(own: DataFrame):
        return spark.sparkContext.broadcast(WindowSet([tuple(r) for r in own.select("item_id", "text").collect()], n))

    if parts <= 1:
        items = shared(pieces)
        return documents, lambda rows, data, at: hits_of(items.value, data, at)
    key = F.unhex(F.sha2("text", 256))
    texts = documents.filter("text is not null").select(key.alias("key"), "text")
    found = None
    for p in range(parts):
        items = shared(pieces.filter(F.pmod(F.xxhash64("item_id", "piece", "text"), F.lit(parts)) == p))

        def look(batches: Iterator[pa.RecordBatch], items=items):
            for rows, data, at in text_blocks(batches):
                by = hits_of(items.value, data, at)[1]
                if by:
                    yield pa.record_batch([row_of_batch(rows, "key").take(pa.array(list(by))), pa.array(list(by.values()), HITS_ARROW)], ["key", "hits"])

        own = saved(texts.mapInArrow(look, f"key binary, hits {HITS}").dropDuplicates(["key"]))
        found = own if found is None else found.unionByName(own)
        items.unpersist()
    name, own_key = free_name(documents, "_hits"), free_name(documents, "_key")
    found = found.groupBy("key").agg(F.flatten(F.collect_list("hits")).alias(name)).withColumnRenamed("key", own_key)
    documents = documents.withColumn(own_key, key).join(found, own_key, "left").drop(own_key)

    def written(rows, data, at):
        return word_places(data, at)[2], {k: hits for k, hits in enumerate(row_of_batch(rows, name).to_pylist()) if hits}

    return documents, written


def scan(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (code points of the hit runs, end exclusive) for every row of documents.

    Null and empty texts have no words and no hits; null item texts have no windows; items with the same window all count.
    A null item_id counts as an item of its own, written as an empty string. Repeated rows each get their row; other columns are not read.
    """
    documents, hits = searched(spark, documents.select("doc_id", "text"), benchmark, n, max_windows)

    def look(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            cuts, by = hits(rows, data, at)
            m = len(at) - 1
            n_hit, n_items, shas, spans = np.zeros(m, np.int64), np.zeros(m, np.int64), [hashlib.sha256(b"").hexdigest()] * m, [[]] * m
            for k, found in by.items():
                covered = np.zeros(cuts[k + 1] - cuts[k], bool)
                for h in found:
                    covered[h["first"] : h["first"] + h["size"]] = True
                ids = set().union(*(h["ids"] for h in found))
                n_hit[k], n_items[k] = covered.sum(), len(ids)
                shas[k] = hashlib.sha256(",".join(sorted(x or "" for x in ids)).encode()).hexdigest()
                spans[k] = _merged(data[at[k] : at[k + 1]].tobytes(), [(h["a"], h["b"]) for h in found])
            yield pa.record_batch([
                row_of_batch(rows, "doc_id"), pa.array(np.diff(cuts), pa.int64()), pa.array(n_hit), pa.array(n_items), pa.array(shas), pa.array(n_hit > 0),
                pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(look, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>")


def _merged(text: bytes, found: list[tuple[int, int]]) -> list[list[int]]:
    """Byte spans that touch become one, then code points."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return before[np.array(out, int)].tolist()


def scan_by_join(documents: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The same result without spans, which the tests compare with: windows of both sides meet in a shuffle join by their text. Rows of one doc_id and text are one document here and come out as often as they went in."""
    words = words_in("text")

    def windows(size):
        return F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, size), " ").alias("g")))

    items = benchmark.select("item_id", words.alias("w")).filter(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(n)))
    grams = items.select("item_id", "size", F.explode(windows(F.col("size"))).alias("x")).select("item_id", "size", F.col("x.g").alias("g")).distinct()
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # n at most
    docs = documents.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).select("doc_id", "copies", F.xxhash64("text").alias("h"), words.alias("w"))
    hits = None
    for size in sizes:
        own = docs.filter(F.size("w") >= size).select("doc_id", "h", F.explode(windows(F.lit(size))).alias("x")).select("doc_id", "h", "x.at", "x.g")
        part = own.join(grams.filter(F.col("size") == size), "g").select("doc_id", "h", "at", F.lit(size).alias("size"), "item_id")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = docs.select("doc_id", "h", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("item_id")).filter("false")
    covered = hits.select("doc_id", "h", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("k")).groupBy("doc_id", "h").agg(F.count_distinct("k").alias("n_hit"))
    which = hits.select("doc_id", "h", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i")).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("i")).alias("ids"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("doc_id", "h")]
    joined = docs.alias("d").join(covered.alias("x"), same, "left").select("d.*", "n_hit")
    joined = joined.alias("d").join(which.alias("x"), same, "left").select("d.*", "ids")
    none = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(none).cast("long").alias("n_items"),
        F.sha2(F.array_join(none, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.explode(F.array_repeat("copies", F.col("copies").cast("int"))).alias("_c"),
    ).drop("_c")


def remove_spans(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, n: int = N, max_share: float = 0.5, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents with their benchmark passages cut out (a blank instead); those of whose words more than max_share are hit go. Same columns; n_chars counts anew where there is one. A null text stays null."""
    names, schema = documents.columns, documents.schema
    documents, hits = searched(spark, documents, benchmark, n, max_windows)

    def cut(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            cuts, by = hits(rows, data, at)
            text = row_of_batch(rows, "text").to_pylist()
            kept = np.ones(len(text), bool)
            for k, found in by.items():
                covered = np.zeros(cuts[k + 1] - cuts[k], bool)
                for h in found:
                    covered[h["first"] : h["first"] + h["size"]] = True
                kept[k] = covered.mean() <= max_share
                spans = _merged(text[k].encode(), [(h["a"], h["b"]) for h in found])
                text[k] = " ".join(text[k][a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), None], strict=True))
            rows = rows.select(names)
            place = rows.schema.get_field_index("text")
            yield rows.set_column(place, rows.schema.field(place), pa.array(text, rows.schema.field(place).type)).filter(pa.array(kept))

    out = documents.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(names) if "n_chars" in names else out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
sizes AS (SELECT DISTINCT n FROM g),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, g.item_id FROM dw JOIN g ON dw.g = g.g AND dw.n = g.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
