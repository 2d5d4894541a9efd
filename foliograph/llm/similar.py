"""Near-duplicates by word shingles of similarity LEAST or more: SimHash, the byte-position inverted index and count filtering.

The method is that of op8 (simhash.py) with wide fingerprints. At a similarity of 0.8 the vectors of two sets of shingles stand at
an angle of 0.476, so 15 % of their majority bits differ: ten of 64, of which an index of eight positional bytes promises a shared
one only up to seven. So the stage of the corpus pipeline takes fingerprints of POSITIONS bytes: a bit is 1 if it is set in over
half of the hashes of the text's different shingles. A list of the index holds the fingerprints that have the same two bytes at two
positions; each position belongs to one of the LISTS lists of a fingerprint. A pair of 0.8 meets in one with a chance of 0.9999.

Of pairs that meet, the bits of the first GLANCE bytes are looked at. Pairs that pass, however many, are linked to clusters, and all pairs of a cluster are compared
by their whole fingerprints: the shared positional bytes are tallied, pairs with LEAST_SHARED or more are retained, and their bits are compared. The standard deviation of the bits that differ is 16 at
0.8, so they decide only some three deviations away from LEAST: up to SURE differing bits a pair is a link, beyond FAR it is none.
Those between are links if the shingles of their texts have a similarity of LEAST or more; they are compared with the texts beside the members of the cluster.
Clusters of more than CLUSTER members are not crossed: their pairs are compared list by list, those between in the first list alone where they meet.

No pair of a list is left out. First the members of the lists of a few positions are dealt over blocks of BLOCK at most, and a
block is compared in one task, which joins most of what matches. Then all lists that still hold several components are
compared, those of more than SIDE members block against block, leaving out only pairs that are in one component already: the members of the list's largest
component meet all others, and those meet each other. So a list of one group is not compared again, and the work grows with
the square of a list's length only as far as its members don't match.
No step hands on pairs: a task returns links between components, or members of a cluster or list. The glances go over the lists in rounds, and after a
round what it has linked is one cluster, so that a group of copies is returned by the first lists alone, not once by list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import LOWER, byte_set, free_name, row_of_batch, span_hashes, text_blocks, weighted, word_places
from foliograph.llm.graph import components, saved

SHINGLE = 5
LEAST = 0.8
POSITIONS = 256
#: Positions by list, lists of a fingerprint, those of them that the first step goes through, and the rounds of lists whose members are dealt at a time.
BAND = 2
LISTS = POSITIONS // BAND
FIRST_LISTS, ROUNDS = 4, (0, 4, 32, 64, 96, LISTS)
NUMBERED = 48
#: Bytes of a fingerprint that all members of a list bring along, and differing bits of these up to which a pair goes on.
GLANCE, GLANCE_BITS = 32, 72
#: Shared bytes from which a pair is retained, differing bits up to which it is looked at, and up to which it is a link without a look at its texts.
LEAST_SHARED, FAR, SURE = 24, 448, 257
#: Members of a list that one task compares with each other at first, and members of each side when blocks meet.
BLOCK, SIDE = 512, 2048
#: Bytes of texts of each side when blocks meet with their texts, about; a longer text is there alone.
SIDE_BYTES = 1 << 24
#: Members of each side when the members of a cluster meet, and members up to which they do: a member has no more copies than lists.
CLUSTER_SIDE = 64
CLUSTER = LISTS * CLUSTER_SIDE
#: Hashes whose bits are added up at once: a sum fits a byte.
ADDED = 255
#: Pairs that are compared at once.
CELLS = 1 << 15
_NOT_BLANK = byte_set((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
_rng = np.random.default_rng(42)
_FLIP, _TIMES = _rng.integers(0, 2**64, (2, POSITIONS // 8), np.uint64)
_TIMES |= np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts (fewer words: the whole sequence), and n + 1 offsets by text."""
    low = LOWER[data]
    starts, ends, words = word_places(low, at, _NOT_BLANK)
    sums = weighted(span_hashes(weighted(low), starts, ends))
    n = np.diff(words)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    cuts = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(n)), many)
    first = words[text] + np.arange(cuts[-1]) - cuts[text]
    return span_hashes(sums, first, np.minimum(first + k, words[text + 1])), cuts


def wide(hashes: np.ndarray) -> np.ndarray:
    """POSITIONS bytes of hash bits by 64-bit hash."""
    x = (hashes[:, None] ^ _FLIP) * _TIMES
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x.view(np.uint8)


def sketch(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each text, a row of POSITIONS bytes: a bit is 1 if set in over half of its different hashes; zeros for a text without words."""
    out = np.zeros((len(cuts) - 1, POSITIONS), np.uint8)
    for t in np.flatnonzero(np.diff(cuts)).tolist():
        own = np.unique(hashes[cuts[t] : cuts[t + 1]])
        ones = np.zeros(POSITIONS * 8, np.int64)
        for i in range(0, len(own), ADDED):
            ones += np.unpackbits(wide(own[i : i + ADDED]), axis=1).sum(0, dtype=np.uint8)
        out[t] = np.packbits(2 * ones > len(own))
    return out


def row_key() -> Column:
    """The same for rows of one doc_id (or none) and one text only."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def sketches(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, key (row_key()), size (bytes) and sketch (binary) of every row's whole text; null, empty and blank texts have the zero sketch."""

    def of(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            found = sketch(*shingle_hashes(data, at, k))
            yield pa.record_batch([row_of_batch(rows, "doc_id"), row_of_batch(rows, "key"), pa.array(np.diff(at)), pa.array([r.tobytes() for r in found], pa.binary())], ["doc_id", "key", "size", "sketch"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", row_key().alias("key"), "text").mapInArrow(of, f"doc_id {kind}, key long, size long, sketch binary")


#: own: the member is compared with the whole part; root: its component.
PART = ["list", "block", "node", "root", "own", "sketch"]


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[str]]]:
    """The rows of whole parts (list, block), which lie together, as arrays of the columns of PART, and their texts if there are such."""
    held, texts = None, []
    for batch in batches:
        if batch.num_rows:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            _, places, values = batch.column(5).buffers()
            at = np.frombuffer(places, np.int32)[batch.column(5).offset :]
            now.append(np.frombuffer(values, np.uint8)[at[0] : at[batch.num_rows]].reshape(batch.num_rows, -1))
            texts += batch.column(6).to_pylist() if batch.num_columns > 6 else []
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cuts = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if len(cuts):
                yield [c[: cuts[-1]] for c in held], texts[: cuts[-1]]
                held, texts = [c[cuts[-1] :] for c in held], texts[cuts[-1] :]
    if held is not None:
        yield held, texts


class Shingles:
    """Whether two of the texts have k-word shingles of similarity LEAST or more; each text is hashed once."""

    def __init__(self, texts: list[str], k: int):
        self.texts, self.k, self.known = texts, k, {}

    def of(self, i: int) -> np.ndarray:
        if i not in self.known:
            data = self.texts[i].encode()
            self.known[i] = np.unique(shingle_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), self.k)[0])
        return self.known[i]

    def similar(self, i: int, j: int) -> bool:
        a, b = sorted((self.of(i), self.of(j)), key=len)
        if not len(a) or len(a) < LEAST * len(b):
            return False
        shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return shared >= LEAST * (len(a) + len(b) - shared)


def compared(columns: list[np.ndarray], far: int, sure: int, texts: Shingles | None) -> tuple[np.ndarray, np.ndarray]:
    """Of whole parts: components as their links leave them, and which members have pairs of more than sure and up to far differing bits that these don't join. With texts, those pairs are links or not.

    Whole fingerprints are tallied first, and asked for in the first list alone where the two meet, or in their cluster; of shorter ones all pairs of up to far bits are asked for.
    """
    lists, block, _, root, own, sketch = columns
    root, asked, full = root.copy(), np.zeros(len(root), bool), sketch.shape[1] == POSITIONS
    words, which = np.ascontiguousarray(sketch).view(np.uint64), lists >> NUMBERED
    left, held = np.arange(len(root)), []

    def join(a, b):
        root[root == max(a, b)] = min(a, b)

    # members that stand d places apart, for all parts at once
    for d in range(1, len(root)):
        left = left[: np.searchsorted(left, len(root) - d)]
        left = left[(lists[left] == lists[left + d]) & (block[left] == block[left + d])]
        if not len(left):
            break
        i = left[(own[left] | own[left + d]) & (root[left] != root[left + d])]
        for k in range(0, len(i), CELLS):
            a = i[k : k + CELLS]
            if full:
                same = sketch[a] == sketch[a + d]
                a, same = a[(kept := same.sum(1) >= LEAST_SHARED)], same[kept]
            bits = np.bitwise_count(words[a] ^ words[a + d]).sum(1, dtype=np.int64)
            for x in a[bits <= sure].tolist():
                if root[x] != root[x + d]:
                    join(root[x], root[x + d])
            between = (bits > sure) & (bits <= far) & (root[a] != root[a + d])
            if full:
                both = same.reshape(len(a), LISTS, BAND).all(2)
                between &= (which[a] == LISTS) | (both.argmax(1) == which[a])
            if texts is None:
                held.append((a[between], d))
            else:
                for x in a[between].tolist():
                    if root[x] != root[x + d] and texts.similar(x, x + d):
                        join(root[x], root[x + d])
    for a, d in held:
        a = a[root[a] != root[a + d]]
        asked[a] = asked[a + d] = True
    return root, asked


def matching(parts: DataFrame, far: int, sure: int, k: int) -> DataFrame:
    """(a, b, list, node): either components a, b that are one, or a member of a list that has pairs of more than sure and up to far bits. Parts with a column text have their pairs decided by it."""

    def found(batches: Iterator[pa.RecordBatch]):
        for columns, texts in parts_of(batches):
            lists, node, root = columns[0], columns[2], columns[3]
            now, asked = compared(columns, far, sure, Shingles(texts, k) if texts else None)
            old, at = np.unique(root, return_index=True)
            moved = now[at] != old
            n, m = int(moved.sum()), int(asked.sum())
            if n + m:
                left, right = pa.nulls(n, pa.int64()), pa.nulls(m, pa.int64())
                columns = [pa.concat_arrays([pa.array(x), right]) for x in (old[moved], now[at][moved])] + [pa.concat_arrays([left, pa.array(x)]) for x in (lists[asked], node[asked])]
                yield pa.record_batch(columns, ["a", "b", "list", "node"])

    columns = [*PART, *(["text"] if "text" in parts.columns else [])]
    return parts.select(columns).repartition("list", "block").sortWithinPartitions("list", "block").mapInArrow(found, "a long, b long, list long, node long")


def whole(n: Column, size: int | Column, n_bytes: Column | None = None) -> Column:
    """Blocks for n members, or for members with so many bytes of text."""
    parts = F.ceil(n / size).cast("int")
    return parts if n_bytes is None else F.greatest(parts, F.ceil(n_bytes / SIDE_BYTES).cast("int"))


def deal(own: str, of: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(own)), of).cast("int")


def listed(nodes: DataFrame, first: int, end: int) -> DataFrame:
    """(list, node, root, and other columns) by each of the lists [first, end) of the nodes (node, root, sketch, ...). A list is its number, then NUMBERED bits of a hash of the bytes at its positions."""
    value = lambda i: F.xxhash64(F.substring("sketch", i * BAND + 1, F.lit(BAND))).bitwiseAND(F.lit((1 << NUMBERED) - 1))
    keys = F.array(*[F.lit(i << NUMBERED) + value(i) for i in range(first, end)])
    return nodes.select(F.explode(keys).alias("list"), *[c for c in nodes.columns if c != "sketch"])


def several(lists: DataFrame) -> DataFrame:
    """The lengths n of those lists that hold several components."""
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return saved(sizes.select("list", "n"))


def blocks(lists: DataFrame) -> DataFrame:
    """Each member of a list in one block of the list."""
    return lists.withColumn("block", deal("block", whole(F.col("n"), BLOCK))).withColumn("own", F.lit(True))


def met(lists: DataFrame) -> DataFrame:
    """Each two members of different components of a list in a block: lists of up to SIDE members as they are, without a look at what they hold, longer ones crossed."""
    long = F.broadcast(saved(lists.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > SIDE).select("list")))
    short = lists.join(long, "list", "left_anti").withColumn("own", F.lit(True)).withColumn("block", F.lit(0))
    return short.unionByName(crossed(lists.join(long, "list", "left_semi")).select(short.columns))


def crossed(lists: DataFrame) -> DataFrame:
    """The lists or clusters of several components, so that each two members of different components meet in a block. A column size, if there is one, counts bytes of text."""
    size = F.col("size") if "size" in lists.columns else F.lit(0)
    sizes = lists.groupBy("list", "root").agg(F.count("*").alias("m"), F.sum(size).alias("b")).groupBy("list")
    sizes = sizes.agg(F.max(F.struct("m", "root", "b")).alias("top"), F.sum("m").alias("n"), F.sum("b").alias("b")).filter("top.m < n")
    side = F.when(F.shiftright("list", NUMBERED) == LISTS, CLUSTER_SIDE).otherwise(SIDE)
    i, j = whole(F.col("top.m"), side, F.col("top.b")), whole(F.col("n") - F.col("top.m"), side, F.col("b") - F.col("top.b"))
    sizes = sizes.select("list", F.col("top.root").alias("top"), i.alias("i"), j.alias("j"))
    dealt = lists.join(sizes, "list").withColumn("own", F.col("root") != F.col("top")).withColumn("at", deal("side", F.when(F.col("own"), F.col("j")).otherwise(F.col("i"))))
    # block x * j + y: members x of the largest component and y of the others; i * j + x * j + y, x < y: members x and y of the others
    largest = F.transform(F.sequence(F.lit(0), F.col("j") - 1), lambda y: F.col("at") * F.col("j") + y)
    others = F.transform(F.sequence(F.lit(0), F.col("i") - 1), lambda x: x * F.col("j") + F.col("at"))
    each = F.filter(F.sequence(F.lit(0), F.col("j") - 1), lambda y: y != F.col("at"))
    pairs = F.transform(each, lambda y: (F.col("i") + F.least(y, F.col("at"))) * F.col("j") + F.greatest(y, F.col("at")))
    return dealt.withColumn("block", F.explode(F.when(F.col("own"), F.concat(others, pairs)).otherwise(largest)))


def renamed(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, root) after links between them have joined some."""
    joined = saved(components(links))
    if known is None:
        return joined
    old = known.join(joined.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return saved(old.unionByName(joined.join(known, "node", "left_anti")))


def roots(nodes: DataFrame, documents: DataFrame | None = None, k: int = SHINGLE) -> DataFrame:
    """(node, root) of those of the nodes (node, sketch, key, size; distinct) that match others: root is the least node reachable over links of pairs that meet in a list.

    key names a node's row of documents by row_key(), size counts its text's bytes. Without documents pairs of up to FAR differing bits are links.
    """
    prints, sure = nodes.select("node", "sketch"), FAR if documents is None else SURE
    links = lambda out: out.filter("a is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    asked = lambda out: out.filter("node is not null").select("list", "node").distinct()
    first = listed(prints.withColumn("root", F.col("node")), 0, FIRST_LISTS)
    known = renamed(None, links(matching(blocks(first.join(several(first), "list")).join(prints, "node"), SURE, SURE, k)))
    rooted = lambda of: prints.join(of, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("glance", F.substring("sketch", 1, GLANCE))
    near = known
    for i, end in pairwise(ROUNDS):
        parts = met(listed(rooted(near), i, end)).withColumnRenamed("glance", "sketch")
        near = renamed(near, links(matching(parts, GLANCE_BITS, GLANCE_BITS, k)))
    sizes = near.groupBy("root").agg(F.count("*").alias("members"))
    near = saved(near.join(sizes, "root").select("node", F.col("root").alias("cluster"), "members"))
    now = saved(rooted(known).join(near, "node"))
    cluster = F.lit(LISTS << NUMBERED) + F.xxhash64("cluster").bitwiseAND(F.lit((1 << NUMBERED) - 1))
    parts = crossed(now.filter(F.col("members") <= CLUSTER).select(cluster.alias("list"), "node", "root", "sketch")).select(PART)
    large = now.filter(F.col("members") > CLUSTER).select("node", "root", "sketch", "glance")
    if not large.isEmpty():
        lists = asked(matching(met(listed(large, 0, LISTS)).withColumnRenamed("glance", "sketch"), GLANCE_BITS, -1, k))
        parts = parts.unionByName(met(saved(lists.join(large.drop("glance"), "node"))).select(PART))
    out = saved(matching(parts, FAR, sure, k))
    known = renamed(known, links(out))
    if documents is None:
        return known
    lists = asked(out).join(known, "node", "left").join(nodes.select("node", "size"), "node").withColumn("root", F.coalesce("root", "node"))
    lists = saved(lists)
    lists = saved(lists.join(several(lists), "list"))
    keys = saved(nodes.join(lists.select("node").distinct(), "node").select("node", "sketch", F.col("key").alias("_key")))
    texts = documents.select(row_key().alias("_key"), "text").join(keys, "_key").select("node", "sketch", "text").dropDuplicates(["node"])
    return renamed(known, links(matching(crossed(lists).join(texts, "node"), FAR, SURE, k)))


def grouped(documents: DataFrame, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """doc_id, key and root of every row (rows of one root are one group), written, and the rows of sketches by node."""
    docs = saved(sketches(documents, k).select("doc_id", "key", "size", "sketch", F.xxhash64("sketch").alias("node")))
    nodes = saved(docs.groupBy("node").agg(F.first("sketch").alias("sketch"), F.min(F.struct("key", "size")).alias("row")).select("node", "sketch", "row.key", "row.size"))
    known = roots(nodes.filter(F.col("sketch") != F.lit(bytes(POSITIONS))), documents, k)
    return saved(docs.select("doc_id", "key", "node").join(known, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root")))


def near_duplicates(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links, its own included) of every row.

    Rows of one sketch, thus exact copies, are one node from the start; texts without words are one group of their own.
    Null doc_ids don't count for the smallest unless there is no other. Repeated rows each get their row.
    """
    docs = grouped(documents, k)
    return docs.join(docs.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row of each group of near_duplicates(), in the same columns: the one of the least doc_id (none: last), of several the one of the least row_key().

    Null, empty and blank texts are one group. All columns come back as they are, whatever their names.
    """
    docs = grouped(documents, k)
    first = docs.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id"), F.col("key"))).alias("first")).select(F.col("first.key").alias("key"))
    kept = saved(docs.groupBy("key").agg(F.count("*").alias("n")).join(first.withColumn("keep", F.lit(True)), "key", "left"))
    key, place = free_name(documents, "key"), free_name(documents, "place")
    gone = kept.filter("keep is null").select(F.col("key").alias(key))
    repeated = kept.filter("keep and n > 1").select(F.col("key").alias(key))
    # of rows of one doc_id (or none) and text the least is taken in partial steps: they may be many
    rows = documents.withColumn(key, row_key()).join(gone, key, "left_anti")
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]))
    one = rows.join(repeated, key, "left_semi").groupBy(key).agg(least.alias(place)).select(f"`{place}`.*")
    return rows.join(repeated, key, "left_anti").select(documents.columns).unionByName(one)
