"""Prefix tries of conversations by van Emde Boas recursion.

A trie of height 2^j is cut at half its depth: an upper trie, and below it a forest whose roots are the prefixes that reach the cut. A
prefix at the cut is named, by its smallest member, from the name of the trie's root and the name of the 2^(j-1) turns after it; names
of runs of turns come from pairs of shorter runs. The upper trie and the lower forest are then tries of half the height, so one round
of grouping and joining cuts all tries of a height at once, and as many rounds as the longest conversation's length has binary digits
name every prefix. Totals go the other way: once tries of a height have their totals, the roots of the lower ones are grafted onto
the nodes of the upper one that they hang below, all pairs of tries in one round.

Rows are (conversation, depth); no step holds a whole conversation or a whole node, and a round of halved height has at most half
the rows of all turns. Only the digest of a node's members needs them in order, which SHA-256 asks for: ids are joined to long strings range by range,
and only those strings meet by node, where they are hashed one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import row_of_batch, table
from foliograph.llm.graph import saved

#: Conversations that take their heads from the same one, and remainders of crc32 that say how many turns they take.
FAMILY, FOLDS = 5, 9
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), name (a digest of role and text), size (UTF-8 bytes of the text), by turn (null first); null role and text are empty.

    Rows of one turn number stand in the order of their digests. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", name.alias("name"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "name")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), F.unhex("name").alias("name"), "size")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, pos, name, size) in which conversation c begins with the first h turns of c - c % FAMILY, with h = crc32(c) % FOLDS, and goes on with its own turns after its first h; and (conv_id, length) of all of them."""
    c = F.col("conv_id")
    ids = own.select("conv_id").distinct().select("conv_id", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string")) % FOLDS).alias("h"))
    head = ids.join(own.withColumnRenamed("conv_id", "base"), "base").filter("pos <= h").select("conv_id", "pos", "name", "size")
    sizes = own.groupBy(F.col("conv_id").alias("base")).agg(F.max("pos").alias("n"))
    ids = ids.join(sizes, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    rest = own.join(ids, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "size")
    sequences = saved(head.unionByName(rest))
    lengths = ids.select("conv_id").join(sequences.groupBy("conv_id").agg(F.max("pos").alias("length")), "conv_id", "left")
    return sequences, saved(lengths.select("conv_id", F.coalesce("length", F.lit(0)).alias("length")))


def runs_of_turns(sequences: DataFrame, rounds: int) -> list[DataFrame]:
    """By j: (conv_id, i, run), the name of the turns after (i - 1) * 2^j up to i * 2^j, from those of two halves."""
    out = [sequences.select("conv_id", F.col("pos").alias("i"), F.col("name").alias("run"))]
    for _ in range(1, rounds):
        odd = F.col("i") % 2 == 1
        pairs = out[-1].groupBy("conv_id", F.shiftright(F.col("i") + 1, 1).alias("i")).agg(F.max(F.when(odd, F.col("run"))).alias("a"), F.max(F.when(~odd, F.col("run"))).alias("b"))
        out.append(saved(pairs.filter("a is not null and b is not null").select("conv_id", "i", F.unhex(F.sha2(F.concat("a", "b"), 256)).alias("run"))))
    return out


def prefixes(sequences: DataFrame, lengths: DataFrame, rounds: int, least: int) -> DataFrame:
    """(conv_id, depth, node) of every prefix of every conversation, its empty one included: node is the smallest conversation that begins with it."""
    runs = runs_of_turns(sequences, rounds)
    named = lengths.select("conv_id", F.lit(0).cast("long").alias("i"), F.lit(least).cast("long").alias("node"))
    for j in reversed(range(rounds)):
        # the tries of height 2^(j+1) are cut at 2^j; i counts depths by 2^j, so odd ones are the cuts
        cut = runs[j].filter("i % 2 = 1").join(named.select("conv_id", (F.col("i") * 2 + 1).alias("i"), F.col("node").alias("root")), ["conv_id", "i"])
        names = cut.groupBy("root", "i", "run").agg(F.min("conv_id").alias("node"))
        found = cut.join(names, ["root", "i", "run"]).select("conv_id", "i", "node")
        named = saved(named.withColumn("i", F.col("i") * 2).unionByName(found))
    return named.withColumnRenamed("i", "depth")


def grafted(own: DataFrame, paths: DataFrame, rounds: int) -> DataFrame:
    """Sums over subtrees of the columns n_leaves and saved_tokens of nodes (conv_id, depth). paths: prefixes()."""
    totals = own
    for j in range(rounds):
        place = F.shiftright("depth", j)
        roots = totals.filter((F.col("depth") % (1 << j) == 0) & (place % 2 == 1)).select("conv_id", (place - 1).alias("upper"), "n_leaves", "saved_tokens")
        above = paths.filter(place % 2 == 0).select("conv_id", place.alias("upper"), "node", "depth")
        more = roots.join(above, ["conv_id", "upper"]).select(F.col("node").alias("conv_id"), "depth", "n_leaves", "saved_tokens")
        totals = saved(totals.unionByName(more).groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    return totals


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, depth, conv_id) in order, ids that follow each other in a node comma-joined, with the first of them."""
    for rows in batches:
        node, depth, ids = (row_of_batch(rows, c).to_pylist() for c in ("node", "depth", "conv_id"))
        heads = [i for i in range(len(ids)) if i == 0 or node[i] != node[i - 1] or depth[i] != depth[i - 1]]
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(heads, [*heads[1:], len(ids)], strict=True)]
        yield pa.record_batch([pa.array([x[i] for i in heads], pa.int64()) for x in (node, depth, ids)] + [pa.array(texts, pa.string())], ["node", "depth", "first", "ids"])


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of a node's strings, which lie together in order; one string is held at a time."""
    held, state = None, None
    out = lambda keys, shas: pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(shas, pa.string())], ["conv_id", "depth", "ends_sha256"])
    for rows in batches:
        keys, shas = [], []
        for key, ids in zip(zip(row_of_batch(rows, "node").to_pylist(), row_of_batch(rows, "depth").to_pylist(), strict=True), row_of_batch(rows, "ids"), strict=True):
            if key != held:
                if held is not None:
                    keys.append(held)
                    shas.append(state.hexdigest())
                held, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        yield out(keys, shas)
    if held is not None:
        yield out([held], [state.hexdigest()])


def ends(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end: a digest of their ids, ascending, comma-joined."""
    last = paths.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("node", "depth", "conv_id")
    order = ["node", "depth", "conv_id"]
    strings = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined_ids, "node long, depth long, first long, ids string")
    return strings.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(hashed_ids, "conv_id long, depth long, ends_sha256 string")


def trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row by distinct prefix of the sequences (conv_id, pos from 1, name, size; lengths: conv_id, length), the empty one included.

    conv_id (smallest member), depth, parent_conv_id (of the prefix without its last turn; null for the root), n_convs (members), n_children, n_leaves (childless
    nodes below, or itself), saved_tokens (over its subtree: members but one, times the size of the last turn), ends_sha256 (ids of members that end there).
    No conversations give no nodes.
    """
    deepest, least = lengths.agg(F.max("length"), F.min("conv_id")).first()
    if least is None:
        return sequences.sparkSession.createDataFrame([], NODES)
    rounds = deepest.bit_length()
    paths = prefixes(sequences, lengths, rounds, least)
    members = paths.groupBy(F.col("node").alias("conv_id"), "depth").agg(F.count("*").alias("n_convs"))
    # a node's own conversation leads to its parent and has its last turn
    before = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    last = sequences.select("conv_id", F.col("pos").alias("depth"), "size")
    nodes = saved(members.join(before, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left"))
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))).alias("saved_tokens"))
    rows = nodes.join(grafted(own, paths, rounds), ["conv_id", "depth"]).join(ends(paths, lengths), ["conv_id", "depth"], "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))


OP11_SQL = """
WITH t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, name) AS k, name, size FROM (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)),
bits AS (SELECT c, c - c % 5 AS base, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS x FROM (SELECT DISTINCT c FROM t)),
ids AS (SELECT c, base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], x), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 9 AS h FROM bits),
m AS (SELECT ids.c, h, count(t.k) AS taken FROM ids LEFT JOIN t ON t.c = base AND t.k <= h GROUP BY ids.c, h),
s AS (SELECT ids.c, t.k AS d, name, size FROM ids JOIN t ON t.c = base AND t.k <= h UNION ALL SELECT t.c, t.k - h + taken, name, size FROM t JOIN m ON t.c = m.c WHERE t.k > h),
l AS (SELECT m.c, coalesce(list(name ORDER BY d) FILTER (d IS NOT NULL), []) AS names, coalesce(list(size ORDER BY d) FILTER (d IS NOT NULL), []) AS sizes FROM m LEFT JOIN s ON s.c = m.c GROUP BY m.c),
p AS (SELECT c, d, len(names) AS n, CASE WHEN d = 0 THEN '' ELSE array_to_string(names[1:d], '') END AS key, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size FROM (SELECT *, unnest(range(0, len(names) + 1)) AS d FROM l)),
n AS (SELECT key, d, min(c) AS c, count(*) AS members, (count(*) - 1) * max(size) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY key, d),
k AS (SELECT x.key, count(y.key) AS children FROM n x LEFT JOIN n y ON y.d = x.d + 1 AND y.key[:64 * x.d] = x.key GROUP BY x.key),
b AS (SELECT x.key, CAST(sum((k.children = 0)::INT) AS BIGINT) AS leaves, CAST(sum(y.own) AS BIGINT) AS saved FROM n x JOIN n y ON y.d >= x.d AND y.key[:64 * x.d] = x.key JOIN k ON k.key = y.key GROUP BY x.key)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, u.c AS parent_conv_id, n.members AS n_convs, k.children AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN k ON k.key = n.key JOIN b ON b.key = n.key LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.key = n.key[:64 * (n.d - 1)]
"""
