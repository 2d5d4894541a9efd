"""Exact duplicates by a content sort.

Spark samples splitters and deals the normalised texts over ranges, sorts every range externally, and so places equal texts side
by side. Each range is then read once in order and every text is compared, in full, with the one before it. Splitters are of
bounded size: the first HEAD characters, then a digest that tells texts of one head apart, then the identifier. So a group of
copies that holds a third of all rows is split over as many ranges as its share needs. The first and last run of each range,
two rows a range, are compared once more with those of the ranges beside it, and runs that go on are counted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import free_name, row_of_batch, table
from foliograph.llm.decontam import LOWER_AZ, UPPER_AZ
from foliograph.llm.graph import saved

#: Characters of a text that a splitter holds.
HEAD = 64


def normal(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER_AZ, LOWER_AZ))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Runs:
    """Rows of one range in order, cut into runs of equal texts; a run may go on over batches, of which only its ids are held."""

    #: edge: 1 the range's first run, 2 its last, 3 both; text: of the first row of such runs.
    NAMES = ["doc_id", "keep_id", "group_size", "kept", "sha", "part", "edge", "text"]

    def __init__(self, part: int):
        self.part, self.ids, self.text, self.sha, self.closed = part, [], None, None, 0

    def add(self, ids: pa.Array, text: pa.Array, sha: pa.Array) -> Iterator[pa.RecordBatch]:
        same = np.concatenate([[self.ids != [] and text[0].equals(self.text)], pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero(~same)
        if self.ids:
            self.ids.append(ids[: starts[0]] if len(starts) else ids)
        if len(starts):
            if self.ids:
                yield self.close(0)
            cuts = starts
            if self.closed == 0 and len(cuts) > 1:
                self.open(ids[cuts[0] : cuts[1]], text[cuts[0]], sha[cuts[0]])
                yield self.close(0)
                cuts = cuts[1:]
            if len(cuts) > 1:
                self.closed += len(cuts) - 1
                yield self.rows(ids[cuts[0] : cuts[-1]], cuts - cuts[0], pc.take(sha, pa.array(cuts[:-1])), 0, None)
            # a text is held, not the batch that it lies in
            self.open(ids[cuts[-1] :], pa.scalar(text[cuts[-1]].as_py(), text.type), pa.scalar(sha[cuts[-1]].as_py(), sha.type))

    def open(self, ids, text, sha) -> None:
        self.ids, self.text, self.sha = [ids], text, sha

    def close(self, last: int) -> pa.RecordBatch:
        """The open run; last is 2 at the end of the range."""
        ids, edge = pa.concat_arrays(self.ids), last + (self.closed == 0)
        self.ids, self.closed = [], self.closed + 1
        return self.rows(ids, np.array([0, len(ids)]), pa.array([self.sha.as_py()], self.sha.type), edge, self.text.as_py() if edge else None)

    def rows(self, ids: pa.Array, cuts: np.ndarray, sha: pa.Array, edge: int, text: str | None) -> pa.RecordBatch:
        sizes = np.diff(cuts)
        run = np.repeat(np.arange(len(sizes)), sizes)
        kept = np.zeros(len(ids), bool)
        kept[cuts[:-1]] = True
        n = len(ids)
        texts = pa.nulls(n, pa.string()) if text is None else pa.array([text, *[None] * (n - 1)], pa.string())
        columns = [ids, pc.take(ids, pa.array(cuts[:-1][run])), pa.array(sizes[run]), pa.array(kept), pc.take(sha, pa.array(run)), pa.array(np.full(n, self.part, np.int32)), pa.array(np.full(n, edge, np.int32)), texts]
        return pa.record_batch(columns, self.NAMES)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = Runs(TaskContext.get().partitionId())
    for rows in batches:
        if rows.num_rows:
            yield from runs.add(*(row_of_batch(rows, c) for c in ("doc_id", "text", "sha")))
    if runs.ids:
        yield runs.close(2)
    pa.default_memory_pool().release_unused()


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id (the largest doc_id among the rows of an equal text, which stays), group_size, kept and sha (binary SHA-256 of the normalised text) of every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Null doc_ids come last: such a row stays only if its group has no other.
    Of rows repeated with the doc_id that stays, one is kept. Other columns are not read. An empty table gives an empty table.
    """
    rows = documents.select("doc_id", normal(F.col("text")).alias("text"), F.spark_partition_id().alias("from"))
    rows = rows.select("doc_id", "text", F.substring("text", 1, HEAD).alias("head"), digest(F.col("text")).alias("sha"), "from")
    order = [F.desc_nulls_last("doc_id"), "from"]
    ranges = rows.repartitionByRange("head", "sha", *order).sortWithinPartitions("head", "sha", "text", *order)
    kind = documents.schema["doc_id"].dataType.simpleString()
    # written, so that numbers of ranges stay what they are
    found = saved(ranges.select("doc_id", "text", "sha").mapInArrow(compared, f"doc_id {kind}, keep_id {kind}, group_size long, kept boolean, sha binary, part int, edge int, text string"))

    edges = found.filter("edge > 0").groupBy("part", "edge").agg(F.count("*").alias("n"), F.max("keep_id").alias("keep"), F.max("text").alias("text"))
    # two rows a range, without texts: the ranges' own order
    line = Window.orderBy("part", "edge")
    edges = edges.join(edges.select("part", "edge").withColumn("at", F.row_number().over(line)), ["part", "edge"])
    after = edges.select((F.col("at") + 1).alias("at"), F.col("part").alias("part_before"), F.col("text").alias("text_before"))
    goes_on = F.coalesce((F.col("part_before") < F.col("part")) & (F.col("text_before") == F.col("text")), F.lit(False))
    chained = edges.join(after, "at", "left").select("at", "part", "edge", "n", "keep", goes_on.alias("goes_on"))
    chained = chained.withColumn("chain", F.sum((~F.col("goes_on")).cast("long")).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    whole = chained.groupBy("chain").agg(F.sum("n").alias("whole"), F.max("keep").alias("whole_keep"))
    stitched = chained.join(whole, "chain").select("part", "edge", "goes_on", "whole", "whole_keep")

    ends = found.filter("edge > 0").drop("text").join(stitched, ["part", "edge"])
    ends = ends.select("doc_id", F.col("whole_keep").alias("keep_id"), F.col("whole").alias("group_size"), (F.col("kept") & ~F.col("goes_on")).alias("kept"), "sha")
    return found.filter("edge = 0").select("doc_id", "keep_id", "group_size", "kept", "sha").unionByName(ends)


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents without exact duplicates: of each group one row, with all its columns, of those with the largest doc_id."""
    key = free_name(documents, "_sha")
    stay = groups(documents).filter("kept").select(F.col("sha").alias(key), F.col("doc_id").alias(f"{key}id"))
    same = [F.col(key), F.col(f"{key}id")]
    docs = documents.withColumn(key, digest(normal(F.col("text")))).alias("d")
    stay = stay.alias("k")
    return docs.join(stay, (F.col(f"d.{key}") == F.col(f"k.{key}")) & F.col("d.doc_id").eqNullSafe(same[1]), "left_semi").dropDuplicates([key]).drop(key)


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
