"""Connected components by alternating large and small stars, and tables written into the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.sources.tables import shared_folder

_written: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the shared folder and read again: the lineage ends here, the rows outlive lost executors, and the planner knows their size."""
    path = f"{shared_folder(df.sparkSession)}/foliograph-{uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_alone(step: Callable[[], DataFrame], before: list[str]) -> tuple[DataFrame, list[str]]:
    """What a step returns, saved, and its path; the tables that it has saved on its way and those of `before`, on which nothing depends any more, are removed."""
    first = len(_written)
    out = step()
    inner = _written[first:]
    out = saved(out)
    path = _written[-1]
    forget(out.sparkSession, [*before, *inner])
    return out, [path]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Removes saved tables, in whatever file system they lie."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def _large(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least one."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to its least one."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether each node of the links (u > v) either points to one other or is pointed to."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the least node reachable. No node has to see all of its component at once: every step is a grouped minimum and a join."""
    e = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(e):
        e = saved(_small(_large(e)))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
