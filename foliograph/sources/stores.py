"""Keyed stores as Parquet, saved by version, compacted and read by bucket.

Spark has no transaction over several tables, so a save writes each store under its version, then an index of the keys that it
touches, and publishes all of it by one row of a manifest, written last. Readers go by the manifest: of every key they see the
last published version of a store, whole. A save that fails is not seen, and saving the same version again overwrites what it left.

Rows and index lie in BUCKETS folders by a hash of their key, so a reader who asks for some keys opens their buckets alone. After COMPACT_AFTER
saves what is published is written as one base, published in the same way, from which readers then start; so they open as many files after a
thousand saves as after a few. What the base before it made superfluous is removed; readers of the last state are not disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators.playback import upsert

BUCKETS = 32
#: Saves on top of a base after which a new one is made.
COMPACT_AFTER = 8
BOOK = ["book_id"]


def bucket_of(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def put(rows: DataFrame, key: list[str], path: str) -> None:
    """One file by bucket at most, if the rows are few; the buckets of a base are written by as many tasks."""
    rows.withColumn("bucket", bucket_of(key)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def publish(spark: SparkSession, root: str, step: int, kind: str, stores: list[str]) -> None:
    spark.range(1).select(F.lit(kind).alias("kind"), F.array(*map(F.lit, stores)).cast("array<string>").alias("stores")).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/step={step}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder of any file system that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def published(spark: SparkSession, root: str, before: int | None = None) -> list:
    """Steps from the last base on, in order; a few rows, since compaction removes the older ones. before: of versions below it."""
    if not any(x.startswith("step=") for x in folders(spark, f"{root}/manifest")):
        return []
    steps = sorted((r["step"], r["kind"], r["stores"]) for r in spark.read.parquet(f"{root}/manifest").collect() if before is None or r["step"] < 2 * before)
    bases = [i for i, s in enumerate(steps) if s[1] == "base"]
    return steps[bases[-1] :] if bases else steps


def save(ids: DataFrame, root: str, version: int, stores: dict[str, DataFrame | None], key: list[str] = BOOK, compact_after: int = COMPACT_AFTER) -> None:
    """Replaces what the stores hold of the keys of ids, all at once; None removes it. Versions must ascend from 0; stores not named stay."""
    spark, ids, step = ids.sparkSession, ids.select(*key).distinct(), 2 * version
    for name, rows in stores.items():
        if rows is not None:
            put(rows.join(ids, key, "left_semi"), key, f"{root}/{name}/step={step}")
    touched = F.explode(F.array(*[F.struct(F.lit(name).alias("store"), F.lit(rows is not None).alias("kept")) for name, rows in stores.items()]))
    put(ids.select(*key, touched.alias("t")).select(*key, "t.*"), key, f"{root}/index/step={step}")
    publish(spark, root, step, "save", [name for name, rows in stores.items() if rows is not None])
    if len(published(spark, root)) > compact_after:
        compact(spark, root, version, key)


def load(spark: SparkSession, root: str, name: str, keys: DataFrame | None = None, key: list[str] = BOOK, before: int | None = None) -> DataFrame | None:
    """The rows of a store as last published (before: by versions below it), or of some keys, of whose buckets alone files are opened; None if nothing of the store was ever published.

    Rows of versions with further columns are read together with those that lack them, as nulls.
    """
    steps = published(spark, root, before)
    held = [s for s, _, stores in steps if name in stores]
    if not held:
        return None
    at = lambda part, of: spark.read.option("basePath", f"{root}/{part}").option("mergeSchema", True).parquet(*[f"{root}/{part}/step={s}" for s in of])
    rows, index = at(name, held), at("index", [s for s, _, _ in steps]).filter(F.col("store") == name)
    if keys is not None:
        keys = keys.select(*key).distinct()
        buckets = [r[0] for r in keys.select(bucket_of(key)).distinct().collect()]  # BUCKETS at most
        rows, index = (x.filter(F.col("bucket").isin(buckets)).join(keys, key, "left_semi") for x in (rows, index))
    last = index.groupBy(*key).agg(F.max("step").alias("step"), F.max_by("kept", "step").alias("kept")).filter("kept").drop("kept")
    return rows.join(last, [*key, "step"]).drop("step", "bucket")


def compact(spark: SparkSession, root: str, version: int, key: list[str] = BOOK) -> None:
    """Writes what is published up to a version as one base, publishes that, and removes what was superfluous before."""
    steps, step = published(spark, root), 2 * version + 1
    if [s[0] for s in steps] == [step]:  # made before, and perhaps stopped while it removed what was superfluous
        vacuum(spark, root, step)
        return
    names = sorted({name for _, _, stores in steps for name in stores})
    kept = None
    for name in names:
        rows = load(spark, root, name, key=key)
        put(rows, key, f"{root}/{name}/step={step}")
        own = rows.select(*key).distinct().withColumn("store", F.lit(name)).withColumn("kept", F.lit(True))
        kept = own if kept is None else kept.unionByName(own)
    if kept is not None:
        put(kept, key, f"{root}/index/step={step}")
        publish(spark, root, step, "base", names)
        vacuum(spark, root, steps[0][0])


def vacuum(spark: SparkSession, root: str, step: int) -> None:
    """Removes all that lies below a step; the manifest's rows first, so that what is half removed isn't seen."""
    for part in ["manifest", *(x for x in folders(spark, root) if x != "manifest")]:
        for x in folders(spark, f"{root}/{part}"):
            if x.startswith("step=") and int(x[5:]) < step:
                remove(spark, f"{root}/{part}/{x}")


def merge(rows: DataFrame, root: str, version: int, name: str, key: list[str], order: list[str]) -> None:
    """Saves of every key the last by order of the rows and of what is stored of it. The same version can be merged again."""
    ids = rows.select(*key).distinct()
    old = load(rows.sparkSession, root, name, ids, key, before=version)
    save(ids, root, version, {name: upsert(rows if old is None else rows.unionByName(old, allowMissingColumns=True), key, order)}, key)
