"""Orders that no single task has to see: running sums and ranks over ranges, and chains followed by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.sources.tables import written


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str], place: str | None = None) -> DataFrame:
    """rows with, for each of sums (name: column), the sum of the column over the rows before in the order of their key, and the row's place (from 0). order must be total within a key.

    A scan on two levels: rows are dealt over ranges of (keys, order) by sampled splitters, each range is summed, the ranges' sums are added up in
    their order (a row for each range and key in it), and each range is scanned on its own. So a key that holds a third of all rows, or an order
    without any key, is scanned by as many tasks as it fills ranges.
    """
    values = sums | ({place: "_one"} if place else {})
    own = rows.withColumn("_one", F.lit(1).cast("long")).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    own = written(own)
    parts = own.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in values.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_range", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in values])
    so_far = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = own.select("*", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(name) for name, c in values.items()])
    on = F.col("s._range") == F.col("p._range")
    for k in keys:
        on &= F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}"))
    joined = scanned.alias("s").join(parts.alias("p"), on)
    return joined.select(*[F.col(f"s.{c}") for c in rows.columns], *[(F.col(f"s.{name}") + F.col(f"p._{name}")).cast(scanned.schema[name].dataType).alias(name) for name in values])


def segment_sums(rows: DataFrame, keys: list[str], order: list[Column], starts: str, sums: dict[str, str]) -> DataFrame:
    """rows with segment (from 0, counted within the key; a row whose boolean column `starts` is true opens one) and, for each of sums, the sum of a column that is never negative
    from the segment's first row up to the row itself. One scan: what had been summed up before a segment is the least sum before any of its rows."""
    found = running(rows.withColumn("_start", F.coalesce(F.col(starts), F.lit(False)).cast("long")), keys, order, {"_opened": "_start"} | {f"_sum_{name}": c for name, c in sums.items()})
    found = found.withColumn("_opened", F.col("_opened") + F.col("_start"))
    base = found.groupBy(*keys, "_opened").agg(*[F.min(f"_sum_{name}").alias(f"_base_{name}") for name in sums])
    on = F.col("r._opened") == F.col("b._opened")
    for k in keys:
        on &= F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    totals = [(F.col(f"r._sum_{name}") + F.coalesce(F.col(f"r.{c}"), F.lit(0)) - F.col(f"b._base_{name}")).cast("long").alias(name) for name, c in sums.items()]
    return found.alias("r").join(base.alias("b"), on).select(*[F.col(f"r.{c}") for c in rows.columns], F.col("r._opened").alias("segment"), *totals)


def ranked(rows: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """rows with their place (from 1) in an order over the whole table, which must be total."""
    found = running(rows, [], order, {}, place)
    return found.withColumn(place, F.col(place) + 1)


def chains(steps: DataFrame, key: list[str]) -> DataFrame:
    """key, at, end, hops, last: where one gets from each row by its steps, by pointer jumping.

    steps: key, at (a place, of one row by key), to (the place that follows, or null), value (what counts of a place, or null). A step to a place without a row
    ends the chain before it. hops counts the values after `at`, last is the last of them (null: none), end is the last place. Chains must not be circular.
    Each round joins every pointer with the one that begins where it ends, which doubles their lengths, so there are as many rounds as the longest chain has binary digits.
    """
    on = [*key, "to"]
    there = steps.select(*key, F.col("at").alias("to"), F.col("value").alias("last"), F.lit(True).alias("there"))
    now = steps.select(*key, "at", "to").join(there, on, "left")
    now = written(now.select(*key, "at", F.when(F.col("there"), F.col("to")).alias("to"), F.col("last").isNotNull().cast("long").alias("hops"), "last"))
    while True:
        ahead = now.filter(F.col("to").isNotNull()).select(*key, F.col("at").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("last").alias("later"))
        now = written(now.join(ahead, on, "left").select(
            *key, "at", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("later", "last").alias("last"), F.col("next").isNotNull().alias("moved"),
        ))
        if now.filter("moved").isEmpty():
            return now.select(*key, "at", F.coalesce("to", "at").alias("end"), "hops", "last")


def reached(steps: DataFrame, heads: DataFrame, key: list[str]) -> DataFrame:
    """key, at: all places on the chains that begin at heads (key, at). steps: key, at, to, with one row by key and at.

    What k rounds have reached lies less than 2^k steps from its head; the pointers over 2^k steps, which are their own square by then, reach as many again.
    """
    on = [*key, "at"]
    found, jumps = written(heads.select(*on).distinct()), written(steps.filter(F.col("to").isNotNull()).select(*on, "to"))
    while not jumps.isEmpty():
        found = written(found.unionByName(found.join(jumps, on).select(*key, F.col("to").alias("at"))).distinct())
        jumps = written(jumps.join(jumps.select(*key, F.col("at").alias("to"), F.col("to").alias("next")), [*key, "to"]).select(*on, F.col("next").alias("to")))
    return found
