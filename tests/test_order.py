"""Orders over ranges and chains by pointer jumping against plain Python, with hot keys, many ranges, nulls and empty tables."""

import random
from collections import defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from foliograph.operators import order
from foliograph.operators import playback as P
from foliograph.operators import queue as Q


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def some_rows():
    """A key with two thirds of all rows, a null key, and rows whose place is their number."""
    rng = random.Random(4)
    return [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randrange(100), rng.random() < 0.1) for i in rng.sample(range(3000), 2000)]


def test_running(spark, many_ranges):
    data = some_rows()
    rows = spark.createDataFrame(data, "key string, at long, n long, starts boolean").repartition(5)
    got = {(r["key"], r["at"]): (r["before"], r["place"]) for r in order.running(rows, ["key"], [F.col("at")], {"before": "n"}, "place").collect()}
    by = defaultdict(list)
    for key, at, n, _ in sorted(data, key=lambda r: r[1]):
        by[key].append((at, n))
    want = {(key, at): (s, i) for key, x in by.items() for i, ((at, _), s) in enumerate(zip(x, accumulate((n for _, n in x), initial=0), strict=False))}
    assert got == want
    places = [r["at"] for r in order.ranked(rows, [F.desc("at")]).orderBy("place").collect()]
    assert places == sorted((r[1] for r in data), reverse=True)
    assert order.ranked(rows.limit(0), [F.desc("at")]).count() == 0


def test_segments(spark, many_ranges):
    data = some_rows()
    got = {(r["key"], r["at"]): (r["segment"], r["total"]) for r in order.segment_sums(spark.createDataFrame(data, "key string, at long, n long, starts boolean"), ["key"], [F.col("at")], "starts", {"total": "n"}).collect()}
    want, state = {}, defaultdict(lambda: (0, 0))
    for key, at, n, starts in sorted(data, key=lambda r: r[1]):
        segment, total = state[key]
        state[key] = (segment + 1, n) if starts else (segment, total + n)
        want[key, at] = state[key]
    assert got == want


def test_chains(spark):
    """Chains of all lengths, some of which end at a place without a row, and one that many lead into."""
    rng = random.Random(6)
    steps = {("x", i): (i + 1, f"v{i}" if i % 3 else None) for i in range(70)} | {("y", i): (rng.randrange(i + 1, 60) if i < 40 else None, f"w{i}") for i in range(50)} | {("z", 0): (99, "alone")}
    rows = spark.createDataFrame([(k, at, to, v) for (k, at), (to, v) in steps.items()], "key string, at long, to long, value string")
    want = {}
    for key, at in steps:
        here, hops, last = at, 0, None
        while (step := steps[key, here][0]) is not None and (key, step) in steps:
            here = step
            if steps[key, here][1] is not None:
                hops, last = hops + 1, steps[key, here][1]
        want[key, at] = (here, hops, last)
    assert {(r["key"], r["at"]): (r["end"], r["hops"], r["last"]) for r in order.chains(rows, ["key"]).collect()} == want
    heads = spark.createDataFrame([("x", 60), ("y", 0), ("y", 3)], "key string, at long")
    reach = set()
    for key, at in (("x", 60), ("y", 0), ("y", 3)):
        while at is not None and (key, at) in steps:
            reach.add((key, at))
            at = steps[key, at][0]
    got = order.reached(rows.select("key", "at", F.when(F.col("to") < 70, F.col("to")).alias("to")), heads, ["key"])
    assert {tuple(r) for r in got.collect() if (r["key"], r["at"]) in steps} == reach
    assert order.chains(rows.limit(0), ["key"]).count() == 0 and order.reached(rows.limit(0), heads.limit(0), ["key"]).count() == 0


def test_auto_advance(spark):
    """Books taken off in between are passed over, an unknown one stops playback, and so does the end of the list."""
    lists = [(1, 0, "a"), (1, 1, "gone"), (1, 2, "b"), (1, 3, "nowhere"), (1, 4, "c"), (1, 5, "d"), (2, 0, "d"), (2, 1, "gone"), (2, 2, "both")]
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    books = one([("a",), ("b",), ("c",), ("d",), ("gone",), ("not listed",)], "book_id string")
    removed = one([(1, "gone"), (2, "gone"), (2, "both"), (2, "both")], "reader long, book_id string")
    ended = one([(1, x) for x in ("a", "b", "nowhere", "c", "d", "gone", "not listed")] + [(2, "d"), (2, "d"), (3, "a")], "reader long, book_id string")
    got = {tuple(r) for r in Q.auto_advance(one(lists, "reader long, place long, book_id string"), books, removed, ended).collect()}
    assert got == {(1, "a", 1, "b", "unknown"), (1, "b", 0, "b", "unknown"), (1, "c", 1, "d", "end"), (1, "d", 0, "d", "end"), (2, "d", 0, "d", "end")}


def test_throttled(spark):
    """A timer is not extended by moves while it runs; a move at its very end sets the next one."""
    moves = [(1, 0, 1), (1, 3_999, 2), (1, 4_000, 3), (1, 4_000, 4), (1, 8_001, 5), (1, 20_000, 6), (2, 50, 7)]
    got = sorted(map(tuple, P.throttled(spark.createDataFrame(moves, "reader long, t long, event_id long")).collect()))
    assert got == [(1, 0, 4_000, 2), (1, 4_000, 8_000, 4), (1, 8_001, 12_001, 5), (1, 20_000, 24_000, 6), (2, 50, 4_050, 7)]


def test_timeline(spark):
    chunks = spark.createDataFrame([(1, 7, 0, 165, 520), (1, 8, 0, 0, 100), (1, 8, 1, 330, 0), (1, 9, 0, 5, 5)], "book_id long, block_id long, chunk_idx long, words long, pause_ms long")
    queue = spark.createDataFrame([(1, 0, 8), (1, 1, 7)], "book_id long, pos long, block_id long")
    got = sorted(tuple(r)[1:] for r in Q.timeline(chunks, queue).collect())
    assert got == [(0, 0, 0, 0, 100), (0, 1, 100, 120_000, 0), (1, 0, 120_100, 60_000, 520)]


def test_session_rate(spark):
    log = [(1, 1, 1, False, 30, 15_000), (1, 2, 2, False, 30, 6_000), (1, 3, 3, True, 100, 21_000), (1, 4, 4, None, 1, 0)]
    rows = spark.createDataFrame(log, "reader long, s long, event_id long, opens boolean, words long, ms long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(map(tuple, P.session_rate(rows, ["reader"]).collect()))
    assert got == [(1, 1, 0, 30, 15_000, None), (1, 2, 0, 60, 21_000, 171), (1, 3, 1, 100, 21_000, 286), (1, 4, 1, 101, 21_000, 289)]
