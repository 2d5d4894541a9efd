"""Streams over files that come one after the other, against the same tables at rest."""

import os
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from foliograph.operators import playback as P
from foliograph.sources import projections as S
from foliograph.sources import stores
from foliograph.streaming import playback as live

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_rates_and_positions(spark, tmp_path):
    log = S.playlog(spark, SF)
    for k in range(3):
        log.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    now = {"availableNow": True}
    live.rates(stream(), f"{tmp_path}/rates", f"{tmp_path}/c1", ["reader"], now).awaitTermination()
    live.positions(stream(), f"{tmp_path}/places", f"{tmp_path}/c2", ["reader"], ["ts", "event_id"], now).awaitTermination()
    assert len(stores.published(spark, f"{tmp_path}/rates")) >= 3
    assert rows(live.last_rates(spark, f"{tmp_path}/rates", ["reader"])) == rows(P.speaking_rate(log, ["reader"]))
    want = P.upsert(log, ["reader"], ["ts", "event_id"])
    assert rows(live.stored(spark, f"{tmp_path}/places", ["reader"])) == rows(want)
    some = want.filter("reader % 5 = 1")
    assert rows(live.stored(spark, f"{tmp_path}/places", ["reader"], some)) == rows(some)


@pytest.fixture
def rocks(spark):
    """A state store with timers, where none is set."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_session_rates(rocks, tmp_path):
    """A stream whose files follow each other in time gives what the table at rest gives; a restart takes up the state."""
    log = S.playlog(rocks, SF).select("reader", "ts", "event_id", (F.col("event_type") == "view").alias("opens"), "words", "ms")
    want = rows(P.session_rate(log, ["reader"]).withColumn("wpm", F.col("wpm").cast("double")))
    cut = [F.lit(f"2024-01-{d:02} 00:00:00").cast(log.schema["ts"].dataType) for d in (11, 21)]
    parts = [log.filter(F.col("ts") < cut[0]), log.filter((F.col("ts") >= cut[0]) & (F.col("ts") < cut[1])), log.filter(F.col("ts") >= cut[1])]
    for part in parts:
        part.repartition(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = rocks.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
        live.session_rates(stream, f"{tmp_path}/out", f"{tmp_path}/c", {"availableNow": True}).awaitTermination()
    assert rows(rocks.read.parquet(f"{tmp_path}/out").drop("batch")) == want


def test_throttle(rocks, tmp_path):
    """Moves of two readers, some while a timer runs and one after a restart: one write by reader and timer, of the last move before it ended; no state stays behind."""
    schema = "reader long, ts timestamp, event_id long, place string"
    sent = [[(1, 1, "a"), (2, 2, "b")], [(1, 3, "c"), (2, 4, "d"), (1, 5, "e")]]
    out = f"{tmp_path}/out"

    def drop(moves):
        data = rocks.createDataFrame(moves, "reader long, event_id long, place string")
        data.select("reader", F.timestamp_seconds(F.col("event_id")).alias("ts"), "event_id", "place").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

    def start():
        return live.throttled(rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"), out, f"{tmp_path}/c", every=20_000, trigger={"processingTime": "300 milliseconds"})

    def written(n):
        for _ in range(200):
            found = [tuple(r) for r in rocks.read.schema(f"{schema}, due long, batch long").parquet(out).select("reader", "event_id", "place", "due").collect()] if os.path.exists(out) else []
            if len(found) >= n:
                return sorted(found)
            time.sleep(0.2)
        raise AssertionError(found)

    def taken(query, n):
        """With timers there is always one more batch to run, so processAllAvailable() would wait for ever."""
        for _ in range(300):
            if sum(p["numInputRows"] for p in query.recentProgress) >= n:
                return
            time.sleep(0.1)
        raise AssertionError(query.recentProgress)

    os.makedirs(f"{tmp_path}/log")
    for moves in sent:
        drop(moves)
    query = start()
    taken(query, 5)
    query.stop()
    # after a restart Spark looks at timers once the first rows have come
    query = start()
    drop([(3, 6, "z")])
    first = written(2)
    assert [r[:3] for r in first if r[0] < 3] == [(1, 5, "e"), (2, 4, "d")]
    drop([(1, 7, "f"), (1, 8, "g")])
    second = written(4)
    assert [r[:3] for r in second] == [(1, 5, "e"), (1, 8, "g"), (2, 4, "d"), (3, 6, "z")] and second[1][3] > second[0][3]
    for _ in range(100):
        if query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0:
            break
        time.sleep(0.2)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    query.stop()


def test_closing_positions(spark, tmp_path):
    """The last move of each session, with its offset and fraction as the table at rest gives them; sessions that the watermark hasn't passed stay open, and moves behind it are dropped."""
    queue = spark.createDataFrame([(1, 0, 10, 4, 0), (1, 1, 11, 6, 4), (2, 0, 20, 0, 0)], "book_id long, pos long, block_id long, words long, cum_words long")
    chunks = spark.createDataFrame([(1, 11, 0, 0), (1, 11, 1, 30), (2, 20, 0, 0)], "book_id long, block_id long, chunk_idx long, offset long")
    files = [
        [(7, 0, 1, 1, 0, 0), (7, 100, 2, 1, 1, 0), (7, 50, 3, 1, 1, 1), (8, 20, 4, 2, 0, 0)],
        [(7, 130, 5, 1, 1, 1), (9, 5_000, 6, 1, 0, 0)],
        [(7, 9_000, 8, 1, 1, 0)],
        [(7, 140, 7, 1, 0, 0)],
        [(9, 90_000, 9, 1, 1, 0)],
    ]
    schema = "reader long, s long, event_id long, book_id long, pos long, chunk_idx long"
    for k, moves in enumerate(files):
        spark.createDataFrame(moves, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(f"{tmp_path}/log/n={k}")
        os.utime(next(pathlib.Path(f"{tmp_path}/log/n={k}").glob("*.parquet")), (1_000 + k, 1_000 + k))
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
    found = live.closing_positions(stream, queue, chunks, "10 minutes", "5 minutes")
    found.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(live.numbered(f"{tmp_path}/out")).start().awaitTermination()
    got = sorted((r["reader"], r["closed"].timestamp(), r["book_id"], r["block_id"], r["offset"], r["fraction"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(7, 730, 1, 11, 30, 0.4), (7, 9_600, 1, 11, 0, 0.4), (8, 620, 2, 20, 0, 0.0), (9, 5_600, 1, 10, 0, 0.0)]
    at = spark.createDataFrame([(7, 1, 1, 1)], "reader long, book_id long, pos long, chunk_idx long")
    assert [tuple(r) for r in P.progress_records(at, queue, chunks).collect()] == [(7, 1, 11, 30, 0.4)]
