"""Playback as it happens, for Structured Streaming: running rates, last positions, throttled and closing writes over streams of spoken chunks and moves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from foliograph.operators.playback import EVERY_MS, TRUSTED_MS, progress_records, speaking_rate
from foliograph.sources import stores

#: Least time between two writes of positions.
EVERY = "4 seconds"


def rates(log: DataFrame, path: str, checkpoint: str, keys: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Speaking rates by keys (P2) of a streaming log (keys, words, ms): the state holds two sums by key, and each batch stores the keys that it has changed, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        stores.save(batch, path, number, {"rates": batch}, keys)

    return speaking_rate(log, keys).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": EVERY})).foreachBatch(write).start()


def positions(log: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], trigger: dict | None = None) -> StreamingQuery:
    """The last row by key, stored once a trigger at most (P4). A batch that is run again overwrites what it has written, and a late row doesn't take the place of a later one."""

    def write(batch: DataFrame, number: int) -> None:
        stores.merge(batch, path, number, "positions", key, order)

    return log.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": EVERY})).foreachBatch(write).start()


def stored(spark: SparkSession, path: str, key: list[str], keys: DataFrame | None = None) -> DataFrame:
    """The positions that are stored, or those of some keys; the store is compacted as it is written, so old batches are not read."""
    return stores.load(spark, path, "positions", keys, key)


def last_rates(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The rates that are stored, the last of each key."""
    return stores.load(spark, path, "rates", key=key)


class Throttle(StatefulProcessor):
    """Of one reader: the last move, and when it is written. A timer is set by the first move after a write and not extended by those that follow."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("due", LongType()), StructField("ts", TimestampType()), StructField("event_id", LongType()), StructField("place", StringType())]))

    def write(self, reader, held) -> pd.DataFrame:
        return pd.DataFrame({"reader": [reader], "due": [held[0]], "ts": [held[1]], "event_id": [held[2]], "place": [held[3]]})

    def handleInputRows(self, key, rows, timerValues):
        now, held = timerValues.getCurrentProcessingTimeInMs(), self.held.get() if self.held.exists() else None
        if held is not None and held[0] <= now:  # its timer has run out and is heard only after the input
            yield self.write(key[0], held)
            self.handle.deleteTimer(held[0])
            held = None
        due = held[0] if held is not None else now + self.every
        if held is None:
            self.handle.registerTimer(due)
        last = None if held is None else (held[1], held[2], held[3])
        for batch in rows:
            for ts, event_id, place in zip(batch["ts"], batch["event_id"], batch["place"], strict=True):
                if last is None or (pd.Timestamp(ts), event_id) >= (pd.Timestamp(last[0]), last[1]):
                    last = (ts, int(event_id), place)
        self.held.update((due, pd.Timestamp(last[0]).to_pydatetime(), last[1], last[2]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists() and (held := self.held.get())[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self.write(key[0], held)

    def close(self) -> None:
        pass


def numbered(path: str):
    """A batch writer that leaves each batch under its number; one that is run again overwrites what it has written."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def throttled(moves: DataFrame, path: str, checkpoint: str, every: int = EVERY_MS, trigger: dict | None = None) -> StreamingQuery:
    """Writes of positions, one by reader and timer (P3): reader, due (ms), ts, event_id and place of the last move before. moves: reader, ts, event_id, place (a string).

    A reader without moves since the last write has no state. Needs spark.sql.streaming.stateStore.providerClass to be RocksDB's.
    """
    rows = moves.groupBy("reader").transformWithStateInPandas(Throttle(every), "reader long, due long, ts timestamp, event_id long, place string", "Append", "ProcessingTime")
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(numbered(path)).start()


class SinceOpened(StatefulProcessor):
    """Of one reader: words and milliseconds since a book was opened (P2); opening one begins anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", StructType([StructField(c, LongType()) for c in ("session", "words", "ms")]))

    def handleInputRows(self, key, rows, timerValues):
        # batches of a reader's rows, which are taken in their order
        log = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        session, words, ms = self.sums.get() if self.sums.exists() else (0, 0, 0)
        opened = log["opens"].fillna(False).astype(bool).cumsum()
        own = log.assign(session=session + opened)
        for name, before in (("words", words), ("ms", ms)):
            own[name] = own.groupby("session")[name].cumsum() + (own["session"] == session) * before
        self.sums.update(tuple(int(own[c].iloc[-1]) for c in ("session", "words", "ms")))
        wpm = (own["words"] / own["ms"].where(own["ms"] > 0) * 60000 + 0.5).where(own["ms"] > TRUSTED_MS)
        yield pd.DataFrame({"reader": key[0], "event_id": own["event_id"], "session": own["session"], "words": own["words"], "ms": own["ms"], "wpm": wpm // 1})

    def close(self) -> None:
        pass


def session_rates(log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """What session_rate() gives after every event, of a log (reader, ts, event_id, opens, words, ms) that comes by ts; rows of one batch may come in any order."""
    rows = log.groupBy("reader").transformWithStateInPandas(SinceOpened(), "reader long, event_id long, session long, words long, ms long, wpm double", "Append", "None")
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": EVERY})).foreachBatch(numbered(path)).start()


def closing_positions(moves: DataFrame, queue: DataFrame, chunks: DataFrame, gap: str, late: str) -> DataFrame:
    """reader, closed, book_id, block_id, offset, fraction: what is stored when a reader has left a book (P4): of moves (reader, ts, event_id, book_id, pos, chunk_idx), a stream, the last of each session.

    A player's page going away is not to be seen in a log, so a session ends after a `gap` without moves, an extension; moves that come more than `late` behind the newest are dropped.
    The sums and offsets of the queue (book_id, pos, block_id, words, cum_words) and chunks (book_id, block_id, chunk_idx, offset) are tables at rest, joined to the sessions that end.
    """
    last = F.max_by(F.struct("pos", "chunk_idx"), F.struct("ts", "event_id")).alias("at")
    ended = moves.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "reader", "book_id").agg(last)
    return progress_records(ended.select("reader", F.col("w.end").alias("closed"), "book_id", "at.pos", "at.chunk_idx"), queue, chunks)
