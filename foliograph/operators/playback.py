"""What a player's log says: speaking rates, last progress, keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import order

TRUSTED_MS = 20_000
#: Least time between two writes of a reader's position.
EVERY_MS = 4_000

# A player's settings until a reader changes them.
DEFAULTS = {
    "rate": 1.0, "pitch": 1.0, "volume": 1.0, "footnote_mode": "chapter-end", "describe_images": False, "read_tables": False, "read_captions": True,
    "announce_chapters": True, "pause_scale": 1.0, "base_wpm": 165,
}
# End of the fixed values.


def speaking_rate(log: DataFrame, keys: list[str], base_wpm: float = 165, rate: float = 1.0) -> DataFrame:
    """keys, words, ms, wpm (published once more than 20 s were spoken), effective (P2, M4). Partial sums, one shuffle."""
    sums = log.groupBy(*keys).agg(F.sum("words").cast("long").alias("words"), F.sum("ms").cast("long").alias("ms"))
    wpm = F.when(F.col("ms") > TRUSTED_MS, F.floor(F.col("words") / F.col("ms") * 60000 + 0.5).cast("long"))
    return sums.withColumn("wpm", wpm).withColumn("effective", T.effective_wpm(F.col("wpm"), base_wpm, rate))


def running_rate(log: DataFrame, keys: list[str]) -> DataFrame:
    """The rate as it stood after every event."""
    so_far = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = log.withColumn("w", F.sum("words").over(so_far)).withColumn("t", F.sum("ms").over(so_far))
    return sums.select(*keys, "event_id", F.when(F.col("t") > TRUSTED_MS, F.floor(F.col("w") / F.col("t") * 60000 + 0.5).cast("long")).alias("wpm"))


def session_rate(log: DataFrame, keys: list[str]) -> DataFrame:
    """keys, event_id, session, words, ms, wpm after every event, counted from the opening of a book on (P2): a row whose column `opens` is true begins anew. A busy reader is scanned by ranges."""
    rows = log.select(*keys, "ts", "event_id", "opens", F.col("words").alias("w"), F.col("ms").alias("t"))
    sums = order.segment_sums(rows, keys, [F.col("ts"), F.col("event_id")], "opens", {"words": "w", "ms": "t"})
    return sums.select(*keys, "event_id", F.col("segment").alias("session"), "words", "ms", F.when(F.col("ms") > TRUSTED_MS, F.floor(F.col("words") / F.col("ms") * 60000 + 0.5).cast("long")).alias("wpm"))


def throttled(moves: DataFrame, every: int = EVERY_MS) -> DataFrame:
    """reader, opened, due, event_id: the writes of positions (P3). A move sets a timer unless one is running; moves meanwhile don't extend it, and what is written when it ends is the last move before.

    moves: reader, t (in ms), event_id; of moves of one time the last event_id counts. Each move points to the first one after the timer that it would set; the moves that do set one
    are those that are reached from the reader's first. Moves without a reader or a time set none.
    """
    rows = moves.dropna(subset=["reader", "t"]).groupBy("reader", F.col("t").alias("at")).agg(F.max("event_id").alias("event_id"))
    later = Window.partitionBy("reader").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -every)
    steps = rows.withColumn("to", F.min("at").over(later))
    set_by = order.reached(steps, rows.groupBy("reader").agg(F.min("at").alias("at")), ["reader"]).withColumn("opened", F.col("at"))
    so_far = Window.partitionBy("reader").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.join(set_by, ["reader", "at"], "left").withColumn("opened", F.max("opened").over(so_far))
    return timed.groupBy("reader", "opened").agg(F.max_by("event_id", "at").alias("event_id")).select("reader", "opened", (F.col("opened") + every).alias("due"), "event_id")


def upsert(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last write of every key (S13): a partial maximum, no sort."""
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*key, "v.*")


def delete_keys(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """A store without the rows of deleted keys (S11); call it for each store of a cascade."""
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def with_defaults(settings: DataFrame, defaults: dict) -> DataFrame:
    """Stored settings over defaults; a missing column or null takes the default."""
    return settings.select(*[c for c in settings.columns if c not in defaults], *[(F.coalesce(F.col(k), F.lit(v)) if k in settings.columns else F.lit(v)).alias(k) for k, v in defaults.items()])


def stored_settings(rows: DataFrame, stored: str, defaults: dict) -> DataFrame:
    """rows with their settings, read from JSON objects that any version of a player has stored (S14), instead of the column `stored`.

    A setting that the object lacks, as a later version has brought it, or holds as null or of another kind, takes its default. Fields that are not known here, of
    later versions or given up, are kept in `other` as name=value, by name, comma-joined. What is no object holds nothing.
    """
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    known = F.from_json(stored, ", ".join(f"{k} {kinds[type(v)]}" for k, v in defaults.items()))
    given = F.coalesce(F.from_json(stored, "map<string,string>"), F.create_map().cast("map<string,string>"))
    others = F.array_sort(F.transform(F.map_entries(F.map_filter(given, lambda k, v: ~k.isin(*defaults))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    own = rows.withColumn("known", known)
    return own.select(*[c for c in rows.columns if c != stored], *[F.coalesce(F.col("known")[k], F.lit(v)).alias(k) for k, v in defaults.items()], F.array_join(others, ",").alias("other"))


def progress_records(at: DataFrame, queue: DataFrame, chunks: DataFrame) -> DataFrame:
    """book_id, block_id, offset, fraction (of the words before it, 0 of an empty queue): what is stored of a position (P4). at: book_id, pos, chunk_idx; its other columns come first. It may be a stream."""
    total = queue.groupBy("book_id").agg(F.sum("words").alias("total"))
    rows = at.join(queue.select("book_id", "pos", "block_id", "cum_words"), ["book_id", "pos"]).join(total, "book_id")
    rows = rows.join(chunks.select("book_id", "block_id", "chunk_idx", "offset"), ["book_id", "block_id", "chunk_idx"], "left")
    others = [c for c in at.columns if c not in ("book_id", "pos", "chunk_idx")]
    return rows.select(*others, "book_id", "block_id", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), F.when(F.col("total") > 0, F.col("cum_words") / F.col("total")).otherwise(0.0).alias("fraction"))


def time_left(done: DataFrame, base_wpm: float = 165, rate: float = 1.0) -> DataFrame:
    """book_id, seconds, left (as text): what a book still takes (M5). done: book_id, words_done, total_words, wpm (measured, or null)."""
    seconds = (F.col("total_words") - F.col("words_done")) / T.effective_wpm(F.col("wpm"), base_wpm, rate) * 60
    return done.select("book_id", F.round(seconds, 4).alias("seconds"), T.duration(seconds).alias("left"))


def edit_blocks(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """The blocks with the texts of edits (book_id, block_id, text) in place (P11): edited, and words as runs without white space; totals of chapters and books stay as they were."""
    own = edits.select("book_id", "block_id", F.col("text").alias("put"))
    rows = blocks.join(own, ["book_id", "block_id"], "left").withColumn("edited", F.col("put").isNotNull())
    return rows.withColumn("words", F.when(F.col("edited"), T.count_tokens(F.col("put"))).otherwise(F.col("words"))).withColumn("text", F.coalesce("put", "text")).drop("put")


def bookmarks(at: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, block_id, offset, excerpt of the 180 characters from there (P12). at: book_id, block_id, offset."""
    rows = at.join(blocks.select("book_id", "block_id", "text"), ["book_id", "block_id"])
    return rows.select("book_id", "block_id", "offset", T.js_trim(F.substring(F.col("text"), (F.col("offset") + 1).cast("int"), F.lit(180))).alias("excerpt"))


def book_title(title: Column, file_name: Column) -> Column:
    """A file's own title if it looks like one, else its name without extension and underscores."""
    blank = f"[{T.WS}]"
    named = T.js_trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(file_name, r"(?i)\.pdf\z", ""), "_+", " "), f"{blank}{{2,}}", " "))
    own = F.coalesce(T.js_trim(title), F.lit(""))
    return F.when((F.length(own) > 2) & ~own.rlike(r"(?i)\Auntitled|\Amicrosoft word"), own).otherwise(named)


def imported(books: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, title, author, words, added_at of new books (S7, S9). books: book_id, title, author, file_name, added_at; blocks: book_id, words."""
    words = blocks.groupBy("book_id").agg(F.sum("words").cast("long").alias("words"))
    return books.join(words, "book_id", "left").select("book_id", book_title(F.col("title"), F.col("file_name")).alias("title"), F.coalesce(T.js_trim(F.col("author")), F.lit("")).alias("author"), F.coalesce("words", F.lit(0)).cast("long").alias("words"), "added_at")


def library(books: DataFrame) -> DataFrame:
    """The books with their place (from 1) in the library: those added last come first, those of one time by id (S12). A rank over the whole table, in ranges."""
    return order.ranked(books, [F.desc_nulls_last("added_at"), F.asc("book_id")])


def importable(name: Column, mime: Column) -> Column:
    """Files that are taken in."""
    return F.coalesce(name.rlike(r"(?i)\.pdf\z"), F.lit(False)) | F.coalesce(mime == "application/pdf", F.lit(False))


def import_fraction(phase: Column, page: Column, pages: Column) -> Column:
    """How far an import is (M14): reading is the first four fifths, structuring the last; 0 without pages."""
    reading = phase.isin("scanning", "ocr")
    return F.when(pages > 0, F.when(reading, 0.0).otherwise(0.8) + page / pages * F.when(reading, 0.8).otherwise(0.2)).otherwise(0.0)
