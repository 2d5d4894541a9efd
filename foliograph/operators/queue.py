"""Play queues: audible blocks in order, prefix sums, lookups and book lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import order
from foliograph.operators.narration import scaled_pause


def audible(mode: str, captions: bool, images: bool) -> Column:
    kind = F.col("type")
    return F.when(kind == "footnote", F.lit(mode != "skip")).when(kind == "caption", F.lit(captions)).when(kind == "image", F.lit(images)).otherwise(F.lit(True))


def build_queue(blocks: DataFrame, mode: str = "chapter-end", captions: bool = True, images: bool = True) -> DataFrame:
    """book_id, pos, block_id, chapter, words, cum_words (before the entry) of blocks (book_id, block_id, chapter, type, note_ref, words) (Q1 to Q4).

    In mode `inline` a note follows the first audible body block of its chapter that cites it; notes that none cites
    follow the chapter's body, by where their ref is first seen, those without ref last.
    """
    own = blocks.filter(audible(mode, captions, images)).withColumn("is_note", F.col("type") == "footnote")
    if mode == "inline":
        ref = F.when(F.coalesce("note_ref", F.lit("")) != "", F.col("note_ref"))
        own = own.withColumn("ref", ref)
        by_ref = Window.partitionBy("book_id", "chapter", "ref")
        anchor = F.when(F.col("ref").isNotNull(), F.min(F.when(~F.col("is_note"), F.col("block_id"))).over(by_ref))
        seen = F.when(F.col("ref").isNotNull(), F.min(F.when(F.col("is_note"), F.col("block_id"))).over(by_ref))
        own = own.withColumn("anchor", anchor).withColumn("seen", seen)
        place = F.when(~F.col("is_note"), F.col("block_id")).when(F.col("anchor").isNotNull(), F.col("anchor")).otherwise(F.lit(2**62))
        own = own.withColumn("place", place).withColumn("late", F.when(F.col("is_note") & F.col("anchor").isNull(), F.coalesce("seen", F.lit(2**62))).otherwise(F.lit(0)))
        keys = ["chapter", "place", "is_note", "late", "block_id"]
    else:
        keys = ["chapter", "is_note", "block_id"]
    order = Window.partitionBy("book_id").orderBy(*keys)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return own.select("book_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "block_id", "chapter", "words", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("long").alias("cum_words"))


def totals(queue: DataFrame) -> DataFrame:
    """book_id, total_words, n (Q5)."""
    return queue.groupBy("book_id").agg(F.sum("words").cast("long").alias("total_words"), F.count("*").alias("n"))


def chapter_entries(queue: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, chapter, entry, tick: first position of each chapter, 0 for one without audible blocks, and its place on the scrubber (Q6, M6)."""
    entry = queue.groupBy("book_id", "chapter").agg(F.min("pos").alias("entry"), F.min("cum_words").alias("cum"))
    rows = chapters.select("book_id", "chapter").distinct().join(entry, ["book_id", "chapter"], "left").join(totals(queue), "book_id", "left")
    tick = F.round(F.coalesce("cum", F.lit(0)) / F.when(F.col("total_words") > 0, F.col("total_words")), 6)
    return rows.select("book_id", "chapter", F.coalesce("entry", F.lit(0)).cast("long").alias("entry"), F.when((tick > 0.004) & (tick < 0.996), tick).alias("tick"))


def seek_fraction(queue: DataFrame, targets: DataFrame) -> DataFrame:
    """book_id, fraction, pos: the last position at or before that share of the words (P5). targets: book_id, fraction.

    Entries and targets stand in one order by words, where a target takes the last position before it: an as-of lookup in one exchange.
    """
    book = Window.partitionBy("book_id")
    both = queue.select("book_id", "cum_words", "words", "pos", F.lit(None).cast("double").alias("fraction")).unionByName(targets.select("book_id", F.lit(None).cast("long").alias("cum_words"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("pos"), F.col("fraction").cast("double").alias("fraction")))
    aim = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fraction"))) * F.sum("words").over(book)
    both = both.withColumn("n", F.count("pos").over(book)).withColumn("at", F.coalesce(F.col("cum_words").cast("double"), aim))
    so_far = book.orderBy("at", F.col("pos").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.max("pos").over(so_far)).filter("pos is null and n > 0").select("book_id", "fraction", F.coalesce("found", F.lit(0)).cast("long").alias("pos"))


def position_of(queue: DataFrame, targets: DataFrame) -> DataFrame:
    """book_id, target, pos: the block itself, else the first later block in queue order, else the last entry (Q7). targets: book_id, target.

    Entries and targets stand in one order by block; the least position of the later blocks is a running minimum from the end.
    """
    both = queue.select("book_id", F.col("block_id").alias("target"), "pos", F.lit(False).alias("asked")).unionByName(targets.select("book_id", "target").distinct().select("book_id", "target", F.lit(None).cast("long").alias("pos"), F.lit(True).alias("asked")))
    book = Window.partitionBy("book_id")
    own = F.max("pos").over(Window.partitionBy("book_id", "target").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    later = F.min("pos").over(book.orderBy(F.desc("target")).rangeBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("later", later).withColumn("last", F.max("pos").over(book)).withColumn("own", own)
    return found.filter("asked and last is not null").select("book_id", "target", F.coalesce("own", "later", "last").cast("long").alias("pos"))


def at_offset(positions: DataFrame, queue: DataFrame, chunks: DataFrame) -> DataFrame:
    """book_id, target, pos, chunk_idx: where a saved block and character are taken up (P6): the last chunk that begins at or before the character, else the first.

    positions: book_id, target, offset, pos (of position_of); chunks: book_id, block_id, chunk_idx, offset.
    """
    asked = positions.join(queue.select("book_id", "pos", "block_id"), ["book_id", "pos"])
    found = asked.join(chunks.select("book_id", "block_id", "chunk_idx", F.col("offset").alias("begins")), ["book_id", "block_id"], "left")
    return found.groupBy("book_id", "target", "offset", "pos").agg(F.coalesce(F.max(F.when(F.col("begins") <= F.col("offset"), F.col("chunk_idx"))), F.lit(0)).cast("long").alias("chunk_idx"))


def skipped(at: DataFrame, by: str = "chunk") -> DataFrame:
    """pos and chunk_idx after a step of delta (P7), of rows with pos, chunk_idx, delta, n_chunks (of the block) and n (of the queue).

    A step by chunks that leaves the block goes to the first chunk of the block beside it; a step by blocks stops at the queue's ends.
    """
    target = F.col("chunk_idx") + F.col("delta")
    inside = F.lit(by == "chunk") & (target >= 0) & (target < F.col("n_chunks"))
    delta = F.when(F.col("delta") > 0, 1).otherwise(-1) if by == "chunk" else F.col("delta")
    moved = F.least(F.col("n") - 1, F.greatest(F.lit(0), F.col("pos") + delta))
    return at.withColumn("pos", F.when(inside, F.col("pos")).otherwise(moved).cast("long")).withColumn("chunk_idx", F.when(inside, target).otherwise(0).cast("long"))


def reading_window(queue: DataFrame, at: DataFrame, before: int = 25, after: int = 45) -> DataFrame:
    """The queue entries around a position (M11). at: book_id, here."""
    return queue.join(at, "book_id").filter((F.col("pos") >= F.col("here") - before) & (F.col("pos") < F.col("here") + after)).select("book_id", "here", "pos", "block_id")


def shelf(books: DataFrame, progress: DataFrame) -> DataFrame:
    """book_id and badges (M10), comma-joined: OCR, columns, sparse text, share read. books: book_id, ocr, n_columns, coverage; progress: book_id, fraction."""
    fraction = F.coalesce("fraction", F.lit(0.0))
    badges = F.array(
        F.when(F.col("ocr"), "OCR"), F.when(F.col("n_columns") > 1, F.concat(F.col("n_columns").cast("string"), F.lit(" columns"))), F.when((F.col("coverage") < 0.8) & ~F.col("ocr"), "sparse text"),
        F.when(fraction > 0.01, F.concat(T.percent(fraction), F.lit(" read"))),
    )
    return books.join(progress.select("book_id", "fraction"), "book_id", "left").select("book_id", F.array_join(F.array_compact(badges), ",").alias("badges"))


def edited_list(ids: Column, action: Column, book: Column, to: Column) -> Column:
    """A reading list, an array, after an action (P13): add (at the end, if absent), remove, or move (of the book to a place, from 0)."""
    rest = F.filter(ids, lambda x: x != book)
    moved = F.concat(F.slice(rest, F.lit(1), to), F.array(book), F.slice(rest, to + 1, F.size(rest) + 1))
    added = F.when(F.array_contains(ids, book), ids).otherwise(F.concat(ids, F.array(book)))
    return F.when(action == "add", added).when(action == "remove", rest).when((action == "move") & F.array_contains(ids, book), moved).otherwise(ids)


def reading_list(ids: DataFrame, books: DataFrame, progress: DataFrame) -> DataFrame:
    """pos, book_id, words, words_left, started: a reader's list in order, unknown books dropped (M8 to M10). ids: pos, book_id; progress: book_id, fraction."""
    rows = ids.join(books, "book_id").join(progress, "book_id", "left")
    fraction = F.coalesce("fraction", F.lit(0.0))
    return rows.select("pos", "book_id", "words", F.floor(F.col("words") * (1 - fraction) + 0.5).cast("long").alias("words_left"), (fraction > 0.01).alias("started"))


def auto_advance(lists: DataFrame, books: DataFrame, removed: DataFrame, finished: DataFrame) -> DataFrame:
    """reader, book_id, played, last_id, stopped_by: what is played after a book of a reader's list has ended (P13): the books after it, from their beginnings, up to the end of the list
    (`end`) or a book that the library doesn't know (`unknown`), at which playback stops. Books taken off the list in between are passed over.

    lists: reader, place (one row each, counted from 0 without gaps), book_id; removed: reader, book_id; finished: reader, book_id. A finished book that is unknown or not on its reader's list starts nothing.
    """
    own = ["reader", "book_id"]
    rows = lists.join(removed.select(*own).distinct().withColumn("gone", F.lit(True)), own, "left").join(books.select("book_id").distinct().withColumn("known", F.lit(True)), "book_id", "left")
    gone, known = F.coalesce("gone", F.lit(False)), F.coalesce("known", F.lit(False))
    rows = rows.select(*own, F.col("place").alias("at"), gone.alias("gone"), (~gone & ~known).alias("unknown"))
    played = F.when(~F.col("gone") & ~F.col("unknown"), F.col("book_id"))
    chained = order.chains(rows.select("reader", "at", F.when(~F.col("unknown"), F.col("at") + 1).alias("to"), played.alias("value")), ["reader"])
    started = rows.filter(~F.col("gone") & ~F.col("unknown")).select(*own, "at").join(finished.select(*own).distinct(), own).join(chained, ["reader", "at"])
    started = started.join(rows.select("reader", F.col("at").alias("end"), "unknown"), ["reader", "end"])
    return started.select(*own, F.col("hops").alias("played"), F.coalesce("last", "book_id").alias("last_id"), F.when(F.col("unknown"), "unknown").otherwise("end").alias("stopped_by"))


def chapter_jump(queue: DataFrame, chapters: DataFrame, jumps: DataFrame) -> DataFrame:
    """book_id, chapter, pos, chunk_idx: where a jump to a chapter lands (P7): at the chapter's first audible block, of a chapter without any at the queue's start; no such chapter, no jump. jumps: book_id, chapter."""
    entries = chapter_entries(queue, chapters).select("book_id", "chapter", F.col("entry").alias("pos"))
    return jumps.select("book_id", "chapter").distinct().join(entries, ["book_id", "chapter"]).withColumn("chunk_idx", F.lit(0).cast("long"))


def timeline(chunks: DataFrame, queue: DataFrame, base_wpm: float = 165, rate: float = 1.0, scale: float = 1.0) -> DataFrame:
    """book_id, pos, chunk_idx, start_ms, speech_ms, pause_ms: when each chunk of a book begins to be spoken (P1 as a table): the speech and scaled pauses of all chunks before it in the queue.

    chunks: book_id, block_id, chunk_idx, words, pause_ms; queue: book_id, pos, block_id. A long book is scanned by ranges.
    """
    speech = F.floor(F.col("words") * 60000 / (base_wpm * rate) + 0.5).cast("long")
    rows = chunks.join(queue.select("book_id", "pos", "block_id"), ["book_id", "block_id"]).select("book_id", "pos", "chunk_idx", speech.alias("speech_ms"), scaled_pause(F.col("pause_ms"), scale, rate).alias("pause_ms"))
    rows = rows.withColumn("both", F.col("speech_ms") + F.col("pause_ms"))
    return order.running(rows, ["book_id"], [F.col("pos"), F.col("chunk_idx")], {"start_ms": "both"}).select("book_id", "pos", "chunk_idx", "start_ms", "speech_ms", "pause_ms")


def marks_in_order(marks: DataFrame) -> DataFrame:
    """book_id, mark_id, block_id, place (from 0): the bookmarks of a book by block, those of one block as they were set (S12). marks: book_id, mark_id (ascending with time), block_id."""
    return order.running(marks.select("book_id", "mark_id", "block_id"), ["book_id"], [F.col("block_id"), F.col("mark_id")], {}, "place")
