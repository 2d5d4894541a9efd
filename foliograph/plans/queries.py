"""The registered queries: operators over the supplied tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import chapters as C
from foliograph.operators import furniture as H
from foliograph.operators import narration as K
from foliograph.operators import order
from foliograph.operators import playback as P
from foliograph.operators import queue as Q
from foliograph.plans import layout_queries
from foliograph.sources import projections as S
from foliograph.sources import stores
from foliograph.sources.tables import shared_folder


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return S.texts(spark, d).select("doc_id", T.clean(F.col("text")).alias("text"))


def speech_text(spark: SparkSession, d: str) -> DataFrame:
    return S.texts(spark, d).select("doc_id", T.speech(F.col("text")).alias("text"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.texts(spark, d).select("doc_id", T.count_words(F.col("text")).alias("words"), T.count_tokens(F.col("text")).alias("tokens"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: sentences and words by language."""
    rows = K.split_sentences(S.texts(spark, d), "doc_id", "lang").withColumn("words", T.count_words(F.col("text")))
    return rows.groupBy("lang").agg(F.count("*").alias("sentences"), F.sum("words").alias("words"), F.round(F.sum("words") / F.count("*"), 6).alias("mean_words"))


def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return K.split_sentences(S.texts(spark, d), "doc_id")


def roman_values(spark: SparkSession, d: str) -> DataFrame:
    """Numerals written from numbers, and read back."""
    step = F.explode(F.sequence(F.lit(1), F.lit(7)))
    v = S.read(spark, d, "part").select("p_size", step.alias("step")).select((F.col("p_size") + F.col("step") * 50).cast("long").alias("v")).distinct()
    tens = F.array(*map(F.lit, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]))
    ones = F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]))
    hundreds = F.array(*map(F.lit, ["", "C", "CC", "CCC", "CD", "D"]))
    at = lambda a, n: F.get(a, n.cast("int"))
    written = F.concat(at(hundreds, F.floor(F.col("v") / 100)), at(tens, F.floor(F.col("v") / 10) % 10), at(ones, F.col("v") % 10))
    return v.select("v", T.roman_to_int(written).alias("value"))


def numerals(spark: SparkSession, d: str) -> DataFrame:
    """The digits of event and user numbers spelt with letters of either case, in any order, some of which are no numeral's, and read as numerals."""
    number = F.concat(F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    return S.read(spark, d, "events").select(F.translate(number, "0123456789", "IVXLCDMivc").alias("plain"), F.translate(number, "0123456789", "iixIJCdXMl").alias("odd")).select(
        F.explode(F.array("plain", "odd", F.concat(F.lit("é"), "plain"), F.substring("odd", 3, 99))).alias("numeral")
    ).distinct().select("numeral", T.roman_to_int(F.col("numeral")).alias("value"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return S.doc_blocks(spark, d).withColumn("words", T.count_words(F.col("text")))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    first = Window.partitionBy("book_id", "chapter")
    return K.chunk_blocks(S.doc_blocks(spark, d).withColumn("opens_chapter", F.col("block_id") == F.min("block_id").over(first)))


def chunk_pacing(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("book_id").agg(F.count("*").alias("n_chunks"), F.sum("words").alias("words"), F.sum(K.scaled_pause(F.col("pause_ms"), 1.2, 1.5)).alias("pause_ms"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return C.paragraphs(S.texts(spark, d), "doc_id")


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return H.line_keys(S.doc_lines(spark, d))


def folios(spark: SparkSession, d: str) -> DataFrame:
    return S.doc_lines_dressed(spark, d).filter(F.col("band") & T.is_folio(F.col("line"))).select("book", "page", "line_idx")


def running_heads(spark: SparkSession, d: str) -> DataFrame:
    return H.running_heads(S.doc_lines(spark, d), S.doc_pages(spark, d))


def stripped_lines(spark: SparkSession, d: str) -> DataFrame:
    return H.strip_furniture(S.doc_lines_dressed(spark, d), S.doc_pages(spark, d))


def chapters(spark: SparkSession, d: str) -> DataFrame:
    return C.chapters(S.raw_paragraphs(spark, d))


def durations(spark: SparkSession, d: str) -> DataFrame:
    return chapters(spark, d).select("book_id", "chapter", T.duration(F.col("words") / F.lit(165.0) * 60).alias("duration"))


def quality(spark: SparkSession, d: str) -> DataFrame:
    chars = S.text_lines(spark, d).groupBy("doc_id").agg(F.sum(F.length(T.js_trim(F.col("line")))).alias("chars"))
    return C.quality(S.doc_pages(spark, d).join(chars, "doc_id"), 1000)


def queue_end(spark: SparkSession, d: str) -> DataFrame:
    return Q.build_queue(blocks(spark, d))


def queue_inline(spark: SparkSession, d: str) -> DataFrame:
    return Q.build_queue(blocks(spark, d), "inline")


def queue_skip(spark: SparkSession, d: str) -> DataFrame:
    return Q.build_queue(blocks(spark, d), "skip")


def queue_progress(spark: SparkSession, d: str) -> DataFrame:
    return Q.chapter_entries(queue_end(spark, d), S.doc_blocks(spark, d))


def seek(spark: SparkSession, d: str) -> DataFrame:
    fractions = F.explode(F.array(*map(F.lit, [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0])))
    return Q.seek_fraction(queue_end(spark, d), S.read(spark, d, "documents").select(F.col("doc_id").alias("book_id"), fractions.alias("fraction")))


def position(spark: SparkSession, d: str) -> DataFrame:
    notes = S.doc_blocks(spark, d).filter("type = 'footnote'").select("book_id", F.col("block_id").alias("target"))
    return Q.position_of(queue_skip(spark, d), notes)


def reading_window(spark: SparkSession, d: str) -> DataFrame:
    queue = queue_end(spark, d)
    return Q.reading_window(queue, queue.groupBy("book_id").agg(F.floor(F.count("*") / 2).alias("here")))


def reading_list(spark: SparkSession, d: str) -> DataFrame:
    ids = S.read(spark, d, "conversations").select(F.col("conv_id").alias("pos")).distinct().withColumn("book_id", F.col("pos") * 7)
    books = S.texts(spark, d).select(F.col("doc_id").alias("book_id"), T.count_words(F.col("text")).alias("words"))
    progress = S.read(spark, d, "events").groupBy(F.col("user_id").alias("book_id")).agg((F.max(F.col("event_id") % 100) / 100.0).alias("fraction"))
    return Q.reading_list(ids, books, progress)


def wpm(spark: SparkSession, d: str) -> DataFrame:
    return P.speaking_rate(S.playlog(spark, d), ["reader", "day"]).withColumn("day", F.col("day").cast("string")).withColumn("wpm", F.col("wpm").cast("double"))


def running_wpm(spark: SparkSession, d: str) -> DataFrame:
    return P.running_rate(S.playlog(spark, d), ["reader"]).withColumn("wpm", F.col("wpm").cast("double"))


def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    return P.upsert(S.playlog(spark, d).select("reader", "ts", "event_id", "words"), ["reader"], ["ts", "event_id"])


def upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    return P.delete_keys(S.read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), S.read(spark, d, "labels"), ["doc_id"])


def places(queue: DataFrame) -> DataFrame:
    """A position in every book, chosen by its number, with the queue's length."""
    return queue.groupBy("book_id").agg(F.count("*").alias("n")).withColumn("pos", F.col("book_id") * 7 % F.col("n")).withColumn("chunk_idx", F.lit(0).cast("long"))


def progress_records(spark: SparkSession, d: str) -> DataFrame:
    queue = queue_end(spark, d)
    at = places(queue).withColumn("chunk_idx", F.col("book_id") % 2)
    return P.progress_records(at.select("book_id", "pos", "chunk_idx"), queue, chunks(spark, d)).withColumn("fraction", F.round("fraction", 6))


def time_left(spark: SparkSession, d: str) -> DataFrame:
    queue = queue_end(spark, d)
    done = places(queue).select("book_id", "pos").join(queue.select("book_id", "pos", F.col("cum_words").alias("words_done")), ["book_id", "pos"]).join(Q.totals(queue), "book_id")
    return P.time_left(done.withColumn("wpm", F.when(F.col("book_id") % 3 == 0, F.col("book_id") % 200)))


def seek_offset(spark: SparkSession, d: str) -> DataFrame:
    """Saved places in notes, captions and other blocks, taken up in a queue without notes."""
    queue = queue_skip(spark, d)
    saved = S.doc_blocks(spark, d).filter((F.col("book_id") + F.col("block_id")) % 5 == 0).select("book_id", F.col("block_id").alias("target"), F.lit(120).cast("long").alias("offset"))
    return Q.at_offset(Q.position_of(queue, saved).join(saved, ["book_id", "target"]), queue, chunks(spark, d))


def skip(spark: SparkSession, d: str) -> DataFrame:
    """Steps of one chunk and of three blocks, either way, from a place in every book."""
    queue = queue_end(spark, d)
    sizes = chunks(spark, d).groupBy("book_id", "block_id").agg(F.count("*").alias("n_chunks"))
    at = places(queue).join(queue.select("book_id", "pos", "block_id"), ["book_id", "pos"]).join(sizes, ["book_id", "block_id"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    step = lambda by, delta: Q.skipped(at.withColumn("delta", F.lit(delta)), by).select("book_id", F.lit(by).alias("by"), F.lit(delta).cast("long").alias("delta"), "pos", "chunk_idx")
    return step("chunk", 1).unionByName(step("chunk", -1)).unionByName(step("block", 3)).unionByName(step("block", -3))


def settings_change(spark: SparkSession, d: str) -> DataFrame:
    """Where a listener stands after the queue was built anew: notes inline, captions and images left out."""
    own, old = blocks(spark, d), queue_end(spark, d)
    held = places(old).select("book_id", "pos").join(old.select("book_id", "pos", F.col("block_id").alias("target")), ["book_id", "pos"]).select("book_id", "target")
    return Q.position_of(Q.build_queue(own, "inline", captions=False, images=False), held)


def edited_blocks(spark: SparkSession, d: str) -> DataFrame:
    edits = S.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("book_id"), F.col("turn").alias("block_id")).agg(F.max("text").alias("text"))
    return P.edit_blocks(blocks(spark, d), edits).select("book_id", "block_id", "text", "edited", "words")


def bookmarks(spark: SparkSession, d: str) -> DataFrame:
    at = S.read(spark, d, "events").select((F.col("event_id") % 97).alias("book_id"), (F.col("user_id") % 11).alias("block_id"), (F.col("event_id") % 50).alias("offset")).distinct()
    return P.bookmarks(at, S.doc_blocks(spark, d))


def imported(spark: SparkSession, d: str) -> DataFrame:
    """The pages table as files: titles of its addresses, some blank or of a template; listed by what was added last."""
    n, url = F.col("page_id"), F.col("url")
    title = F.when(n % 4 == 0, F.lit("Untitled 3")).when(n % 4 == 1, F.lit(" ab ")).when(n % 4 == 2, F.concat(F.lit(" On "), url)).otherwise(F.lit("Microsoft Word - x"))
    books = S.read(spark, d, "pages").select(n.alias("book_id"), title.alias("title"), F.when(n % 2 == 0, F.lit(" A. Nyone ")).alias("author"), F.concat(F.lit("my__file  "), url, F.lit(".PDF")).alias("file_name"), (n * 7919 % 1000).alias("added_at"))
    found = P.imported(books, blocks(spark, d).select("book_id", "words"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.floor(F.col("book_id") / 1000)).orderBy(F.desc("added_at"), "book_id")).cast("long"))


def list_edits(spark: SparkSession, d: str) -> DataFrame:
    """Reading lists after additions, removals and moves."""
    own = S.read(spark, d, "events").groupBy(F.col("user_id").alias("reader")).agg(F.slice(F.sort_array(F.collect_set(F.col("event_id") % 23)), 1, 8).alias("ids"))
    action = F.element_at(F.array(*map(F.lit, ["add", "remove", "move"])), (F.col("reader") % 3 + 1).cast("int"))
    made = own.withColumn("ids", Q.edited_list(F.col("ids"), action, F.when(F.col("reader") % 2 == 0, F.get("ids", F.lit(0))).otherwise(F.lit(5).cast("long")), F.lit(2)))
    return made.select("reader", F.posexplode("ids").alias("place", "book_id")).withColumn("place", F.col("place").cast("long"))


def shelf(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    books = S.read(spark, d, "documents").select(n.alias("book_id"), (n % 7 == 0).alias("ocr"), (n % 3 + 1).alias("n_columns"), (n % 10 / 10.0).alias("coverage"))
    progress = S.read(spark, d, "events").groupBy(F.col("user_id").alias("book_id")).agg((F.max(F.col("event_id") % 100) / 100.0).alias("fraction"))
    return Q.shelf(books, progress)


def highlights(spark: SparkSession, d: str) -> DataFrame:
    """The word shown as spoken at a character of every chunk, chosen by its numbers."""
    own = chunks(spark, d).withColumn("char_index", (F.col("block_id") * 31 + F.col("chunk_idx") * 17 + F.col("book_id")) % (F.length("text") + 9))
    return K.highlighted(own, S.doc_blocks(spark, d))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and shares as they are shown (M2, M3): bytes of the texts taken up to 4,000 times."""
    docs = S.read(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    return docs.select("doc_id", T.file_size(F.col("n").cast("long") * (F.col("doc_id") % 4000 + 1)).alias("size"), T.percent(F.col("n") / 2000.0 - 0.1).alias("share"))


def settings(spark: SparkSession, d: str) -> DataFrame:
    """What readers have stored over the defaults."""
    n = F.col("reader")
    stored = S.read(spark, d, "events").select(F.col("user_id").alias("reader")).distinct()
    stored = stored.select("reader", F.when(n % 3 == 0, 0.5 + n % 4 * 0.25).alias("rate"), F.when(n % 5 == 0, (n % 90 + 120).cast("int")).alias("base_wpm"), F.when(n % 2 == 0, "inline").alias("footnote_mode"), F.when(n % 7 == 0, True).alias("read_tables"))
    return P.with_defaults(stored, P.DEFAULTS)


def import_progress(spark: SparkSession, d: str) -> DataFrame:
    """The pages table as files of several kinds on their way in."""
    n = F.col("page_id")
    name = F.concat(F.lit("f"), n.cast("string"), F.element_at(F.array(*map(F.lit, [".pdf", ".PDF", ".txt", ".pdf.zip"])), (n % 4 + 1).cast("int")))
    phase = F.element_at(F.array(*map(F.lit, ["loading", "scanning", "analysing", "ocr", "done"])), (n % 5 + 1).cast("int"))
    files = S.read(spark, d, "pages").select("page_id", name.alias("name"), F.when(n % 6 == 3, "application/pdf").alias("mime"), phase.alias("phase"), (F.length("url") % 12).alias("page"), (n % 9).alias("pages"))
    return files.filter(P.importable(F.col("name"), F.col("mime"))).select("page_id", "name", F.round(P.import_fraction(F.col("phase"), F.col("page"), F.col("pages")), 6).alias("fraction"))


def rate_steps(spark: SparkSession, d: str) -> DataFrame:
    own = S.read(spark, d, "events").select(F.col("user_id").alias("reader")).distinct().withColumn("rate", (F.col("reader") % 160 + 45) / 100.0)
    return own.select("reader", "rate", T.rate_step(F.col("rate"), True).alias("faster"), T.rate_step(F.col("rate"), False).alias("slower"))


def auto_advance(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries of reading lists, in which every twentieth book or so is unknown and every fifth has been taken off; some of the others end."""
    events = S.read(spark, d, "events").select(F.col("user_id").alias("reader"), F.col("event_id").alias("book_id"), "ts", "event_type")
    lists = order.running(events.select("reader", "book_id", "ts"), ["reader"], [F.col("ts"), F.col("book_id")], {}, "place")
    known, gone = events.filter("event_type <> 'error' or book_id % 4 > 0"), events.filter("event_type = 'signup'")
    return Q.auto_advance(lists, known, gone, events.filter("event_type = 'view' and book_id % 3 = 0"))


def chapter_jump(spark: SparkSession, d: str) -> DataFrame:
    """Jumps to the second and the last chapter but one of every book, in a queue without notes."""
    own = S.doc_blocks(spark, d)
    last = own.groupBy("book_id").agg(F.max("chapter").alias("n"))
    jumps = last.select("book_id", F.explode(F.array(F.lit(1).cast("long"), F.col("n") - 1)).alias("chapter"))
    return Q.chapter_jump(queue_skip(spark, d), own, jumps)


def timeline(spark: SparkSession, d: str) -> DataFrame:
    return Q.timeline(chunks(spark, d), queue_end(spark, d), rate=1.25, scale=1.2)


def session_wpm(spark: SparkSession, d: str) -> DataFrame:
    """Rates since a book was opened; every view opens one."""
    return P.session_rate(S.playlog(spark, d).withColumn("opens", F.col("event_type") == "view"), ["reader"]).withColumn("wpm", F.col("wpm").cast("double"))


def throttled_writes(spark: SparkSession, d: str) -> DataFrame:
    """Writes of positions, of a log whose days are taken as 8.64 seconds. Times count to the nearest millisecond, as in SQL."""
    moves = S.read(spark, d, "events")
    moves = moves.withColumn("us", S.micros(moves, "ts"))
    return P.throttled(moves.select(F.col("user_id").alias("reader"), F.expr("(us + CASE WHEN us < 0 THEN -500 ELSE 500 END) DIV 10000000").alias("t"), "event_id"))


def library(spark: SparkSession, d: str) -> DataFrame:
    return P.library(S.read(spark, d, "documents").select(F.col("doc_id").alias("book_id"), (F.col("doc_id") * 7919 % 1000).alias("added_at")))


def bookmark_order(spark: SparkSession, d: str) -> DataFrame:
    return Q.marks_in_order(S.read(spark, d, "events").select((F.col("event_id") % 97).alias("book_id"), F.col("event_id").alias("mark_id"), (F.col("user_id") % 11).alias("block_id")))


def settings_versions(spark: SparkSession, d: str) -> DataFrame:
    """Settings as three versions of a player have stored them: the first knew one setting, the third one more than are known here."""
    n = F.col("reader")
    rate, wpm = F.concat(F.lit('"rate": '), (n % 4 * 0.25 + 0.5).cast("string")), F.concat(F.lit('"base_wpm": '), (n % 90 + 120).cast("string"))
    more = F.concat(F.lit('"theme": "t'), (n % 7).cast("string"), F.lit('", "read_tables": '), F.when(n % 2 == 0, "true").otherwise("null"))
    text = F.when(n % 3 == 0, rate).when(n % 3 == 1, F.concat_ws(", ", wpm, rate)).otherwise(F.concat_ws(", ", more, wpm))
    stored = S.read(spark, d, "events").select(F.col("user_id").alias("reader")).distinct().withColumn("stored", F.concat(F.lit("{"), text, F.lit("}")))
    return P.stored_settings(stored, "stored", P.DEFAULTS)


def stored_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds of all books' blocks after three saves and a compaction: all books, a fifth of them edited, a seventh removed."""
    root = f"{shared_folder(spark)}/store-{uuid4().hex}"
    own, ids = S.doc_blocks(spark, d).select("book_id", "block_id", "text"), S.read(spark, d, "documents").select(F.col("doc_id").alias("book_id"))
    stores.save(ids, root, 1, {"blocks": own})
    stores.save(ids.filter("book_id % 5 = 0"), root, 2, {"blocks": own.withColumn("text", F.concat("text", F.lit("!")))})
    stores.compact(spark, root, 2)
    stores.save(ids.filter("book_id % 7 = 0"), root, 3, {"blocks": None})
    return stores.load(spark, root, "blocks")


NAMES = (
    clean_text, speech_text, word_counts, sentences, sentence_rows, roman_values, chunks, chunk_pacing, paragraphs, signatures, folios, running_heads, stripped_lines,
    chapters, durations, quality, queue_end, queue_inline, queue_skip, queue_progress, seek, position, reading_window, reading_list, wpm, running_wpm, progress_latest, upsert_delete,
    progress_records, time_left, seek_offset, skip, settings_change, edited_blocks, bookmarks, imported, list_edits, shelf,
    highlights, sizes, settings, import_progress, rate_steps,
    stored_blocks, numerals, settings_versions, auto_advance, chapter_jump, timeline, session_wpm, throttled_writes, library, bookmark_order,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES} | layout_queries.queries()
