"""From blocks to utterances: sentences, chunks with pauses, their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as T


def split_sentences(blocks: DataFrame, *keys: str) -> DataFrame:
    """keys, idx, offset, text: one row by sentence of column text. Null texts have none."""
    # the outer form, as the other one has its array made twice: once more for a filter on its size
    rows = blocks.select(*keys, F.posexplode_outer(T.sentences(F.col("text"))).alias("idx", "s")).filter(F.col("idx").isNotNull())
    return rows.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("s.offset").cast("long").alias("offset"), F.col("s.text").alias("text"))


def label(read_tables: bool, describe_images: bool) -> Column:
    """The spoken label of a block that needs one (K5)."""
    rows = F.size(F.split("text", ";")).cast("string")
    table = F.concat(F.lit("Table, "), rows, F.lit(" rows.")) if read_tables else F.concat(F.lit("Table with "), rows, F.lit(" rows, skipped."))
    image = F.concat(F.lit("Figure. "), F.col("text")) if describe_images else F.lit(None)
    note = F.when(F.coalesce("note_ref", F.lit("")) != "", F.concat(F.lit("Note "), "note_ref", F.lit("."))).otherwise("Note.")
    return F.when(F.col("type") == "table", table).when(F.col("type") == "image", image).when(F.col("type") == "footnote", note)


def chunk_blocks(blocks: DataFrame, read_tables: bool = False, describe_images: bool = False) -> DataFrame:
    """book_id, block_id, chunk_idx, offset, text, pause_ms, words of blocks (book_id, block_id, type, text, note_ref, opens_chapter) (K2 to K4).

    Everything of a block is made within its row; no shuffle.
    """
    kind = "array<struct<text:string,offset:int,pause:int>>"
    own = F.when((F.col("type") == "image") | ((F.col("type") == "table") & F.lit(not read_tables)), F.array().cast(kind)).otherwise(F.flatten(F.transform(T.sentences(F.col("text")), lambda s: T.pieces(s["text"], s["offset"]))))
    lead = F.when(F.col("label").isNotNull(), F.array(F.struct(F.col("label").alias("text"), F.lit(0).alias("offset"), F.lit(T.PAUSES["sentence"]).alias("pause")))).otherwise(F.array().cast(kind))
    rows = blocks.withColumn("label", label(read_tables, describe_images)).withColumn("spoken", own).withColumn("all", F.concat(lead, "spoken"))
    cut_off = (F.col("type") == "paragraph") & ~T.js_trim(F.col("text")).rlike(ENDED)
    rows = rows.select("book_id", "block_id", "type", "opens_chapter", cut_off.alias("cut_off"), F.size("all").alias("n"), F.posexplode_outer("all").alias("chunk_idx", "c")).filter(F.col("chunk_idx").isNotNull())
    silent = (F.col("type") == "image") | ((F.col("type") == "table") & F.lit(not read_tables))
    rest = F.when(F.col("type") == "heading", F.when(F.col("opens_chapter"), T.PAUSES["chapter"]).otherwise(T.PAUSES["heading"])).otherwise(F.greatest(F.col("c.pause"), F.lit(T.PAUSES["paragraph"])))
    pause = F.when((F.col("chunk_idx") < F.col("n") - 1) | silent, F.col("c.pause")).when(F.col("cut_off"), T.PAUSES["clause"]).otherwise(rest)
    return rows.select("book_id", "block_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("c.offset").cast("long").alias("offset"), F.col("c.text").alias("text"), pause.cast("long").alias("pause_ms"), T.count_tokens(F.col("c.text")).alias("words"))


#: A text that ends a sentence.
ENDED = r"""[.!?\x{2026}]["'\x{201D}\x{2019})\]]*\z"""


def scaled_pause(ms: Column, pause_scale: float, rate: float) -> Column:
    """K6."""
    return F.floor(ms * pause_scale / max(0.5, rate) + 0.5).cast("long")


def highlighted(at: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, block_id, chunk_idx, start (in the block's text), word: the displayed word that is being spoken.

    at: book_id, block_id, chunk_idx, offset, text (of the chunk), char_index (in its speech form). The place is carried over in proportion to the
    lengths, then widened to the blanks around it; an empty stretch has an empty word.
    """
    rows = at.join(blocks.select("book_id", "block_id", F.col("text").alias("whole")), ["book_id", "block_id"])
    rows = rows.withColumn("live", F.substring(F.col("whole"), (F.col("offset") + 1).cast("int"), F.length("text")))
    spoken, n = F.greatest(F.length(T.speech(F.col("text"))), F.lit(1)), F.length("live")
    rows = rows.withColumn("here", F.greatest(F.lit(0), F.least(n - 1, F.floor(F.col("char_index") / spoken * n + 0.5).cast("int"))))
    rows = rows.withColumn("start", F.length(F.regexp_replace(F.substring(F.col("live"), F.lit(1), F.col("here")), rf"[^{T.WS}]++\z", "")))
    word = F.regexp_extract(F.substring(F.col("live"), F.col("start") + 1, n), rf"\A[^{T.WS}]*", 0)
    return rows.select("book_id", "block_id", "chunk_idx", (F.col("offset") + F.col("start")).cast("long").alias("start"), word.alias("word"))
