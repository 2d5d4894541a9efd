"""Paragraphs from lines, chapter starts, note relocation, chapter summaries, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T

SHORT_LINE = 45


#: Ends of a sentence at the end of a line.
STOPPED = r"""[.!?]["')\]]?\z"""


def paragraphs(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, idx, text: paragraphs of plain text (B17). A blank line ends one; so does a short line that ends a sentence, unless it is the paragraph's first.

    A wrapped line is joined with a blank, or without its hyphen before a lower-case letter; blocks.wrapped() is the form for set lines (B15).
    Each line is a letter of a string of flags, in which one pattern finds the closing lines, so the work is linear in the text.
    Lines hold no line break: one of them stands for a wrap, two or more for a paragraph's end.
    """
    bind = lambda value, body: F.transform(F.array(value), body)[0]
    flag = lambda line: F.when(line == "", "b").when((F.length(line) < SHORT_LINE) & line.rlike(STOPPED), "e").otherwise("n")

    def set_apart(lines: Column) -> Column:
        # a paragraph is a line of any kind, then lines that don't end it; the next that does becomes c
        flags = F.regexp_replace(F.array_join(F.transform(lines, flag), ""), "(?<!n)([ne]n*+)e", "$1c")
        return F.array_join(F.zip_with(lines, F.filter(F.split(flags, ""), lambda f: f != ""), lambda line, f: F.concat(line, F.when(f == "c", "\n\n").otherwise("\n"))), "")

    whole = F.regexp_replace(bind(F.transform(F.split("text", r"\r?\n"), T.js_trim), set_apart), r"(?<=[\p{L}\p{N}])-\n(?=\p{Ll})", "")
    made = F.transform(F.split(whole, "\n{2,}"), lambda p: F.translate(F.btrim(p, F.lit("\n")), "\n", " "))
    return texts.select(*keys, F.posexplode(F.filter(made, lambda p: F.length(p) > 1)).alias("idx", "text")).withColumn("idx", F.col("idx").cast("long"))


def opening_words(text: Column, page: Column) -> Column:
    """A label for a section without a heading."""
    words = F.split(T.js_trim(text), f"[{T.WS}]+")
    first = F.array_join(F.slice(words, 1, 7), " ")
    return F.when(F.length(first) < 8, F.concat(F.lit("Page "), page.cast("string"))).otherwise(F.concat(F.lit("p."), page.cast("string"), F.lit(" — "), first, F.when(F.size(words) > 7, "…").otherwise("")))


def outline(marks: DataFrame) -> DataFrame:
    """book_id, place, title, page of the usable outline entries (S6): the upper two levels, with a title and a page; of one page the first. marks: book_id, mark_ord, depth, title, page."""
    title = F.regexp_replace(T.js_trim(F.col("title")), f"[{T.WS}]+", " ")
    own = marks.filter((F.col("depth") <= 1) & (F.col("page") > 0)).withColumn("title", title).filter("title <> ''")
    first = own.groupBy("book_id", "page").agg(F.min_by("title", "mark_ord").alias("title"))
    return first.select("book_id", "page", "title", F.row_number().over(Window.partitionBy("book_id").orderBy("page")).alias("place"))


def stamped(raw: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """The raw blocks with chapter, and title and source at each chapter's first.

    Starts come from the outline, else from chapter headings, or from even sections if there are fewer than two; there is always one at 0.
    Each block belongs to the last start at or before it.
    """
    book = Window.partitionBy("book_id")
    rows = raw.withColumn("is_chapter", (F.col("type") == "heading") & T.looks_like_chapter(F.col("text")))
    rows = rows.withColumn("n_found", F.sum(F.col("is_chapter").cast("int")).over(book)).withColumn("n", F.count("*").over(book))
    even = F.col("raw_idx") % F.greatest(F.lit(25), F.ceil(F.col("n") / 12)) == 0
    inferred = F.when(F.col("n_found") >= 2, F.when(F.col("is_chapter"), F.col("text"))).when(even, opening_words(F.col("text"), F.col("page")))
    if marks is None:
        rows = rows.withColumn("marked", F.lit(None).cast("string")).withColumn("has_outline", F.lit(False))
    else:
        # of an entry's page the first heading, else the first block; books with two usable entries or more go by them, which they have at hand: blocks stay where their book is
        entries = outline(marks).groupBy("book_id").agg(F.collect_list(F.struct("page", "title")).alias("entries")).filter(F.size("entries") >= 2)
        page = Window.partitionBy("book_id", "page")
        first = F.coalesce(F.min(F.when(F.col("type") == "heading", F.col("raw_idx"))).over(page), F.min("raw_idx").over(page))
        entry = F.get(F.filter("entries", lambda e: e["page"] == F.col("page")), F.lit(0))["title"]
        rows = rows.withColumn("first", first).join(entries, "book_id", "left").withColumn("has_outline", F.col("entries").isNotNull())
        rows = rows.withColumn("marked", F.when(F.col("raw_idx") == F.col("first"), entry)).drop("entries")
    title = F.coalesce(F.when(F.col("has_outline"), F.col("marked")).otherwise(inferred), F.when(F.col("raw_idx") == 0, "Opening"))
    rows = rows.withColumn("title", title).withColumn("source", F.when(F.col("title").isNotNull(), F.when(F.col("marked").isNotNull(), "outline").otherwise("heuristic")))
    order = book.orderBy("raw_idx")
    return rows.withColumn("chapter", (F.sum(F.col("title").isNotNull().cast("int")).over(order) - 1).cast("long"))


def assembled(raw: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """book_id, block_id, type, text, page, chapter, words, note_ref of raw blocks, with title and source at each chapter's start (C8, C10): notes move behind their chapter's body; ids are dense."""
    ids = Window.partitionBy("book_id").orderBy("chapter", F.col("type") == "footnote", "raw_idx")
    ref = F.col("note_ref") if "note_ref" in raw.columns else F.lit(None).cast("string")
    return stamped(raw, marks).select("book_id", (F.row_number().over(ids) - 1).cast("long").alias("block_id"), "type", "text", "page", "chapter", T.count_words(F.col("text")).alias("words"), ref.alias("note_ref"), "title", "source")


def chapters(raw: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """book_id, chapter, title, source, start_block, end_block, page, words (C9). A start is a block of its chapter, so none is empty."""
    return assembled(raw, marks).groupBy("book_id", "chapter").agg(
        F.max("title").alias("title"), F.max("source").alias("source"), F.min("block_id").alias("start_block"), (F.max("block_id") + 1).alias("end_block"),
        F.min_by("page", "block_id").alias("page"), F.sum("words").cast("long").alias("words"),
    )


def chapter_times(chapters: DataFrame, wpm: float = 165) -> DataFrame:
    """book_id, chapter, title, page, duration, inferred (not from an outline) of chapters (M7)."""
    return chapters.select("book_id", "chapter", "title", "page", T.duration(F.col("words") / F.lit(float(wpm)) * 60).alias("duration"), (F.col("source") == "heuristic").alias("inferred"))


PAINTS_IMAGE = ("paintImageXObject", "paintInlineImageXObject", "paintImageMaskXObject", "paintJpegXObject")


def extraction_quality(pages: DataFrame, operations: DataFrame, dropped: DataFrame, raw: DataFrame) -> DataFrame:
    """One row by book of what was found (C11), whether OCR would be asked for (C12) and whether its text is sparse.

    pages: book_id, page, chars, has_text, n_columns; operations: book_id, page, op, of which those that paint images count, on text-poor pages only (S4);
    dropped: book, page, line_idx of furniture; raw: raw blocks.
    """
    images = operations.filter(F.col("op").isin(*PAINTS_IMAGE)).groupBy("book_id", "page").agg(F.count("*").alias("images"))
    poor = pages.join(images, ["book_id", "page"], "left").withColumn("images", F.when(~F.col("has_text"), F.coalesce("images", F.lit(0))).otherwise(0))
    book = poor.groupBy("book_id").agg(
        F.count("*").alias("n_pages"), F.round(F.avg(F.col("has_text").cast("int")), 6).alias("coverage"), F.sum("images").cast("long").alias("images"), F.max("n_columns").alias("n_columns"),
        F.sort_array(F.collect_list(F.when(F.col("images") > 0, F.col("page")))).alias("scanned"),
    )
    heads = dropped.groupBy(F.col("book").alias("book_id")).agg(F.count("*").alias("headers"))
    kind = lambda k: F.sum((F.col("type") == k).cast("int")).cast("long")
    counts = raw.groupBy("book_id").agg(kind("footnote").alias("footnotes"), kind("table").alias("tables"), F.sum("n_hyphens").cast("long").alias("hyphens"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return book.join(heads, "book_id", "left").join(counts, "book_id", "left").select(
        "book_id", "n_pages", "coverage", F.array_join("scanned", ",").alias("scanned"), "n_columns", zero("headers"), zero("footnotes"), zero("tables"), "images", zero("hyphens"),
        ((F.col("coverage") < 0.6) & (F.size("scanned") > 0)).alias("needs_ocr"), (F.col("coverage") < 0.85).alias("sparse"),
    )


def quality(pages: DataFrame, least_chars: int = 100) -> DataFrame:
    """book, n_pages, coverage (share of pages with enough characters), scanned (those without) of pages (book, page, chars), as far as characters alone tell (C11)."""
    poor = F.col("chars") < least_chars
    out = pages.groupBy("book").agg(F.count("*").alias("n_pages"), F.sum((~poor).cast("int")).cast("long").alias("n_text"), F.array_join(F.array_sort(F.collect_list(F.when(poor, F.col("page")))), ",").alias("scanned"))
    coverage = F.col("n_text") / F.col("n_pages")
    return out.select("book", "n_pages", F.round(coverage, 6).alias("coverage"), "scanned", (coverage < 0.6).alias("needs_ocr"))
