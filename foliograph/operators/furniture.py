"""Running heads, feet and page numbers: signatures, keys, detection and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators.layout import PAGE, in_band


def keys_of(line: Column) -> Column:
    """The signature, and its first and last four words if it has more than four (H4)."""

    def keys(sig: Column) -> Column:
        words = F.filter(F.split(sig, " "), lambda w: w != "")
        four = F.when(F.size(words) > 4, F.array(F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, -4, 4), " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.length(sig) >= 2, F.concat(F.array(sig), four)).otherwise(F.array().cast("array<string>"))

    # bound once: four regexes are not to run for each use
    return F.transform(F.array(T.signature(line)), keys)[0]


def line_keys(lines: DataFrame) -> DataFrame:
    """book, page, line_idx, key of the band lines (H1, H2, H4)."""
    return lines.filter("band").select("book", "page", "line_idx", F.explode(keys_of(F.col("line"))).alias("key"))


def running_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """book, key, pages of the keys that stand on a quarter of a book's pages, three at least (H5). pages: book, page.

    Keys are made distinct by page before they are counted, so the count is a plain partial aggregation.
    """
    counts = pages.groupBy("book").agg(F.count_distinct("page").alias("n_pages"))
    keys = line_keys(lines).select("book", "key", "page").distinct().groupBy("book", "key").agg(F.count("*").alias("pages"))
    return keys.join(counts, "book").filter(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.25))).select("book", "key", "pages")


def furniture(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """book, page, line_idx of the band lines to drop: folios, and those with a repeating key."""
    repeated = line_keys(lines).join(running_heads(lines, pages).select("book", "key"), ["book", "key"], "left_semi").select("book", "page", "line_idx")
    return lines.filter(F.col("band") & T.is_folio(F.col("line"))).select("book", "page", "line_idx").unionByName(repeated).distinct()


def strip_furniture(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines without furniture (H6)."""
    return lines.join(furniture(lines, pages), ["book", "page", "line_idx"], "left_anti")


def page_keys() -> Column:
    """The keys on a page, once each. Pages: with lines and page_height."""
    return F.array_distinct(F.flatten(F.transform(F.filter("lines", in_band), lambda z: keys_of(z["text"]))))


def by_books(pages: DataFrame, sizes: Column) -> DataFrame:
    """Pages of lines with heads, the keys on them that repeat in their book (H5), and body, the median of the book's sizes. sizes: those of a page, an array of (s, weight).

    A page lies among its keys and sizes, so that they are counted where the page is and neither is joined: a book's pages meet in one task, and nothing is gathered of a book.
    """
    page = F.struct(*[c for c in pages.columns if c not in PAGE])
    none = F.lit(None)
    no_page = none.cast(pages.select(page).schema[0].dataType)
    row = lambda own=no_page, key=none, s=none, weight=none: F.struct(own.alias("own"), key.cast("string").alias("key"), s.cast("double").alias("s"), weight.cast("long").alias("weight"))
    rows = pages.select(*PAGE, F.inline(F.concat(F.array(row(page)), F.transform(page_keys(), lambda k: row(key=k)), F.transform(sizes, lambda s: row(s=s["s"], weight=s["weight"])))))
    is_page, book = F.col("own").isNotNull(), Window.partitionBy("book_id")
    rows = rows.withColumn("n_on", F.count("key").over(Window.partitionBy("book_id", "key")))
    rows = rows.withColumn("n_pages", F.sum(is_page.cast("int")).over(book)).withColumn("body", F.percentile("s", F.lit(0.5), F.col("weight")).over(book))
    repeats = F.when(F.col("n_on") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.25)), F.col("key"))
    rows = rows.withColumn("heads", F.collect_list(repeats).over(Window.partitionBy(*PAGE)))
    return rows.filter(is_page).select(*PAGE, "heads", "body", "own.*")


def is_furniture(line: Column) -> Column:
    """Whether a line of a page with its heads goes: a folio in the band, or one with a repeating key (H3, H5)."""
    return in_band(line) & (T.is_folio(line["text"]) | F.exists(keys_of(line["text"]), lambda k: F.array_contains("heads", k)))
