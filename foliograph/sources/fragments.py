"""Pages of positioned text as JSON lines, one record a page, as an extractor leaves them.

The lines lie in folders by a hash of the book and by ranges of PAGES pages. Who asks for some books or pages opens their folders alone: both
conditions are partition filters. Records are read with a fixed schema; one that isn't JSON, or lacks its book, page or items, is set aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, PAGES = 16, 64
ITEM = "struct<str:string,transform:array<double>,width:double,height:double,fontName:string,order:bigint>"
PAGE = f"book_id bigint, page bigint, width double, height double, items array<{ITEM}>"


def bucket_of(book: Column) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(BUCKETS)).cast("int")


def write_pages(items: DataFrame, path: str) -> None:
    """Writes text items (book_id, page, frag_ord, str, scale, left, base, width, height, font, page_width, page_height) as pages. A page's items are gathered in one row."""
    item = F.struct("frag_ord", "str", "scale", "left", "base", "width", "height", "font")
    write_whole_pages(items.groupBy("book_id", "page", "page_width", "page_height").agg(F.collect_list(item).alias("items")), path)


def write_whole_pages(pages: DataFrame, path: str) -> None:
    """Writes pages (book_id, page, page_width, page_height, items), each from where it lies, in files by task and folder. JSON repeats itself, so it is written with gzip, and no line is moved before."""
    zero = F.lit(0.0)
    item = lambda i: F.struct(
        i["str"].alias("str"), F.array(F.lit(1.0), zero, zero, i["scale"], i["left"], i["base"]).alias("transform"), i["width"].alias("width"), i["height"].alias("height"),
        i["font"].alias("fontName"), i["frag_ord"].alias("order"),
    )
    by_order = F.transform(F.array_sort("items", lambda a, b: F.when(a["frag_ord"] < b["frag_ord"], -1).when(a["frag_ord"] > b["frag_ord"], 1).otherwise(0)), item)
    rows = pages.select("book_id", "page", F.col("page_width").alias("width"), F.col("page_height").alias("height"), by_order.alias("items"))
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")
    rows.select(line, bucket_of(F.col("book_id")).alias("bucket"), F.floor(F.col("page") / PAGES).cast("int").alias("range")).write.partitionBy("bucket", "range").text(path, compression="gzip")


def page_records(spark: SparkSession, path: str, books: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """value (the line) and r (its record, or nulls), of all pages or those of some books and of pages from first to last."""
    lines = spark.read.schema("value string, bucket int, range int").text(path)
    if books is not None:
        ids = spark.createDataFrame([(b,) for b in books], "b bigint")
        lines = lines.filter(F.col("bucket").isin([r[0] for r in ids.select(bucket_of(F.col("b"))).distinct().collect()]))
    if first is not None:
        lines = lines.filter(F.col("range") >= first // PAGES)
    if last is not None:
        lines = lines.filter(F.col("range") <= last // PAGES)
    rows = lines.select("value", F.from_json("value", f"{PAGE}, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("r"))
    wanted = F.lit(True)
    for asked, test in ((books, lambda: F.col("r.book_id").isin(books)), (first, lambda: F.col("r.page") >= first), (last, lambda: F.col("r.page") <= last)):
        if asked is not None:
            wanted &= F.coalesce(test(), F.lit(True))
    return rows.filter(wanted)


def is_whole() -> Column:
    return F.col("r.bad").isNull() & F.col("r.book_id").isNotNull() & F.col("r.page").isNotNull() & F.col("r.items").isNotNull()


def read_pages(spark: SparkSession, path: str, books: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The text items of pages, as fragments() takes them; items without a text or a transform of six numbers have none of it."""
    rows = page_records(spark, path, books, first, last).filter(is_whole()).select("r.*").withColumnRenamed("width", "page_width").withColumnRenamed("height", "page_height")
    rows = rows.select("book_id", "page", "page_width", "page_height", F.posexplode("items").alias("at", "i"))
    place = lambda n: F.get("i.transform", F.lit(n))
    return rows.select(
        "book_id", "page", F.coalesce("i.order", F.col("at").cast("long")).alias("frag_ord"), "i.str", place(3).alias("scale"), place(4).alias("left"), place(5).alias("base"),
        F.col("i.width").alias("width"), F.col("i.height").alias("height"), F.col("i.fontName").alias("font"), "page_width", "page_height",
    )


def set_aside(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines that are no whole record."""
    return page_records(spark, path).filter(~is_whole()).select("value")
