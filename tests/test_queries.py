"""Every registered query with SQL against DuckDB on the smallest tables; rules that the tables don't show on literal rows."""

import os

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliograph.functions import text as T
from foliograph.operators import chapters as C
from foliograph.operators import narration as K
from foliograph.operators import playback as P
from foliograph.operators import queue as Q
from foliograph.plans import layout_oracles, oracles
from foliograph.plans import queries as plans
from foliograph.sources import projections

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_against_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    want = duck.execute((oracles.oracle_sql() | layout_oracles.oracle_sql())[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["word_counts", "paragraphs", "queue_end", "chapters", "signatures"])
def test_large_tables(spark, monkeypatch, name):
    """Tables that are read where they lie give what small ones give, which are dealt over the cores first."""
    rows = lambda: sorted(map(str, plans.queries()[name](spark, SF).collect()))
    dealt = rows()
    monkeypatch.setattr(projections, "ROW_GROUP", 0)
    assert rows() == dealt


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_of_writes(spark, tmp_path, zone):
    """Times just below a millisecond, before 1970, at a change to summer time, and events without a time or a reader."""
    con = duckdb.connect()
    times = ["2024-01-22 22:40:49.999976", "2024-01-22 22:40:49.9995", "2024-01-22 22:40:49.999499", "1969-12-31 23:59:39.9995", "1969-12-31 23:59:40.000501", "2024-03-10 02:30:00", "2024-03-10 03:30:00.25", "2024-03-10 03:30:00"]
    rows = [f"({reader}, {n * 3 + k}, TIMESTAMP '{at}')" for n, at in enumerate(times) for k, reader in enumerate((1, n, "NULL"))] + ["(1, 900, NULL)", "(50, 901, NULL)"]
    con.execute(f"create table events as select * from (values {', '.join(rows)}) e(user_id, event_id, ts)")
    con.execute(f"copy (select user_id::BIGINT AS user_id, event_id::BIGINT AS event_id, ts from events) to '{tmp_path}/events.parquet'")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = plans.queries()["throttled_writes"](spark, str(tmp_path)).select("reader", "opened", "due", "event_id").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = con.execute(f"select reader, opened, due, event_id from ({oracles.oracle_sql()['throttled_writes']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [
    ("ﬁnd the oﬃce", "find the office"), ("a­b​c", "abc"), ("é", "é"), ("One . . . . . 14", "One 14"), ("a ( b ) , c", "a (b), c"), ("x‐y z", "x-y z"), ("● item", "• item"), ("a\x07b", "ab"), ("", ""),
])
def test_clean(spark, raw, want):
    assert value(spark, T.clean, raw) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("see https://a.b/c now", "see link now"), ("mail a.b@c.org now", "mail email address now"), ("cats, e.g. tabbies", "cats, for example, tabbies"), ("pp. 3-5", "pages 3 to 5"), ("$3 million gone", "3 million dollars gone"), ("$5", "5 dollars"),
    ("NASA and the WORLD", "Nasa and the World"), ("wait. . . now", "wait… now"), ("20 °C", "20 degrees Celsius"), ("“hi”—‘so’", "\"hi\", 'so'"), ("etc. etc. x", "et cetera. et cetera. x"), ("no!!", "no!"),
])
def test_speech(spark, raw, want):
    assert value(spark, T.speech, raw) == want


def test_sentences(spark):
    text = 'Dr. Smith paid 3.50 today. He left! "Why?" she said… Then 1. 2 more. end'
    got = [r["text"] for r in value(spark, T.sentences, text)]
    assert got == ["Dr. Smith paid 3.50 today.", "He left!", '"Why?" she said…', "Then 1. 2 more. end"]
    assert all(text[r["offset"] :].startswith(r["text"]) for r in value(spark, T.sentences, text))


@pytest.mark.parametrize(("raw", "want"), [("IV", 4), ("mcmxc", 1990), ("IIII", 4), ("IC", 99), ("X1", 0)])
def test_roman(spark, raw, want):
    assert value(spark, T.roman_to_int, raw) == want


def test_formats(spark):
    rows = [T.duration(F.lit(s)) for s in (-1.0, 45.0, 90.0, 7500.0, 7200.0)] + [T.file_size(F.lit(n)) for n in (12, 2048, 1572864)] + [T.percent(F.lit(x)) for x in (0.125, 2.0)]
    assert list(spark.range(1).select(*rows).first()) == ["--", "45s", "2m", "2h 5m", "2h", "12 B", "2 KB", "1.5 MB", "13%", "100%"]


def test_paragraphs(spark):
    """A wrapped word is joined; a short line that ends a sentence ends the paragraph unless it is its first."""
    text = "First line of a hyphen-\nated word that goes on here\nto a short end.\nOne.\nTwo\n\nX\nlast"
    got = C.paragraphs(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("idx").collect()
    assert [r["text"] for r in got] == ["First line of a hyphenated word that goes on here to a short end.", "One. Two", "X last"]


def test_inline_queue(spark):
    rows = [(1, 0, 0, "heading", None, 2), (1, 1, 0, "paragraph", None, 5), (1, 2, 0, "paragraph", "1", 5), (1, 3, 0, "footnote", "1", 3), (1, 4, 0, "footnote", "9", 3)]
    blocks = spark.createDataFrame(rows, "book_id int, block_id long, chapter int, type string, note_ref string, words int")
    order = lambda mode: [r["block_id"] for r in Q.build_queue(blocks, mode).orderBy("pos").collect()]
    assert order("chapter-end") == [0, 1, 2, 3, 4] and order("inline") == [0, 1, 2, 3, 4] and order("skip") == [0, 1, 2]


def test_paragraph_ends(spark):
    """Of closing lines in a row every second one is a paragraph's first; blank lines, line breaks of either kind, empty and null texts."""
    rows = [(1, "One.\nTwo.\nThree.\nFour.\nFive."), (2, "\r\n\r\n  a-\r\nb \r\n\r\n\r\nlong-\nEnd"), (3, ""), (4, None), (5, "x")]
    got = C.paragraphs(spark.createDataFrame(rows, "id int, text string"), "id").orderBy("id", "idx").collect()
    assert [(r["id"], r["idx"], r["text"]) for r in got] == [(1, 0, "One. Two."), (1, 1, "Three. Four."), (1, 2, "Five."), (2, 0, "ab"), (2, 1, "long- End")]


@pytest.mark.parametrize(("at", "want"), [(0, (4, "one")), (4, (8, "two")), (7, (8, "two")), (99, (12, "three"))])
def test_highlight(spark, at, want):
    blocks = spark.createDataFrame([(1, 2, "Oh, one two three")], "book_id int, block_id int, text string")
    said = spark.createDataFrame([(1, 2, 0, 4, "one two three", at)], "book_id int, block_id int, chunk_idx int, offset int, text string, char_index int")
    assert tuple(K.highlighted(said, blocks).first())[3:] == want


def test_display(spark):
    steps = [T.rate_step(F.lit(r), up) for r, up in ((1.0, True), (1.98, True), (0.52, False), (1.1, False))]
    done = [P.import_fraction(F.lit(p), F.lit(a), F.lit(n)) for p, a, n in (("scanning", 5, 10), ("analysing", 5, 10), ("ocr", 1, 0))]
    taken = [P.importable(F.lit(n), F.lit(m)) for n, m in (("A.PDF", None), ("a", "application/pdf"), ("a.pdf.txt", "text/plain"), (None, None))]
    assert list(spark.range(1).select(*steps).first()) == [1.05, 2.0, 0.5, 1.05]
    assert [round(x, 9) for x in spark.range(1).select(*done).first()] == [0.4, 0.9, 0.0]
    assert list(spark.range(1).select(*taken).first()) == [True, True, False, False]


def test_whole_books(spark):
    """What holds of any book: chunks are short and all of their blocks', nearly all words of prose are spoken, every block stands once in the queue, chapter after chapter."""
    own = plans.blocks(spark, SF)
    chunks = plans.chunks(spark, SF)
    assert chunks.agg(F.max(F.length("text"))).first()[0] <= 300
    prose = own.filter("type = 'paragraph'")
    spoken = chunks.join(prose.select("book_id", "block_id"), ["book_id", "block_id"]).agg(F.sum("words")).first()[0]
    assert spoken > 0.95 * prose.agg(F.sum(T.count_tokens(F.col("text")))).first()[0]
    for mode in ("queue_end", "queue_inline"):
        queue = plans.queries()[mode](spark, SF)
        assert queue.count() == queue.select("book_id", "block_id").distinct().count() == own.count()
        order = Window.partitionBy("book_id").orderBy("pos")
        assert queue.withColumn("back", F.lag("chapter").over(order) > F.col("chapter")).filter("back").isEmpty()
        assert queue.groupBy("book_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")).filter("a <> 0 or b <> n - 1").isEmpty()
