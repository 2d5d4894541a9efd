"""Rules of set pages that the tables hardly show, on literal rows."""

import pathlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import blocks as B
from foliograph.operators import books
from foliograph.operators import chapters as C
from foliograph.operators import furniture as H
from foliograph.operators import layout as L
from foliograph.operators import playback as P
from foliograph.operators import queue as Q
from foliograph.plans import layout_queries
from foliograph.sources import fragments
from foliograph.sources.tables import shared_folder


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("lines", "want"), [
    (["The trea-", "ty failed."], "The treaty failed."), (["Anglo-", "Saxon"], "Anglo-Saxon"), (["one", "two"], "one two"), (["a -", "b"], "a - b"), (["x", "y-"], "x y-"), (["in 19-", "century"], "in 19century"),
])
def test_wrapped(spark, lines, want):
    assert one(spark, B.wrapped(F.array(*map(F.lit, lines)))) == want


@pytest.mark.parametrize(("values", "share", "want"), [([3.0, 1.0, 2.0], 0.5, 2.0), ([1.0, 2.0, 3.0, 4.0], 0.5, 3.0), ([5.0], 0.9, 5.0), ([1.0, 2.0], 0.1, 1.0)])
def test_nearest_rank(spark, values, share, want):
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", L.ranked_value("x", share, Window.partitionBy(F.lit(1))).alias("r"))
    assert [r["x"] for r in rows.filter("r.picked").collect()] == [want]


def frags(spark, rows):
    return spark.createDataFrame([(1, 1, i, *r, r[4], "f", 612.0, 792.0) for i, r in enumerate(rows)], "book_id int, page int, frag_ord int, str string, x double, y double, w double, size double, h double, font string, page_width double, page_height double")


def test_lines(spark):
    """A drifting baseline stays one line; a gap asks for a blank unless there is one."""
    got = L.lines(frags(spark, [("Hel", 72.0, 100.0, 20.0, 10.0), ("lo", 92.5, 103.0, 10.0, 10.0), ("there ", 106.0, 105.5, 30.0, 10.0), ("now", 140.0, 106.0, 20.0, 10.0), ("next", 72.0, 115.0, 20.0, 10.0)])).orderBy("line_idx").collect()
    assert [r["text"] for r in got] == ["Hello there now", "next"]


def test_bands(spark):
    """Two columns above and below a line across the page."""
    rows = [(f"{c}{k}", 72.0 + 246 * (c == "r"), 100.0 + 20 * k + 100 * (k > 5), 200.0, 10.0) for c in "rl" for k in range(12)]
    got = L.lines(frags(spark, [*rows, ("across", 90.0, 260.0, 432.0, 10.0)])).orderBy("line_idx").collect()
    assert [r["text"] for r in got] == [*[f"l{k}" for k in range(6)], *[f"r{k}" for k in range(6)], "across", *[f"l{k}" for k in range(6, 12)], *[f"r{k}" for k in range(6, 12)]]
    assert {r["n_columns"] for r in got} == {2}


def test_items(spark):
    """Sizes and heights of zero or none, and blank items."""
    schema = "book_id int, page int, frag_ord int, str string, scale double, left double, base double, width double, height double, font string, page_width double, page_height double"
    rows = [(1, 1, i, t, s, 1.0, 700.0, 5.0, h, "f", 612.0, 792.0) for i, (t, s, h) in enumerate([("a", -9.0, 0.0), ("b", 0.0, 8.0), ("c", None, None), ("  ", 9.0, 9.0), (None, 9.0, 9.0)])]
    got = L.fragments(spark.createDataFrame(rows, schema)).orderBy("frag_ord").collect()
    assert [(r["str"], r["size"], r["h"], r["y"]) for r in got] == [("a", 9.0, 9.0, 92.0), ("b", 8.0, 8.0, 92.0), ("c", 10.0, 10.0, 92.0)]


@pytest.mark.parametrize(("text", "want"), [
    ("Chapter 4", True), ("PART ONE", True), ("Prologue", True), ("XIV", True), ("xiv", False), ("12", True), ("1234", False), ("Chapterhouse", False), ("About the Author", True), ("Chapter " + "x" * 90, False), ("book review", False), ("canto iv", True),
])
def test_chapter_titles(spark, text, want):
    assert one(spark, T.looks_like_chapter(F.lit(text))) is want


@pytest.mark.parametrize(("text", "want"), [("12", True), ("- 3 -", True), ("[iv]", False), ("xiv", True), ("Page 3 of 10", True), ("3 | The Book", True), ("The Book · 3", True), ("12345", False), ("Chapter", False)])
def test_folios(spark, text, want):
    assert one(spark, T.is_folio(F.lit(text))) is want


def test_outline(spark):
    """Headings of an entry's page open the chapter; entries without blocks are passed over; a first chapter is put in."""
    raw = spark.createDataFrame([(1, i, t, x, p) for i, (t, x, p) in enumerate([("paragraph", "a", 1), ("paragraph", "b", 2), ("heading", "H", 2), ("footnote", "n", 2), ("paragraph", "c", 3)])], "book_id int, raw_idx int, type string, text string, page int")
    marks = spark.createDataFrame([(1, 0, 0, " The  Second ", 2), (1, 1, 1, "Third", 3), (1, 2, 2, "deep", 1), (1, 3, 0, "none", 9)], "book_id int, mark_ord int, depth int, title string, page int")
    got = C.chapters(raw, marks).orderBy("chapter").collect()
    assert [(r["title"], r["source"], r["start_block"], r["end_block"]) for r in got] == [("Opening", "heuristic", 0, 2), ("The Second", "outline", 2, 4), ("Third", "outline", 4, 5)]


def test_lists(spark):
    edit = lambda action, book, to=0: one(spark, Q.edited_list(F.array(*map(F.lit, [1, 2, 3])), F.lit(action), F.lit(book), F.lit(to)))
    assert edit("add", 4) == [1, 2, 3, 4] and edit("add", 2) == [1, 2, 3] and edit("remove", 2) == [1, 3] and edit("move", 3) == [3, 1, 2] and edit("move", 1, 2) == [2, 3, 1] and edit("move", 9) == [1, 2, 3]


@pytest.mark.parametrize(("title", "name", "want"), [(" A Book ", "x.pdf", "A Book"), ("ab", "my__file.PDF", "my file"), ("Untitled 1", "a_b  c.pdf", "a b c"), (None, "d.pdf", "d"), ("Microsoft Word - z", "e.txt", "e.txt")])
def test_titles(spark, title, name, want):
    assert one(spark, P.book_title(F.lit(title), F.lit(name))) == want


def test_pages(spark, tmp_path):
    """Items come back as they were written; broken lines are set aside; some books and pages are read from their folders alone."""
    items = spark.createDataFrame([(b, p, i, f"t{i} ü \"", 10.0 * i, 1.5, 700.25, 30.0, 0.0, None if i else "Serif", 612.0, 792.0) for b in range(20) for p in (1, 70, 130) for i in range(3)], "book_id long, page long, frag_ord long, str string, scale double, left double, base double, width double, height double, font string, page_width double, page_height double")
    path = f"{tmp_path}/pages"
    fragments.write_pages(items, path)
    broken = ['{"book_id": 3, "page": 1, "items": [', '{"page": 1, "items": []}', "no json", '{"book_id": 3, "page": "one", "items": []}', '{"book_id": 3, "page": 2}']
    (next(pathlib.Path(path).glob("bucket=*/range=0")) / "more.txt").write_text("\n".join([*broken, '{"book_id": 99, "page": 1, "width": 1, "height": 2, "items": [{"str": "x"}, {"str": null, "transform": [1, 2]}]}']))
    rows = lambda df: sorted(map(str, df.select(items.columns).collect()))
    found = fragments.read_pages(spark, path)
    assert rows(found.filter("book_id < 99")) == rows(items) and found.filter("book_id = 99").count() == 2
    assert sorted(r["value"] for r in fragments.set_aside(spark, path).collect()) == sorted(broken)
    few = fragments.read_pages(spark, path, books=[4, 7], first=64, last=129)
    assert rows(few) == rows(items.filter("book_id in (4, 7) and page = 70"))
    assert "range#" in few._jdf.queryExecution().toString().split("PartitionFilters")[1][:300] and {x.split("range=")[1][:1] for x in few.inputFiles()} <= {"0", "1", "2"}
    assert len(few.filter("true")._jdf.queryExecution().executedPlan().toString()) and fragments.read_pages(spark, path, books=[]).count() == 0
    assert L.fragments(found).filter("book_id < 99").count() == items.count()


ODD = ["plain", "a  b\tc", "x ( y [ z", "so , it . is )", "dots . . . . end", "a____b", "bad\x07bell\x85", "\ufb01n\u00ad \u2013 \u2212\u00a0\u3000q", "e\u0301", " . . . .", "\u2028x\u2028,", "{\u00a0y", "\ufeff", ""]


def test_books(spark):
    """What is made of a book in Python is what the column functions make of it: cleaned texts, keys, folios, and all blocks of the smallest tables."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    got = rows.select("t", T.clean(F.col("t")).alias("clean"), H.keys_of(F.col("t")).alias("keys"), T.is_folio(F.col("t")).alias("folio")).collect()
    assert [(r["clean"], r["keys"], r["folio"]) for r in got] == [(books.clean(r["t"]), books.keys_of(r["t"]), bool(books.FOLIO.search(r["t"].strip(T.BLANKS)))) for r in got]
    pages = layout_queries.kept_lines(layout_queries.with_books(spark, "/root/testdata/sf0.001"))
    want = B.raw_blocks(B.labelled(L.segments(pages)))
    assert sorted(map(str, layout_queries.raw_blocks(spark, "/root/testdata/sf0.001").select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_pages_are_compressed(spark, tmp_path):
    """Pages are written with gzip, many times smaller than their lines."""
    items = spark.createDataFrame([(1, p, i, f"text {i}", 10.0, 1.5, 700.25, 30.0, 0.0, "Serif", 612.0, 792.0) for p in range(50) for i in range(80)], "book_id long, page long, frag_ord long, str string, scale double, left double, base double, width double, height double, font string, page_width double, page_height double")
    fragments.write_pages(items, f"{tmp_path}/pages")
    n_bytes = sum(f.stat().st_size for f in pathlib.Path(tmp_path).rglob("part-*"))
    assert fragments.read_pages(spark, f"{tmp_path}/pages").count() == 4000 and n_bytes < 4000 * 20


@pytest.mark.parametrize("name", ["line_kinds", "raw_blocks", "book_blocks", "book_chapters", "chapter_list", "extraction_quality"])
def test_nothing_is_written(spark, name):
    """Pages, lines and blocks aren't written between steps; texts are moved to their book's task, at most."""
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.rglob("*"))
    assert layout_queries.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert set(shared.rglob("*")) == before


@pytest.mark.parametrize(("stored", "want"), [
    ('{"rate": 1.5}', (1.5, 165, "chapter-end", "")), ('{"rate": 2, "base_wpm": 180, "theme": "dark", "keys": {"a": 1}}', (2.0, 180, "chapter-end", "keys={\"a\":1},theme=dark")),
    ("{}", (1.0, 165, "chapter-end", "")), (None, (1.0, 165, "chapter-end", "")), ("broken", (1.0, 165, "chapter-end", "")), ('{"rate": null, "footnote_mode": "skip"}', (1.0, 165, "skip", "")), ('{"base_wpm": "fast"}', (1.0, 165, "chapter-end", "")),
])
def test_stored_settings(spark, stored, want):
    row = P.stored_settings(spark.createDataFrame([(1, stored)], "reader int, stored string"), "stored", P.DEFAULTS).first()
    assert (row["rate"], row["base_wpm"], row["footnote_mode"], row["other"]) == want
