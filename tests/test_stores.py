"""Stores by version: what is published is seen, whole, whatever came between; compaction, pruned reads, crashes and schemas that have grown."""

import pathlib

import pytest
from pyspark.sql import functions as F

from foliograph.sources import stores


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "book_id int")


def blocks(spark, *rows):
    return spark.createDataFrame(list(rows), "book_id int, text string")


def read(spark, root, name, **more):
    found = stores.load(spark, root, name, **more)
    return None if found is None else sorted(map(tuple, found.select("book_id", "text").collect()))


def test_versions(spark, tmp_path):
    """A save replaces a book in the stores it names; one that wasn't published is not seen; a removed book is gone from all; the same before and after compaction."""
    root = str(tmp_path)
    assert read(spark, root, "blocks") is None
    stores.save(ids(spark, 1, 2), root, 1, {"books": blocks(spark, (1, "A"), (2, "B")), "blocks": blocks(spark, (1, "x"), (1, "y"), (2, "z"))})
    stores.save(ids(spark, 1), root, 2, {"blocks": blocks(spark, (1, "w"), (2, "not of this save"))})
    for compacted in (False, True):
        if compacted:
            stores.compact(spark, root, 2)
        assert read(spark, root, "blocks") == [(1, "w"), (2, "z")] and read(spark, root, "books") == [(1, "A"), (2, "B")]
    stores.put(blocks(spark, (1, "lost")), ["book_id"], f"{root}/blocks/step=6")
    assert read(spark, root, "blocks") == [(1, "w"), (2, "z")]
    stores.save(ids(spark, 2), root, 3, {"books": None, "blocks": None})
    stores.save(ids(spark, 2), root, 3, {"books": None, "blocks": None})
    assert read(spark, root, "blocks") == [(1, "w")] and read(spark, root, "books") == [(1, "A")]
    stores.compact(spark, root, 3)
    assert read(spark, root, "blocks") == [(1, "w")] and read(spark, root, "files") is None and read(spark, root, "blocks", before=3) == [(1, "w"), (2, "z")]


def test_many_saves(spark, tmp_path):
    """What a reader opens doesn't grow with the saves; the reader of one book opens one bucket."""
    root, want, files, opened = str(tmp_path), {}, [], []
    for v in range(24):
        own = [v % 7, v % 5 + 10]
        want |= {b: f"{b} of {v}" for b in own}
        stores.save(ids(spark, *own), root, v, {"blocks": blocks(spark, *[(b, want[b]) for b in own])}, compact_after=4)
        if v % 5 == 4:
            files.append(len(list(pathlib.Path(root).rglob("*.parquet"))))
            opened.append(len(stores.load(spark, root, "blocks").inputFiles()))
    assert read(spark, root, "blocks") == sorted(want.items())
    assert max(files) <= 2 * files[0] + 40 and max(opened) <= 30
    one = stores.load(spark, root, "blocks", ids(spark, 11))
    assert [tuple(r) for r in one.select("book_id", "text").collect()] == [(11, want[11])]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]


def test_crash(spark, tmp_path, monkeypatch):
    """A compaction that ends before its manifest row is not seen, and can be made again; so with a vacuum that is half done."""
    root = str(tmp_path)
    for v in range(3):
        stores.save(ids(spark, v, 9), root, v, {"blocks": blocks(spark, (v, str(v)), (9, f"last {v}"))}, compact_after=99)
    want = [(0, "0"), (1, "1"), (2, "2"), (9, "last 2")]

    def crash(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(stores, "publish", crash)
        with pytest.raises(RuntimeError):
            stores.compact(spark, root, 2)
    assert read(spark, root, "blocks") == want and len(stores.published(spark, root)) == 3
    with monkeypatch.context() as m:
        m.setattr(stores, "vacuum", crash)
        with pytest.raises(RuntimeError):
            stores.compact(spark, root, 2)
    assert read(spark, root, "blocks") == want and [s[1] for s in stores.published(spark, root)] == ["base"]
    stores.compact(spark, root, 2)
    assert read(spark, root, "blocks") == want


def test_grown_schema(spark, tmp_path):
    """Rows of three versions of a schema lie in one store; what a version didn't have is null, and stays so through compaction."""
    root = str(tmp_path)
    one = lambda v, cols: stores.save(ids(spark, v), root, v, {"settings": ids(spark, v).select("book_id", *cols)}, compact_after=99)
    one(1, [F.lit(1.5).alias("rate")])
    one(2, [F.lit(1.25).alias("rate"), F.lit(180).alias("base_wpm")])
    one(3, [F.lit(200).alias("base_wpm"), F.lit("dark").alias("theme")])
    want = [(1, None, 1.5, None), (2, 180, 1.25, None), (3, 200, None, "dark")]
    for _ in range(2):
        assert sorted(map(tuple, stores.load(spark, root, "settings").select("book_id", "base_wpm", "rate", "theme").collect())) == want
        stores.compact(spark, root, 3)


def test_merge(spark, tmp_path):
    """The last by order of a key stays, whichever version brings it; merging a version again changes nothing."""
    root = str(tmp_path)
    moves = lambda *rows: spark.createDataFrame(list(rows), "reader int, t int, place string")
    versions = [[(1, 5, "a"), (2, 1, "b"), (1, 4, "c")], [(1, 3, "late"), (2, 2, "d")], [(3, 0, "e")]]
    for v, rows in enumerate(versions):
        for _ in range(2):
            stores.merge(moves(*rows), root, v, "positions", ["reader"], ["t"])
    assert sorted(map(tuple, stores.load(spark, root, "positions", key=["reader"]).collect())) == [(1, 5, "a"), (2, 2, "d"), (3, 0, "e")]
