"""Very long texts full of what an operator looks for: same results, in a time that grows with the text; and names and hosts that have got in the way."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import decontam, licenses, pii, urlfilter


def within(seconds, work, *args):
    start = time.time()
    out = work(*args)
    assert time.time() - start < seconds
    return out


def test_many_tags():
    text = b"// SPDX-License-Identifier: MIT \n// SPDX-License-Identifier: Apache-2.0 OR ISC\n" * 25_000
    n_words, _, _, _, _, labels, _, permissive = within(10, licenses.scan_text, text)
    assert (n_words, labels, permissive) == (25_000 * 12, "apache,isc,mit", True)
    one_line = b"SPDX-License-Identifier: GPL-2.0 " * 50_000
    assert within(10, licenses.scan_text, one_line)[5:] == ("gpl", licenses.TAG_WEIGHT, False)
    places = b"x " * 10 + b"mit license " * 100_000
    assert within(10, licenses.scan_text, places)[:5] == (200_010, 100_000, 10, 10 + 199_998, "mit")


@pytest.mark.parametrize(("expression", "labels", "permissive"), [
    ("MIT AND (GPL-2.0", {"mit", "gpl"}, False), ("MIT AND (GPL-2.0 OR", {"mit", "gpl"}, False), ("MIT AND ( (", {"mit"}, True), ("(MIT OR (GPL-3.0 AND ISC", {"mit", "gpl", "isc"}, True),
    ("MIT OR GPL-2.0 AND", {"mit", "gpl"}, True), ("((GPL-2.0) AND MIT", {"gpl", "mit"}, False), ("MIT) AND GPL-2.0", {"mit"}, True), ("MIT WITH", {"mit"}, True),
])
def test_open_expressions(expression, labels, permissive):
    assert licenses.evaluate(expression) == (frozenset(labels), permissive)


@pytest.mark.parametrize("expression", ["", "(", "((", "AND MIT", "*/", "( AND"])
def test_no_expression(expression):
    assert licenses.evaluate(expression) is None


def test_many_spans():
    rng = np.random.default_rng(1)
    base = [("email", int(a), int(a) + 15) for a in range(0, 1_000_000, 20)]
    more = [("secret", int(a), int(a) + int(n)) for a, n in zip(rng.integers(0, 1_000_000, 50_000), rng.integers(1, 9, 50_000), strict=True)]
    got = within(10, pii.all_spans, base, more)
    assert {s for s in got if s[0] == "secret"} == {m for m in more if m[1] % 20 >= 15 and m[1] % 20 + m[2] - m[1] <= 20}


def test_spans_beside_each_other():
    """Against every pair; base spans of different kinds may overlap each other."""
    rng = np.random.default_rng(2)
    made = lambda n: [(pii.KINDS[int(k)], int(a), int(a) + int(m)) for k, a, m in zip(rng.integers(0, len(pii.KINDS), n), rng.integers(0, 300, n), rng.integers(1, 20, n), strict=True)]
    for _ in range(50):
        base, more = made(8), made(30)
        kept = {m for m in more if all(m[2] <= b[1] or m[1] >= b[2] for b in base)}
        assert pii.all_spans(base, more) == sorted({*base, *kept}, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
    assert pii.all_spans([], []) == []


def test_many_hits(spark):
    passage = " ".join(f"pässage{i}" for i in range(10))
    text = f"eins zwei {passage} drei " * 20_000
    docs = spark.createDataFrame([(1, text), (2, "clean " * 20), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    row = within(60, lambda: decontam.scan(spark, docs, bench).filter("doc_id = 1").first())
    assert (row["n_words"], row["n_hit"], len(row["spans"])) == (260_000, 200_000, 20_000)
    assert row["spans"][:2] == [[10, 10 + len(passage)], [10 + len(f"eins zwei {passage} drei "), 10 + len(f"eins zwei {passage} drei ") + len(passage)]]
    cut = {r["doc_id"]: r["text"] for r in within(60, lambda: decontam.remove_spans(spark, docs, bench, max_share=1.0).collect())}
    assert cut == {1: "eins zwei   drei " * 20_000, 2: "clean " * 20, 3: None}
    assert within(10, decontam._merged, text.encode(), [(i * 20, i * 20 + 9) for i in range(100_000)])


def test_several_sets(spark):
    """Items over several sets and items in pieces, with columns named as the operator's own: what one set gives."""
    words = [f"w{i}" for i in range(200)]
    items = [(1, " ".join(words)), (2, "two words"), (3, " ".join(words[50:62])), (None, "no id of its own is there but ten words at least"), (4, None), (5, "?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["x " * 5 + " ".join(words[20:45]) + " y", "these two words here", " ".join(words[48:64]), "", None, "no id of its own is there but ten words at least", " ".join(words[185:]), " ".join(words[48:64])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("*", F.lit("mine").alias("_hits"), F.lit(7).alias("_key"), F.lit(8).alias("key"))
    rows = lambda df: sorted(map(str, df.collect()))
    one, kept = rows(decontam.scan(spark, docs, bench)), rows(decontam.remove_spans(spark, docs, bench, max_share=0.9))
    for most in (60, 25):
        assert rows(decontam.scan(spark, docs, bench, max_windows=most)) == one
        cut = decontam.remove_spans(spark, docs, bench, max_share=0.9, max_windows=most)
        assert cut.columns == docs.columns and rows(cut) == kept and {r["_hits"] for r in cut.collect()} == {"mine"}
    assert decontam.scan(spark, docs, bench.limit(0), max_windows=50).filter("n_items > 0").isEmpty() and decontam.scan(spark, docs.limit(0), bench, max_windows=50).isEmpty()
    row = decontam.scan(spark, docs, bench, max_windows=50).filter("doc_id = 2").first()
    assert (row["n_hit"], row["n_items"], row["items_sha256"]) == (16, 2, hashlib.sha256(b"1,3").hexdigest())


def test_hosts(spark):
    """Addresses have no parent domains; those in brackets are hosts; a hot host is dealt over groups, which changes nothing."""
    urls = ["http://10.0.0.1/x", "http://7.0.0.1/", "http://[::1]/x", "http://[2001:DB8::2]:80/a/b", "http://a.b.example/p", "http://u@b.example:8/p?q"] + [f"http://hot.example/{i % 3}/{i}" for i in range(300)]
    day = F.lit("2024-02-01").cast("date")
    captures = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("fetched", day)
    patterns = ["0.0.1", "0.1", "10.0.0.1", "[::1]", "[2001:db8::2]/a", "b.example", "hot.example/1", "example"]
    entries = spark.createDataFrame([("l", p, "add") for p in patterns], "list string, pattern string, action string").withColumn("at", F.lit("2024-01-01").cast("date"))
    got = {r["page_id"]: r["rules"] for r in urlfilter.filter_urls(captures, entries).collect()}
    assert [got[i] for i in range(6)] == ["10.0.0.1", "", "[::1]", "[2001:db8::2]/a", "b.example", "b.example"]
    assert all(got[6 + i] == ("hot.example/1" if i % 3 == 1 else "") for i in range(300))
    assert {r["page_id"]: r["host"] for r in urlfilter.filter_urls(captures, entries).collect()}[3] == "[2001:db8::2]"
    assert {r["page_id"]: r["rules"] for r in urlfilter.filter_urls(captures, entries, salt_rows=20).collect()} == got
