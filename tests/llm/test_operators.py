"""The ten operators: brute force, round trips, held-out accuracy, and odd rows (nulls, empty, repeats, clashing columns, empty tables)."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from foliograph.llm import ann, bpe, decontam, langid, licenses, pii, quality, similar, simhash, toxicity, urlfilter
from foliograph.llm.graph import components

SF = "/root/testdata/sf0.01"
LONG = "x" * 70_000 + " the end of it. " + "word " * 9000
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "!!! 123 @"), (5, "same text here"), (5, "same text here"), (None, "no id at all"), (6, LONG), (7, "日本語 é")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every odd kind, with further columns whose names clash with the operators' own."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("?").alias("score"), F.lit(0).alias("row"), F.lit(0).alias("k"), F.lit(0).alias("fp"), F.lit(0).alias("_row"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language(spark, docs, odd):
    trees = langid.train(docs, 50)
    got = {r["doc_id"]: r for r in langid.identify(spark, docs, trees).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in truth.items()]) > 0.98
    rows = langid.identify(spark, odd, trees).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 4)} == {"und"}
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(spark, odd, none).collect()} == {"und"}
    assert langid.identify(spark, odd.limit(0), trees).count() == 0


def test_code_lengths():
    """The walk over shared nodes against a direct recursion over counts."""
    texts = {"a": [b"abab abba ab"] * 3, "b": [b"bcbc bccb cb", b"cab"] * 3}
    trees = langid.grow(texts, order=2, least=1)

    def bits(lang, text):
        fold = lambda t: "".join(chr(langid.FOLD[b]) for b in t)
        counts, counted, padded = {}, fold(b"  ".join([b"", *texts[lang]])), "  " + fold(text)
        for i in range(2, len(counted)):
            for k in range(3):
                own = counts.setdefault(counted[i - k : i], {})
                own[counted[i]] = own.get(counted[i], 0) + 1
        total = 0.0
        for i in range(2, len(padded)):
            for k in (2, 1, 0, -1):
                if k < 0:
                    total += 8
                    break
                c = counts.get(padded[i - k : i])
                if c is None:
                    continue
                n, d = sum(c.values()), len(c)
                if padded[i] in c:
                    total -= np.log2(c[padded[i]] / (n + d))
                    break
                total -= np.log2(d / (n + d))
        return total

    data = [b"abc", b"", b"zz ab", b"cbc"]
    joined, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    got = langid.code_lengths(trees, joined, at, order=2)
    assert np.allclose(got, [[bits(lang, text) for lang in ("a", "b")] for text in data], atol=1e-3)


@pytest.mark.parametrize(("module", "label", "score"), [(toxicity, "toxic", toxicity.score_toxicity), (quality, "quality", quality.score_quality)])
def test_classifiers(spark, docs, odd, module, label, score):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = module.train(docs, labels, sample_docs=150)
    y = {r["doc_id"]: r[label] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    got = {r["doc_id"]: r["score"] for r in score(spark, docs, model).collect()}
    good = np.mean([(got[i] >= module.THRESHOLD) == bool(v) for i, v in y.items()])
    assert good > 0.85
    rows = score(spark, odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 5]
    assert same[0] == same[1]
    assert {r["doc_id"]: r["score"] for r in score(spark, docs.repartition(7), model).collect()} == got
    empty = module.train(docs.limit(0), labels.limit(0))
    assert score(spark, odd, empty).count() == len(ODD)


def test_pooling():
    """Scores of many texts at once against one text at a time: the table of taps against filters over summed embeddings."""
    rng = np.random.default_rng(6)
    model = toxicity.fit([], np.zeros(0), [])
    model.embed = rng.normal(size=model.embed.shape).astype(np.float32)
    texts = [b"one", b"", b"a fool and a liar", b"two words", b"the quick brown fox jumps over the lazy dog " * 30, b"  "]
    ids, cuts = toxicity.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    got = toxicity.responses(model, toxicity.taps(model), ids, cuts)
    for k in range(len(texts)):
        own = model.embed.astype(np.float64)[ids[cuts[k] : cuts[k + 1]]].sum(axis=1)
        assert np.allclose(got[k], toxicity._pooled(model, own)[0], atol=1e-4)


def test_bags():
    """Attention over the passages of one bag, written out, against the scores of many bags at once."""
    model = quality.fit([], np.zeros(0))
    texts = [b"", b"just one passage, with 3 signs!", b" ".join(b"w%d" % i for i in range(200)), b"AAA " * 90]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = quality.bag_scores(model, data, at)
    for text, score in zip(texts, got, strict=True):
        shape, edge, shares, of = quality.passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        bag = np.zeros(quality.HIDDEN)
        if len(text):
            mean = np.array([model.embed[shape[a:b]].mean(axis=0) for a, b in zip(edge, edge[1:], strict=False)])
            h = np.tanh(mean + shares @ model.share + model.bias)
            weight = np.exp((np.tanh(h @ model.tanh_gate) / (1 + np.exp(-h @ model.sigm_gate))) @ model.attend)
            bag = (weight / weight.sum()) @ h
            assert of[-1] == -(-len(text.split()) // quality.PASSAGE_WORDS)
        assert abs(score - 1 / (1 + np.exp(-(bag @ model.out + model.out_bias)))) < 1e-6


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Same TEXT"), (3, None), (4, "")], "item_id long, text string")
    docs = odd.unionByName(odd.limit(1).select(F.lit(9).cast("long").alias("doc_id"), F.lit("zero one, two three FOUR five six seven eight nine ten; eleven twelve").alias("text"), *odd.columns[2:]))
    got = {(r["doc_id"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.scan(spark, docs, bench).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (9, 11, 1, sha("1")) in got and (5, 2, 1, sha("2")) in got and (1, 0, 0, sha("")) in got
    assert decontam.scan(spark, docs, bench).count() == docs.count()
    key = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    a, b = (sorted(map(str, x.select(key).collect())) for x in (decontam.scan(spark, docs, bench), decontam.scan_by_join(docs, bench)))
    assert a == b
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(spark, docs, bench, max_share=0.9).collect()}
    assert cut[9] == "zero   twelve" and cut[1] is None and decontam.scan(spark, docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_in_parts(spark, odd):
    """More windows than one set may hold: the same rows, spans and texts as from one set."""
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(words[i * 5 : i * 5 + 12])) for i in range(10)] + [(10, "same text"), (None, "at all")], "item_id long, text string")
    more = [(20, "é " + " ".join(words)), (21, "x y " * 20 + " ".join(words[3:25]) + " z" * 20), (22, "x " * 30 + " ".join(words[:10]))]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string").select("*", *[F.lit(odd.first()[c]).cast(odd.schema[c].dataType).alias(c) for c in odd.columns[2:]]))
    rows = lambda df: sorted(map(str, df.collect()))
    scanned, cut = rows(decontam.scan(spark, docs, bench)), rows(decontam.remove_spans(spark, docs, bench))
    assert rows(decontam.scan(spark, docs, bench, max_windows=30)) == scanned
    assert rows(decontam.remove_spans(spark, docs, bench, max_windows=30)) == cut and len(cut) < len(scanned)


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[10:20] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(0)).withColumn("rank", F.lit(0))
    got = ann.search(spark, df, F.col("vec_id") % 20 == 0, 20, ann.build(df.filter(ann.usable(F.col("embedding"))), 20, list_rows=40)).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q, found in by.items():
        s = x[q] @ x.T
        s[q] = -np.inf
        hits += len({v for v, _ in found.values()} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        assert sorted(found) == list(range(1, 21))
        in_order = [found[k] for k in range(1, 21)]
        assert in_order == sorted(in_order, key=lambda p: (-p[1], p[0]))
    assert len(by) == 30 and hits / 600 >= 0.9
    few = ann.search(spark, df.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert ann.search(spark, df.filter("vec_id >= 1000 and vec_id < 1004"), F.lit(True)).count() == 0


def test_neighbours_repeated(spark):
    """Rows that stand several times, and a vec_id of many vectors next to a query, take one place each."""
    x = np.random.default_rng(1).normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build(df, 20, list_rows=40)
    result = lambda rows: {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(spark, rows, F.col("vec_id") % 20 == 0, 20, index).collect()}
    once = result(df)
    assert len(once) == 600 and result(df.unionByName(df)) == once
    near = spark.createDataFrame([(601, (x[0] * (1 - i / 1000)).tolist()) for i in range(30)], df.schema)
    many = result(df.unionByName(near))
    first = [once[0, k] for k in range(1, 21)]
    place = sum(x[0] @ x[i] > x[0] @ x[0] for i in first)
    assert place < 19 and [many[0, k] for k in range(1, 21)] == [*first[:place], 601, *first[place:19]]


def test_urls(spark):
    entries = spark.createDataFrame([("l", "bad.com", "add", 5), ("l", "bad.com", "remove", 9), ("l", "bad.com", "remove", 9), ("l", "x.org/p", "add", 1), ("l", None, "add", 1)], "list string, pattern string, action string, at int")
    pages = [(1, "http://a.BAD.com/x", 5), (2, "https://u@bad.com:80/", 8), (3, "http://bad.com", 9), (4, "http://bad.com", 4), (5, "http://x.org/p/q?r", 3), (6, None, 3), (7, "", 3), (8, "http://bad.com", None), (1, "http://a.BAD.com/x", 5)]
    got = {r["page_id"]: (r["blocked"], r["n_rows"]) for r in urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, fetched int"), entries).collect()}
    assert got == {1: (True, 2), 2: (True, 1), 3: (False, 1), 4: (False, 1), 5: (True, 1), 6: (False, 1), 7: (False, 1), 8: (False, 1)}


@pytest.mark.parametrize("sizes", [{}, {"chunk_chars": 100, "overlap_chars": 30}, {"chunk_chars": 100, "overlap_chars": 30, "local_chars": 200}])
def test_bpe(spark, odd, sizes):
    path = __import__("public_tokenizers").path(bpe.VOCABULARY)
    own = tiktoken.Encoding("test", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=bpe.encoder(path)._mergeable_ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(odd, **sizes)).collect()
    want = sorted(((str(i), np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in ODD))
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["bytes"])) for r in rows) == want


def test_licenses(spark, odd):
    assert licenses.evaluate("(MIT OR GPL-2.0-only) AND Apache-2.0 */") == (frozenset({"mit", "gpl", "apache"}), True)
    assert licenses.evaluate("MIT AND GPL-3.0-or-later")[1] is False and licenses.evaluate("AND") is None
    text = "Under the MIT License; the mit-license.\nSPDX-License-Identifier: BSD-3-Clause OR GPL-2.0 WITH Classpath-exception-2.0"
    n, base, first, last, own, labels, score, permissive = licenses.scan_text(text.encode())
    assert (base, first, last, own, labels, permissive) == (2, 2, 5, "mit", "bsd,gpl,mit", True) and 0 < score <= 1
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_text(b"")[:6] == (0, 0, None, None, "", "")


def test_license_base(spark):
    """The base columns against SQL over a whole table."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = licenses.op7_licenses(spark, sf).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select {', '.join(columns)} from ({licenses.base_sql()})").fetchall()) and any(r["n_base"] for r in got)


def test_fingerprints(spark, docs):
    """Majority bits of the shingles' XXH64, one text at a time."""
    rows = docs.limit(150).collect() + [Row(doc_id=-1, text="a b"), Row(doc_id=-2, text="A\tb c\x0bd d d d")]
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")).collect()}
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[r["doc_id"]] & (2**64 - 1) == fp


def test_empty_tables(spark, docs, odd):
    """No rows in, no rows out, and nothing learned from nothing."""
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.scan(spark, none, bench).count() == 0 and decontam.remove_spans(spark, none, bench).count() == 0
    assert bpe.decode(bpe.encode(none)).count() == 0 and licenses.scan_licenses(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and similar.keep_one(none).count() == 0
    model = pii.train(none)
    assert pii.find(spark, none, model).count() == 0 and pii.find(spark, odd, model).count() == len(ODD)
    for module, score in ((toxicity, toxicity.score_toxicity), (quality, quality.score_quality)):
        assert score(spark, none, module.train(none, labels)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(spark, vectors, F.lit(True)).count() == 0
    pages, entries = spark.createDataFrame([], "page_id long, url string, fetched int"), spark.createDataFrame([], "list string, pattern string, action string, at int")
    some = spark.createDataFrame([(1, "http://a.b/" + "x" * 100_000, 1)], pages.schema).withColumn("salt", F.lit(0)).withColumn("list", F.lit("l"))
    assert urlfilter.filter_urls(pages, entries).count() == 0 and [r["blocked"] for r in urlfilter.filter_urls(some, entries).collect()] == [False]


def test_stages_on_odd_rows(spark, odd):
    """Every stage but the last gives rows of the same columns, with values as they came; the last one row for each."""
    known = odd.withColumn("lang", F.when(F.col("doc_id") != 7, "en"))
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, known, sf)
        assert out.columns == known.columns, name
        assert {(r["score"], r["row"], r["k"], r["fp"], r["_row"]) for r in out.collect()} <= {("?", 0, 0, 0, 0)}, name
        assert stage(spark, known.limit(0), sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, known, sf).count() == len(ODD)
    trees = langid.train(known.filter("doc_id = 5"))
    assert langid.keep_known(spark, known.drop("lang"), trees).count() > 0


def reached(prints):
    """Brute force: components of all pairs of at most two differing bits."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                root[find(b)] = find(a)
    groups = {}
    for p in prints:
        groups.setdefault(find(p), set()).add(p)
    return {frozenset(g) for g in groups.values()}


def test_simhash_links(spark):
    """Short and long posting lists: a tight cloud of prints, far more than LONG_LIST in a list, beside random ones."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(-(2**62), 2**62))
    cloud = {centre}
    while len(cloud) < 300:
        p = centre
        for b in rng.integers(0, 40, rng.integers(1, 5)).tolist():
            p ^= 1 << b
        cloud.add(p)
    prints = sorted(cloud | set(rng.integers(-(2**62), 2**62, 100).tolist()) | {0, 1, 3, -1, -(2**63)})
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(got.get(p, p), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == reached(prints)


def test_simhash_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {(0, 1)} and len(by[5]) == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_similar(spark, odd):
    """Against all pairs: a group longer than a list, near copies of 1 to 9 changed words, texts that share a long passage only."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts, base, passage = [word(150) for _ in range(40)], word(300), word(60)
    for t in texts[:30]:
        copy = list(t)
        for i in rng.integers(0, len(t), rng.integers(1, 10)):
            copy[i] = "x"
        texts.append(copy)
    for i in range(90):
        texts.append([*base[:i], "changed", *base[i + 1 :]])
    texts += [word(15) + passage + word(15) for _ in range(90)]
    texts = [" ".join(t) for t in texts]
    rows = similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    group = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(texts) == len(group)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    for a in range(len(texts)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert j < 0.87 or group[a] == group[b]
            assert j > 0.7 or group[a] != group[b]
    assert len({group[i] for i in range(70, 160)}) == 1
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 5").count() == 1 and kept.filter("doc_id in (1, 2, 3)").count() == 1
    assert similar.near_duplicates(odd).count() == len(ODD) and similar.near_duplicates(odd.limit(0)).count() == 0


def test_similar_exact(spark):
    """Pairs about the threshold: grouped by the similarity of their shingles, on either side of 0.8; and groups of many such pairs."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    texts = []
    for i in range(200):
        own = word(204)
        texts += [own, [*own[: 181 + i % 4 * 2], *word(23 - i % 4 * 2)]]
    base = word(204)
    texts += [[*base[:184], *word(20)] for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    group = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8 for i in range(0, 400, 2)]
    assert 50 <= sum(near) <= 150
    assert all((group[2 * i + 1] == 2 * i) == same for i, same in enumerate(near))
    assert len({group[i] for i in range(400, 430)}) == (1 if len(sets[400] & sets[401]) / len(sets[400] | sets[401]) >= 0.8 else 30)


def test_similar_fingerprints():
    """The near-dedup stage's fingerprints are SimHash: majority bits of the different shingles, which differ by the angle between two sets (least hashes would differ in 10 % of their bits at 0.8)."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**64, 900, np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**64, 100, np.uint64)])
    texts = [a, b, a[:1], a[:2], a[:0], np.concatenate([a[:5], a[:4], a[:1]]), a[:5]]
    got = similar.sketch(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    bits = np.unpackbits(got, axis=1)
    differ = (bits[0] != bits[1]).mean()
    assert abs(differ - np.arccos(800 / 900) / np.pi) < 0.03
    assert (got[5] == got[6]).all() and not got[4].any()
    for t, row in zip(texts, bits, strict=True):
        each = [np.unpackbits(similar.wide(np.array([h], np.uint64))[0]) for h in set(t.tolist())]
        assert row.tolist() == [int(2 * sum(int(e[i]) for e in each) > len(each)) for i in range(8 * similar.POSITIONS)]


def test_similar_rows(spark):
    """Different texts of one or no doc_id are documents of their own; a copy without doc_id goes."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (2, texts[4]), (3, texts[3])]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([rows[i] for i in (0, 2, 3, 4, 5)], "doc_id long, text string").collect()))


def test_similar_hub(spark):
    """One list of 12 sketches: 0 matches 1, and 1 matches 2, which 0 does not; the others match none."""
    rng = np.random.default_rng(4)
    x = rng.integers(1, 255, (12, similar.POSITIONS)).astype(np.uint8)
    x[1:3] = x[0]
    x[1:3, 6:120:6] += 1
    x[1:3, 200:237] += 1
    x[2, 7:120:6] += 1
    x[2, 120:157] += 1
    x[:, :6] = 7
    assert (x[0] == x[1]).sum() == (x[1] == x[2]).sum() == 200 and (x[0] == x[2]).sum() == 144
    nodes = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "node long, sketch binary")
    assert {(r["node"], r["root"]) for r in similar.roots(nodes).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_similar_long_lists(spark, monkeypatch):
    """Pairs of 0.88 among 600 texts that share a passage, thus meet in long lists, and pairs of long lists dealt over several blocks."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    passage, texts = word(250), []
    for _ in range(300):
        own = word(60)
        texts += [[*passage, *own, *word(20)], [*passage, *own, *word(20)]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for block, side in ((similar.BLOCK, similar.SIDE), (8, 6)):
        monkeypatch.setattr(similar, "BLOCK", block)
        monkeypatch.setattr(similar, "SIDE", side)
        group = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
        assert group == {i: i - i % 2 for i in range(600)}


@pytest.mark.parametrize("cluster", [similar.LISTS * 64, 8])
def test_similar_large_group(spark, monkeypatch, cluster):
    """One group of near copies of similarities from 0.4 up, against all pairs, compared as a cluster or list by list. As a cluster, a member is returned a few times, not once by list."""
    rng = np.random.default_rng(11)
    base, rows, matching = [f"w{x}" for x in rng.integers(0, 5000, 150)], [], similar.matching
    texts = [[*base] for _ in range(240)]
    for t in texts:
        for i in rng.integers(0, len(t), rng.integers(0, 9)):
            t[i] = f"x{rng.integers(0, 10**6)}"
    texts = [" ".join(t) for t in texts]

    def counted(*args):
        rows.append((out := similar.saved(matching(*args))).count())
        return out

    monkeypatch.setattr(similar, "matching", counted)
    monkeypatch.setattr(similar, "CLUSTER", cluster, raising=False)
    got = similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    shingles, group = similar.Shingles(texts, 5), list(range(len(texts)))
    x = np.stack([similar.sketch(shingles.of(i), np.array([0, len(shingles.of(i))]))[0] for i in group])
    bits = np.bitwise_count(x[:, None] ^ x).sum(2, dtype=np.int64)
    for a in range(len(texts)):
        for b in range(a):
            if bits[a, b] <= similar.SURE or bits[a, b] <= similar.FAR and shingles.similar(a, b):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(group))
    assert 20 < len(set(group)) < 200
    assert cluster == 8 or sum(rows) < 12 * len(texts)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y", "1.2.3.4.5 300.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713+44 20 7946 0958 +12", "@a.b .@a.b.c", "9" * 30 + ".1.1.1", ""])
def test_base_rules(text):
    keep = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)), "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    assert pii.base_spans(text) == [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if keep[k](m[0])]


def test_crf_gradients():
    rng = np.random.default_rng(2)
    emit, moves, gold = rng.normal(size=(4, 2, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS)), rng.integers(0, pii.TAGS, (4, 2))
    _, d_emit, d_moves = pii.crf_gradients(emit, moves, gold)
    for target, grad, at in ((emit, d_emit, (1, 0, 2)), (moves, d_moves, (1, 2))):
        target[at] += 1e-5
        up = pii.crf_gradients(emit, moves, gold)[0]
        target[at] -= 2e-5
        down = pii.crf_gradients(emit, moves, gold)[0]
        target[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_pii_windows():
    """Spans of the windows that are run, from anchors on, against those of all windows; long spans run far from their anchors."""
    rng = np.random.default_rng(5)
    filler = "some plain words of no account, "
    texts = [filler * 9, filler + "x" * 5 + "9" + "y" * 200 + " end " + filler * 3, filler * 2 + "a" * 150 + "@" + "b" * 120 + ".org " + filler, "", "1", filler * 5 + "key " + "ab" * 50 + "1234" + "cd" * 60]
    texts += ["".join(rng.choice(list("ab1@. Z"), 700, p=[0.4, 0.3, 0.02, 0.01, 0.02, 0.05, 0.2])) for _ in range(20)]
    # an untrained network tags at random, so runs of all kinds reach over many windows
    for seed in range(4):
        made = np.random.default_rng(seed)
        model = pii.fresh(made)
        model.moves += 3 * np.eye(pii.TAGS)
        model.out *= 5
        coded = [pii.classes_of(t) for t in texts]
        few, full = pii.tags_of(model, coded), pii.tags_of(model, coded, everywhere=True)
        for p, a, b in zip(coded, few, full, strict=True):
            runs = np.cumsum(np.concatenate([[0], np.diff(b) != 0])) if len(b) else np.zeros(0, int)
            for r in np.unique(runs[(p == 2) | (p == 9)]):
                at = np.flatnonzero(runs == r)
                around = np.arange(max(0, at[0] - 1), min(len(b), at[-1] + 2)) if b[at[0]] else at[:0]
                assert (a[around] == b[around]).all()
        assert pii.decode_spans(model, texts) == pii.decode_spans(model, texts, everywhere=True)


def test_pii(spark, docs, odd, monkeypatch):
    model = pii.train(docs, 200)
    rows = {r["doc_id"]: r for r in pii.find(spark, docs.limit(300), model).collect()}
    for r in docs.limit(300).collect():
        base = pii.base_spans(r["text"])
        assert rows[r["doc_id"]]["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(filter(None, rows[r["doc_id"]]["spans"].split(",")))
    assert pii.find(spark, odd, model).count() == len(ODD)
    text = "Write to jo.34@mail7.example.com or +1 (017) 555-7713 now."
    one = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert {r["text"] for r in pii.redact(spark, one, model).collect()} == {"Write to <EMAIL> or <PHONE> now.", None}


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"] and corpus_pipeline.ORACLE_SQL is None
