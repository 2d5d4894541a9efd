"""The operators over whole groups and tables - content sort, fingerprinted phrases, prefix tries - against brute force, with odd rows and forced collisions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import exact, phrases, prefix_trie, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_trie", "op12_phrases", "op13_exact"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact(spark):
    """A group of copies over many ranges, copies in other cases, texts of one long head, nulls, repeated rows, an accent that is not lower-cased."""
    rng = random.Random(3)
    rows = [(i, "The Same Copy" if i % 3 else "the same copy") for i in range(3000)]
    rows += [(5000 + i, "h" * 100 + f" tail {i % 700}") for i in range(1500)]
    rows += [(None, None), (7, ""), (8, None), (None, "no id"), (None, "no id"), (9, "É"), (10, "é"), (11, "Z" * 200_000), (12, "z" * 200_000), (13, "same row"), (13, "same row"), (13, "other row"), (-4, " "), (None, "ab"), (-9, "AB")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", F.lit(1).alias("head"), F.lit("x").alias("sha"), F.lit(2).alias("part"), F.lit(0).alias("from"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = exact.groups(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = defaultdict(list)
    for i, text in rows:
        by[low(text)].append(i)
    want = Counter()
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["sha"].hex()) for r in got) == want
    kept = [(r["sha"].hex(), r["doc_id"], r["keep_id"]) for r in got if r["kept"]]
    assert len(kept) == len(by) == len({k[0] for k in kept}) and all(a == b for _, a, b in kept)
    once = exact.keep_one(docs)
    assert once.columns == docs.columns and {(r["doc_id"], low(r["text"])) for r in once.collect()} == {(k[1], t) for k in kept for t in by if hashlib.sha256(t.encode()).hexdigest() == k[0]} and once.count() == len(by)
    assert exact.groups(docs.limit(0)).count() == 0 and exact.keep_one(docs.limit(0)).count() == 0


def best_phrases(rows, least, first=2000, longest=5):
    """The whole rule by counting in dictionaries."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", low(text)
        for stop in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(stop, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found, out = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}, defaultdict(list)
    for (lang, p), a in found.items():
        inside = any(q != p and x == lang and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in found.items())
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if not inside:
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, rows in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:first], 1)}


def some_texts():
    rng = random.Random(5)
    words = ["a", "B", "é", "Ωmega", "the", "x-y", "\x00", " ", "日本", "1"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ".", "\n", ", "]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    return rows + [("en", None), ("en", ""), ("fr", " \t "), ("en", "a b a b a"), ("en", "a b a b a"), ("de", "?!"), ("de", "one " * 30_000)]


@pytest.mark.parametrize("power", [27, 15, 6])
def test_phrases(spark, power):
    """With bitmaps of any size, of which the smallest lets all phrases through."""
    rows = some_texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).select("*", F.lit(1).alias("h"), F.lit(2).alias("k"), F.lit("p").alias("phrase"), F.lit(3).alias("n"))
    got = {tuple(r) for r in phrases.collocations(docs, first=40, least=5, power=power).collect()}
    assert got == best_phrases(rows, 5, 40) and len({r[0] for r in got}) == 3
    assert phrases.collocations(docs.limit(0)).count() == 0 and phrases.collocations(docs.filter("lang = 'fr'")).count() == 0


def test_phrases_are_handed_on(monkeypatch):
    """What a task hands on because it holds too much adds up to the same."""
    h = np.array([3, 1, 3, 2, 1, 3], np.uint64)
    assert [x.tolist() for x in phrases.added(h, np.arange(6))] == [[1, 2, 3], [5, 3, 7]]
    assert [x.tolist() for x in phrases.added(h[:0], np.arange(0))] == [[], []]


@pytest.mark.parametrize("weak", [1, 2, 7, 1 << 40])
def test_collisions(monkeypatch, weak):
    """Fingerprints that are cut down to few values: words and phrases are told apart by their bytes."""
    hashes = phrases.span_hashes
    monkeypatch.setattr(phrases, "span_hashes", lambda *x: hashes(*x) % np.uint64(weak))
    texts = [(t or "").encode() for _, t in some_texts()[:40]]
    block = phrases.Block(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.zeros(len(texts), np.uint64))
    ids = phrases.word_ids(block)
    words = [block.data[a:b].tobytes() for a, b in zip(block.starts, block.ends, strict=True)]
    assert len(set(zip(ids.tolist(), words, strict=True))) == len(set(words)) == len(set(ids.tolist()))
    for k in (1, 2, 3):
        first, h = block.grams(k)
        heads, counts = phrases.grouped(ids, first, h, k)
        got = dict(zip(phrases.spelt(block, heads, k), counts.tolist(), strict=True))
        assert len(got) == len(heads) and got == Counter(b" ".join(words[i : i + k]) for i in first.tolist())


def nodes_of(sequences):
    """Nodes of all prefixes by dictionaries: sequences by id of (key, size) turns."""
    members = defaultdict(list)
    for c in sorted(sequences):
        keys = tuple(k for k, _ in sequences[c])
        for d in range(len(keys) + 1):
            members[keys[:d]].append(c)
    children, out = Counter(p[:-1] for p in members if p), set()
    own = {p: (len(m) - 1) * (sequences[m[0]][len(p) - 1][1] if p else 0) for p, m in members.items()}
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own[p]
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(sequences[c]) == len(p))
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie(spark):
    """Deep and hot conversations, heads taken from others, missing or short; turns without number, repeated turns, nulls, negative ids."""
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "é", "yes", None, "no way"])) for c in rng.sample(range(-12, 90), 70) for t in range(rng.randrange(1, 9))]
    rows += [(200 + i, t, "user", f"turn {t}") for i in range(120) for t in (0, 1, 2)]
    rows += [(400 + i, t, "user", "deep" if t < 37 else f"{t} {i % 2}") for i in (0, 1, 2) for t in range(75)]
    rows += [(500, None, "a", "first"), (500, None, "a", "before"), (500, 1, "b", "x"), (500, 1, "b", "x"), (None, 0, "user", "of none"), (503, 0, "user", "one of the tail")]
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).select("*", F.lit(1).alias("depth"), F.lit(2).alias("pos"), F.lit("n").alias("name"), F.lit(0).alias("size"))
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, name, (role, text), len(text.encode())))
    own = {c: [(key, size) for _, _, _, key, size in sorted(x)] for c, x in own.items()}
    sequences = {}
    for c, x in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        sequences[c] = own.get(base, [])[:h] + x[h:]
    assert any(not x for x in sequences.values())
    got = {tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(made))).collect()}
    assert got == nodes_of(sequences)
    plain = prefix_trie.turns(made)
    lengths = plain.groupBy("conv_id").agg(F.max("pos").alias("length"))
    assert {tuple(r) for r in prefix_trie.trie(plain, lengths).collect()} == nodes_of(own)
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(made.limit(0)))).count() == 0
    alone = prefix_trie.rebuilt(prefix_trie.turns(made.filter("conv_id = 503")))
    assert {tuple(r) for r in prefix_trie.trie(*alone).collect()} == nodes_of({503: [] if zlib.crc32(b"503") % 9 else own[503]})


def test_ids_in_batches():
    """A node's ids that come in several strings and batches."""
    batch = lambda *rows: prefix_trie.pa.record_batch([prefix_trie.pa.array(x) for x in zip(*rows, strict=True)], ["node", "depth", "conv_id"])
    strings = [b.rename_columns(["node", "depth", "first", "ids"]) for b in prefix_trie.joined_ids(iter([batch((1, 2, 1), (1, 2, 5)), batch((1, 2, 30), (1, 3, 7)), batch((2, 3, 7))]))]
    got = [tuple(r.values()) for b in prefix_trie.hashed_ids(iter(strings)) for r in b.to_pylist()]
    assert got == [(1, 2, hashlib.sha256(b"1,5,30").hexdigest()), (1, 3, hashlib.sha256(b"7").hexdigest()), (2, 3, hashlib.sha256(b"7").hexdigest())]
