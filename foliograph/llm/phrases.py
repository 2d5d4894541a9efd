"""Phrase collocations by Rabin-Karp fingerprints.

Prefix polynomials give every n-gram of a text a 64-bit fingerprint. Phrases are found by length: an n-gram of k words is
counted only if both of the k - 1 words in it are frequent, which is looked up in a bitmap of fixed size; a bit set by another
phrase costs a row, no result. Tasks add up equal fingerprints before the shuffle, which adds up those of the tasks.

Then each task looks once more at its texts: occurrences of frequent fingerprints are grouped, each is compared with the one that
its group points to, word by word as bytes, and only the phrases pointed to are written out. The last shuffle adds up phrases, not
fingerprints, so counts are exact whatever collides, and infrequent phrases never leave the tasks as text (but for set bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.llm.common import LOWER, byte_set, row_of_batch, span_hashes, table, text_blocks, weighted, word_places
from foliograph.llm.graph import saved

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Bits of the bitmap of frequent fingerprints, as a power of 2: 16 MB in the driver and in each Python worker, whatever the input.
BITS = 27
#: Fingerprints that a task holds before it adds up equal ones, and distinct ones that it holds before it hands them on.
HELD, DISTINCT = 1 << 19, 1 << 19
#: Bytes of text that are hashed at once, and in which equal occurrences are grouped before they are written out.
GROUPED_BYTES = 1 << 19
#: A-Z in lower case, a tab as a blank: words stand joined as they are found.
PLAIN = LOWER.copy()
PLAIN[9] = 32
STOPS = byte_set((0x0A, 0x0D), *((b, b) for b in b".,;:!?"))
IN_WORD = ~STOPS & ~byte_set((9, 9), (32, 32))


class Block:
    """The words of some texts: starts, ends, fingerprints, and pieces, within which phrases lie. Fingerprints of different languages differ."""

    def __init__(self, data: np.ndarray, at: np.ndarray, seeds: np.ndarray):
        self.data = PLAIN[data]
        self.starts, self.ends, cuts = word_places(self.data, at, IN_WORD)
        self.counts = np.diff(cuts)
        self.text = np.repeat(np.arange(len(at) - 1), self.counts)
        self.piece = np.cumsum(STOPS[self.data])[self.starts] + self.text if len(self.starts) else self.starts
        self.words = span_hashes(weighted(self.data), self.starts, self.ends)
        self.sums, self.seeds = weighted(self.words), seeds

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of the phrases of k words."""
        first = np.arange(max(0, len(self.words) - k + 1))
        first = first[self.piece[first] == self.piece[first + k - 1]]
        h = span_hashes(self.sums, first, first + k) ^ self.seeds[self.text[first]]
        h *= np.uint64(0x9FB21C651E98DF25)
        return first, h ^ (h >> np.uint64(28))

    def known(self, k: int, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """grams(k) whose first and last k - 1 words are both in the bitmap."""
        first, h = self.grams(k)
        if k == 1:
            return first, h
        shorter, own = self.grams(k - 1)
        frequent = np.zeros(len(self.words), bool)
        frequent[shorter[bits.has(own)]] = True
        both = frequent[first] & frequent[first + 1]
        return first[both], h[both]


class Bits:
    """A set of fingerprints, with others that share their bits."""

    def __init__(self, power: int = BITS):
        self.shift, self.bytes, self.grew = np.uint64(64 - power), np.zeros(1 << (power - 3), np.uint8), False

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.shift
        return (self.bytes[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def add(self, power: int, frequent: DataFrame) -> Bits:
        """With the fingerprints (column h) of a table: Spark makes the bitmap in chunks of 4 KB, of which only as many come here as it has."""
        slot = F.shiftrightunsigned("h", 64 - power)
        chunks = frequent.select(F.shiftright(slot, 15).alias("chunk"), slot.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
        out, held = Bits(power), np.zeros(max(len(self.bytes), 4096), np.uint8)
        for chunk, bits in chunks.collect():
            held[chunk * 4096 : (chunk + 1) * 4096] = np.frombuffer(bits, np.uint8)
        out.grew = bool(held.any())
        out.bytes = self.bytes | held[: len(self.bytes)]
        return out


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], Block]]:
    for rows, data, at in text_blocks(batches, most=most):
        langs = row_of_batch(rows, "lang").to_pylist()
        seed = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
        yield langs, Block(data, at, np.array([seed[x] for x in langs], np.uint64))


def added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
    return h[heads], np.add.reduceat(n, heads) if len(heads) else n


def frequent(documents: DataFrame, k: int, bits, least: int) -> DataFrame:
    """h: fingerprints of k words that occur `least` times or more."""

    def count(batches: Iterator[pa.RecordBatch]):
        known, fresh, n_fresh = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        row = lambda x: pa.record_batch([pa.array(x[0].view(np.int64)), pa.array(x[1])], ["h", "n"])
        for _, block in blocks(batches, GROUPED_BYTES):
            fresh.append(block.known(k, bits.value)[1])
            n_fresh += len(fresh[-1])
            if n_fresh > HELD:
                h, n = np.unique(np.concatenate(fresh), return_counts=True)
                known = added(np.concatenate([known[0], h]), np.concatenate([known[1], n]))
                fresh, n_fresh = [], 0
                if len(known[0]) > DISTINCT:
                    yield row(known)
                    known = known[0][:0], known[1][:0]
        h, n = np.unique(np.concatenate([*fresh, known[0][:0]]), return_counts=True)
        yield row(added(np.concatenate([known[0], h]), np.concatenate([known[1], n])))

    rows = documents.mapInArrow(count, "h long, n long")
    return rows.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h")


def word_ids(block: Block) -> np.ndarray:
    """A number by word of a block, the same for words of the same bytes only: words of one fingerprint are compared with the first of them."""
    _, first, of = np.unique(block.words, return_index=True, return_inverse=True)
    head, sizes = first[of], block.ends - block.starts
    alike = sizes == sizes[head]
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    here = np.minimum(np.repeat(block.starts[head], sizes) + at, max(len(block.data) - 1, 0))
    differs = block.data[np.repeat(block.starts, sizes) + at] != block.data[here]
    alike &= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[differs], minlength=len(sizes)) == 0
    if alike.all():
        return of
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(block.data[a:b].tobytes(), len(numbers)) for a, b in zip(block.starts, block.ends, strict=True)], np.int64)


def grouped(ids: np.ndarray, first: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, count) of the different phrases among occurrences: groups of a fingerprint, each occurrence compared with the one that its group points to; what differs makes groups of its own."""
    heads, counts = [], []
    while len(first):
        _, head, of = np.unique(h, return_index=True, return_inverse=True)
        same = np.ones(len(first), bool)
        for j in range(k):
            same &= ids[first + j] == ids[first[head][of] + j]
        heads.append(first[head])
        counts.append(np.bincount(of[same], minlength=len(head)))
        first, h = first[~same], h[~same]
    none = np.zeros(0, np.int64)
    return np.concatenate([*heads, none]), np.concatenate([*counts, none])


def spelt(block: Block, first: np.ndarray, k: int) -> list[bytes]:
    """The words of phrases, space-joined."""
    text, a, b = block.data.tobytes(), block.starts[first], block.ends[first + k - 1]
    lengths = sum((block.ends[first + j] - block.starts[first + j] for j in range(k)), np.int64(k - 1))
    out = [text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    for i in np.flatnonzero(b - a != lengths).tolist():
        out[i] = b" ".join(out[i].split())
    return out


def written(documents: DataFrame, bits, longest: int) -> DataFrame:
    """lang, k, phrase, n: phrases whose fingerprints are in the bitmap, with their occurrences in some block of texts; and for each language all its words, with k = 0 and no phrase."""

    def look(batches: Iterator[pa.RecordBatch]):
        for langs, block in blocks(batches, GROUPED_BYTES):
            lang, kinds, phrases, n = [], [], [], []
            if len(block.words):
                ids = word_ids(block)
                for k in range(1, longest + 1):
                    first, h = block.known(k, bits.value)
                    kept = bits.value.has(h)
                    heads, counts = grouped(ids, first[kept], h[kept], k)
                    phrases += spelt(block, heads, k)
                    lang += [langs[i] for i in block.text[heads].tolist()]
                    kinds.append(np.full(len(heads), k))
                    n.append(counts)
            all_words: dict[str, int] = {}
            for x, own in zip(langs, block.counts.tolist(), strict=True):
                all_words[x] = all_words.get(x, 0) + own
            columns = [pa.array([*lang, *all_words], pa.string()), pa.array(np.concatenate([*kinds, np.zeros(len(all_words), np.int64)]), pa.int32()), pa.array([*phrases, *[None] * len(all_words)], pa.binary()).cast(pa.string()), pa.array(np.concatenate([*n, list(all_words.values())]).astype(np.int64))]
            yield pa.record_batch(columns, ["lang", "k", "phrase", "n"])

    return documents.mapInArrow(look, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def counts(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, power: int = BITS) -> DataFrame:
    """lang, k, phrase, n: the exact number of occurrences, within pieces, of every phrase of 1 to `longest` words that has `least` or more; k = 0: all words of a language (phrase null).

    Words are what stands between blanks and tabs with A-Z in lower case; pieces end at . , ; : ! ? and line breaks. A null text is empty, a null lang is `und`.
    Repeated rows count as often as they occur. Other columns are not read. An empty table gives none.
    """
    context = documents.sparkSession.sparkContext
    rows = documents.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    bits = Bits(power)
    for k in range(1, longest + 1):
        shared = context.broadcast(bits)
        bits = bits.add(power, frequent(rows, k, shared, least))
        shared.unpersist()
        if not bits.grew:
            break
    return saved(written(rows, context.broadcast(bits), longest).filter((F.col("k") == 0) | (F.col("n") >= least)))


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score: each phrase of two words and more of counts() with the cut of least score, the shortest first part among those."""
    part = lambda at, size: F.array_join(F.slice(F.split("phrase", " "), at, size), " ")
    phrases, totals = found.filter("k > 0"), found.filter("k = 0").select("lang", F.col("n").alias("n"))
    cuts = phrases.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", part(F.lit(1), F.col("cut"))).withColumn("rest", part(F.col("cut") + 1, F.col("k"))).drop("k")
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({big('a')} * {big('n')} * 1000) div ({big('l')} * {big('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def whole(found: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase of the phrases of two words and more that don't lie inside a longer one which has `share` percent of their occurrences or more."""
    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = found.filter("k > 2").select("lang", "n", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return found.filter("k > 1").join(longer, ["lang", "phrase"], "left").filter((F.col("longer").isNull()) | (100 * F.col("longer") < share * F.col("n"))).select("lang", "phrase")


def collocations(documents: DataFrame, first: int = FIRST, longest: int = LONGEST, least: int = LEAST, power: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases, see counts(), scored() and whole()."""
    found = counts(documents, longest, least, power)
    best = scored(found).join(whole(found), ["lang", "phrase"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM c, range(1, 5) u(cut) WHERE cut < k),
s AS (SELECT cuts.*, x.n AS l, y.n AS r, t.n, CAST((CAST(1000 AS HUGEINT) * a * CAST(t.n AS HUGEINT)) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.head JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest JOIN t ON t.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND len(c.w) > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b ANTI JOIN d USING (lang, phrase) QUALIFY rank <= 2000
"""
