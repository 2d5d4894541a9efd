"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of up to chunk_chars characters is one chunk. A longer one is cut into chunks that overlap,
each pre-tokenised from its own start: of a text of up to local_chars in the task that has read it,
of a longer one dealt over the tasks. Two neighbours that have a pre-token boundary in common agree from there
on, as a match depends on nothing before it; so they are stitched at the first common boundary,
each task encodes its piece from seam to seam, and the ids are put together in order. Seams are
found from the boundaries in the overlaps alone; texts of chunks don't meet again. A text in
which two neighbours find no common boundary (one pre-token over the whole overlap) is encoded as
a whole instead. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import row_of_batch, table, text_blocks
from foliograph.llm.graph import saved

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS, OVERLAP_CHARS, LOCAL_CHARS = 1 << 13, 256, 1 << 16
#: Characters before the end of a cut text in which a boundary may still move: a contraction has three, and one looks ahead by one.
UNSURE = 4


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    """One of a worker process, from the rank file at a path that every executor has."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(re.sub(r"\W", "_", path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def token_bytes(path: str) -> dict[int, bytes]:
    own = encoder(path)
    return {i: own.decode_single_token_bytes(i) for i in own._mergeable_ranks.values()}


def encode_text(path: str, text: str) -> bytes:
    """Ids of a text's pre-tokens as little-endian unsigned 32-bit integers."""
    return np.asarray(encoder(path).encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()


def boundaries(text: str, last: bool) -> list[int]:
    """Where pre-tokens of a chunk begin or end, but for those that its cut end may have made."""
    pattern = regex.compile(public_tokenizers.PATTERN)
    found = [0, *(m.end() for m in pattern.finditer(text))]
    return found if last else [p for p in found if p <= len(text) - UNSURE]


def overlap_ends(text: str, k: int, last: bool, chunk_chars: int, overlap_chars: int) -> tuple[list[int], list[int]]:
    """Boundaries of chunk k in its overlaps with the chunk before and the one behind, counted from the whole text's start."""
    start = k * chunk_chars
    found = [start + p for p in boundaries(text, last)]
    return [p for p in found if p <= start + overlap_chars], [p for p in found if p >= start + chunk_chars]


def encode_chunks(path: str, text: str, chunk_chars: int, overlap_chars: int) -> bytes:
    """Ids of one text by its chunks: pieces from seam to seam, or the whole if two neighbours have no boundary in common."""
    n = -(-len(text) // chunk_chars)
    if n < 2:
        return encode_text(path, text)
    ends = [overlap_ends(text[k * chunk_chars : (k + 1) * chunk_chars + overlap_chars], k, k == n - 1, chunk_chars, overlap_chars) for k in range(n)]
    common = [set(tail) & set(head) for (_, tail), (head, _) in zip(ends, ends[1:], strict=False)]
    if not all(common):
        return encode_text(path, text)
    seams = [0, *map(min, common), len(text)]
    return b"".join(encode_text(path, text[a:b]) for a, b in zip(seams, seams[1:], strict=False))


def encode(documents: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, local_chars: int = LOCAL_CHARS) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit token ids) of every row's whole text, without special tokens.

    Null and empty texts have no ids. Repeated rows each get their row; other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def local(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            ids = [encode_chunks(path, data[a:b].tobytes().decode(), chunk_chars, overlap_chars) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([row_of_batch(rows, "doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    short = docs.filter(F.length("text") <= local_chars).mapInArrow(local, f"doc_id {kind}, ids binary")

    def cut(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                text = data[a:b].tobytes().decode()
                starts = range(0, len(text), chunk_chars)
                parts = [text[c : c + chunk_chars + overlap_chars] for c in starts]
                of = pa.array(np.full(len(starts), i))
                yield pa.record_batch([row_of_batch(rows, "row").take(of), row_of_batch(rows, "doc_id").take(of), pa.array(range(len(starts)), pa.int32()), pa.array(np.arange(len(starts)) == len(starts) - 1), pa.array(parts)], ["row", "doc_id", "k", "last", "text"])

    long = docs.filter(F.length("text") > local_chars).withColumn("row", F.monotonically_increasing_id())
    # written once: the rows' numbers have to be the same for all that follows
    chunks = saved(long.mapInArrow(cut, f"row long, doc_id {kind}, k int, last boolean, text string").repartition("row", "k"))

    def edges(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            k, last = row_of_batch(rows, "k").to_pylist(), row_of_batch(rows, "last").to_pylist()
            head, tail = [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                ends = overlap_ends(data[a:b].tobytes().decode(), k[i], last[i], chunk_chars, overlap_chars)
                head.append(ends[0])
                tail.append(ends[1])
            yield pa.record_batch([*(row_of_batch(rows, c) for c in ("row", "k", "last")), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], ["row", "k", "last", "head", "tail"])

    order = Window.partitionBy("row").orderBy("k")
    seams = chunks.select("row", "k", "last", "text").mapInArrow(edges, "row long, k int, last boolean, head array<int>, tail array<int>")
    seams = seams.select("row", "k", "last", F.array_min(F.array_intersect("tail", F.lead("head").over(order))).alias("next"))
    seams = saved(
        seams.withColumn("begin", F.coalesce(F.lag("next").over(order), F.lit(0)))
        .withColumn("stitched", F.min(F.col("last") | F.col("next").isNotNull()).over(Window.partitionBy("row")))
    )
    start = F.col("k") * chunk_chars
    own = F.when(F.col("last"), F.substring("text", F.col("begin") - start + 1, F.length("text"))).otherwise(F.substring("text", F.col("begin") - start + 1, F.col("next") - F.col("begin")))
    # of a text without a seam somewhere the chunks' own parts go on, without the overlap
    piece = F.when(F.col("stitched"), own).otherwise(F.substring("text", 1, chunk_chars))
    pieces = chunks.drop("last").join(seams, ["row", "k"]).select("row", "doc_id", "k", "stitched", piece.alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            stitched = row_of_batch(rows, "stitched").to_pylist()
            raw = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            ids = [encode_text(path, x.decode()) if done else x for x, done in zip(raw, stitched, strict=True)]
            yield pa.record_batch([*(row_of_batch(rows, c) for c in ("row", "doc_id", "k", "stitched")), pa.array(ids, pa.binary())], ["row", "doc_id", "k", "stitched", "part"])

    def put_together(batches: Iterator[pa.RecordBatch]):
        """Rows of one text lie together: ids of stitched pieces, or the bytes of a whole text, which is encoded here."""
        held, of, doc, done = [], None, None, True

        def out():
            whole = b"".join(held)
            return pa.record_batch([pa.array([doc], doc_type), pa.array([whole if done else encode_text(path, whole.decode())], pa.binary())], ["doc_id", "ids"])

        for batch in batches:
            doc_type = row_of_batch(batch, "doc_id").type
            for row, now, stitched, part in zip(*(row_of_batch(batch, c).to_pylist() for c in ("row", "doc_id", "stitched", "part")), strict=True):
                if held and row != of:
                    yield out()
                    held = []
                of, doc, done = row, now, stitched
                held.append(part)
        if held:
            yield out()

    parts = pieces.mapInArrow(encoded, f"row long, doc_id {kind}, k int, stitched boolean, part binary")
    return short.unionByName(parts.repartition("row").sortWithinPartitions("row", "k").mapInArrow(put_together, f"doc_id {kind}, ids binary"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds bytes, the concatenated raw bytes of the ids, which are the text's UTF-8 if the ids are whole. Null ids give empty bytes; an id that the vocabulary lacks raises KeyError."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        of = token_bytes(path).__getitem__
        for batch in batches:
            ids = row_of_batch(batch, "ids")
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [b"".join(map(of, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else b"" for x in ids[i : i + 256]]
                yield pa.record_batch([row_of_batch(part, "doc_id"), row_of_batch(part, "ids"), pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, bytes binary")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
