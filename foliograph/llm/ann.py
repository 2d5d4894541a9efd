"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted by balanced k-means on a bounded sample and stay in memory; a vector goes to
the list of its nearest centroid and is replicated to further lists whose centroid is almost as
near (boundary vectors). A query searches the centroids through a neighbour graph, keeps the lists
whose distance is within a ratio of the nearest one's, and is compared with all vectors of those
lists. The ratio is calibrated on the sample, so that lists of that ratio hold TARGET_RECALL of the
true neighbours there.

Inner products are turned into distances by one more coordinate: vectors are completed to a common
length, queries get a zero. Scores are computed on the original vectors, in double precision,
coordinate by coordinate, so equal vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.llm.common import least_ids, row_of_batch, table
from foliograph.llm.graph import saved

K, QUERY_EVERY = 20, 20
#: Vectors that centroids and the ratio are fitted on (the least xxhash64(vec_id); at least so many, and SAMPLE_LIST for each list), and sample queries of the calibration.
#: A quarter of them is kept for the ratio, of so many queries (of those of the search, least hashes first); below FEW_ROWS all serve both ends.
SAMPLE_ROWS, SAMPLE_LIST, SAMPLE_QUERIES, FEW_ROWS = 20_000, 4, 400, 400
#: Vectors by list, before replicas; lists at most; replicas of a boundary vector and their distance ratio; recall that the ratio is calibrated to.
LIST_ROWS, MAX_LISTS, REPLICAS, REPLICA_RATIO, TARGET_RECALL = 256, 16_384, 4, 1.04, 0.96
DEGREE, ITERATIONS = 16, 12
#: Nearest centroids that a search of the graph expands whatever their distance, and pairs whose distances are held at once.
BEAM, BLOCK_PAIRS = 32, 1 << 14
#: Whole lists are put together to shards of so many rows; a longer list is a shard of its own, dealt over blocks of so many. Probes of a shard that one task takes.
BLOCK_ROWS, BLOCK_PROBES = 20_000, 20_000
#: Vectors that walk the graph together, and distances that are held at once while the index is fitted.
BLOCK_SEARCH, CELLS = 500, 1 << 22


@dataclass
class Index:
    centroids: np.ndarray  # (lists, dim + 1)
    graph: np.ndarray  # (lists, degree)
    norm: float  # the longest vector's square length
    ratio: float
    dim: int


def usable(column: Column) -> Column:
    """Vectors that take part: not null, not empty, not zero, without null or non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def completed(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)


def in_blocks(n: int, width: int) -> list[slice]:
    """Slices of n rows, so that a slice has CELLS distances to `width` others, about."""
    step = max(1, CELLS // max(1, width))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def balanced(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k centroids; a cluster larger than its share is made to look farther away in the next assignment, which evens the lists out."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    weight, scale, who = np.zeros(k), 0.0, np.zeros(len(x), int)
    for _ in range(ITERATIONS):
        least = np.zeros(len(x))
        for part in in_blocks(len(x), k):
            d = squares(x[part], c)
            least[part] = d.min(axis=1)
            # the scale of the last assignment; at first nothing is weighted
            who[part] = (d + weight * scale).argmin(axis=1)
        scale = np.median(least) or 1.0
        size = np.bincount(who, minlength=k)
        weight = np.clip(weight + 0.1 * (size / (len(x) / k) - 1), -0.5, 2)
        order = np.argsort(who, kind="stable")
        full = np.flatnonzero(size)
        c[full] = np.add.reduceat(x[order], (np.cumsum(size) - size)[full], axis=0) / size[full][:, None]
    used = np.zeros(k, bool)
    for part in in_blocks(len(x), k):
        used[squares(x[part], c).argmin(axis=1)] = True
    return c[used]


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each centroid's neighbours in a ring, which keep every centroid in reach, and the nearest 2 * degree of its nearest others and of those that it is near to; rows are filled up with the centroid itself."""
    k = len(c)
    near = min(degree, max(1, k - 1))
    ring = np.stack([np.arange(k), (np.arange(k) + 1) % k, np.full(k, -1.0)], axis=1)
    links = [ring, ring[:, [1, 0, 2]]]
    for part in in_blocks(k, k):
        d = squares(c[part], c)
        own = np.arange(part.start, part.stop)
        d[np.arange(len(own)), own] = np.inf
        to = d.argsort(axis=1, kind="stable")[:, :near]
        way = np.stack([np.repeat(own, near), to.ravel(), np.take_along_axis(d, to, axis=1).ravel()], axis=1)
        links += [way, way[:, [1, 0, 2]]]
    both = np.concatenate(links)
    # of two of one neighbour the nearer, the ring's before all
    both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
    both = both[np.concatenate([[True], (both[1:, :2] != both[:-1, :2]).any(axis=1)])]
    both = both[np.lexsort((both[:, 1], both[:, 2], both[:, 0]))]
    at, to = both[:, 0].astype(int), both[:, 1].astype(int)
    n = np.bincount(at, minlength=k)
    place = np.arange(len(at)) - (np.cumsum(n) - n)[at]
    graph = np.repeat(np.arange(k)[:, None], min(int(n.max()), 2 + 2 * degree), axis=1)
    kept = place < graph.shape[1]
    graph[at[kept], place[kept]] = to[kept]
    return graph


def graph_search(index: Index, q: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lists, distances) of the centroids within ratio times the nearest found, of the `least` nearest found in any case; by row, nearest first.

    Each query walks with a beam of its nearest centroids, from those of evenly spread entries on. A beam that lies within
    the ratio as a whole is doubled and walks on; so what is held grows with what is found, not with the lists.
    """
    k, rows, width = len(index.centroids), np.arange(len(q)), max(BEAM, least)
    entry = np.unique(np.linspace(0, k - 1, min(k, width + 2 * int(k**0.5))).astype(int))
    d = np.sqrt(squares(q, index.centroids[entry]))
    first = d.argsort(axis=1, kind="stable")[:, :width]
    ids, d = entry[first], np.take_along_axis(d, first, axis=1)
    found = []
    while len(rows):
        more = width - ids.shape[1]
        ids, d = np.pad(ids, ((0, 0), (0, more)), constant_values=-1), np.pad(d, ((0, 0), (0, more)), constant_values=np.inf)
        step = max(1, CELLS // (max(8, width // 4) * index.graph.shape[1]))
        for i in range(0, len(rows), step):
            walk(index, q[rows[i : i + step]], ids[i : i + step], d[i : i + step], ratio)
        within = d <= ratio * d[:, :1]
        full = within[:, -1] & (width < k)
        within[:, :least] |= np.isfinite(d[:, :least])
        r, c = np.nonzero(within & ~full[:, None])
        found.append((rows[r], ids[r, c], d[r, c]))
        rows, ids, d, width = rows[full], ids[full], d[full], 2 * width
    r, j, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (rows, rows, np.zeros(0))
    order = np.argsort(r, kind="stable")
    return r[order], j[order], d[order]


def walk(index: Index, q: np.ndarray, ids: np.ndarray, d: np.ndarray, ratio: float) -> None:
    """Expands, in place, what of the beams (nearest first, filled up with -1 and inf) is within the ratio or among the BEAM nearest, till nothing nearer comes.

    A round expands a quarter of a beam. A centroid that fell out of a beam may be met again and falls out again, so no list of those seen is kept.
    """
    width, rows, done = ids.shape[1], np.arange(len(ids)), ids < 0
    while True:
        todo = ~done[rows] & ((np.arange(width) < BEAM) | (d[rows] <= ratio * d[rows, :1]))
        todo &= np.cumsum(todo, axis=1) <= max(8, width // 4)
        going = todo.any(axis=1)
        rows, todo = rows[going], todo[going]
        if not len(rows):
            return
        r, c = np.nonzero(todo)
        done[rows[r], c] = True
        near = ragged(len(rows), r, index.graph[ids[rows[r], c]], -1).reshape(len(rows), -1)
        # a beam's own come before the same centroid met anew
        key = np.sort(np.concatenate([2 * ids[rows], 2 * near + 1], axis=1), axis=1)
        fresh = (key & 1 == 1) & (key > 0)
        fresh[:, 1:] &= key[:, 1:] >> 1 != key[:, :-1] >> 1
        r, c = np.nonzero(fresh)
        j = key[r, c] >> 1
        far = np.empty(len(j))
        for i in range(0, len(j), BLOCK_PAIRS):
            part = slice(i, i + BLOCK_PAIRS)
            gap = q[rows[r[part]]] - index.centroids[j[part]]
            far[part] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        nearer = far < d[rows[r], -1]
        r, j, far = r[nearer], j[nearer], far[nearer]
        both = np.concatenate([d[rows], ragged(len(rows), r, far, np.inf)], axis=1)
        order = both.argsort(axis=1, kind="stable")[:, :width]
        d[rows] = np.take_along_axis(both, order, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], ragged(len(rows), r, j, -1)], axis=1), order, axis=1)
        more = both.shape[1] - width
        done[rows] = np.take_along_axis(np.pad(done[rows], ((0, 0), (0, more))), order, axis=1) | (ids[rows] < 0)


def ragged(n: int, rows: np.ndarray, values: np.ndarray, fill: float) -> np.ndarray:
    """Values side by side in their rows (given in ascending order), which are filled up."""
    count = np.bincount(rows, minlength=n)
    out = np.full((n, int(count.max(initial=0)), *values.shape[1:]), fill, values.dtype)
    out[rows, np.arange(len(rows)) - (np.cumsum(count) - count)[rows]] = values
    return out


def replicas(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lists): the nearest list of every vector, and up to REPLICAS - 1 more within REPLICA_RATIO."""
    r, j, d = graph_search(index, x, REPLICA_RATIO, 1)
    n = np.bincount(r, minlength=len(x))
    first = np.arange(len(r)) - (np.cumsum(n) - n)[r] < REPLICAS
    return r[first], j[first]


def build(vectors: DataFrame, k: int = K, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, queries: Column | None = None) -> Index | None:
    """Fits the index on a bounded sample, of rows that aren't queries if there are such: a row that centroids are fitted on finds fewer lists within a ratio. The dimension is the commonest one (of equal, the larger); None if no vector can take part."""
    kinds = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not kinds:
        return None
    dim, n = kinds[0]["dim"], kinds[0]["n"]
    own = vectors.filter(F.size("embedding") == dim)
    norm = own.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]
    wanted = max(1, min(max_lists, -(-n // list_rows)))
    rows = max(SAMPLE_ROWS, SAMPLE_LIST * wanted)
    others = own if queries is None else own.filter(~F.coalesce(queries, F.lit(False)))
    asked = None
    if queries is None or others.isEmpty():
        others = own
    else:
        wants = own.filter(queries)
        asked = wants.join(F.broadcast(least_ids(wants, "vec_id", SAMPLE_QUERIES)), "vec_id").select("embedding").limit(SAMPLE_QUERIES).toArrow()
        asked = asked if asked.num_rows else None
    ids = least_ids(others, "vec_id", rows)
    sample = others.join(F.broadcast(ids), "vec_id").select("embedding").limit(rows).toArrow()
    x = completed(matrix(sample["embedding"]), norm)
    x = x[np.lexsort(x.T[::-1])]
    # rows that centroids are fitted on lie nearer to them than others do, so the ratio is taken from rows apart
    apart = np.arange(len(x)) % 4 == 3 if len(x) >= FEW_ROWS else np.ones(len(x), bool)
    fitted = x[~apart] if len(x) >= FEW_ROWS else x
    c = balanced(fitted, max(1, min(wanted, len(x) // SAMPLE_LIST)))
    index = Index(c, neighbour_graph(c), norm, 1.0, dim)
    # of the k nearest of n rows about so many are among those apart
    index.ratio = calibrated(index, x[apart], max(1, -(-k * int(apart.sum()) // n)), matrix(asked["embedding"]) if asked is not None else None)
    return index


def calibrated(index: Index, x: np.ndarray, k: int, asked: np.ndarray | None = None) -> float:
    """The ratio whose lists hold TARGET_RECALL of the sample queries' k true neighbours in the sample; without queries given, rows of the sample ask for others."""
    if len(x) < 2:
        return 1.0
    own = np.linspace(0, len(x) - 1, min(len(x), SAMPLE_QUERIES)).astype(int)
    q = np.pad(asked, ((0, 0), (0, 1))) if asked is not None else x[own].copy()
    q[:, -1] = 0
    d = np.sqrt(squares(q, index.centroids))
    parts = [(i, replicas(index, x[i : i + BLOCK_SEARCH])) for i in range(0, len(x), BLOCK_SEARCH)]
    rows, lists = np.concatenate([i + r for i, (r, _) in parts]), np.concatenate([j for _, (_, j) in parts])
    order = np.argsort(rows, kind="stable")
    lists, at = lists[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))])
    near = q @ x.T
    if asked is None:
        near[np.arange(len(q)), own] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    need = np.array([[d[i][lists[at[b] : at[b + 1]]].min() / d[i].min() for b in best[i]] for i in range(len(q))])
    return float(max(1.0, np.quantile(need, TARGET_RECALL))) * (1 + 1e-9)


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = K, index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest other rows by inner product, ties to the smaller vec_id; fewer only if there are fewer.

    Queries whose lists hold fewer than k others are compared with all rows instead, in blocks.

    vectors: vec_id and embedding; rows of other dimensions than the index's, and those that usable() rejects, take no part, neither do rows
    without vec_id. A vec_id that occurs again is one candidate (of its scores the largest counts) and one query for each different vector.
    """
    # written once: each of the steps below reads it, and none is to see a row twice
    whole = saved(vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct())
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    index = index or build(whole, k, queries=is_query)
    if index is None:
        return spark.createDataFrame([], schema)
    own = whole.filter(F.size("embedding") == index.dim)
    shared = spark.sparkContext.broadcast(index)
    item = vectors.schema["embedding"].dataType.elementType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_SEARCH):
                part = batch.slice(i, BLOCK_SEARCH)
                rows, lists = replicas(shared.value, completed(matrix(row_of_batch(part, "embedding")), shared.value.norm))
                yield pa.record_batch([pa.array(lists, pa.int32()), *(row_of_batch(part, c).take(pa.array(rows)) for c in ("vec_id", "embedding"))], ["list", "vec_id", "embedding"])

    postings = own.mapInArrow(placed, f"list int, vec_id {kind}, embedding array<{item}>")
    held = postings.groupBy("list", "vec_id").agg(F.count("*").alias("n")).groupBy("list").agg(F.sum("n").alias("n"), F.count("*").alias("ids")).collect()  # a row by list
    mean = max(1, sum(r["ids"] for r in held) // max(1, len(held)))
    least = min(len(index.centroids), 2 + REPLICAS * (k + 1) * 2 // mean)

    def probed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_SEARCH):
                part = batch.slice(i, BLOCK_SEARCH)
                x = matrix(row_of_batch(part, "embedding"))
                q = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
                rows, lists, _ = graph_search(shared.value, q, shared.value.ratio, least)
                yield pa.record_batch([pa.array(lists, pa.int32()), *(row_of_batch(part, c).take(pa.array(rows)) for c in ("vec_id", "embedding"))], ["list", "vec_id", "embedding"])

    queries = own.filter(is_query)
    probes = queries.mapInArrow(probed, f"list int, vec_id {kind}, embedding array<{item}>")
    def nearest(va, ia, vb, ib) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A list against the queries that probe it: each one's k best vec_ids, and what may tie with them in rounding."""
        order = np.argsort(ia, kind="stable")
        va, ia = va[order], ia[order]
        heads = np.flatnonzero(np.concatenate([[True], ia[1:] != ia[:-1]]))
        slack = 1e-9 * float(np.abs(va).max() * np.abs(vb).max()) * va.shape[1]
        for i in range(0, len(vb), 256):
            near = vb[i : i + 256] @ va.T
            near[ib[i : i + 256, None] == ia[None, :]] = -np.inf
            by_id = near if len(heads) == len(ia) else np.maximum.reduceat(near, heads, axis=1)
            m = min(k, len(heads))
            floor = -np.partition(-by_id, m - 1, axis=1)[:, m - 1] - slack
            r, c = np.nonzero((near >= floor[:, None]) & np.isfinite(near))
            score = np.zeros(len(r))
            for j in range(va.shape[1]):
                score += vb[i + r, j] * va[c, j]
            yield best(ib[i + r], ia[c], score)

    def best(q, v, s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best different vec_ids of every query, each with its largest score."""
        order = np.lexsort((-s, v, q))
        q, v, s = q[order], v[order], s[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, v, s = q[fresh], v[fresh], s[fresh]
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[top], v[top], s[top]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        """All lists of a shard, one after the other; each query keeps its k best of the shard."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if a.num_rows and b.num_rows:
            va, ia, la = matrix(a["embedding"]), a["vec_id"].to_numpy(), a["list"].to_numpy()
            vb, ib, lb = matrix(b["embedding"]), b["vec_id"].to_numpy(), b["list"].to_numpy()
            for j in np.intersect1d(la, lb).tolist():
                x, y = np.flatnonzero(la == j), np.flatnonzero(lb == j)
                out += nearest(va[x], ia[x], vb[y], ib[y])
        q, v, s = best(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(q, ia_type), "vec_id": pa.array(v, ia_type), "score": pa.array(s, pa.float64())})

    ia_type = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[kind]

    def matched(postings: DataFrame, sizes: dict[int, int], probes: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): of each shard of lists, the k best rows of every query that probes one of its lists."""
        asked = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
        shards, shard, filled = [], 0, 0
        for j, n in sorted(sizes.items()):
            if filled and filled + n > BLOCK_ROWS:
                shard, filled = shard + 1, 0
            filled += n
            shards.append((int(j), shard, -(-n // BLOCK_ROWS)))
        wanted: dict[int, int] = {}
        for j, own_shard, _ in shards:
            wanted[own_shard] = wanted.get(own_shard, 0) + asked.get(j, 0)
        blocks = spark.createDataFrame([(j, x, rows, max(1, -(-wanted[x] // BLOCK_PROBES))) for j, x, rows in shards if asked.get(j)] or [(-1, 0, 1, 1)], "list int, shard int, rows int, queries int")

        def dealt(df: DataFrame, own_part: str, other: str, own_name: str, other_name: str) -> DataFrame:
            """Own rows go to one block of their side, and to every block of the other's."""
            parts = df.join(F.broadcast(blocks), "list").withColumn(own_name, F.pmod(F.xxhash64("vec_id"), F.col(own_part)).cast("int"))
            return parts.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("list", "vec_id", "embedding", (F.col("shard") + F.lit(0)).alias("shard"), "r", "q")

        left = dealt(postings, "rows", "queries", "r", "q").groupBy("shard", "r", "q")
        right = dealt(probes, "queries", "rows", "q", "r").groupBy("shard", "r", "q")
        return left.cogroup(right).applyInArrow(compare, f"query_id {kind}, vec_id {kind}, score double")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    result = saved(ranked(matched(postings, {r["list"]: r["n"] for r in held}, probes)))
    full = result.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = saved(queries.join(full, "vec_id", "left_anti").select("vec_id", "embedding"))
    if short.isEmpty():
        return result
    one = F.lit(0).alias("list")
    exact = ranked(matched(own.select(one, "vec_id", "embedding"), {0: own.count()}, short.select(one, "vec_id", "embedding")))
    return result.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(exact)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


#: The exact result, which the test measures recall against.
EXACT_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
