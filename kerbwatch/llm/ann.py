"""Operator 8: nearest neighbours by balanced posting lists and a graph over their centroids."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.llm.common import batches, bounded
from kerbwatch.session import staged

K = 20
QUERY_DIVISOR = 20
# Vectors the index is fitted on (centroids, graph, pruning); every row is indexed. Many lists take more.
FIT_ROWS, FIT_ROWS_PER_LIST = 20_000, 12
CALIBRATION_QUERIES = 200
ROWS_PER_LIST = 4_000
LEAST_LISTS, MOST_LISTS = 64, 16_384
# A vector near a border goes to several lists: at most so many, none much farther than the nearest.
# How much farther is decided by the fit, see `fit`.
REPLICAS, REPLICA_RATIOS = 4, (1.01, 1.03, 1.06, 1.15)
SHARD_ROWS = 8_192  # rows of a list that one group holds; longer lists lie in several shards
BLOCK_QUERIES = 4_096  # queries of a list that one group holds; more of them make several blocks
DEGREE = 16  # edges of a centroid in the graph
LEAST_EXPANDED = 24  # centroids a graph search looks at before it may stop
WANTED = 0.96  # share of true neighbours the pruning is calibrated to reach on the fit sample
AT_ONCE = 1 << 21  # distances held at once


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # one dimension more than the vectors, see `lifted`
    graph: list[np.ndarray]
    norm: float
    ratio: float
    replica_ratio: float


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component that brings each to length `norm`.

    The largest inner product with a query (lifted by a zero) is then the least distance to it.
    """
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def lifted_queries(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Queries brought to length `norm`, which changes no ranking, and lifted by a zero."""
    scaled = vectors * (norm / np.sqrt((vectors * vectors).sum(axis=1)))[:, None]
    return np.concatenate((scaled, np.zeros((len(vectors), 1))), axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def blocks_of(rows: int, lists: int) -> Iterator[slice]:
    """Ranges of rows whose distances to all lists are few enough to be held at once."""
    step = max(1, AT_ONCE // max(1, lists))
    return (slice(lo, lo + step) for lo in range(0, rows, step))


def balanced_centroids(points: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means whose crowded clusters push points away, so that lists come out of like length."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), lists, replace=len(points) < lists)].copy()
    price = np.zeros(lists)
    for _ in range(rounds):
        counts, sums, least = np.zeros(lists, np.int64), np.zeros_like(centroids), 0.0
        for some in blocks_of(len(points), lists):
            away = distances(points[some], centroids)
            nearest = (away + price).argmin(axis=1)
            counts += np.bincount(nearest, minlength=lists)
            np.add.at(sums, nearest, points[some])
            least += away.min(axis=1).sum()
        price += 0.02 * least / len(points) * (counts / (len(points) / lists) - 1)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    return centroids


def centroid_graph(centroids: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Neighbours of each centroid: the nearest ones, those it is near to, and a ring through all."""
    n = len(centroids)
    edges: list[set[int]] = [{(i + 1) % n, (i - 1) % n} for i in range(n)]
    few = min(degree + 1, n)
    for some in blocks_of(n, n):
        away = distances(centroids[some], centroids)
        for i, near in enumerate(np.argpartition(away, few - 1, axis=1)[:, :few].tolist(), some.start):
            for j in near:
                edges[i].add(j)
                edges[j].add(i)
    return [np.array(sorted(e - {i}), np.int64) for i, e in enumerate(edges)]


def probed(index: Index, query: np.ndarray) -> np.ndarray:
    """Lists whose centroid is at most `ratio` times as far as the nearest, by best-first search."""
    centroids, graph = index.centroids, index.graph
    first = float(np.sqrt(((centroids[0] - query) ** 2).sum()))
    seen = np.zeros(len(centroids), bool)
    seen[0] = True
    away = np.full(len(centroids), np.inf)
    away[0] = best = first
    waiting = [(first, 0)]
    expanded = 0
    while waiting:
        d, c = heapq.heappop(waiting)
        if expanded >= LEAST_EXPANDED and d > index.ratio * best:
            break
        expanded += 1
        new = graph[c][~seen[graph[c]]]
        if not len(new):
            continue
        seen[new] = True
        away[new] = np.sqrt(((centroids[new] - query) ** 2).sum(axis=1))
        best = min(best, float(away[new].min()))
        for j in new.tolist():
            heapq.heappush(waiting, (float(away[j]), j))
    return np.flatnonzero(away <= index.ratio * best)


def enough(found: np.ndarray, query: np.ndarray, index: Index, sizes: np.ndarray, k: int) -> np.ndarray:
    """The lists found, and the next nearest ones until they surely hold `k` others than the query.

    A vector lies in REPLICAS lists at most, so that many times as many rows are enough.
    """
    wanted = REPLICAS * (k + 1)
    if sizes[found].sum() >= wanted:
        return found
    order = np.argsort(((index.centroids - query) ** 2).sum(axis=1), kind="stable")
    order = np.concatenate((found, order[~np.isin(order, found)]))
    return order[: int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1]


def _lists_taken(points: np.ndarray, centroids: np.ndarray, replica_ratio: float) -> np.ndarray:
    """Lists of each point, REPLICAS columns, -1 where there are fewer."""
    few = min(4 * REPLICAS, len(centroids))
    taken = np.full((len(points), REPLICAS), -1)
    for some in blocks_of(len(points), max(len(centroids), 64 * points.shape[1])):
        away = distances(points[some], centroids)
        near = np.argpartition(away, few - 1, axis=1)[:, :few]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, 1), axis=1, kind="stable"), 1)
        own = taken[some]  # a view
        own[:, 0] = near[:, 0]
        rows = np.arange(len(own))
        count = np.ones(len(own), np.int64)
        least = away[rows, near[:, 0]]
        for k in range(1, few):
            c = near[:, k]
            d = away[rows, c]
            ok = (count < REPLICAS) & (d <= replica_ratio * least)
            if not ok.any():
                break
            for r in range(REPLICAS):
                between = np.sqrt(((centroids[own[:, r]] - centroids[c]) ** 2).sum(axis=1))
                ok &= (own[:, r] < 0) | (between > 0.5 * d)
            own[rows[ok], count[ok]] = c[ok]
            count[ok] += 1
    return taken


def lists_of(points: np.ndarray, centroids: np.ndarray, replica_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, list): the nearest list, and further ones across a border.

    A further list is taken if it is little farther than the nearest and the point is nearer to it
    than it is to the lists taken already, which would be searched along with it.
    """
    taken = _lists_taken(points, centroids, replica_ratio)
    point, slot = np.nonzero(taken >= 0)
    return point, taken[point, slot]


def fit(sample: np.ndarray, norm: float, lists: int, seed: int = 3) -> Index:
    """Centroids and graph of a sample, and the ratios of replication and of pruning.

    For each way to replicate, the pruning ratio is the one that finds WANTED of the sample's
    neighbours; the way that then leaves fewest rows to compare is kept. Vectors with clear clusters
    gain by replicas at the borders, vectors without any would only be compared several times.
    """
    points = lifted(sample, norm)
    centroids = balanced_centroids(points, min(lists, len(points)), seed=seed)
    graph = centroid_graph(centroids)
    rng = np.random.default_rng(seed)
    chosen = rng.choice(len(sample), min(CALIBRATION_QUERIES, len(sample)), replace=False)
    away = distances(lifted_queries(sample[chosen], norm), centroids)
    away /= np.maximum(away.min(axis=1), 1e-300)[:, None]
    products = sample[chosen] @ sample.T
    products[np.arange(len(chosen)), chosen] = -np.inf
    top = np.argsort(-products, axis=1, kind="stable")[:, : min(K, max(1, len(sample) - 1))]
    ways = []
    for replica_ratio in REPLICA_RATIOS:
        taken = _lists_taken(points, centroids, replica_ratio)
        sizes = np.bincount(taken[taken >= 0], minlength=len(centroids))
        # A neighbour is found as soon as the ratio reaches the nearest list that it lies in.
        reach = np.stack([np.where(taken[t] >= 0, a[taken[t]], np.inf).min(axis=1) for t, a in zip(top, away, strict=True)])
        ratio = float(np.quantile(reach, WANTED)) * (1 + 1e-9)
        compared = float(((away <= ratio) * sizes).sum(axis=1).mean())
        ways.append((compared, replica_ratio, ratio))
    _, replica_ratio, ratio = min(ways)
    return Index(centroids, graph, norm, ratio, replica_ratio)


def _valid(vector: Column, size: int) -> Column:
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return (F.size(vector) == size) & ~bad & F.exists(vector, lambda x: x != 0)


def _stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def neighbours(
    vectors: DataFrame,
    k: int = K,
    query_divisor: int = QUERY_DIVISOR,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of every vector whose id is divisible.

    Nearness is the largest inner product, computed in double precision on the original vectors;
    ties go to the smaller id. The index (centroids, their graph, the ratios; 2 MB for 64 dimensions
    and 4,096 lists) is fitted on a bounded sample. Every row is put into the lists it is near to, but
    of rows with equal vectors those that `k + 1` smaller ids precede can be nobody's neighbour and are
    left out. Lists that are long lie in shards of bounded size, all of which are searched. Queries
    meet the lists that the graph search and the ratio leave; lists that many queries ask meet them
    in blocks. Blocks follow the queries of a list, so rows travel in proportion to the table while
    lists do (up to MOST_LISTS).

    Vectors that are null, zero, hold a null or non-finite component, or have another size than
    most, take no part, nor do null ids. Of rows of one id the largest vector counts. With fewer
    candidates than `k` all are returned; without queries the result is empty.
    """
    spark = vectors.sparkSession
    doubles = F.col(vector_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), doubles.alias("v"))
    named = named.filter("vec_id is not null and v is not null")
    common = named.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return spark.createDataFrame([], out)
    usable = named.filter(_valid(F.col("v"), common["n"]))
    valid = staged(usable.groupBy("vec_id").agg(F.max("v").alias("v")), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    about = valid.agg(F.count("*").alias("rows"), F.max(length).alias("norm")).first()
    if not about["rows"]:
        return spark.createDataFrame([], out)
    lists = max(LEAST_LISTS, min(MOST_LISTS, about["rows"] // ROWS_PER_LIST))
    turn = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000_000))
    share = min(1.0, max(FIT_ROWS, FIT_ROWS_PER_LIST * lists) / about["rows"])
    sample = valid.filter(turn < int(1_000_000_000 * share)).select("vec_id", "v")
    rows = sorted(sample.collect() or valid.limit(FIT_ROWS).collect(), key=lambda r: (r["vec_id"], r["v"]))
    index = fit(np.array([r["v"] for r in rows], np.float64), float(about["norm"]) * (1 + 1e-12), lists)

    def assign(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            points = lifted(_stacked(batch.column("v")), index.norm)
            point, of = lists_of(points, index.centroids, index.replica_ratio)
            kept = [batch.column(c).take(pa.array(point)) for c in ("vec_id", "v")]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), *kept], ["list", "vec_id", "v"])

    def choose(batch_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batch_rows):
            queries = lifted_queries(_stacked(batch.column("v")), index.norm)
            found = [enough(probed(index, q), q, index, rows_of, k) for q in queries]
            point = np.repeat(np.arange(len(found)), [len(f) for f in found])
            kept = [batch.column(c).take(pa.array(point)) for c in ("vec_id", "v")]
            of = pa.array(np.concatenate(found), pa.int32())
            yield pa.RecordBatch.from_arrays([of, *kept], ["list", "vec_id", "v"])

    schema = "list int, vec_id bigint, v array<double>"
    # Equal vectors score alike, so of them only the smallest ids can be among the best; the first
    # of a vector that a third of all rows share are found before anything is shuffled.
    alike = W.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    first = valid.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1)
    listed = staged(bounded(first.select("vec_id", "v")).mapInArrow(assign, schema), "lists")
    rows_of = _counted(listed, len(index.centroids))
    asked = valid.filter(F.pmod("vec_id", F.lit(query_divisor)) == 0)
    sent = staged(bounded(asked).mapInArrow(choose, schema), "queries")
    asked_of = _counted(sent, len(index.centroids))
    parts = _parts_of_lists(spark, rows_of, asked_of)
    left = listed.join(parts, "list").select(
        "list",
        F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        "vec_id",
        "v",
    )
    right = sent.join(parts, "list").select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int").alias("block"),
        "vec_id",
        "v",
    )
    keys = ["list", "shard", "block"]

    def compare(_, held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if held.empty or asking.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        vectors, ids = np.stack(held["v"].to_numpy()), held["vec_id"].to_numpy(np.int64)
        order = np.lexsort((*vectors.T, ids))
        vectors, ids = vectors[order], ids[order]
        made = []
        for lo in range(0, len(asking), 256):
            some = asking.iloc[lo : lo + 256]
            products = np.stack(some["v"].to_numpy()) @ vectors.T
            for q, v, row in zip(some["vec_id"], some["v"], products, strict=True):
                made.append(best_of(int(q), np.asarray(v), row, ids, vectors, k))
        return pd.concat(made, ignore_index=True)

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        compare, "query_id bigint, vec_id bigint, score double"
    )
    # Found in several lists, with equal scores; all three steps share one exchange by query.
    nearest = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = met.withColumn("rank", F.dense_rank().over(nearest)).filter(F.col("rank") <= k)
    once = near.dropDuplicates(["query_id", "vec_id"])
    ranked = once.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _counted(listed: DataFrame, lists: int) -> np.ndarray:
    """Rows of each list: at most MOST_LISTS numbers."""
    rows = np.zeros(lists, np.int64)
    for r in listed.groupBy("list").count().collect():
        rows[r["list"]] = r["count"]
    return rows


def parts_of(rows_of: np.ndarray, asked_of: np.ndarray) -> list[tuple[int, int, int]]:
    """(list, shards of its rows, blocks of its queries) of the lists that hold rows and are asked."""
    used = np.flatnonzero((rows_of > 0) & (asked_of > 0))
    shards, blocks = -(-rows_of[used] // SHARD_ROWS), -(-asked_of[used] // BLOCK_QUERIES)
    return list(zip(used.tolist(), shards.tolist(), blocks.tolist(), strict=True))


def _parts_of_lists(spark: SparkSession, rows_of: np.ndarray, asked_of: np.ndarray) -> DataFrame:
    """The same as a table of at most MOST_LISTS short rows, to be broadcast."""
    table = spark.createDataFrame(parts_of(rows_of, asked_of), "list int, shards int, blocks int")
    return F.broadcast(table)


def best_of(
    query: int, vector: np.ndarray, rough: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> pd.DataFrame:
    """The `k` best of one group for one query, without the query itself.

    Products of a block may differ in the last bits by their place in it, so those that could be
    among the best are computed again one by one; equal vectors then get equal scores.
    """
    rough = np.where(ids == query, -np.inf, rough)
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        at = np.flatnonzero(rough >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else rough > -np.inf)
    else:
        at = np.flatnonzero(rough > -np.inf)
    score = (vectors[at] * vector).sum(axis=1)
    best = np.lexsort((ids[at], -score))[:k]
    return pd.DataFrame({"query_id": query, "vec_id": ids[at][best], "score": score[best]})
