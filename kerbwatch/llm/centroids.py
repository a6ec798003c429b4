"""Operator 12: centroid clustering of integer vectors with scalar lookup tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwatch.llm.common import batches
from kerbwatch.session import staged

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
# Integer components stay within this, so that sums of a whole table fit 38 digits.
REACH = 1 << 62
LONGEST = (1 << 63) - 1
# Rows whose distances are held at once.
_ROWS = 4096


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """`vec_id` and `v`, floor(scale * x) of every component, of the vectors that take part."""
    own = F.col(vector_col).cast("array<double>")
    finite = F.forall(own, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))

    def whole(x: Column) -> Column:
        inside = F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(REACH))), F.lit(-float(REACH)))
        return F.floor(inside).cast("bigint")

    kept = vectors.filter((F.size(own) == dimensions) & finite)
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(own, whole).alias("v"))


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of one dimension, ascending, and which of them each row has."""
    if column.dtype == object or int(column.max()) - int(column.min()) > 4 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    low = column.min()
    there = np.zeros(int(column.max() - low) + 1, bool)
    there[column - low] = True
    number = np.cumsum(there) - 1
    return np.flatnonzero(there) + low, number[column - low]


def exact_type(values: np.ndarray, centroids: np.ndarray) -> type:
    """The narrowest type that holds every distance; Python's own integers beyond 64 bits."""
    apart = max(int(values.max()), int(centroids.max())) - min(int(values.min()), int(centroids.min()))
    most = values.shape[1] * apart * apart
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (ties: the smaller) and the squared distance.

    For each dimension the squared difference of every occurring value to every centroid is put into
    a table once; a row's distances are the sum of the table rows that its values point to.
    """
    kind = exact_type(values, centroids)
    tables = []
    for d in range(values.shape[1]):
        some, at = occurring(values[:, d].astype(object) if kind is object else values[:, d])
        apart = some.astype(kind)[:, None] - centroids[:, d].astype(kind)
        tables.append((apart * apart, at))
    cluster = np.empty(len(values), np.int64)
    distance = np.empty(len(values), kind)
    for lo in range(0, len(values), _ROWS):
        hi = min(lo + _ROWS, len(values))
        total = np.zeros((hi - lo, len(centroids)), kind)
        for table, at in tables:
            total += table[at[lo:hi]]
        cluster[lo:hi] = total.argmin(axis=1)
        distance[lo:hi] = total[np.arange(hi - lo), cluster[lo:hi]]
    return cluster, distance


def _values(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dimensions)


def cluster_sums(whole: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, place, total, n) of one round's assignment: a row per centroid and dimension."""
    k, dimensions = centroids.shape

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dimensions), object)
        sizes = np.zeros(k, np.int64)
        for batch in batches(rows):
            values = _values(batch, dimensions)
            cluster, _ = nearest(values, centroids)
            order = np.argsort(cluster, kind="stable")
            named, firsts, counts = np.unique(cluster[order], return_index=True, return_counts=True)
            # Halves of 32 bits, so that no sum of a batch can overflow.
            high = np.add.reduceat(values[order] >> 32, firsts, axis=0).astype(object)
            low = np.add.reduceat(values[order] & 0xFFFFFFFF, firsts, axis=0).astype(object)
            sums[named] += (high << 32) + low
            sizes[named] += counts
        held = np.flatnonzero(sizes)
        if len(held):
            totals = [[Decimal(x) for x in sums[c].tolist()] for c in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array(sizes[held]), pa.array(totals, pa.list_(pa.decimal128(38, 0)))],
                ["cluster", "n", "sums"],
            )

    parts = whole.mapInArrow(run, "cluster int, n bigint, sums array<decimal(38,0)>")
    placed = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    return placed.groupBy("cluster", "place").agg(F.sum("part").alias("total"), F.sum("n").alias("n")).collect()


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Every centroid with rows becomes floor(sum / count) of them; the others stay."""
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    dimensions = centroids.shape[1]

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            cluster, distance = nearest(_values(batch, dimensions), centroids)
            told = pa.array([min(int(x), LONGEST) for x in distance], pa.int64()) if distance.dtype == object else pa.array(distance, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), told], ["vec_id", "cluster", "distance"]
            )

    kind = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def centroid_clusters(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = 2,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors of exactly `dimensions` components, none null or non-finite; components become
    floor(scale * x) and are written once as integers. Centroids start as the vectors with the
    smallest sha256 of `<seed>:<vec_id>`. Every round reads the integers, assigns by lookup tables
    built for each batch from the values that occur in it, and sends one partial sum per task and
    centroid to the shuffle; the driver holds centroids only, whose size the parameters fix.

    Rows that share a vec_id, and equal vectors, are rows of their own; a null vec_id is hashed as no
    digits; equal hashes go by the components. With fewer vectors than `clusters` each starts one; an
    empty table gives an empty table. Components beyond 2^62 count as that; distances and sums beyond
    a long are told as the largest long. Other columns are not read.
    """
    whole = staged(integer_vectors(vectors, id_col, vector_col, dimensions, scale), "integer-vectors")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = whole.select(F.sha2(name.cast("binary"), 256).alias("turn"), "v").orderBy("turn", "v").limit(clusters)
    start = [r["v"] for r in first.orderBy("turn", "v").collect()]
    if not start:
        return whole.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"),
        )
    centroids = np.array(start, np.int64)
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(whole, centroids))
    rows = staged(assigned(whole, centroids), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = [0] * len(centroids)
    for r in sums:
        inertia[r["cluster"]] = int(r["s"])
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array(*[F.lit(min(s, LONGEST)).cast("bigint") for s in inertia])
    return rows.select(
        "vec_id", "cluster", "distance",
        F.get(own, "cluster").alias("cluster_inertia"),
        F.lit(min(sum(inertia), LONGEST)).cast("bigint").alias("inertia"),
        F.get(F.array(*[F.lit(s) for s in shown]), "cluster").alias("centroid_sha256"),
    )


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2) -> str:
    """The same results for DuckDB."""
    apart = "list_sum(list_transform(list_zip(i.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""i AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v
  FROM i QUALIFY c < {clusters})""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT r, vec_id, i.v, c.c, CAST({apart} AS BIGINT) AS d FROM i, c{n} c
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c.c) = 1)"""
        )
        if n < rounds:
            parts.append(
                f"""s{n} AS (SELECT c, place, sum(v[place]) AS s, count(*) AS n FROM a{n}, unnest(range(1, {DIMENSIONS + 1})) AS u(place) GROUP BY c, place),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.c = c.c)"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
