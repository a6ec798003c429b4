"""Operator 12 against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np

from kerbwatch.llm.centroids import LONGEST, centroid_clusters, nearest


def plain(rows, clusters, rounds, dimensions):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    turn = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=turn)[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == k]
            if own:
                centroids[k] = [sum(col) // len(own) for col in zip(*own)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in found if c == k) for k in range(len(centroids))]
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    cap = lambda x: min(x, LONGEST)
    return [(i, c, cap(d), cap(inertia[c]), cap(sum(inertia)), shown[c]) for i, d, c in found]


def vectors(seed, n, dimensions, reach=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-reach, reach) for _ in range(dimensions)]) for i in range(n)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (n, None), (n + 1, [0.5] * (dimensions - 1)), (n + 2, [])]
    rows += [(n + 3, [None] + [0.1] * (dimensions - 1)), (n + 4, [math.nan] * dimensions), (n + 5, [math.inf] + [0.0] * (dimensions - 1))]
    return rows


def collected(spark, rows, **settings):
    extra = [(i, v, 1, "w", 0.5) for i, v in rows]
    kind = "vec_id long, embedding array<double>, cluster int, v string, distance double"
    frame = spark.createDataFrame(extra, kind).repartition(3)
    return sorted(map(tuple, centroid_clusters(frame, **settings).collect()), key=repr)


def test_equals_plain_loops(spark):
    for seed, n, k, d, reach in ((1, 120, 7, 6, 1.0), (2, 60, 5, 3, 1e8), (3, 40, 4, 2, 3e15)):
        rows = vectors(seed, n, d, reach)
        want = sorted(plain(rows, k, 5, d), key=repr)
        assert collected(spark, rows, clusters=k, dimensions=d) == want


def test_few_vectors_and_none(spark):
    rows = vectors(4, 8, 4)[:8]
    assert collected(spark, rows, clusters=40, dimensions=4) == sorted(plain(rows, 40, 5, 4), key=repr)
    empty = collected(spark, [(1, None)], dimensions=4)
    assert empty == []


def test_ties_go_to_the_smaller_number():
    cluster, distance = nearest(np.array([[0], [4], [2]]), np.array([[4], [0], [4]]))
    assert cluster.tolist() == [1, 0, 0] and distance.tolist() == [0, 0, 4]
    huge = np.array([[1 << 62], [-(1 << 62)]])
    cluster, distance = nearest(huge, huge[:1])
    assert [int(x) for x in distance] == [0, 1 << 126]
