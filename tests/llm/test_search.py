"""Operator 8 against brute force."""

import numpy as np

from kerbwatch.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, k=20, divisor=20):
    out = {}
    for i in np.flatnonzero(ids % divisor == 0):
        score = vectors @ vectors[i]
        score[i] = -np.inf
        out[int(ids[i])] = [int(v) for v in ids[np.lexsort((ids, -score))][: min(k, len(ids) - 1)]]
    return out


def measured(spark, ids, vectors, **kw):
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, vectors, strict=True)]
    got = ann.neighbours(spark.createDataFrame(rows, SCHEMA), **kw).toPandas()
    expected = brute(ids, vectors)
    hits = total = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and q not in set(own["vec_id"])
        exact = [float((vectors[np.searchsorted(ids, v)] * vectors[np.searchsorted(ids, q)]).sum()) for v in own["vec_id"]]
        assert np.allclose(own["score"], exact, rtol=0, atol=1e-12)
        pairs = list(zip(-own["score"], own["vec_id"], strict=True))
        assert pairs == sorted(pairs)
        hits += len(set(own["vec_id"]) & set(expected[q]))
        total += len(expected[q])
    assert set(got["query_id"]) == set(expected)
    return hits / total


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas().sort_values("vec_id")
    vectors = np.stack([np.asarray(v, np.float64) for v in rows["embedding"]])
    assert measured(spark, rows["vec_id"].to_numpy(), vectors) >= 0.9


def test_recall_on_clusters_of_unlike_norms(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16)) * 4
    vectors = (centers[rng.integers(30, size=1500)] + rng.normal(size=(1500, 16))).astype(np.float32).astype(np.float64)
    assert measured(spark, np.arange(1500), vectors) >= 0.9


def test_shards_and_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)).astype(np.float32).astype(np.float64)
    vectors[100:250] = vectors[100]  # a vector that many rows share, split over shards
    assert measured(spark, np.arange(400), vectors) >= 0.9


def test_graph_search_finds_what_the_ratio_allows():
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(2000, 12))
    norm = float(np.sqrt((sample * sample).sum(axis=1)).max())
    index = ann.fit(sample, norm, 64)
    found = wanted = 0
    for q in ann.lifted_queries(sample[:100], norm):
        away = ann.distances(q[None], index.centroids)[0]
        exact = set(np.flatnonzero(away <= index.ratio * away.min()).tolist())
        found += len(exact & set(ann.probed(index, q).tolist()))
        wanted += len(exact)
    assert found / wanted > 0.98
    counts = np.bincount(ann.lists_of(ann.lifted(sample, norm), index.centroids, index.replica_ratio)[1], minlength=64)
    assert counts.max() < 6 * counts.mean()


def test_odd_vectors_take_no_part(spark):
    good = [(i, [1.0, float(i)], 0) for i in range(0, 41, 10)]
    odd = [
        (100, None, 0), (120, [0.0, 0.0], 0), (140, [1.0, None], 0), (160, [float("nan"), 1.0], 0),
        (180, [float("inf"), 1.0], 0), (200, [1.0], 0), (None, [1.0, 1.0], 0), (40, [1.0, 40.0], 0),
    ]
    got = ann.neighbours(spark.createDataFrame(good + odd, SCHEMA)).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and {r.vec_id for r in got} <= {0, 10, 20, 30, 40}
    assert sorted(r.vec_id for r in got if r.query_id == 40) == [0, 10, 20, 30]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == [40, 30, 10, 0]
    assert ann.neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann.neighbours(spark.createDataFrame(odd[:5], SCHEMA)).collect() == []
    assert ann.neighbours(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).collect() == []
    assert ann.neighbours(spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)).collect() == []


def test_blocks_follow_the_queries_of_a_list():
    rows, asked = np.array([20_000, 100, 0, 50]), np.array([4_097, 40_000_000, 7, 0])
    parts = ann.parts_of(rows, asked)
    assert parts == [(0, 3, 2), (1, 1, 9766)]  # lists without rows or without queries take no part
    # Ten times the table in ten times the lists, each asked as often: ten times the copies.
    copies = sum(rows[i] * blocks for i, _, blocks in parts)
    grown = ann.parts_of(np.tile(rows, 10), np.tile(asked, 10))
    assert sum(np.tile(rows, 10)[i] * blocks for i, _, blocks in grown) == 10 * copies


def test_equal_vectors_beyond_the_best_are_left_out_exactly(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 6)).astype(np.float32).astype(np.float64)
    vectors[rng.permutation(300)[:200]] = vectors[7]  # queries among the copies too
    ids = np.arange(300)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, vectors, strict=True)]
    got = ann.neighbours(spark.createDataFrame(rows, SCHEMA)).toPandas()
    expected = brute(ids, vectors)
    copies = np.flatnonzero((vectors == vectors[7]).all(axis=1))
    for q in set(copies[copies % 20 == 0].tolist()):
        own = got[got["query_id"] == q].sort_values("rank")
        equal = [int(c) for c in copies if c != q]
        kept = [v for v in own["vec_id"] if v in set(equal)]
        assert kept == [v for v in expected[q] if v in set(equal)]


def test_distances_in_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    sample = rng.normal(size=(700, 10))
    norm = float(np.sqrt((sample * sample).sum(axis=1)).max())
    whole = ann.fit(sample, norm, 32)
    monkeypatch.setattr(ann, "AT_ONCE", 32 * 50)
    cut = ann.fit(sample, norm, 32)
    assert np.allclose(whole.centroids, cut.centroids) and whole.replica_ratio == cut.replica_ratio
    points = ann.lifted(sample, norm)
    assert len(ann.lists_of(points, cut.centroids, 1.15)[0]) == len(ann.lists_of(points, whole.centroids, 1.15)[0])
