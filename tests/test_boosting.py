"""The boosted trees against a learner of plain loops, leaf values, leaf budget and patience."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbwatch.config import BoostSettings, ModelSettings
from kerbwatch.operators import boosting
from kerbwatch.operators.boosting import POISSON, SQUARED, Patience, bin_edges, fit_boosted

BOOST = BoostSettings("b", 1.0, 4, 0.3, 6, 5, 1.5, 2.0)
NO_HOLDOUT = replace(ModelSettings(), early_stopping=False)


def data(seed, n=240, p=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, p)), 1)
    y = rng.poisson(np.exp(0.7 * x[:, 0] - 0.4 * (x[:, 1] > 0) * x[:, 2])).astype(float)
    return x, y, rng.choice([1.0, 2.5], n)


def frame(spark, x, y, w, parts=4):
    rows = [(f"Z{i}", i, [float(v) for v in r], float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "zone_id string, window_start int, x array<double>, y double, w double").repartition(parts)


def fitted(spark, x, y, w, loss, boost=BOOST, model=NO_HOLDOUT, parts=4):
    return fit_boosted(frame(spark, x, y, w, parts), F.col("x"), F.col("y"), "w", loss, boost, model, 1)


def plain_fit(x, y, w, loss, boost):
    """Margins after all rounds: every leaf's every split is tried, the best leaf is split first."""
    edges = bin_edges(x)
    mean = (w * y).sum() / w.sum()
    m = np.full(len(y), math.log(mean) if loss == POISSON else mean)
    for _ in range(boost.max_iter):
        mu = np.exp(m) if loss == POISSON else m
        g, h = w * (mu - y), w * (mu if loss == POISSON else np.ones(len(y)))
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + boost.l2_regularization)
        leaves = [np.arange(len(y))]
        while len(leaves) < boost.max_leaf_nodes:
            best = (0.0, None)
            for k, rows in enumerate(leaves):
                for f in range(x.shape[1]):
                    for edge in edges[f]:
                        a, b = rows[x[rows, f] <= edge], rows[x[rows, f] > edge]
                        if min(len(a), len(b)) >= boost.min_samples_leaf:
                            gain = score(a) + score(b) - score(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, (k, a, b))
            if best[1] is None:
                break
            k, a, b = best[1]
            leaves[k : k + 1] = []
            leaves += [a, b]
        for rows in leaves:
            m[rows] -= boost.learning_rate * g[rows].sum() / (h[rows].sum() + boost.l2_regularization)
    return m


@pytest.mark.parametrize("loss", [POISSON, SQUARED])
def test_equals_a_learner_of_plain_loops(spark, loss):
    x, y, w = data(3)
    target = np.log1p(y) if loss == SQUARED else y
    model = fitted(spark, x, target, w, loss)
    assert np.allclose(model.margin(x), plain_fit(x, target, w, loss, BOOST), atol=1e-4)
    told = frame(spark, x, y, w).select("window_start", model.predict(F.col("x")).alias("p")).orderBy("window_start").collect()
    assert np.allclose([r.p for r in told], model.forecast(model.margin(x)))


def test_leaf_values_are_residuals_over_weight_and_l2(spark):
    x, y, w = data(5)
    model = fitted(spark, x, y, w, SQUARED, replace(BOOST, max_iter=1))
    tree = model.trees[0]
    leaf = tree.leaf_of(x)
    residual = y - model.start
    assert model.start == pytest.approx((w * y).sum() / w.sum())
    for node in np.unique(leaf):
        rows = leaf == node
        want = BOOST.learning_rate * (w * residual)[rows].sum() / (w[rows].sum() + BOOST.l2_regularization)
        assert tree.value[node] == pytest.approx(want, abs=1e-5)


def test_leaf_budget_and_least_rows(spark):
    x, y, w = data(7, 3000)
    boost = BoostSettings("b", 1.0, 3, 0.1, 23, 40, 2.0, 3.0)
    model = fitted(spark, x, y, w, POISSON, boost)
    assert [t.leaves for t in model.trees] == [23, 23, 23]
    for tree in model.trees:
        assert np.unique(tree.leaf_of(x), return_counts=True)[1].min() >= 40


def test_partitions_do_not_matter(spark):
    x, y, w = data(9)
    one, many = (fitted(spark, x, y, w, POISSON, parts=n) for n in (1, 7))
    assert [t.__dict__ for t in one.trees] == [t.__dict__ for t in many.trees]


def test_patience():
    def ends(losses, rounds=12):
        patience = Patience(rounds)
        for trees, loss in enumerate(losses):
            if patience.out_of(loss, trees):
                return trees, patience.size
        return None, patience.size

    rise = [3.0, 2.0]
    assert ends([*rise, *[2.5] * 11, 1.0]) == (None, 13)  # eleven rounds without gain, then a gain
    assert ends([*rise, *[2.5] * 12, 1.0]) == (13, 1)


def test_early_end_goes_back_to_the_best_round(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(400, 3)), rng.poisson(1.0, 400).astype(float), np.ones(400)  # noise alone
    boost = replace(BOOST, max_iter=40, learning_rate=0.5)
    model = fitted(spark, x, y, w, POISSON, boost, replace(ModelSettings(), validation_fraction=0.3, rounds_without_gain=3))
    assert len(model.trees) < 10


def test_rows_without_spread(spark):
    flat = np.zeros((50, 2))
    model = fitted(spark, flat, np.full(50, 2.0), np.ones(50), POISSON)
    assert not model.trees and model.forecast(model.margin(flat))[0] == pytest.approx(2.0)


def test_many_values_are_binned_by_quantiles():
    x = np.random.default_rng(1).normal(size=(5000, 1))
    (edges,) = bin_edges(x, 16)
    counts = np.bincount(np.searchsorted(edges, x[:, 0]))
    assert len(counts) == 16 and counts.min() > 250
    assert boosting.bin_edges(np.array([[1.0], [3.0], [1.0]]))[0].tolist() == [2.0]


def test_a_pass_opens_all_that_is_next():
    """A tree of 23 leaves on noise: trials go on below trials, and the last split needs no pass."""
    rng = np.random.default_rng(4)
    codes, y = rng.integers(0, 64, (4000, 6)).astype(np.uint8), rng.poisson(1.0, 4000).astype(float)
    boost = BoostSettings("b", 1.0, 1, 1.0, 23, 40, 2.0, 3.0)
    asked = []

    def sums_of(tree, nodes):
        slot_of = np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))
        asked.append(len(nodes))
        at = slot_of[tree.leaf_of(codes, binned=True)]
        return boosting.leaf_sums(SQUARED, codes, y, np.ones(4000), np.zeros(4000), at, len(nodes), 64), 0.0

    tree, _ = boosting.grow(sums_of, [np.arange(64) + 0.5] * 6, boost)
    depth = [0] * len(tree.feature)
    for node, feature in enumerate(tree.feature):
        if feature >= 0:
            depth[tree.left[node]] = depth[tree.right[node]] = depth[node] + 1
    assert tree.leaves == 23 and len(asked) <= max(depth) + 1
    leaf = tree.leaf_of(codes, binned=True)
    for node in np.unique(leaf):
        assert tree.value[node] == pytest.approx(y[leaf == node].sum() / ((leaf == node).sum() + 2.0), abs=1e-4)


def test_rows_of_small_nodes_and_recalled_splits_do_not_change_a_tree():
    rng = np.random.default_rng(6)
    codes, y = rng.integers(0, 64, (6000, 6)).astype(np.uint8), rng.poisson(1.0, 6000).astype(float)
    y += (codes[:, 0] > 40) * 3.0 + (codes[:, 1] < 9)
    boost, w, edges = BoostSettings("b", 1.0, 1, 0.05, 23, 40, 2.0, 3.0), np.ones(6000), [np.arange(63) + 0.5] * 6
    passes = {"plain": 0, "sent": 0}

    def slots(tree, nodes):
        slot_of = np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))
        return slot_of[tree.leaf_of(codes, binned=True)]

    def sums_of(tree, nodes):
        passes["plain"] += 1
        return boosting.leaf_sums(SQUARED, codes, y, w, m, slots(tree, nodes), len(nodes), 64), 0.0

    def sent_of(tree, nodes, small):
        passes["sent"] += 1
        at = slots(tree, [*nodes, *small])
        sums = boosting.leaf_sums(SQUARED, codes, y, w, m, np.where(at < len(nodes), at, -1), len(nodes), 64)
        parts = [np.flatnonzero(at == len(nodes) + k) for k in range(len(small))]
        assert all(len(rows) <= 500 for rows in parts)
        steps = [boosting._whole(a) for a in boosting.gradients(SQUARED, y, w, m)]
        return sums, 0.0, {n: boosting.NodeRows(codes[r], *(s[r] for s in steps), 64) for n, r in zip(small, parts)}

    m, recall = np.zeros(6000), boosting.Recall()
    for _ in range(12):
        plain, _ = boosting.grow(sums_of, edges, boost)
        sent, _ = boosting.grow(None, edges, boost, sent_of, 500, recall)
        assert sent == plain and sent.rows == plain.rows
        m += plain.add_to(codes, binned=True)
    assert passes["sent"] <= 0.6 * passes["plain"]


@pytest.mark.parametrize("loss", [POISSON, SQUARED])
def test_a_fit_needs_few_jobs(spark, loss, monkeypatch):
    """Nodes of a few rows cost no pass of their own, whatever the number of leaves."""
    x, y, w = data(11, 3000)
    passes, one_pass = [], boosting._pass
    monkeypatch.setattr(boosting, "_pass", lambda *a: passes.append(1) or one_pass(*a))
    boost = BoostSettings("b", 1.0, 4, 0.1, 23, 40, 2.0, 3.0)
    model = fitted(spark, x, np.log1p(y) if loss == SQUARED else y, w, loss, boost)
    assert [t.leaves for t in model.trees] == [23] * 4 and len(passes) <= 8
    monkeypatch.setattr(boosting, "_SENT_ROWS", 0)
    summed = fitted(spark, x, np.log1p(y) if loss == SQUARED else y, w, loss, boost)
    assert summed.trees == model.trees and len(passes) > 24
