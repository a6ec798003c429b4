"""Saving and loading fitted forecasts: a table of tree nodes, and the numbers beside it as JSON."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import SparkSession

from kerbwatch.operators.boosting import BoostedTrees, Tree
from kerbwatch.operators.forecasting import ForecastModels, ImpactMember

_NODE = "model int, tree int, node int, feature int, bin int, threshold double, left int, right int, value double"


def save_models(spark: SparkSession, models: ForecastModels, path: str) -> str:
    """One row per node; all nodes of a forecast are a few thousand, bounded by the settings."""
    fitted = [models.hotspot, *[m.model for m in models.impact]]
    rows = [
        (k, t, n, *node)
        for k, model in enumerate(fitted)
        for t, tree in enumerate(model.trees)
        for n, node in enumerate(zip(tree.feature, tree.bin, tree.threshold, tree.left, tree.right, tree.value, strict=True))
    ]
    spark.createDataFrame(rows, _NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    numbers = {
        "models": [[m.loss, m.start] for m in fitted],
        "members": [[m.name, m.weight] for m in models.impact],
        "impact_cap": models.impact_cap,
        "count_blend": models.count_blend,
        "impact_blend": models.impact_blend,
    }
    row = spark.createDataFrame([(json.dumps(numbers),)], "value string")
    row.write.mode("overwrite").text(f"{path}/numbers")
    return path


def load_models(spark: SparkSession, path: str) -> ForecastModels:
    numbers = json.loads(spark.read.text(f"{path}/numbers").first()[0])
    nodes = defaultdict(list)
    for r in spark.read.schema(_NODE).parquet(f"{path}/trees").orderBy("model", "tree", "node").collect():
        nodes[r["model"], r["tree"]].append(r)

    def model(k: int, loss: str, start: float) -> BoostedTrees:
        trees = []
        while rows := nodes.get((k, len(trees))):
            names = ("feature", "threshold", "bin", "left", "right", "value")
            trees.append(Tree(*[[r[n] for r in rows] for n in names]))
        return BoostedTrees(loss, start, trees)

    fitted = [model(k, *m) for k, m in enumerate(numbers["models"])]
    members = [ImpactMember(n, w, m) for (n, w), m in zip(numbers["members"], fitted[1:], strict=True)]
    return ForecastModels(
        fitted[0], members, numbers["impact_cap"], numbers["count_blend"], numbers["impact_blend"]
    )
