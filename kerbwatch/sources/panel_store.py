"""The dense panel stored by zone, for repeated work along time without another exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

# Rows of the panel in one bucket, about: 64 bytes a row and column group, so files of some 100 MB.
BUCKET_ROWS = 1_000_000


def store_panel(panel: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS, least_buckets: int = 8) -> str:
    """Writes the panel bucketed by zone and sorted by time within; returns the table's name.

    The table lies under `path`, which all executors must reach. One task writes one bucket, so a
    bucket is one sorted file. Windows by zone over the table read it bucket by bucket.
    """
    spark = panel.sparkSession
    buckets = max(least_buckets, -(-panel.count() // bucket_rows))
    name = f"panel_{uuid.uuid4().hex}"
    writer = panel.repartition(buckets, "zone_id").write.option("path", path)
    writer.bucketBy(buckets, "zone_id").sortBy("zone_id", "window_start").saveAsTable(name)
    return name
