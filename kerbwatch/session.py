"""Session defaults, shared scratch space and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A zone table up to this many rows is broadcast; a row is well under 500 bytes, so 100 MB at most.
BROADCAST_ROW_LIMIT = 200_000
# Raw rows that a task takes at most, about: scored records are sorted by id there, some 600 bytes each.
TASK_ROWS = 400_000

_LOCAL_FOLDERS: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on; safe to apply to a session made elsewhere.

    The JVM never compiles a method above 8,000 bytes of bytecode and interprets it instead. Record
    cleaning fuses dozens of expressions, so Spark is told to give up fusing at that size: its
    per-operator code is split into small methods, which ran 2 to 4 times faster here.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName("kerbwatch")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in `spark.checkpoint.dir`.

    Only a local-mode session without the setting falls back to a temporary folder; on a cluster
    a missing setting is an error, since a machine-local folder dies with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="kerbwatch-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder; all paths of one application lie under one subfolder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/kerbwatch-{app}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Used where a frame feeds several branches: the work behind it runs once, every branch sees the
    same bits, and a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 0, task_rows: int = TASK_ROWS) -> DataFrame:
    """Spread an input with fewer splits than cores, such as one small file, or with more rows a split than a task should take.

    `rows` is the number of rows, where it is known, and a task takes about `task_rows`. Does nothing for inputs with enough splits. Rows
    are dealt by a hash of all columns, which needs no sort to be the same at every try.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))
    return df.repartition(wanted, *df.columns) if df.rdd.getNumPartitions() < wanted else df


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count is provably at most `max_rows`.

    Above the limit the hint is left off and the planner chooses a shuffled join by itself.
    """
    return F.broadcast(df) if max_rows <= BROADCAST_ROW_LIMIT else df
