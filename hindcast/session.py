"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hindcast")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Only a local session may go without that setting; then a temporary folder of this machine is used.
    """
    root = _setting(spark, "spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hindcast-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly over the session's shuffle width by a unique key, for work that is heavy per row.

    A hash of the key, not the key: a table already grouped by the key in few, merged partitions would stay as it is.
    """
    return df.repartition(shuffle_width(df.sparkSession), F.xxhash64(key))


def materialize(df: DataFrame, key: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; with a unique ``key``, in evenly filled files.

    For tables that several jobs read (model fits, searches): the lineage is cut, and the copy outlives lost executors.
    """
    path = shared_dir(df.sparkSession)
    (spread(df, key) if key else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession, low: int = 8, high: int = 1024) -> int:
    """How many value ranges to cut a sorted computation into: the session's shuffle width, within bounds."""
    return max(low, min(high, int(spark.conf.get("spark.sql.shuffle.partitions"))))
