"""Session helpers: a local builder for tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from importlib import import_module

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "emberwatch", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # As many partitions as cores: merging them by size would only idle cores on small tables.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package()
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, which a cluster must name.

    Only a local master, whose executors are this process, may leave it unset; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberwatch-"))
    return spark.sparkContext.getCheckpointDir()


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one run's files."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """A frame written to the shared folder and read back: computed once, with no lineage to redo."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package() -> None:
    """Send this package's functions to Python workers by value.

    Workers, and the driver-side worker of stateful streams, then need no copy of the package on
    their path. On clusters that install it everywhere this is harmless.
    """
    cloudpickle.register_pickle_by_value(import_module("emberwatch"))
