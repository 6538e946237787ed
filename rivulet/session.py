"""Spark sessions with the settings that the dialect and the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from rivulet.errors import ConfigError

#: The dialect's settings. ANSI: overflow, division by zero and bad casts are errors, not nulls.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.legacy.sizeOfNull": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str = "local[*]", app: str = "rivulet", **settings: str) -> SparkSession:
    """A session with SETTINGS; further settings override them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on an existing session (those of a cluster stay as they are)."""
    for key, value in SETTINGS.items():
        if not key.startswith("spark.sql.streaming"):
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset a local master gets a local one; any
    other is refused: its executors wouldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ConfigError("spark.checkpoint.dir is not set: the cluster's shared folder")
        folder = f"{tempfile.gettempdir()}/rivulet-shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
