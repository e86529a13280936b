"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lodestone", **options: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; other options as keyword arguments with dots as ``__``."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in options.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without it takes a temporary one, on a cluster the setting
    is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return folder.rstrip("/")


def run_folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder there."""
    return f"{shared_folder(spark)}/lodestone-{what}-{uuid.uuid4().hex}"


def written(frame: DataFrame, what: str) -> DataFrame:
    """The frame written to a new folder that driver and executors share, and read back."""
    path = run_folder(frame.sparkSession, what)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
