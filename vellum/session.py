"""A Spark session with the settings the engine is made for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "vellum", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor sees: in the one the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary one is made, but only if driver and executors are one process (tests); on a cluster a
    folder of one machine would lose the data, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellum-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` without its lineage, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
