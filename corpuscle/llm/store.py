"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets one of its own, which goes when Python ends; others must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpuscle-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path of its own for a table."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back: cuts the lineage, and a lost executor costs no more than a read.

    The tables are there until the owner of the folder deletes it, once the results of the job are written.
    """
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
