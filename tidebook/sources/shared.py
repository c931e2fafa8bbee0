"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from pathlib import Path
from tempfile import gettempdir

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or (Path(gettempdir()) / "tidebook-shared").as_uri()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what follows starts from the files, whichever executors are lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a plan holds if it is more than reading and work on single rows.
_WORK = ("Join", "Aggregate", "Window", "Generate", "Deduplicate", "Distinct", "Sort")


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """df for use more than once: as it is if it only reads and works on single rows, else written.

    Steps that join a table with sums of its own use it twice; without this a chain of such steps would be worked out as often
    as two to the power of its length.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    return written(df, name) if any(w in plan for w in _WORK) else df
