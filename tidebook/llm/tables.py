"""Reading inputs and writing intermediate tables that outlive an executor."""

from __future__ import annotations

import uuid
from pathlib import Path
from tempfile import gettempdir

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go when the job that made them ends; what is needed later is in a written table.
SESSION = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or (Path(gettempdir()) / "tidebook-shared").as_uri()


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{name}{k or ''}").lower() not in taken)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of its own for each row: its doc_id, if every row has one of its own, else a new one.

    New ones are written with the rows, so that they stay the row's whenever it is read again.
    """
    counts = df.agg(F.count("*").alias("n"), F.count_distinct(F.col("doc_id").cast("long")).alias("ids")).first()
    if counts.n == counts.ids:
        return df.withColumn(name, F.col("doc_id").cast("long"))
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, how: str = "inner", share: int = 500) -> DataFrame:
    """rows joined with keyed, which has one row for each key `on` and says in column n how many rows have it (n goes).

    Keys with over 1/share of all those rows are fewer than share, so they are sent to all executors and the rows stay
    where they are; the others are dealt by key.
    """
    total = keyed.agg(F.sum(n).alias("_total"))
    sized = keyed.join(F.broadcast(total)).withColumn("_hot", F.col(n) * share > F.col("_total")).drop(n, "_total")
    hot, rest = sized.where("_hot").drop("_hot"), sized.where("not _hot").drop("_hot")
    first = rows.join(F.broadcast(hot), on)
    return first.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how))


def configure(spark: SparkSession) -> None:
    """Set SESSION, for this and all later jobs of the session."""
    for k, v in SESSION.items():
        spark.conf.set(k, v)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))
