"""The append-only ledger and raw exchange messages: JSON lines in day folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType([T.StructField("seq_num", T.LongType()), T.StructField("wall_clock", T.LongType()), T.StructField("entry", T.StructType([T.StructField("type", T.StringType()), T.StructField("data", T.MapType(T.StringType(), T.StringType()))]))])
RAW = "event_type string, type string, market string, asset_id string, price string, size string, side string, maker_address string, taker_address string, transaction_hash string, timestamp string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """seq_num, wall_clock, type, data of all *.jsonl files below path; lines that do not parse are left out."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path)
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", LEDGER).alias("r")).where("r.seq_num is not null and r.entry.type is not null")
    return parsed.select("r.seq_num", "r.wall_clock", F.col("r.entry.type").alias("type"), F.col("r.entry.data").alias("data"))


def append_ledger(entries: DataFrame, path: str, first: int) -> None:
    """Append entries (wall_clock, type, data) in order of time as JSON lines, numbered from first, a folder for each UTC day.

    Numbers run over each batch, so a batch is what one writer appends at once; it is not all of the ledger.
    """
    number = F.row_number().over(W.orderBy("wall_clock", "type")) + F.lit(first - 1)
    rows = entries.withColumn("seq_num", number.cast("long")).withColumn("day", F.date_format(F.timestamp_millis("wall_clock"), "yyyy-MM-dd"))
    line = F.to_json(F.struct("seq_num", "wall_clock", F.struct("type", "data").alias("entry")))
    rows.select("day", line.alias("value")).write.partitionBy("day").mode("append").option("compression", "none").text(path)


def open_positions(ledger: DataFrame) -> DataFrame:
    """market_id and last_seq of positions whose last entry opened them; two writers may share numbers, so time comes first."""
    own = ledger.where(F.col("type").isin("position_opened", "position_closed")).withColumn("market_id", F.col("data")["market_id"])
    last = own.groupBy("market_id").agg(F.max_by("type", F.struct("wall_clock", "seq_num")).alias("last"), F.max("seq_num").alias("last_seq"))
    return last.where("last = 'position_opened'").select("market_id", "last_seq")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def parse_trades(lines: DataFrame) -> DataFrame:
    """Trades from raw messages (column value): an object or an array of them; other events and bad lines are left out.

    A side that is missing is BUY; numbers are read from strings.
    """
    as_list = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    e = lines.select(F.explode(F.from_json(as_list, f"array<struct<{RAW.replace(' string', ': string')}>>")).alias("e")).select("e.*")
    own = e.where(F.coalesce("event_type", "type").isin("trade", "last_trade_price"))
    price, size = F.expr("try_cast(price as double)"), F.expr("try_cast(size as double)")
    return own.select(
        F.col("market").alias("market_id"),
        F.col("asset_id").alias("token_id"),
        F.upper(F.coalesce("side", F.lit("BUY"))).alias("side"),
        F.coalesce(price, F.lit(0.0)).alias("price"),
        F.coalesce(size, F.lit(0.0)).alias("size"),
        (F.coalesce(price, F.lit(0.0)) * F.coalesce(size, F.lit(0.0))).alias("notional"),
        F.col("maker_address").alias("maker"),
        F.col("taker_address").alias("taker"),
        F.col("transaction_hash").alias("tx_hash"),
        F.expr("try_cast(timestamp as bigint)").alias("timestamp"),
    )


def levels(raw: Column) -> Column:
    """array<struct<price, size>> from array<struct<price: string, size: string>>, without prices of zero or less."""
    read = F.transform(raw, lambda x: F.struct(x["price"].cast("double").alias("price"), x["size"].cast("double").alias("size")))
    return F.filter(read, lambda x: x["price"] > 0)
