"""Views over the star-schema tables in the shapes that the operators take.

Prices are in ticks of a hundredth and sizes are whole numbers, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, wallet, token, market, side, ticks, size, ts (ms)."""
    e = read(spark, sf_dir, "events")
    token = F.col("event_id") % 8
    return e.select(
        "event_id",
        F.col("user_id").alias("wallet"),
        token.alias("token"),
        F.expr("(event_id % 8) div 2").alias("market"),
        F.when(F.expr("(event_id div 3) % 2 = 0"), "BUY").otherwise("SELL").alias("side"),
        (1 + F.floor(F.col("value") * 100).cast("long") % 99).alias("ticks"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("size"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, side (bid or ask), ticks, size, level (1 is best): order-book levels."""
    li = read(spark, sf_dir, "lineitem")
    ticks = (1 + F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long") % 45).alias("t")
    raw = li.select(F.col("l_partkey").alias("book"), F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"), ticks, F.col("l_quantity").cast("long").alias("q"))
    raw = raw.withColumn("ticks", F.when(F.col("side") == "bid", F.col("t")).otherwise(F.col("t") + 46))
    summed = raw.groupBy("book", "side", "ticks").agg(F.sum("q").alias("size"))
    best = F.when(F.col("side") == "bid", -F.col("ticks")).otherwise(F.col("ticks"))
    return summed.withColumn("level", F.row_number().over(W.partitionBy("book", "side").orderBy(best)).cast("long"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, bids, asks: arrays of struct<price, size>, best first. A book has at most 45 levels a side."""
    level = levels(spark, sf_dir)
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("level", "ticks", "size")))), lambda x: F.struct((x["ticks"] / 100).alias("price"), x["size"].cast("double").alias("size")))
    return level.groupBy("book").agg(side("bid").alias("bids"), side("ask").alias("asks"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, ts (ms), price."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("price"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, question, category: one market for each part."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("market"), F.col("p_name").alias("question"), F.col("p_type").alias("category"))


def mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (a market: the part that the user's number points to), event_id, ts (ms), price in hundredths from 0.01 to 0.99."""
    t = trades(spark, sf_dir)
    return t.select((F.col("wallet") + 1).alias("series"), "event_id", "ts", (F.col("ticks") / 100).alias("price"))
