"""Streaming forms: deduplication, rates, sessions and order-book state. Event time is the column ts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import folder


def deduplicated(stream: DataFrame, keys: list[str], ttl: str = "60 seconds") -> DataFrame:
    """The first of the rows that share keys within ttl; state is dropped behind the watermark."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def event_rate(stream: DataFrame, span: str = "5 seconds", late: str = "60 seconds") -> DataFrame:
    """source, start, n, per_second over tumbling spans."""
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return stream.withWatermark("ts", late).groupBy("source", F.window("ts", span).alias("w")).agg(F.count("*").alias("n")).select("source", F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"))


def violation_sessions(stream: DataFrame, gap: str = "120 seconds") -> DataFrame:
    """check_id, first and last time seen, times seen, peak and whether it was ever tradeable, for checks not seen for `gap`."""
    own = stream.withWatermark("ts", gap).groupBy("check_id", F.session_window("ts", gap).alias("w"))
    return own.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("seen"), F.max("magnitude").alias("peak"), F.bool_or("tradeable").alias("tradeable")).drop("w")


BOOK = "token string, ts timestamp, best_bid double, best_ask double, levels int"


def book_state(deltas: DataFrame) -> DataFrame:
    """BOOK after each batch of level changes (token, ts, side, price, size, full) of a token, in order of time.

    A size of 0 removes a level; the first row of a full snapshot (full = its number, else 0) clears the book.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sides, prices, sizes, shot = state.get if state.exists else ([], [], [], 0)
        book = pd.DataFrame({"side": pd.Series(sides, dtype=object), "price": pd.Series(prices, dtype=float), "size": pd.Series(sizes, dtype=float)})
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable").reset_index(drop=True)
        last = rows["ts"].iloc[-1]
        number = rows["full"].where(rows["full"] > 0)
        fresh = number.notna() & (number != number.ffill().shift().fillna(shot))
        if fresh.any():
            start = int(fresh.to_numpy().nonzero()[0][-1])
            book, rows, shot = book.iloc[:0], rows.iloc[start:], int(rows["full"].iloc[start])
        book = pd.concat([book, rows[["side", "price", "size"]]]).drop_duplicates(["side", "price"], keep="last")
        book = book[book["size"] != 0]
        state.update((book["side"].tolist(), book["price"].tolist(), book["size"].tolist(), shot))
        bids, asks = book["price"][book["side"] == "bid"], book["price"][book["side"] == "ask"]
        yield pd.DataFrame({"token": [key[0]], "ts": [last], "best_bid": [bids.max() if len(bids) else 0.0], "best_ask": [asks.min() if len(asks) else 1.0], "levels": [len(book)]})

    return deltas.groupBy("token").applyInPandasWithState(step, BOOK, "sides array<string>, prices array<double>, sizes array<double>, shot long", "update", GroupStateTimeout.NoTimeout)


def gathered(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has appended once all that is there has been read: its files and its state are in the folder that executors share."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
