"""Paper positions: executions that share a key add up, market resolutions close them; marks, profit by strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..sources.shared import settled
from . import ranges, series

KEY = ["market", "token", "strategy", "direction"]


def _gain(price: Column) -> Column:
    """Of one unit, by the position's direction."""
    return F.when(F.col("direction") == "BUY", price - F.col("entry")).otherwise(F.col("entry") - price)


def _epochs(executions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Executions of a size with epoch, the number of resolutions that their market had by then, and ends, all of these in order."""
    ends = resolutions.groupBy("market").agg(F.array_sort(F.collect_list(F.struct("ts", "price"))).alias("ends"))
    rows = executions.where("size > 0").join(ends, "market", "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<struct<ts: bigint, price: double>>")))
    return rows.withColumn("epoch", F.size(F.filter("ends", lambda e: e["ts"] <= F.col("ts"))))


def lifecycle(executions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """KEY, epoch, fills, size, entry (mean by size), fee, ev (of the first execution), opened_at, exit and closed_at (null: open).

    executions: KEY, event_id, size, price, fee, ev, ts. resolutions: market, ts, price; one closes all positions that
    the market has by then, whatever their token, and what is executed later opens the next epoch. A market has few
    resolutions, so they are an array; executions are added up before they meet in one task.
    """
    rows = _epochs(executions, resolutions)
    agg = rows.groupBy(*KEY, "epoch").agg(
        F.count("*").alias("fills"),
        F.sum("size").alias("size"),
        (F.sum(F.col("size") * F.col("price")) / F.sum("size")).alias("entry"),
        F.sum("fee").alias("fee"),
        F.min_by("ev", F.struct("ts", "event_id")).alias("ev"),
        F.min("ts").alias("opened_at"),
        F.first("ends").alias("ends"),
    )
    end = F.get("ends", F.col("epoch"))
    return agg.withColumns({"exit": end["price"], "closed_at": end["ts"]}).drop("ends")


def closes(positions: DataFrame) -> DataFrame:
    """KEY, epoch, size, entry, exit, gross and net profit, holding_ms, realized_ev, and how far the value was off, of those that are closed."""
    gain = _gain(F.col("exit"))
    rows = positions.where("closed_at is not null")
    return rows.select(*KEY, "epoch", "size", "entry", "exit", (gain * F.col("size")).alias("gross"), (gain * F.col("size") - F.col("fee")).alias("net"), (F.col("closed_at") - F.col("opened_at")).alias("holding_ms"), gain.alias("realized_ev"), (F.col("ev") - gain).alias("ev_error"), "fee")


def marked(positions: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """Open positions at their token's mark (token, mark): unrealized profit less fees, and age_ms."""
    rows = positions.where("closed_at is null").join(marks, "token")
    return rows.withColumns({"unrealized": _gain(F.col("mark")) * F.col("size") - F.col("fee"), "age_ms": now - F.col("opened_at")}).drop("exit", "closed_at")


def profit_by_strategy(closed: DataFrame, held: DataFrame, p: float = 0.05) -> DataFrame:
    """strategy, trades, wins (over 0), losses, realized, unrealized, total, mean, t and p (0 and 1 where undefined), significant.

    Strategies without a closed position are left out.
    """
    agg = closed.groupBy("strategy").agg(F.count("*").alias("trades"), F.count_if(F.col("net") > 0).alias("wins"), F.count_if(F.col("net") <= 0).alias("losses"), F.sum("net").alias("realized"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("sd"))
    rows = agg.join(held.groupBy("strategy").agg(F.sum("unrealized").alias("unrealized")), "strategy", "left").withColumn("unrealized", F.coalesce("unrealized", F.lit(0.0)))
    t, value = S.t_test(F.col("trades"), F.col("mean"), F.col("sd"))
    rows = rows.withColumns({"total": F.col("realized") + F.col("unrealized"), "win_rate": F.col("wins") / F.col("trades"), "t": F.nanvl(t, F.lit(0.0)), "p": F.nanvl(value, F.lit(1.0))})
    return rows.withColumn("significant", F.col("p") < p).drop("sd")


def excursions(executions: DataFrame, resolutions: DataFrame, marks: DataFrame) -> DataFrame:
    """KEY, epoch, favorable, adverse: the furthest that the mark was on either side of the position's entry while it was open (0 at least).

    marks: token, ts, event_id, mark. A mark counts from the execution on that opens the position, that with the same ts and
    event_id included, to the resolution; between two executions it is held against the mean entry of those so far. So each
    execution makes one stretch of its token's line of marks, whose extremes come from a pyramid over the line.
    """
    key, order = [*KEY, "epoch"], ["ts", "event_id"]
    rows = _epochs(executions, resolutions).withColumn("closed_at", F.get("ends", F.col("epoch"))["ts"]).drop("ends")
    rows = series.summed(series.summed(rows, key, order, F.col("size") * F.col("price"), "_cost"), key, order, F.col("size"), "_held").withColumn("entry", F.col("_cost") / F.col("_held"))
    line = settled(series.numbered(marks.select("token", *order, "mark"), ["token"], order, series.HOUR, "at"))
    rows = ranges.places(rows.select(*key, *order, "entry", "closed_at"), line, ["token"], order).withColumnRenamed("before", "first")
    rows = settled(series.lagged(rows, key, order, {"_next": "first"}, ahead=True))
    ends = rows.where("_next is null and closed_at is not null").select(*key, F.col("closed_at").alias("ts"), F.lit((1 << 62)).alias("event_id"))
    ends = ranges.places(ends, line, ["token"], order).select(*key, F.col("before").alias("_end"))
    size = line.groupBy("token").agg(F.count("*").alias("_all"))
    rows = rows.join(ends, key, "left").join(size, "token", "left").withColumn("last", F.coalesce("_next", F.when(F.col("closed_at").isNotNull(), F.col("_end")).otherwise(F.col("_all")), F.lit(0)) - 1)
    found = ranges.extremes(rows.select(*key, *order, "entry", "first", "last"), line.select("token", "at", F.col("mark").alias("value")), ["token"], [*key, *order])
    up, down = F.col("hi") - F.col("entry"), F.col("entry") - F.col("lo")
    buy = F.col("direction") == "BUY"
    zero = F.lit(0.0)
    return found.groupBy(*key).agg(F.greatest(F.max(F.when(buy, up).otherwise(down)), zero).alias("favorable"), F.greatest(F.max(F.when(buy, down).otherwise(up)), zero).alias("adverse"))
