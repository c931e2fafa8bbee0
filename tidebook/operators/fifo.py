"""First-in-first-out matching of buys and sells without a loop.

In each key, in order, sells first use up what was bought before. With net the
running sum of signed sizes, a sell's part that no buy covers is the growth of
max(0, -min net); the rest and the buys lie as intervals on one axis of matched
size. Between two neighbouring ends of intervals, on that axis, one buy and one sell
lie over each other: the ends of both sides are sorted once, and each takes the open
interval of the other side along, so a key costs its trades and not their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def match(trades: DataFrame, keys: list[str], order: list[str], skip_free: bool = True, dust: float = 0.001) -> DataFrame:
    """keys, entry_id, exit_id, entry_ts, exit_ts, entry_ticks, exit_ticks, size, pnl_ticks for each matched pair.

    trades: keys, event_id, side, ticks, size, ts. skip_free leaves out trades without a price.
    Sells before any buy match nothing; matches of no more than dust are dropped.
    """
    rows = trades.where("ticks > 0") if skip_free else trades
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(*order)
    buys = F.when(F.col("side") == "BUY", F.col("size")).otherwise(0)
    net = F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size"))
    rows = rows.withColumn("net", F.sum(net).over(upto)).withColumn("bought", F.sum(buys).over(upto))
    rows = rows.withColumn("short", F.greatest(F.lit(0), -F.min("net").over(upto)))
    rows = rows.withColumn("used", F.col("size") - (F.col("short") - F.coalesce(F.lag("short").over(before), F.lit(0))))
    rows = rows.withColumn("sold", F.sum(F.when(F.col("side") == "SELL", F.col("used")).otherwise(0)).over(upto))
    # Ends of intervals on the axis: the next buy and the next sell at or after an end are those that lie before it.
    common = [*keys, "event_id", "ts", "ticks"]
    entry = rows.where("side = 'BUY'").select(*common, (F.col("bought") - F.col("size")).alias("low"), F.col("bought").alias("high"), F.lit(0).alias("kind"))
    exit_ = rows.where("side = 'SELL' and used > 0").select(*common, (F.col("sold") - F.col("used")).alias("low"), F.col("sold").alias("high"), F.lit(1).alias("kind"))
    ends = entry.unionByName(exit_).withColumn("x", F.struct("event_id", "ts", "ticks", "low", "high"))
    # Equal ends of a buy and a sell are one cut: all that follow, from the farthest back.
    axis = ends.groupBy(*keys, "high").agg(F.max(F.when(F.col("kind") == 0, F.col("x"))).alias("b"), F.max(F.when(F.col("kind") == 1, F.col("x"))).alias("s"))
    back = W.partitionBy(*keys).orderBy(F.desc("high")).rowsBetween(W.unboundedPreceding, 0)
    both = axis.withColumns({"b": F.last("b", True).over(back), "s": F.last("s", True).over(back)}).where("b is not null and s is not null")
    low = F.greatest(F.col("b.low"), F.col("s.low"))
    both = both.select(*keys, *(F.col(f"{c}.{f}").alias(f"{name}_{to}") for c, name in (("b", "entry"), ("s", "exit")) for f, to in (("event_id", "id"), ("ts", "ts"), ("ticks", "ticks"))), (F.col("high") - low).alias("size"))
    size = F.col("size")
    out = both.withColumn("size", size).where(F.col("size") > dust)
    return out.select(*keys, "entry_id", "exit_id", "entry_ts", "exit_ts", "entry_ticks", "exit_ticks", "size", ((F.col("exit_ticks") - F.col("entry_ticks")) * F.col("size")).alias("pnl_ticks"))
