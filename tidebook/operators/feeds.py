"""Snapshots and what changed between them: versions with their time of validity, events, and lists that gain and lose items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series

DAY = 86_400_000


def versions(snapshots: DataFrame, key: list[str], state: list[str], bucket: int = 32 * DAY) -> DataFrame:
    """The rows of snapshots (ts, key, state, others) that are a key's first or whose state is another than in the row before, with valid_from,
    valid_to (the next change; null: none yet) and was, the state before as a struct (null: first)."""
    told = snapshots.withColumn("_state", F.struct(*state))
    rows = series.lagged(told, key, ["ts"], {"was": "_state"}, bucket=bucket)
    changed = rows.where(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col("_state"))).drop("_state")
    return series.lagged(changed, key, ["ts"], {"valid_to": "ts"}, bucket=bucket, ahead=True).withColumnRenamed("ts", "valid_from")


def market_events(changes: DataFrame) -> DataFrame:
    """changes (as `versions` of status and resolution gives them) with event: created, resolved (a status that becomes resolved) or changed."""
    event = F.when(F.col("was").isNull(), "created").when((F.col("status") == "resolved") & (F.col("was.status") != "resolved"), "resolved").otherwise("changed")
    return changes.withColumn("event", event)


def valid_at(changes: DataFrame, ts: Column) -> DataFrame:
    """The versions that hold at a time: the feed replayed to it."""
    return changes.where((F.col("valid_from") <= ts) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts)))


def list_changes(lists: DataFrame, item: str) -> DataFrame:
    """ts, item, change (added or removed) between a list and the one before; the first one's items are all added.

    lists: ts, item: each list's items. Lists are numbered; an item is added where the list before lacks it, and removed at the list
    after one that has it. Only an item's own rows meet.
    """
    rows = lists.select("ts", item).distinct()
    times = series.numbered(rows.select("ts").distinct().withColumn("_one", F.lit(1)), ["_one"], ["ts"], 32 * DAY, "_n").drop("_one")
    after = times.select((F.col("_n") - 1).alias("_n"), F.col("ts").alias("_after"))
    each = rows.join(times.join(after, "_n", "left"), "ts")
    each = series.lagged(series.lagged(each, [item], ["ts"], {"_before": "_n"}, bucket=32 * DAY), [item], ["ts"], {"_next": "_n"}, bucket=32 * DAY, ahead=True)
    added = each.where(F.col("_before").isNull() | (F.col("_before") < F.col("_n") - 1)).select("ts", item, F.lit("added").alias("change"))
    removed = each.where(F.col("_after").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("_n") + 1))).select(F.col("_after").alias("ts"), item, F.lit("removed").alias("change"))
    return added.unionByName(removed)
