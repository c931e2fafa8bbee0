"""Guarded state machines over long histories.

A request to move to a state is a map of states: those that may move there do, the others stay as they are. Maps compose, and
composition is associative. So a history is cut into blocks of a bounded length, each block becomes one map, the maps of
a history's blocks say in which state each block begins, and the blocks are gone through apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series

#: Requests in a block.
BLOCK = 256

# The states of a hypothesis, and where each may go.
HYPOTHESIS = {
    "registered": ["collecting_data", "rejected"],
    "collecting_data": ["testing", "rejected"],
    "testing": ["validated", "rejected"],
    "validated": ["promoted", "retired"],
    "rejected": [],
    "promoted": ["retired"],
    "retired": [],
}


def run(requests: DataFrame, by: list[str], order: list[str], to: str, moves: dict[str, list[str]], start: str, bucket: int = series.HOUR) -> DataFrame:
    """requests with before, after (states) and accepted: whether the move is one that the state before allows.

    requests: by, order (its first column a number), to. A state that the machine does not know is never reached.
    """
    states = list(moves)
    place = {s: i for i, s in enumerate(states)}
    names = F.array(*map(F.lit, states))
    # For each state asked for, the state that each state moves to.
    maps = F.create_map(*(x for s in states for x in (F.lit(s), F.array(*(F.lit(place[s] if s in moves[q] else i) for i, q in enumerate(states))))))
    same = F.array(*(F.lit(i) for i in range(len(states))))
    step = lambda asked: F.coalesce(F.try_element_at(maps, asked), same)
    rows = series.numbered(requests, by, order, bucket, "_at").withColumn("_block", F.floor(F.col("_at") / BLOCK))
    blocks = rows.groupBy(*by, "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(to).alias("to")))), lambda x: x["to"]).alias("asked"))
    whole = blocks.withColumn("map", F.aggregate("asked", same, lambda m, asked: F.transform(m, lambda i: F.get(step(asked), i))))
    first = F.lit(place[start])

    def begin(acc: Column, x: Column) -> Column:
        return F.struct(F.get(x["map"], acc["at"]).alias("at"), F.concat(acc["begins"], F.array(F.struct(x["_block"].alias("_block"), acc["at"].alias("at")))).alias("begins"))

    nothing = F.struct(first.alias("at"), F.array().cast("array<struct<_block: bigint, at: int>>").alias("begins"))
    begins = whole.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", "map"))).alias("maps")).select(*by, F.inline(F.aggregate("maps", nothing, begin)["begins"]))

    def walk(acc: Column, asked: Column) -> Column:
        then = F.get(step(asked), acc["at"])
        return F.struct(then.alias("at"), F.concat(acc["path"], F.array(F.struct(acc["at"].alias("before"), then.alias("after")))).alias("path"))

    path = F.aggregate("asked", F.struct(F.col("at"), F.array().cast("array<struct<before: int, after: int>>").alias("path")), walk)["path"]
    walked = blocks.join(begins, [*by, "_block"]).select(*by, "_block", F.posexplode(path).alias("_k", "_x")).withColumn("_at", F.col("_block") * BLOCK + F.col("_k"))
    out = rows.join(walked.drop("_block", "_k"), [*by, "_at"])
    before, after = (F.get(names, F.col(f"_x.{c}")) for c in ("before", "after"))
    return out.select(*requests.columns, before.alias("before"), after.alias("after"), (F.col("_x.before") != F.col("_x.after")).alias("accepted"))


def final(walked: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, state, requests and rejected, after a history's last request."""
    return walked.groupBy(*by).agg(F.max_by("after", F.struct(*order)).alias("state"), F.count("*").alias("requests"), F.count_if(~F.col("accepted")).alias("rejected"))
