"""Order-book measures as column expressions over arrays of struct<price, size>, best level first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import NAN


def total(levels: Column, weight=None) -> Column:
    """Sum of sizes, each times weight(price, position from 0)."""
    parts = F.transform(levels, lambda x, i: x["size"] * (weight(x["price"], i) if weight else 1.0))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def top(levels: Column, n: int, skip: int = 0) -> Column:
    return F.slice(levels, 1 + skip, n)


def best(levels: Column, what: str) -> Column:
    return F.get(levels, 0)[what]


def ratio(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask); 0 if both are 0."""
    return F.when(bid + ask == 0, 0.0).otherwise((bid - ask) / (bid + ask))


def imbalance(bids: Column, asks: Column) -> Column:
    return ratio(F.coalesce(best(bids, "size"), F.lit(0.0)), F.coalesce(best(asks, "size"), F.lit(0.0)))


def multi_level_imbalance(bids: Column, asks: Column, n: int = 5) -> Column:
    by_rank = lambda p, i: 1 / (i + 1)
    return ratio(total(top(bids, n), by_rank), total(top(asks, n), by_rank))


def deep_imbalance(bids: Column, asks: Column) -> Column:
    """Levels 2 to 5, the second counting most."""
    # Twelve times the weights 1, 1/2, 1/3, 1/4: sums of whole sizes are exact, so a limit is met or not whatever their order.
    by_rank = lambda p, i: 12 / (i + 1)
    return ratio(total(top(bids, 4, 1), by_rank), total(top(asks, 4, 1), by_rank))


def weighted_mid(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    return F.when(bid_size + ask_size == 0, NAN).otherwise((ask_size * bid + bid_size * ask) / (bid_size + ask_size))


def microprice(bids: Column, asks: Column) -> Column:
    """NaN if a side is empty."""
    quoted = (F.size(bids) > 0) & (F.size(asks) > 0)
    return F.when(quoted, weighted_mid(best(bids, "price"), best(bids, "size"), best(asks, "price"), best(asks, "size"))).otherwise(NAN)


def mid(bids: Column, asks: Column) -> Column:
    return F.coalesce((best(bids, "price") + best(asks, "price")) / 2, F.lit(0.0))


def spread(bids: Column, asks: Column) -> Column:
    return F.coalesce(best(asks, "price") - best(bids, "price"), F.lit(0.0))


def depth_within(levels: Column, share: float) -> Column:
    """Size at prices within share of the best one, with a hair of tolerance."""
    first = best(levels, "price")
    return total(F.filter(levels, lambda x: F.abs(x["price"] - first) <= first * share * (1 + 1e-9)))


def sweep(levels: Column, size: Column) -> Column:
    """struct<filled, cost, used>: what an order of this size takes, level by level; it may stay partly unfilled."""
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("used"))

    def step(a: Column, x: Column) -> Column:
        take = F.least(x["size"], size - a["filled"])
        on = take > 0
        return F.struct((a["filled"] + F.when(on, take).otherwise(0.0)).alias("filled"), (a["cost"] + F.when(on, take * x["price"]).otherwise(0.0)).alias("cost"), (a["used"] + F.when(on, 1).otherwise(0)).cast("long").alias("used"))

    return F.aggregate(levels, start, step)


def vwap(levels: Column, size: Column) -> Column:
    """Mean price of an order of this size; NaN if the book does not hold it."""
    done = sweep(levels, size)
    return F.when((size <= 0) | (done["filled"] < size), NAN).otherwise(done["cost"] / size)


def liquidity_score(bids: Column, asks: Column, mid_price: Column) -> Column:
    """Depth of five levels a side, less the farther from the middle, as s / (s + 10000)."""
    near = lambda p, i: 1 / (1 + 100 * F.abs(mid_price - p) / mid_price)
    s = total(top(bids, 5), near) + total(top(asks, 5), near)
    return F.when((mid_price <= 0) | (F.size(bids) + F.size(asks) == 0), 0.0).otherwise(s / (s + 10_000))


def herfindahl(levels: Column, n: int = 5) -> Column:
    """Concentration of size over the first n levels; 0 if there is none."""
    few = top(levels, n)
    s = total(few)
    squares = F.aggregate(few, F.lit(0.0), lambda a, x: a + x["size"] * x["size"])
    return F.when(s == 0, 0.0).otherwise(squares / (s * s))
