"""Consistency of prices between markets: dated questions, prerequisites, sums; how long violations last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import text as X

# Least profit, depth of a leg and size of a trade; shared words; silence that ends a violation.
LEAST, DEPTH, SIZE, SHARED, SILENCE_MS = 0.005, 50.0, 100.0, 0.4, 120_000
# Words of a prerequisite and of what it leads to; the first line that fits counts.
CONDITIONS = [
    (["primary", "nomination", "nominate"], ["general", "election", "president"]),
    (["semifinal", "semi"], ["final", "champion", "win"]),
    (["qualify", "qualification"], ["win", "champion", "medal"]),
    (["round"], ["final", "champion"]),
]


def quotes(books: DataFrame, size: float = SIZE) -> DataFrame:
    """book, mid, best bid and ask with their sizes (null: none), and what an order of this size pays or gets (best price if the book lacks it)."""
    b, a = F.col("bids"), F.col("asks")
    fill = lambda side: F.coalesce(F.nanvl(B.vwap(side, F.lit(size)), F.lit(None)), B.best(side, "price"))
    return books.select("book", B.mid(b, a).alias("mid"), B.best(b, "price").alias("bid"), B.best(b, "size").alias("bid_size"), B.best(a, "price").alias("ask"), B.best(a, "size").alias("ask_size"), fill(b).alias("bid_fill"), fill(a).alias("ask_fill"))


def check_id(kind: Column, ids: list[Column]) -> Column:
    """The kind and its markets, sorted as text."""
    return F.concat(kind, F.lit(":"), F.array_join(F.array_sort(F.array(*(i.cast("string") for i in ids))), ","))


def partitions(markets: DataFrame, fee: float = 0.02) -> DataFrame:
    """Checks of clusters whose prices should add up to 1: over 1 all legs are sold, under 1 bought, at what an order of SIZE gets.

    markets: cluster, market and the columns of `quotes`. Clusters of one market with a price, and gaps under .001, are left out.
    """
    live = markets.where("mid > 0")
    agg = live.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("mid").alias("total"), *(F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("bid_fill", "ask_fill")), *(F.min(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("bid_size", "ask_size")))
    over = F.col("total") > 1
    raw = F.when(over, F.col("bid_fill") - 1).otherwise(1 - F.col("ask_fill")) - fee * F.col("n")
    # Sums of prices depend on their order in the last digits, the limits should not.
    rows = agg.withColumns({"violation": F.round(F.abs(F.col("total") - 1), 9), "raw": F.round(raw, 9), "deep": F.when(over, F.col("bid_size")).otherwise(F.col("ask_size")) >= DEPTH})
    rows = rows.where("n >= 2 and violation >= 0.001").withColumn("tradeable", (F.col("raw") > LEAST) & F.col("deep"))
    return rows.select(F.concat(F.lit("exhaustive_partition:"), F.col("cluster").cast("string")).alias("check_id"), F.lit("exhaustive_partition").alias("kind"), "violation", F.greatest("raw", F.lit(0.0)).alias("executable"), "tradeable", F.when(F.col("tradeable"), F.col("raw") * SIZE).otherwise(0.0).alias("profit"))


def _has(words: Column, some: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, some)))


def pair_kinds(markets: DataFrame, pairs: DataFrame) -> DataFrame:
    """check_id, kind, high, low (markets) of the pairs (a, b) whose questions bind their prices: `high` may not cost more than `low`.

    A question with an earlier date may not cost more than one with a later date (subset_superset; temporal, within a
    category, counts words as often as they occur), nor what has a prerequisite more than that (conditional).
    markets: market, question, category. Pairs come from a graph of markets.
    """
    each = markets.select("market", "category", X.tokens(F.col("question")).alias("words"), X.temporal_order(F.col("question")).alias("place"))
    side = lambda s: each.select(*(F.col(c).alias(f"{s}_{c}") for c in each.columns))
    rows = pairs.select(F.col("a").alias("a_market"), F.col("b").alias("b_market")).join(side("a"), "a_market").join(side("b"), "b_market")
    wa, wb = F.array_distinct("a_words"), F.array_distinct("b_words")
    sets = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb), F.lit(1))
    bags = F.size(F.filter("b_words", lambda w: F.array_contains(F.col("a_words"), w))) / F.greatest(F.size("a_words"), F.size("b_words"), F.lit(1))
    dated = F.coalesce(F.col("a_place") != F.col("b_place"), F.lit(False))
    a_first = F.col("a_place") < F.col("b_place")
    lead = None  # whether a is the prerequisite, by the first line that fits
    for before, after in CONDITIONS:
        pre, out = (lambda w: _has(w, before)), (lambda w: _has(w, after))  # noqa: B023
        for value, (p, o) in ((True, (wa, wb)), (False, (wb, wa))):
            fits = pre(p) & out(o) & ~out(p) & ~pre(o)
            lead = F.when(fits, value) if lead is None else lead.when(fits, value)
    rows = rows.withColumns({"dated_a": F.when(dated, a_first), "lead": F.when(F.size(F.array_intersect(wa, wb)) > 0, lead), "sets": sets, "bags": bags})
    kinds = [
        ("subset_superset", (F.col("sets") >= SHARED) & F.col("dated_a").isNotNull(), F.col("dated_a")),
        ("conditional", F.col("lead").isNotNull(), ~F.col("lead")),
        ("temporal", (F.col("bags") >= SHARED) & F.col("dated_a").isNotNull() & (F.col("a_category") == F.col("b_category")), F.col("dated_a")),
    ]
    # What may not cost more: the earlier question, or the outcome.
    found = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), a_high.alias("a_high"))) for kind, test, a_high in kinds)), lambda x: x.isNotNull())
    rows = rows.withColumn("x", F.explode(found))
    high, low = (F.when(F.col("x.a_high") == v, F.col("a_market")).otherwise(F.col("b_market")) for v in (F.lit(True), F.lit(False)))
    return rows.select(check_id(F.col("x.kind"), [high, low]).alias("check_id"), "x.kind", high.alias("high"), low.alias("low"))


def priced(kinds: DataFrame, quotes: DataFrame, fee: float = 0.02) -> DataFrame:
    """check_id, kind, high, low, violation, executable, tradeable, profit of the checks (as `pair_kinds` gives them) that prices contradict.

    `high` is sold, `low` bought. quotes: market and the columns of `quotes`.
    """
    side = lambda s, end: quotes.select(F.col("market").alias(end), *(F.col(c).alias(f"{s}_{c}") for c in ("mid", "bid_size", "bid_fill", "ask_size", "ask_fill")))
    rows = kinds.join(side("h", "high"), "high").join(side("l", "low"), "low").where("h_mid > 0 and l_mid > 0 and h_mid > l_mid")
    raw = F.col("h_bid_fill") - F.col("l_ask_fill") - 2 * fee  # null without quotes on both sides
    rows = rows.withColumns({"raw": raw, "tradeable": F.coalesce((raw > LEAST) & (F.col("h_bid_size") >= DEPTH) & (F.col("l_ask_size") >= DEPTH), F.lit(False))})
    return rows.select(
        "check_id",
        "kind",
        "high",
        "low",
        (F.col("h_mid") - F.col("l_mid")).alias("violation"),
        F.greatest(F.coalesce("raw", F.lit(0.0)), F.lit(0.0)).alias("executable"),
        "tradeable",
        F.when(F.col("tradeable"), F.col("raw") * SIZE).otherwise(0.0).alias("profit"),
    )


def pair_checks(markets: DataFrame, pairs: DataFrame, fee: float = 0.02) -> DataFrame:
    """The checks of pairs (a, b) that prices contradict. markets: market, question, category and the columns of `quotes`."""
    return priced(pair_kinds(markets, pairs), markets, fee)


def sightings(kinds: DataFrame, prices: DataFrame, fee: float = 0.02) -> DataFrame:
    """check_id, high, low, ts, magnitude, tradeable (by the middle prices, after fees) of the checks that are contradicted at a tick.

    prices: market, ts, mid: the price of each market at each tick.
    """
    side = lambda c, end: prices.select(F.col("market").alias(end), "ts", F.col("mid").alias(c))
    rows = kinds.join(side("h", "high"), "high").join(side("l", "low"), ["low", "ts"]).where("h > 0 and l > 0 and h > l")
    gap = F.col("h") - F.col("l")
    return rows.select("check_id", "high", "low", "ts", gap.alias("magnitude"), (gap - 2 * fee > LEAST).alias("tradeable"))


def report(checks: DataFrame) -> DataFrame:
    """kind (null: all), n, tradeable, profit."""
    return checks.rollup("kind").agg(F.count("*").alias("n"), F.count_if("tradeable").alias("tradeable"), F.sum("profit").alias("profit"))


def violations(seen: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """check_id, k, first_ts, last_ts, n, peak, tradeable and resolved_at (null: active) from observations (check_id, ts, magnitude, tradeable).

    A check that is silent for longer ends; it is resolved at the first later observation of any check, which is when
    that is noticed. The times of observations are few: they are those of the checks' runs.
    """
    w = W.partitionBy("check_id").orderBy("ts")
    rows = seen.groupBy("check_id", "ts").agg(F.max("magnitude").alias("magnitude"), F.bool_or("tradeable").alias("tradeable"))
    rows = rows.withColumn("fresh", F.coalesce(F.col("ts") - F.lag("ts").over(w) > silence_ms, F.lit(True)).cast("int"))
    rows = rows.withColumn("k", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("check_id", "k").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max("magnitude").alias("peak"), F.bool_or("tradeable").alias("tradeable"))
    from .series import asof

    ticks = seen.select(F.lit(1).alias("one"), F.col("ts").alias("at")).distinct().withColumn("ts", F.col("at"))
    later = asof(runs.withColumns({"one": F.lit(1), "ts": F.col("last_ts") + silence_ms + 1}), ticks, "one", "ts", "at", "forward", bucket=3_600_000)
    return later.select(*runs.columns, F.col("at").alias("resolved_at"))


def persistence(found: DataFrame, now: int, within_ms: int = 3_600_000) -> DataFrame:
    """One row: active, resolved (within the time), median (upper, by place) and mean duration, share that was ever tradeable.

    found: as `violations` gives it. An active one has lasted until now, a resolved one until it was last seen.
    """
    rows = found.where(F.col("resolved_at").isNull() | (F.col("resolved_at") > now - within_ms))
    rows = rows.withColumn("lasted", F.when(F.col("resolved_at").isNull(), F.lit(now) - F.col("first_ts")).otherwise(F.col("last_ts") - F.col("first_ts")))
    from .series import quantiles

    agg = rows.agg(F.count_if(F.col("resolved_at").isNull()).alias("active"), F.count("resolved_at").alias("resolved"), F.coalesce(F.avg("lasted"), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.avg(F.col("tradeable").cast("double")), F.lit(0.0)).alias("tradeable"))
    middle = quantiles(rows.withColumn("one", F.lit(1)), ["one"], "lasted", {"median_ms": (1, 2)}).drop("one")
    return agg.withColumn("one", F.lit(1)).join(middle.withColumn("one", F.lit(1)), "one", "left").select("active", "resolved", F.coalesce("median_ms", F.lit(0)).alias("median_ms"), "mean_ms", "tradeable")
