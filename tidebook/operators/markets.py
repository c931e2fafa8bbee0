"""Measures, types and capital weights of markets; regimes; signals and their costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import stats as S
from ..sources.shared import settled
from . import chains, series


def book_metrics(books: DataFrame) -> DataFrame:
    b, a = F.col("bids"), F.col("asks")
    return books.withColumns(
        {
            "mid": B.mid(b, a),
            "spread": B.spread(b, a),
            "microprice": B.microprice(b, a),
            "imbalance": B.imbalance(b, a),
            "imbalance5": B.multi_level_imbalance(b, a),
            "deep_imbalance": B.deep_imbalance(b, a),
            "bid_depth5": B.total(B.top(b, 5)),
            "ask_depth5": B.total(B.top(a, 5)),
            "bid_depth_5pct": B.depth_within(b, 0.05),
            "liquidity": B.liquidity_score(b, a, B.mid(b, a)),
            "bid_hhi": B.herfindahl(b),
        }
    )


def sweeps(books: DataFrame, size: float) -> DataFrame:
    """book, filled, used and vwap (NaN if the asks hold less) of a buy of this size."""
    done = B.sweep(F.col("asks"), F.lit(float(size)))
    rows = books.withColumn("done", done)
    return rows.select("book", F.col("done.filled").alias("filled"), F.col("done.used").alias("used"), F.when(F.col("done.filled") < size, S.NAN).otherwise(F.col("done.cost") / size).alias("vwap"))


def features(trades: DataFrame, hour: int = 3_600_000) -> DataFrame:
    """One row a market: rate, dispersion, concentration, dominant wallet and bot ratio, as of the last trade of all."""
    now = trades.agg(F.max("ts").alias("now"))
    gap = F.col("ts") - F.col("_was")
    rows = series.lagged(trades, ["market"], ["ts", "event_id"], {"_was": "ts"}).withColumn("gap", F.when(gap > 0, gap)).join(F.broadcast(now))
    whole = (F.abs(F.col("size") - F.round("size")) < 0.01).cast("double")
    base = rows.groupBy("market").agg(
        F.count("*").alias("n"),
        (F.count_if(F.col("ts") > F.col("now") - hour) / 60).alias("rate"),
        F.coalesce(F.var_pop("gap") / F.avg("gap"), F.lit(0.0)).alias("dispersion"),
        F.avg((F.col("gap") < 1000).cast("double")).alias("quick"),
        F.avg(whole).alias("round"),
        F.count("gap").alias("gaps"),
        (1 - F.coalesce(F.stddev_samp("gap") / F.avg("gap"), F.lit(0.0))).alias("regular"),
        (F.max("now") - F.max("ts")).cast("double").alias("stale_ms"),
    )
    unit = lambda c: S.clamp(c, 0.0, 1.0)
    # Signs of programs, the mean of those that there are: quick answers, whole sizes, regular arrivals, many trades.
    signs = F.array(F.when(F.col("gaps") > 0, F.col("quick")), F.col("round"), F.when(F.col("gaps") >= 5, unit(F.col("regular"))), F.when(F.col("rate") > 10, unit((F.col("rate") - 10) / 50)))
    signs = F.filter(signs, lambda x: x.isNotNull())
    bots = F.when(F.col("n") < 5, 0.0).otherwise(F.aggregate(signs, F.lit(0.0), lambda a, x: a + x) / F.size(signs))
    each = trades.groupBy("market", "wallet").agg(F.sum(F.col("ticks") * F.col("size")).alias("v"))
    share = each.withColumn("share", F.col("v") / F.sum("v").over(W.partitionBy("market")))
    who = share.groupBy("market").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top"), F.max_by("wallet", F.struct("share", -F.col("wallet"))).alias("first"))
    who = who.select("market", "hhi", F.when(F.col("top") > 0.2, F.col("first")).alias("dominant"))
    return base.withColumn("bots", bots).join(who, "market").drop("quick", "round", "regular", "gaps")


#: Fixed value: observations that a market keeps of each kind.
KEPT = 1000


def observed(books: DataFrame, now: int, fee: float = 0.02, hour: int = 3_600_000) -> DataFrame:
    """market, spread_bps (mean of the last spreads over 0; null: none), update_ms (mean time between books whose best three levels differ
    from those before; a minute if unknown) and gap_half_life_ms (median time between books at which the outcomes' middle prices are
    off 1 by more than two fees; null for fewer than three), over a market's last observations of each kind, and gaps_1h, how many of
    these gaps are less than an hour old.

    books: market, outcome (0 or 1), ts, event_id, bids, asks, mid, spread_bps: the book of one outcome after each message.
    """
    by, order, books = ["market"], ["ts", "event_id"], settled(books)
    spread = series.buffered(books.where("spread_bps > 0"), by, order, KEPT).groupBy("market").agg(F.avg("spread_bps").alias("spread_bps"))
    top = F.struct(F.slice("bids", 1, 3).alias("b"), F.slice("asks", 1, 3).alias("a"))
    rows = series.lagged(books.withColumn("top", top), by, order, {"was": "top"}).where(F.col("was").isNull() | (F.col("was") != F.col("top")))
    changed = series.buffered(rows.select("market", *order), by, order, KEPT)
    update = changed.groupBy("market").agg(F.when(F.count("*") >= 2, (F.max("ts") - F.min("ts")) / (F.count("*") - 1)).otherwise(60_000.0).alias("update_ms"))
    mids = books.select("market", *order, "outcome", "mid")
    for k in (0, 1):
        mids = series.carried(mids, by, order, F.when(F.col("outcome") == k, F.col("mid")), f"mid{k}", inclusive=True)
    gaps = series.buffered(mids.where(F.abs(F.col("mid0") + F.col("mid1") - 1) > 2 * fee), by, order, KEPT)
    between = settled(series.lagged(gaps, by, order, {"was": "ts"}).withColumn("gap", F.col("ts") - F.col("was")))
    counts = between.groupBy("market").agg(F.count("*").alias("k"), F.count_if(F.col("ts") > now - hour).alias("gaps_1h"))
    enough = counts.where("k >= 3").select("market")
    half = series.quantiles(between, by, "gap", {"gap_half_life_ms": (1, 2)}).join(enough, "market").withColumn("gap_half_life_ms", F.col("gap_half_life_ms").cast("double"))
    rows = books.select("market").distinct().join(spread, "market", "left").join(update, "market", "left").join(half, "market", "left").join(counts.drop("k"), "market", "left")
    return rows.withColumn("gaps_1h", F.coalesce("gaps_1h", F.lit(0)))


def _steps(*rules: tuple[Column, Column]) -> Column:
    """1 for each first condition that holds, else one half if the second does, averaged."""
    total = F.lit(0.0)
    for full, half in rules:
        total = total + F.when(full, 1.0).when(half, 0.5).otherwise(0.0)
    return total / len(rules)


def classify(f: DataFrame) -> DataFrame:
    """f with score1 to score3, type (1 slow, 2 event-driven, 3 automated; ties 1, 3, 2), confidence and efficiency.

    Fixed values: the limits of all steps and the weights.
    f: market, rate, dispersion, hhi, bots, update_ms, stale_ms, spread_bps, gap_half_life_ms (may be NULL).
    """
    u, st, sp, rt, h, b, d, g = (F.col(c) for c in ("update_ms", "stale_ms", "spread_bps", "rate", "hhi", "bots", "dispersion", "gap_half_life_ms"))
    one = _steps((u > 10_000, u > 5_000), (st > 15_000, st > 8_000), (sp > 300, sp > 150), (rt < 2, rt < 5), (h < 0.10, h < 0.15), (b < 0.3, b < 0.5))
    two = _steps((u.between(2_000, 10_000), (u > 1_000) & (u < 15_000)), (rt.between(2, 15), (rt > 1) & (rt < 20)), (d > 2.0, d > 1.2), (h.between(0.10, 0.25), h.between(0.05, 0.35)))
    three = _steps((u < 2_000, u < 3_000), (sp < 100, sp < 200), (st < 3_000, st < 5_000), (h > 0.25, h > 0.15), (b > 0.7, b > 0.5), (g < 3_000, g < 5_000))
    rows = f.withColumns({"score1": one, "score2": two, "score3": three})
    best, all_ = F.greatest("score1", "score2", "score3"), F.col("score1") + F.col("score2") + F.col("score3")
    kind = F.when(best == 0, 2).when(F.col("score1") == best, 1).when(F.col("score3") == best, 3).otherwise(2)
    confidence = F.when(best == 0, 0.3).otherwise(S.clamp(best / all_, 0.1, 1.0))
    part = lambda weight, c, scale: F.when(c > 0, weight / (1 + c / scale)).otherwise(0.0)
    efficiency = S.clamp(part(0.25, sp, 100) + part(0.20, u, 1000) + part(0.20, F.coalesce(g, F.lit(30_000.0)), 2000) + 0.15 * h + part(0.10, st, 2000) + 0.10 * b, 0.0, 1.0)
    return rows.withColumns({"type": kind.cast("long"), "confidence": confidence, "efficiency": efficiency})


def viable(rows: DataFrame, latency_ms: float = 1_000.0) -> DataFrame:
    """rows with strategies: the names that fit the market's type and figures, in one order for all.

    Fixed values: the limits.
    rows: as `classify`, with gaps_1h, the outcomes' gaps of the last hour (see `observed`).
    """
    rt, sp, u, b, k, g = F.col("rate"), F.col("spread_bps"), F.col("update_ms"), F.col("bots"), F.col("type"), F.col("gap_half_life_ms")
    on = lambda name, test: F.when(test, F.lit(name))
    lasting = F.when(k == 3, F.coalesce(g > 2 * latency_ms, F.lit(False))).otherwise(F.coalesce(g > 2 * latency_ms, F.lit(True)))
    names = F.array(
        on("book_imbalance", ((k == 2) & (rt >= 5) | (k == 3)) & (rt > 5) & (u < 5_000) & (sp < 500)),
        on("microprice_dislocation", (k == 2) & (rt > 10) & (sp < 200) & (u < 2_000)),
        on("wallet_follow", k.isin(1, 2)),
        on("large_trade_reaction", (k == 2) | (k == 3) & (rt > 3)),
        on("complement_arb", (F.col("gaps_1h") > 0.5) & lasting),
        on("cross_market_consistency", k.isin(1, 2)),
        on("stale_book", k.isin(1, 2)),
        on("resolution_convergence", k == 1),
        on("new_market_listing", k == 1),
        on("cascade_detection", k.isin(1, 2) & (b < 0.7)),
    )
    return rows.withColumn("strategies", F.filter(names, lambda x: x.isNotNull()))


def edge_map(rows: DataFrame, capital: float) -> DataFrame:
    """market, edge, allocation for markets with a viable strategy: by squared inefficiency, 90 % of the capital in all, 10 % at most for one; and
    label, one for all: trade_actively if a market's confidence is over one half, else trade_selectively."""
    n = F.size("strategies")
    w = F.pow(1 - F.col("efficiency"), 2) * S.clamp(n / 2, 0.1, 1.0)
    live = settled(rows.where(n > 0).withColumn("weight", w))
    total = live.agg(F.sum("weight").alias("total"), F.max(F.col("confidence") > 0.5).alias("sure"))
    share = F.when(F.col("total") > 0, F.least(F.col("weight") / F.col("total") * capital * 0.9, F.lit(capital * 0.1))).otherwise(0.0)
    label = F.when(F.col("sure"), "trade_actively").otherwise("trade_selectively")
    return live.join(F.broadcast(total)).select("market", ((1 - F.col("efficiency")) * 0.05).alias("edge"), share.alias("allocation"), label.alias("label"))


def regime_ticks(events: DataFrame, tick_ms: int = 3_600_000, window: int = 120, least: int = 10) -> DataFrame:
    """tick, volume, active and spread with their z-scores over the last `window` ticks, this one included (0 for the first few), resolutions and new markets.

    events: ts, size, wallet, spread, resolved and fresh (0 or 1). Ticks are few whatever the number of events.
    """
    each = events.groupBy(F.floor(F.col("ts") / tick_ms).alias("tick")).agg(F.sum("size").cast("double").alias("volume"), F.count_distinct("wallet").cast("double").alias("active"), F.avg("spread").alias("spread"), F.sum("resolved").alias("resolutions"), F.sum("fresh").alias("new_markets"))
    frame = W.orderBy("tick").rowsBetween(-(window - 1), 0)
    few = F.count("*").over(frame) < least
    for c in ("volume", "active", "spread"):
        each = each.withColumn(f"{c}_z", F.when(few, 0.0).otherwise(S.z_score(F.col(c), F.avg(c).over(frame), F.stddev_samp(c).over(frame))))
    return each


def regime(volume_z: Column, wallet_z: Column, spread_z: Column, resolutions: Column, new_markets: Column, high: float = 1.5, low: float = -1.0, wallet: float = 1.5, wide: float = 1.5, rate: float = 5.0) -> tuple[Column, Column]:
    """Name and confidence of the regime with the highest score; of equals the first in the order of the tests. Limits and scores."""
    spike, loud = wallet_z >= wallet, volume_z >= high
    res = F.when(resolutions >= rate, 1.0).otherwise(0.0)
    event = F.when(spike & loud, 1.0).when(spike | (new_markets >= rate), 0.6).when(loud & (wallet_z >= 1.0), 0.5).otherwise(0.0)
    wild = F.when((spread_z >= wide) & loud, 1.0).when((spread_z >= wide) & (volume_z > 0), 0.6).otherwise(0.0)
    thin = F.when((spread_z >= wide) & (volume_z <= low), 1.0).when((spread_z >= wide) & (volume_z < 0), 0.5).when(volume_z <= low, 0.4).otherwise(0.0)
    most = F.greatest(res, event, wild, thin)
    normal = F.when(most < 0.4, 0.8).otherwise(F.greatest(F.lit(0.0), 0.3 - most * 0.2))
    best, total = F.greatest(most, normal), res + event + wild + thin + normal
    name = F.when(res == best, "resolution_clustering").when(event == best, "event_driven").when(wild == best, "high_volatility").when(thin == best, "low_liquidity").otherwise("normal")
    return name, F.least(F.lit(1.0), F.when(total > 0, best / total).otherwise(1.0))


def large_trades(trades: DataFrame, sigma: float = 2.0, last: int = 500, least: int = 10) -> DataFrame:
    """trades with z of their size among the market's last ones, itself included, where it is at least sigma."""
    rows = series.framed(trades, ["market"], ["ts", "event_id"], last, lambda f: {"k": F.count("*").over(f), "z": S.z_score(F.col("size"), F.avg("size").over(f), F.stddev_samp("size").over(f))})
    return rows.where((F.col("k") >= least) & (F.col("z") >= sigma)).drop("k")


def impact_cube(large: DataFrame, least: int = 5) -> DataFrame:
    """market, side and both totals: trades and share of those after which the token's next price went back; NULL under `least`."""
    back = F.when(F.col("side") == "BUY", F.col("next_ticks") < F.col("ticks")).otherwise(F.col("next_ticks") > F.col("ticks"))
    cube = large.where("next_ticks is not null").withColumn("back", back.cast("double")).cube("market", "side").agg(F.count("*").alias("n"), F.avg("back").alias("rate"))
    return cube.withColumn("rate", F.when(F.col("n") >= least, F.col("rate")))


def ev_at(ev0: Column, half_life: Column, t: Column) -> Column:
    """Expected value after t; 0.693147 is a fixed value."""
    return F.when(half_life <= 0, 0.0).when(t <= 0, ev0).otherwise(ev0 * F.exp(-0.693147 * t / half_life))


#: Seconds of delay for which a signal is judged.
VIABLE_AT = (1, 2, 3, 5, 10, 15, 20, 30)


def viability(signals: DataFrame, fee: float = 0.02) -> DataFrame:
    """strategy, delay_s, signals, viable: whether the value left after the delay exceeds fee, slippage and impact.

    signals: strategy, ev, half_life_s, size, spread, mid.
    """
    cost = fee + 0.001 * F.col("size") / 100 * F.col("spread") + F.when(F.col("mid") > 0, 0.0005 * F.col("size") / 100).otherwise(0.0)
    each = signals.withColumn("delay_s", F.explode(F.array(*(F.lit(d).cast("long") for d in VIABLE_AT))))
    ok = ev_at(F.col("ev"), F.col("half_life_s"), F.col("delay_s")) > cost
    return each.groupBy("strategy", "delay_s").agg(F.count("*").alias("signals"), F.count_if(ok).alias("viable"))


def signal_filter(signals: DataFrame, min_ev: float = 0.02, max_size: float = 40.0, repeat_ms: int = 5_000, ci: float = -0.10) -> DataFrame:
    """signals with filter: the first test that a signal fails, NULL if it passes all.

    signals: strategy, market, side, ts, event_id, ev, strength, size, target, and, where known, max_price, ci_low, active
    (the market's), assumed and regime. A duplicate is a signal of the same strategy, market and side within repeat_ms of
    the last one that passed; those that fail a test, this one included, do not begin that time anew.
    """
    has = lambda c: F.col(c) if c in signals.columns else None
    off = lambda c: (F.col(c) <= 0) | (F.col(c) >= 1)
    before = [("min_ev", F.col("ev") < min_ev), ("strength", (F.col("strength") <= 0) | (F.col("strength") > 1)), ("size", F.col("size") <= 0), ("max_size", F.col("size") > max_size)]
    after = [("regime", (F.col("assumed") != "") & (F.col("assumed") != F.col("regime"))) if has("assumed") is not None else None, ("ci_low", F.col("ci_low") < ci) if has("ci_low") is not None else None, ("inactive", ~F.col("active")) if has("active") is not None else None, ("target", off("target")), ("target", off("max_price")) if has("max_price") is not None else None]
    after = [x for x in after if x]
    fails = lambda tests: F.coalesce(*(F.when(test, F.lit(name)) for name, test in tests), F.lit(None).cast("string"))
    rows = signals.withColumns({"_before": fails(before), "_after": fails(after)})
    rows = chains.suppressed(rows, ["strategy", "market", "side"], "ts", "event_id", repeat_ms, F.col("_before").isNull() & F.col("_after").isNull())
    again = F.when(F.col("ts") - F.col("last_kept") < repeat_ms, "duplicate")
    return rows.withColumn("filter", F.coalesce("_before", again, "_after")).drop("_before", "_after", "kept", "last_kept")


def executed(orders: DataFrame, books: DataFrame, fee: float = 0.02) -> DataFrame:
    """event_id, book, filled, vwap, fee, slippage, partial: buys swept over the book's asks; nothing filled on an empty side."""
    rows = orders.join(books, "book").withColumn("done", B.sweep(F.col("asks"), F.col("size").cast("double")))
    filled, cost = F.col("done.filled"), F.col("done.cost")
    return rows.select("event_id", "book", filled.alias("filled"), F.when(filled > 0, cost / filled).alias("vwap"), (cost * fee).alias("fee"), F.when(filled > 0, cost / filled - B.best(F.col("asks"), "price")).alias("slippage"), (filled < F.col("size")).alias("partial"))


def attribution(executions: DataFrame) -> DataFrame:
    """market (NULL: all), n, filled, fees, mean slippage: each market and the total."""
    return executions.rollup("market").agg(F.count("*").alias("n"), F.sum("filled").alias("filled"), F.sum("fee").alias("fees"), F.avg("slippage").alias("slippage"))
