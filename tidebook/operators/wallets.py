"""Measures of a participant's trading, from trades and matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as S


def concentration(trades: DataFrame, by: str = "wallet", over: str = "market") -> DataFrame:
    """by, hhi of notional over `over`, and the largest five of them."""
    each = trades.groupBy(by, over).agg(F.sum(F.col("ticks") * F.col("size")).alias("notional"))
    shared = each.withColumn("share", F.col("notional") / F.sum("notional").over(W.partitionBy(by)))
    ranked = shared.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("notional"), over)))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", F.col(over).alias("what"))))), lambda x: x["what"].cast("string"))
    return ranked.groupBy(by).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.array_join(first, ",").alias("top"))


def active_hours(trades: DataFrame) -> DataFrame:
    """wallet, hour, trades: all 24 hours of each wallet (UTC)."""
    hours = trades.groupBy("wallet", F.hour(F.timestamp_millis("ts")).alias("hour")).agg(F.count("*").alias("trades"))
    grid = trades.select("wallet").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(hours, ["wallet", "hour"], "left").select("wallet", F.col("hour").cast("long").alias("hour"), F.coalesce("trades", F.lit(0)).alias("trades"))


def round_trip_rate(trades: DataFrame) -> DataFrame:
    """wallet, rate: the share of its markets in which it traded two tokens or more."""
    each = trades.groupBy("wallet", "market").agg(F.count_distinct("token").alias("tokens"))
    return each.groupBy("wallet").agg(F.avg((F.col("tokens") >= 2).cast("double")).alias("rate"))


def market_maker_score(trades: DataFrame, least: int = 4) -> DataFrame:
    """wallet, score: balance of buys and sells and use of both tokens, over markets with at least `least` trades."""
    each = trades.groupBy("wallet", "market").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "BUY").alias("b"), F.count_distinct("token").alias("tokens"))
    one = 0.6 * (1 - F.abs(2 * F.col("b") - F.col("n")) / F.col("n")) + 0.4 * (F.col("tokens") >= 2).cast("double")
    return each.groupBy("wallet").agg(F.coalesce(F.avg(F.when(F.col("n") >= least, one)), F.lit(0.0)).alias("score"))


def timing(trades: DataFrame) -> DataFrame:
    """wallet, peak hour and weekday (0 is Sunday; first of equals), and concentration over hours and weekdays."""
    at = F.timestamp_millis("ts")
    out = None
    for name, bin_ in (("hour", F.hour(at)), ("day", F.dayofweek(at) - 1)):
        each = trades.groupBy("wallet", bin_.alias("bin")).agg(F.count("*").alias("n"))
        one = each.groupBy("wallet").agg(F.min_by("bin", F.struct(-F.col("n"), "bin")).cast("long").alias(f"peak_{name}"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias(f"{name}_hhi"))
        out = one if out is None else out.join(one, "wallet")
    return out


def clustering(trades: DataFrame, by: str = "wallet") -> DataFrame:
    """by, score: population variance over squared mean of the times between trades; 0 for fewer than 3 trades."""
    gap = trades.withColumn("gap", F.col("ts") - F.lag("ts").over(W.partitionBy(by).orderBy("ts", "event_id")))
    score = F.var_pop("gap") / (F.avg("gap") * F.avg("gap"))
    return gap.groupBy(by).agg(F.when((F.count("*") < 3) | (F.avg("gap") == 0), 0.0).otherwise(score).alias("score"))


def drawdown_and_streak(pairs: DataFrame) -> DataFrame:
    """wallet, max_drawdown (from a peak of at least 0) and loss_streak (longest run of losses), in order of exits."""
    order = W.partitionBy("wallet").orderBy("exit_ts", "exit_id", "entry_id")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = pairs.withColumn("cum", F.sum("pnl_ticks").over(upto)).withColumn("wins", F.count_if(F.col("pnl_ticks") >= 0).over(upto))
    rows = rows.withColumn("fall", F.greatest(F.lit(0), F.max("cum").over(upto)) - F.col("cum"))
    fall = rows.groupBy("wallet").agg(F.max("fall").alias("max_drawdown"))
    run = rows.groupBy("wallet", "wins").agg(F.count_if(F.col("pnl_ticks") < 0).alias("losses")).groupBy("wallet").agg(F.max("losses").alias("loss_streak"))
    return fall.join(run, "wallet")


def statistics(pairs: DataFrame) -> DataFrame:
    """wallet and its figures over matched pairs: counts, profit, holding times, ratios and a significance test."""
    pnl = F.col("pnl_ticks") / 100
    agg = pairs.groupBy("wallet").agg(
        F.count("*").alias("n"),
        F.sum("pnl_ticks").alias("pnl_ticks"),
        F.avg((F.col("pnl_ticks") > 0).cast("double")).alias("win_rate"),
        F.avg(F.col("exit_ts") - F.col("entry_ts")).alias("avg_hold_ms"),
        F.avg("size").alias("avg_size"),
        F.avg(pnl).alias("m"),
        F.stddev_samp(pnl).alias("sd"),
        F.sqrt(F.sum(F.when(pnl < 0, pnl * pnl).otherwise(0.0)) / F.count("*")).alias("downside"),
    )
    t, p = S.t_test(F.col("n"), F.col("m"), F.col("sd"))
    sortino = F.when(F.col("n") < 2, 0.0).when(F.col("downside") == 0, F.when(F.col("m") > 0, float("inf")).otherwise(0.0)).otherwise(F.col("m") / F.col("downside"))
    out = agg.withColumns({"sharpe": F.when(F.col("n") < 2, 0.0).otherwise(S.sharpe(F.col("m"), F.col("sd"))), "sortino": sortino, "t": t, "p": p, "d": F.when(F.col("n") < 2, S.NAN).otherwise(S.cohens_d(F.col("m"), F.col("sd")))})
    from .series import quantiles

    middle = quantiles(pairs.withColumn("hold", F.col("exit_ts") - F.col("entry_ts")), ["wallet"], "hold", {"median_hold_ms": (1, 2)})
    return out.drop("m", "sd", "downside").join(middle, "wallet")


#: Delays of a follower, in hours of the series' time.
DELAYS_MS = [h * 3_600_000 for h in (1, 2, 3, 5, 10, 15, 20, 30, 45, 60)]


def delay_curve(pairs: DataFrame, trades: DataFrame, delays: list[int] | None = None, gap: int = 43_200_000) -> DataFrame:
    """wallet, delay_ms, n, mean_pnl, win_rate, ir, t, p: pairs entered later, at the price nearest to that time within gap.

    Pairs that would be entered at their exit or after it do not count. With a single pair there is a mean and nothing else.
    """
    late = pairs.withColumn("delay_ms", F.explode(F.array(*(F.lit(d).cast("long") for d in delays or DELAYS_MS))))
    late = late.withColumn("ts", F.col("entry_ts") + F.col("delay_ms")).where("ts < exit_ts")
    series = trades.groupBy("token", "ts").agg(F.max("ticks").alias("at_ticks"))
    from .series import asof

    priced = asof(late, series, "token", "ts", "at_ticks", "nearest", gap, bucket=3_600_000).where("at_ticks is not null")
    gain = F.col("exit_ticks") - F.col("at_ticks")
    # Gains are added up in ticks, so equal means are equal and a sum of zero is one in any order; equal gains have no deviation.
    pnl = gain * F.col("size")
    sd = F.when(F.min(pnl) == F.max(pnl), 0.0).otherwise(F.stddev_samp(pnl / 100))
    agg = priced.groupBy("wallet", "delay_ms").agg(F.count("*").alias("n"), (F.sum(pnl) / F.count("*") / 100).alias("mean_pnl"), sd.alias("sd"), F.avg((gain > 0).cast("double")).alias("w"))
    t, p = S.t_test(F.col("n"), F.col("mean_pnl"), F.col("sd"))
    one = F.col("n") < 2
    ir = F.when(F.col("sd") > 0, F.col("mean_pnl") / F.col("sd")).when(F.col("mean_pnl") > 0, float("inf")).otherwise(0.0)
    return agg.select("wallet", "delay_ms", "n", "mean_pnl", *(F.when(one, v).otherwise(c).alias(name) for name, v, c in (("win_rate", 0.0, F.col("w")), ("ir", 0.0, ir), ("t", 0.0, t), ("p", 1.0, p))))


def delay_advice(wallets: DataFrame, curve: DataFrame, latency_ms: int, delays: list[int] | None = None, significant: float = 0.05) -> DataFrame:
    """wallet, n, ir, advice and best_ms (the delay with the highest significantly positive mean; null: none), at the delay nearest to the latency (of equals the first).

    Fixed values: five pairs at least, t under -1.645 to fade.
    """
    at = min(delays or DELAYS_MS, key=lambda d: abs(d - latency_ms))
    sure = (F.col("p") < significant) & (F.col("mean_pnl") > 0)
    best = curve.where(sure).groupBy("wallet").agg(F.min_by("delay_ms", F.struct(-F.col("mean_pnl"), "delay_ms")).alias("best_ms"))
    here = curve.where(F.col("delay_ms") == at).drop("delay_ms")
    advice = F.when(F.coalesce("n", F.lit(0)) < 5, "shadow_only").when(sure, "follow").when((F.col("mean_pnl") < 0) & (F.col("t") < -1.645), "fade").when(F.col("mean_pnl") > 0, "shadow_only").otherwise("ignore")
    rows = wallets.select("wallet").join(here, "wallet", "left").join(best, "wallet", "left")
    return rows.select("wallet", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ir", F.lit(0.0)).alias("ir"), "win_rate", "t", advice.alias("advice"), "best_ms")


def half_life(curve: DataFrame) -> DataFrame:
    """wallet, halflife_ms, breakeven_ms: where the mean falls to half of the first delay's, and to zero, between delays.

    NULL where it never does; a first mean of zero or less breaks even at once and has no half-life.
    """
    w = W.partitionBy("wallet").orderBy("delay_ms")
    rows = curve.withColumns({"p0": F.lag("mean_pnl").over(w), "d0": F.lag("delay_ms").over(w), "first": F.first("mean_pnl").over(w)})
    step = F.col("delay_ms") - F.col("d0")
    half = F.col("first") / 2
    at_half = F.when((F.col("first") > 0) & (F.col("mean_pnl") <= half) & (F.col("p0") > half), F.col("d0") + (F.col("p0") - half) / (F.col("p0") - F.col("mean_pnl")) * step)
    at_zero = F.when((F.col("first") > 0) & (F.col("mean_pnl") <= 0) & (F.col("p0") > 0), F.col("d0") + F.col("p0") / (F.col("p0") - F.col("mean_pnl")) * step)
    agg = rows.groupBy("wallet").agg(F.max("first").alias("first"), F.min(at_half).alias("halflife_ms"), F.min(at_zero).alias("zero"))
    return agg.select("wallet", "halflife_ms", F.when(F.col("first") <= 0, 0.0).otherwise(F.col("zero")).alias("breakeven_ms"))


def classify(stats: DataFrame, trades: DataFrame, maker: DataFrame, trips: DataFrame, consistency: DataFrame, least: int = 30, p: float = 0.05) -> DataFrame:
    """wallet, trades, class and confidence.

    Under `least` trades by the first rule that fits, with a third of the usual confidence; else by the highest score (of
    equals the first in the order of the rules). Fixed values: the rules' limits and weights.
    stats: as `statistics`; consistency: wallet and consistency of its ratios over regimes (one half if unknown).
    """
    count = trades.groupBy("wallet").agg(F.count("*").alias("trades"))
    rows = count.join(stats, "wallet", "left").join(maker, "wallet").join(trips, "wallet").join(consistency, "wallet", "left")
    hold, win = F.coalesce("median_hold_ms", F.lit(0)) / 1000, F.coalesce("win_rate", F.lit(0.0))
    ratio, trip, maker_score = F.coalesce("sharpe", F.lit(0.0)), F.col("rate"), F.col("score")
    few = F.col("trades") < least
    first = F.when((hold > 0) & (hold < 300) & (win > 0.6), "sniper").when(trip > 0.5, "arbitrageur").when(maker_score > 0.7, "market_maker").when((hold > 3600) & (ratio > 1.0), "swing").otherwise("unclassified")
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    scores = [
        ("sniper", (hold > 0) & (hold < 300), 0.5 * (1 - hold / 300) + 0.5 * F.greatest((win - 0.5) * 5, F.lit(0.0))),
        ("arbitrageur", trip > 0.3, trip),
        ("market_maker", maker_score > 0.5, maker_score),
        ("swing", hold > 3600, 0.4 * F.least(F.lit(1.0), hold / 14_400) + 0.6 * unit(ratio / 2)),
        ("noise", ratio < 0.3, 0.8 * F.greatest(1 - ratio / 0.3, F.lit(0.0))),
    ]
    each = F.filter(F.array(*(F.when(test, F.struct(F.round(-score, 12).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, test, score) in enumerate(scores))), lambda x: x.isNotNull())
    best = F.array_min(each)
    sure = F.coalesce((F.col("p") < p) & (F.col("n") >= least), F.lit(False))
    size = F.least(F.lit(1.0), F.col("trades") / least)
    full = F.when(F.size(each) == 0, 0.3).otherwise(F.least(F.lit(1.0), -best["s"] * size + F.when(sure, 0.15).otherwise(0.0) + 0.1 * F.coalesce("consistency", F.lit(0.5))))
    none = F.col("trades") < 2
    name = F.when(none, "unclassified").when(few, first).otherwise(F.coalesce(best["name"], F.lit("unclassified")))
    return rows.select("wallet", "trades", name.alias("class"), F.when(none, 0.0).when(few, size * 0.3).otherwise(full).alias("confidence"))


def follow_score(stats: DataFrame, risk: DataFrame, advice: DataFrame, profile: DataFrame, trades: DataFrame, window_days: float = 30.0) -> DataFrame:
    """wallet, score and recommendation. The weights, the limits and how each part is scaled.

    .35 delayed ratio (from two pairs on), .20 consistency (from five trades on), .15 significance, .10 raw ratio and
    profit, .10 robustness over regimes (one half if unknown), .05 count, .05 recency. Where the delays advise to fade
    or to follow, that goes before the score.
    """
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    now = trades.agg(F.max("ts").alias("now"))
    last = trades.groupBy("wallet").agg(F.max("ts").alias("last"), F.count("*").alias("trades"))
    delayed = advice.select("wallet", F.col("n").alias("k"), "ir", "advice")
    rows = stats.join(risk, "wallet").join(last, "wallet").join(delayed, "wallet", "left").join(profile.select("wallet", "robustness").distinct(), "wallet", "left").join(F.broadcast(now))
    days = (F.col("now") - F.col("last")) / 86_400_000
    ratio = unit(F.col("sharpe") / 2)
    late = F.when(F.col("k") >= 2, unit(F.col("ir") / 2)).otherwise(0.0)
    steady = F.when(F.col("trades") >= 5, 0.4 * 4 * F.greatest(F.col("win_rate") - 0.5, F.lit(0.0)) + 0.3 * F.greatest(1 - F.col("loss_streak") / 10, F.lit(0.0)) + 0.3 * ratio).otherwise(0.0)
    raw = F.when(F.col("trades") >= 2, 0.7 * ratio + F.when(F.col("pnl_ticks") > 0, 0.15).otherwise(0.0)).otherwise(0.0)
    recency = F.when(days <= 0, 1.0).when(days >= window_days, 0.0).otherwise(F.exp(-0.693 * days / (window_days / 3)))
    score = 0.35 * F.coalesce(late, F.lit(0.0)) + 0.20 * steady + 0.15 * unit(F.nanvl("t", F.lit(0.0)) / 3) + 0.10 * raw + 0.10 * F.coalesce("robustness", F.lit(0.5)) + 0.05 * F.least(F.lit(1.0), F.col("trades") / 30) + 0.05 * recency
    rows = rows.withColumn("score", F.round(score, 9))
    s, by_delay = F.col("score"), F.coalesce("advice", F.lit(""))
    name = F.when((by_delay == "fade") & (s < 0.3), "fade").when((by_delay == "follow") & (s >= 0.4), "follow").when(s >= 0.6, "follow").when(s >= 0.15, "shadow_only").otherwise("ignore")
    return rows.select("wallet", "score", name.alias("recommendation"))


def follow_parameters(trades: DataFrame, advice: DataFrame, curve: DataFrame, capital: float, default_ms: int) -> DataFrame:
    """wallet, delay_ms, least_size (the notional a quarter of its trades stay under) and allocation (a quarter of the ratio, 10 % at most; 2 % without an edge)."""
    from .series import quantiles

    sizes = quantiles(trades.withColumn("notional", F.col("ticks") * F.col("size")), ["wallet"], "notional", {"q": (1, 4)})
    at = advice.select("wallet", F.coalesce("best_ms", F.lit(default_ms)).alias("delay_ms"))
    rows = at.join(curve.select("wallet", "delay_ms", "win_rate", "ir"), ["wallet", "delay_ms"], "left").join(sizes, "wallet")
    edge = F.coalesce((F.col("win_rate") > 0.5) & (F.col("ir") > 0), F.lit(False))
    share = F.when(edge, F.least(F.lit(0.1), 0.25 * F.col("ir"))).otherwise(0.02)
    return rows.select("wallet", "delay_ms", (F.col("q") / 100).alias("least_size"), (share * capital).alias("allocation"))


def positions(trades: DataFrame, fee: float = 0.02) -> DataFrame:
    """wallet, market, token, size, avg_entry, unrealized: buys added up, marked at the token's last price, less fees."""
    mark = trades.groupBy("token").agg((F.max_by("ticks", "event_id") / 100).alias("mark"))
    held = trades.where("side = 'BUY'").groupBy("wallet", "market", "token").agg(F.sum("size").alias("size"), (F.sum(F.col("size") * F.col("ticks")) / F.sum("size") / 100).alias("avg_entry"))
    gain = (F.col("mark") - F.col("avg_entry")) * F.col("size") - fee * F.col("avg_entry") * F.col("size")
    return held.join(mark, "token").withColumn("unrealized", gain)
