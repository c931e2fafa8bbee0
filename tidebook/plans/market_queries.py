"""Queries on books, series, markets, texts and lead-lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import chains, graph, markets, series
from ..sources import views
from ..sources.shared import written
from . import message_queries as messages
from . import sql
from .wallet_queries import r, r_expr

HOUR = 3_600_000


def book_metrics(spark, sf_dir):
    m = markets.book_metrics(views.books(spark, sf_dir))
    return m.select("book", *(r(c) for c in _BOOK))


_BOOK = ("mid", "spread", "microprice", "imbalance", "imbalance5", "deep_imbalance", "bid_depth5", "ask_depth5", "bid_depth_5pct", "liquidity", "bid_hhi")


def vwap_sweep(spark, sf_dir):
    return markets.sweeps(views.books(spark, sf_dir), 60).select("book", "filled", "used", r("vwap"))


def rolling_stats(spark, sf_dir):
    p = views.prices(spark, sf_dir)
    return series.rolling(p, ["series"], ["ts", "event_id"], "price", 20, 15.874507866387544).select("event_id", "series", r("mean"), r("sd"), r("sharpe"))


def volatility(spark, sf_dir):
    return series.volatility(views.prices(spark, sf_dir), "series", ["ts", "event_id"], "price").select("series", r("volatility"))


def autocorrelation(spark, sf_dir):
    return series.autocorrelation(views.prices(spark, sf_dir), "series", ["ts", "event_id"], "price").select("series", r("autocorrelation"))


def linreg(spark, sf_dir):
    p = views.prices(spark, sf_dir).withColumn("x", F.col("event_id").cast("double"))
    return series.regression(p, "series", "x", "price").select("series", r("slope", 9), r("intercept"), r("r2"), r("t"), r("p"))


def bh_adjust(spark, sf_dir):
    p = _p_values(spark, sf_dir)
    return series.adjusted(p, "user_id", "p").select("user_id", r("p"), r("bh"), r("bonferroni"))


def _p_values(spark, sf_dir) -> DataFrame:
    e = views.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    mu = 50.0
    t, p = S.t_test(F.col("n"), F.col("m"), F.col("sd"), mu)
    return e.where("n >= 2").select("user_id", F.round(p, 9).alias("p"))


def percentile_rank(spark, sf_dir):
    return series.percentile_rank(views.prices(spark, sf_dir), "series", "price").select("event_id", r("rank"))


def asof_backward(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    buys = t.where("side = 'BUY'").select("event_id", "token", "ts")
    sells = t.where("side = 'SELL'").select("token", "ts", F.col("ticks").alias("price"))
    return series.asof(buys, sells, "token", "ts", "price", "backward", 30 * 60_000).select("event_id", "price", F.col("value_ts").alias("price_ts"))


def forward_returns(spark, sf_dir):
    p = views.prices(spark, sf_dir).where("price > 0")
    ahead = p.withColumn("ts", F.col("ts") + HOUR).select("series", "event_id", "ts", F.col("price").alias("p0"))
    points = p.groupBy("series", "ts").agg(F.max("price").alias("later"))
    found = series.asof(ahead, points, "series", "ts", "later", "nearest", 15 * 60_000, bucket=HOUR)
    return found.where("later is not null").select("event_id", r_expr((F.col("later") - F.col("p0")) / F.col("p0"), "forward_return"))


def feature_z(spark, sf_dir):
    p = series.framed(views.prices(spark, sf_dir), ["series"], ["ts", "event_id"], 120, lambda f: {"k": F.count("*").over(f), "z": S.z_score(F.col("price"), F.avg("price").over(f), F.stddev_samp("price").over(f))})
    return p.select("event_id", r_expr(F.when(F.col("k") < 5, 0.0).otherwise(F.col("z")), "z"))


def regime_ticks(spark, sf_dir):
    return _regimes(spark, sf_dir).select("tick", r("volume_z"), r("active_z"), r("spread_z"), "resolutions", "new_markets", "regime", r("confidence"))


def _regimes(spark, sf_dir) -> DataFrame:
    first = F.row_number().over(W.partitionBy("wallet", "token").orderBy("ts", "event_id")) == 1
    events = views.trades(spark, sf_dir).withColumns({"spread": F.col("ticks").cast("double"), "resolved": (F.col("event_id") % 31 == 0).cast("int"), "fresh": first.cast("int")})
    t = markets.regime_ticks(events).withColumns({f"{c}_z": F.round(f"{c}_z", 9) for c in ("volume", "active", "spread")})
    name, confidence = markets.regime(F.col("volume_z"), F.col("active_z"), F.col("spread_z"), F.col("resolutions"), F.col("new_markets"))
    return t.withColumns({"regime": name, "confidence": confidence})


REGIMES = ["resolution_clustering", "event_driven", "high_volatility", "low_liquidity", "normal"]


def transition_matrix(spark, sf_dir):
    m = series.transitions(_regimes(spark, sf_dir).withColumn("one", F.lit(1)), "one", "tick", "regime", REGIMES)
    return m.select("from_state", "to_state", "n", r("share"))


def regime_spans(spark, sf_dir):
    t = _regimes(spark, sf_dir)
    change = t.withColumn("old", F.lag("regime").over(W.orderBy("tick"))).where("old is null or old <> regime")
    events = change.select((F.col("tick") * HOUR).alias("ts"), F.col("regime").alias("state"))
    return series.spans_of(events, "ts", "state", 1 << 42)


def _confirmed(spark, sf_dir) -> DataFrame:
    return series.confirmed(_regimes(spark, sf_dir).withColumn("one", F.lit(1)), "one", "tick", "regime")


def regime_confirmed(spark, sf_dir):
    return _confirmed(spark, sf_dir).select("tick", "regime", "current")


def regime_durations(spark, sf_dir):
    """Of the confirmed spans that are over."""
    t = _confirmed(spark, sf_dir)
    change = t.withColumn("old", F.lag("current").over(W.partitionBy("one").orderBy("tick"))).where("old is null or old <> current")
    spans = change.select((F.col("tick") * HOUR).alias("start"), F.lead(F.col("tick") * HOUR).over(W.partitionBy("one").orderBy("tick")).alias("end"), F.col("current").alias("state")).where("end is not null")
    return series.durations(spans, REGIMES).select("state", "n", r("mean_ms", 3))


def large_trades(spark, sf_dir):
    return markets.large_trades(views.trades(spark, sf_dir)).select("event_id", "market", r("z"))


def impact_cube(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    after = series.lagged(t, ["token"], ["ts", "event_id"], {"next_ticks": "ticks"}, ahead=True).select("event_id", "next_ticks")
    cube = markets.impact_cube(markets.large_trades(t, sigma=1.0).join(after, "event_id"))
    return cube.select("market", "side", "n", r("rate"))


def market_types(spark, sf_dir):
    return _types(spark, sf_dir).select("market", r("rate"), r("dispersion", 3), r("hhi"), r("bots"), r("spread_bps", 4), r("update_ms", 3), "gap_half_life_ms", "gaps_1h", "dominant", r("score1"), r("score2"), r("score3"), "type", r("confidence"), r("efficiency"))


def _types(spark, sf_dir) -> DataFrame:
    t = views.trades(spark, sf_dir)
    now = t.agg(F.max("ts")).first()[0] or 0
    seen = markets.observed(messages.books_after(spark, sf_dir), now)
    f = markets.features(t).join(seen, "market", "left").withColumns({"spread_bps": F.coalesce("spread_bps", F.lit(0.0)), "update_ms": F.coalesce("update_ms", F.lit(60_000.0)), "gaps_1h": F.coalesce("gaps_1h", F.lit(0))})
    return written(markets.classify(f), "types")


def edge_map(spark, sf_dir):
    return markets.edge_map(markets.viable(_types(spark, sf_dir)), 10_000.0).select("market", r("edge"), r("allocation"), "label")


def viable_strategies(spark, sf_dir):
    return markets.viable(_types(spark, sf_dir)).select("market", "type", F.array_join("strategies", ",").alias("strategies"))


def _signals(spark, sf_dir) -> DataFrame:
    t = views.trades(spark, sf_dir)
    return t.select(F.concat(F.lit("s"), F.col("token")).alias("strategy"), "market", "side", "ts", "event_id", (F.col("ticks") / 1000).alias("ev"), (F.col("size") / 50).alias("strength"), "size", (F.col("ticks") / 100).alias("target"), (F.col("token") + 1).cast("double").alias("half_life_s"), F.lit(0.03).alias("spread"), (F.col("ticks") / 100).alias("mid"))


def viability_matrix(spark, sf_dir):
    return markets.viability(_signals(spark, sf_dir)).select("strategy", "delay_s", "signals", "viable")


#: How long a signal makes others of its kind repeats.
REPEAT = 6 * HOUR


def _tested(spark, sf_dir) -> DataFrame:
    """Signals with what they assume (the regime of the hour before), the regime that there is, and whether their market, two of which end half-way, is active."""
    t = views.trades(spark, sf_dir)
    hours = _regimes(spark, sf_dir).select("tick", "regime", F.coalesce(F.lag("regime").over(W.orderBy("tick")), F.lit("")).alias("assumed"))
    ends = t.where("market < 2").groupBy("market").agg((F.min("ts") + F.floor((F.max("ts") - F.min("ts")) / 2)).cast("long").alias("end"))
    rows = _signals(spark, sf_dir).withColumns({"tick": F.floor(F.col("ts") / HOUR), "max_price": F.col("target") + 0.03, "ci_low": F.col("ev") - F.col("size") / 500})
    return rows.join(hours, "tick").join(ends, "market", "left").withColumn("active", F.coalesce(F.col("ts") < F.col("end"), F.lit(True)))


def signal_filter(spark, sf_dir):
    return markets.signal_filter(_tested(spark, sf_dir), repeat_ms=REPEAT).select("event_id", "filter")


def _executed(spark, sf_dir) -> DataFrame:
    t = views.trades(spark, sf_dir).where("side = 'BUY'")
    orders = t.select("event_id", "market", (F.col("event_id") % 200 + 1).alias("book"), (F.col("size") * 3).alias("size"))
    return markets.executed(orders, views.books(spark, sf_dir)).join(orders.select("event_id", "market"), "event_id")


def paper_execute(spark, sf_dir):
    return _executed(spark, sf_dir).select("event_id", "book", "filled", r("vwap", 9), r("fee", 9), r("slippage", 9), "partial")


def attribution_rollup(spark, sf_dir):
    return markets.attribution(_executed(spark, sf_dir)).select("market", "n", "filled", r("fees", 4), r("slippage"))


def token_df(spark, sf_dir):
    q = views.questions(spark, sf_dir).select(F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("term"))
    return q.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(spark, sf_dir):
    q = views.questions(spark, sf_dir).select("market", X.tokens(F.col("question")).alias("words"))
    return X.tfidf(q, "market", "words").select("market", "term", r("weight"))


def _classes(spark, sf_dir) -> DataFrame:
    return graph.classes(views.questions(spark, sf_dir))


def _class_rows(spark, sf_dir) -> DataFrame:
    return _classes(spark, sf_dir).where(F.col("market") == F.col("class")).select("class", "question", "category")


def question_classes(spark, sf_dir):
    return _classes(spark, sf_dir).select("market", "class")


def similarity_pairs(spark, sf_dir):
    """Between classes of markets with one question and category; `question_classes` has their members."""
    return graph.similar_pairs(_class_rows(spark, sf_dir), "class", 0.3).select("a", "b", r("shared"), r("similarity"), "kind")


def _clusters(spark, sf_dir) -> DataFrame:
    """market, question, cluster of every market."""
    rows = _class_rows(spark, sf_dir)
    found = graph.clusters(rows.select(F.col("class").alias("id")), graph.similar_pairs(rows, "class", 0.34))
    return _classes(spark, sf_dir).join(found.withColumnRenamed("id", "class"), "class").select("market", "question", "cluster")


def question_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select(F.col("market").alias("id"), "cluster")


def cluster_descriptions(spark, sf_dir):
    return graph.descriptions(_clusters(spark, sf_dir)).select("cluster", "n", "words")


def temporal_order(spark, sf_dir):
    d = views.read(spark, sf_dir, "benchmark")
    return d.select("item_id", X.temporal_order(F.col("text")).alias("place"))


def sessions(spark, sf_dir):
    e = views.read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    s = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), "n", "peak")


def source_health(spark, sf_dir):
    e = views.prices(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    h = e.groupBy("series").agg(F.count("*").alias("n"), F.max("ts").alias("last")).join(F.broadcast(now))
    age = F.col("now") - F.col("last")
    return h.select("series", "n", age.alias("age_ms"), F.when(age > 600_000, "stale").otherwise("ok").alias("status"))


DEDUP = 12 * HOUR


def dedup(spark, sf_dir):
    """Trades of a wallet and token that are no repeats: the last one kept lies half a day or more before."""
    e = chains.suppressed(views.trades(spark, sf_dir), ["wallet", "token"], "ts", "event_id", DEDUP)
    return e.where("kept").select("event_id", "wallet", "token")


_F = "FROM v_levels"
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda w: len(w) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "], w))"
_REG = f"""{sql.TRADES}, a AS (SELECT ts // 3600000 AS tick, CAST(sum(size) AS DOUBLE) AS volume, CAST(count(DISTINCT wallet) AS DOUBLE) AS active, avg(CAST(ticks AS DOUBLE)) AS spread, count(*) FILTER (event_id % 31 = 0) AS resolutions, count(*) FILTER (fresh = 1) AS new_markets
  FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY ts, event_id) AS fresh FROM v_trades) GROUP BY 1),
z0 AS (SELECT *, count(*) OVER w AS k, avg(volume) OVER w AS mv, stddev_samp(volume) OVER w AS sv, avg(active) OVER w AS ma, stddev_samp(active) OVER w AS sa, avg(spread) OVER w AS ms, stddev_samp(spread) OVER w AS ss FROM a WINDOW w AS (ORDER BY tick ROWS 119 PRECEDING)),
z AS (SELECT tick, resolutions, new_markets, round(CASE WHEN k < 10 OR sv = 0 THEN 0.0 ELSE (volume - mv) / sv END, 9) AS volume_z, round(CASE WHEN k < 10 OR sa = 0 THEN 0.0 ELSE (active - ma) / sa END, 9) AS active_z, round(CASE WHEN k < 10 OR ss = 0 THEN 0.0 ELSE (spread - ms) / ss END, 9) AS spread_z FROM z0),
s AS (SELECT *, CASE WHEN resolutions >= 5 THEN 1.0 ELSE 0.0 END AS res, CASE WHEN active_z >= 1.5 AND volume_z >= 1.5 THEN 1.0 WHEN active_z >= 1.5 OR new_markets >= 5 THEN 0.6 WHEN volume_z >= 1.5 AND active_z >= 1.0 THEN 0.5 ELSE 0.0 END AS ev,
  CASE WHEN spread_z >= 1.5 AND volume_z >= 1.5 THEN 1.0 WHEN spread_z >= 1.5 AND volume_z > 0 THEN 0.6 ELSE 0.0 END AS wild, CASE WHEN spread_z >= 1.5 AND volume_z <= -1 THEN 1.0 WHEN spread_z >= 1.5 AND volume_z < 0 THEN 0.5 WHEN volume_z <= -1 THEN 0.4 ELSE 0.0 END AS thin FROM z),
n AS (SELECT *, CASE WHEN greatest(res, ev, wild, thin) < 0.4 THEN 0.8 ELSE greatest(0.0, 0.3 - greatest(res, ev, wild, thin) * 0.2) END AS normal FROM s),
m AS (SELECT *, greatest(res, ev, wild, thin, normal) AS best FROM n),
reg AS (SELECT *, CASE WHEN res = best THEN 'resolution_clustering' WHEN ev = best THEN 'event_driven' WHEN wild = best THEN 'high_volatility' WHEN thin = best THEN 'low_liquidity' ELSE 'normal' END AS regime, least(1.0, best / (res + ev + wild + thin + normal)) AS confidence FROM m)"""
_CONFIRMED = f"""{_REG}, c0 AS (SELECT *, CASE WHEN regime = lag(regime) OVER (ORDER BY tick) THEN 0 ELSE 1 END AS nw FROM reg), c1 AS (SELECT *, sum(nw) OVER (ORDER BY tick) AS run FROM c0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY tick) AS k FROM c1), conf AS (SELECT tick, regime, coalesce(last_value(CASE WHEN k >= 2 THEN regime END IGNORE NULLS) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING), 'normal') AS current FROM c2)"""
_LARGE = f"""{sql.TRADES}, lz AS (SELECT *, count(*) OVER w AS k, avg(size) OVER w AS m, stddev_samp(size) OVER w AS sd FROM v_trades WINDOW w AS (PARTITION BY market ORDER BY ts, event_id ROWS 499 PRECEDING)),
large AS (SELECT *, CASE WHEN sd = 0 THEN 0.0 ELSE (size - m) / sd END AS z FROM lz WHERE k >= 10)"""
_TYPES = f"""{messages._OBSERVED}, g0 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY market ORDER BY ts, event_id) AS d, max(ts) OVER () AS now FROM v_trades), g AS (SELECT *, CASE WHEN d > 0 THEN d END AS gap FROM g0),
b AS (SELECT market, count(*) AS n, count(*) FILTER (ts > now - 3600000) / 60 AS rate, coalesce(var_pop(gap) / avg(gap), 0) AS dispersion,
  avg(CASE WHEN gap < 1000 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) AS quick, avg(CASE WHEN abs(size - round(size)) < 0.01 THEN 1.0 ELSE 0.0 END) AS rnd, count(gap) AS gaps, 1 - coalesce(stddev_samp(gap) / avg(gap), 0) AS regular, CAST(max(now) - max(ts) AS DOUBLE) AS stale_ms FROM g GROUP BY market),
v AS (SELECT market, wallet, sum(ticks * size) AS v FROM v_trades GROUP BY ALL),
sh AS (SELECT *, v / sum(v) OVER (PARTITION BY market) AS share FROM v),
wh AS (SELECT market, sum(share * share) AS hhi, CASE WHEN max(share) > 0.2 THEN arg_max(wallet, share) END AS dominant FROM sh GROUP BY market),
f AS (SELECT b.*, hhi, dominant, CASE WHEN n < 5 THEN 0.0 ELSE list_avg(list_filter([CASE WHEN gaps > 0 THEN quick END, rnd, CASE WHEN gaps >= 5 THEN least(greatest(regular, 0), 1) END, CASE WHEN rate > 10 THEN least(greatest((rate - 10) / 50, 0), 1) END], lambda x: x IS NOT NULL)) END AS bots, coalesce(ob.spread_bps, 0) AS spread_bps, coalesce(ob.update_ms, 60000) AS update_ms, gap_half_life_ms, coalesce(gaps_1h, 0) AS gaps_1h FROM b JOIN wh USING (market) LEFT JOIN ob ON ob.market = b.market),
sc AS (SELECT *, (CASE WHEN update_ms > 10000 THEN 1.0 WHEN update_ms > 5000 THEN 0.5 ELSE 0 END + CASE WHEN stale_ms > 15000 THEN 1.0 WHEN stale_ms > 8000 THEN 0.5 ELSE 0 END + CASE WHEN spread_bps > 300 THEN 1.0 WHEN spread_bps > 150 THEN 0.5 ELSE 0 END
    + CASE WHEN rate < 2 THEN 1.0 WHEN rate < 5 THEN 0.5 ELSE 0 END + CASE WHEN hhi < 0.10 THEN 1.0 WHEN hhi < 0.15 THEN 0.5 ELSE 0 END + CASE WHEN bots < 0.3 THEN 1.0 WHEN bots < 0.5 THEN 0.5 ELSE 0 END) / 6 AS score1,
  (CASE WHEN update_ms BETWEEN 2000 AND 10000 THEN 1.0 WHEN update_ms > 1000 AND update_ms < 15000 THEN 0.5 ELSE 0 END + CASE WHEN rate BETWEEN 2 AND 15 THEN 1.0 WHEN rate > 1 AND rate < 20 THEN 0.5 ELSE 0 END
    + CASE WHEN dispersion > 2.0 THEN 1.0 WHEN dispersion > 1.2 THEN 0.5 ELSE 0 END + CASE WHEN hhi BETWEEN 0.10 AND 0.25 THEN 1.0 WHEN hhi BETWEEN 0.05 AND 0.35 THEN 0.5 ELSE 0 END) / 4 AS score2,
  (CASE WHEN update_ms < 2000 THEN 1.0 WHEN update_ms < 3000 THEN 0.5 ELSE 0 END + CASE WHEN spread_bps < 100 THEN 1.0 WHEN spread_bps < 200 THEN 0.5 ELSE 0 END + CASE WHEN stale_ms < 3000 THEN 1.0 WHEN stale_ms < 5000 THEN 0.5 ELSE 0 END
    + CASE WHEN hhi > 0.25 THEN 1.0 WHEN hhi > 0.15 THEN 0.5 ELSE 0 END + CASE WHEN bots > 0.7 THEN 1.0 WHEN bots > 0.5 THEN 0.5 ELSE 0 END + CASE WHEN gap_half_life_ms < 3000 THEN 1.0 WHEN gap_half_life_ms < 5000 THEN 0.5 ELSE 0 END) / 6 AS score3 FROM f),
ty AS (SELECT *, CASE WHEN greatest(score1, score2, score3) = 0 THEN 2 WHEN score1 = greatest(score1, score2, score3) THEN 1 WHEN score3 = greatest(score1, score2, score3) THEN 3 ELSE 2 END AS type,
  CASE WHEN greatest(score1, score2, score3) = 0 THEN 0.3 ELSE least(greatest(greatest(score1, score2, score3) / (score1 + score2 + score3), 0.1), 1) END AS confidence,
  least(greatest(CASE WHEN spread_bps > 0 THEN 0.25 / (1 + spread_bps / 100) ELSE 0 END + CASE WHEN update_ms > 0 THEN 0.20 / (1 + update_ms / 1000) ELSE 0 END + CASE WHEN coalesce(gap_half_life_ms, 30000) > 0 THEN 0.20 / (1 + coalesce(gap_half_life_ms, 30000) / 2000) ELSE 0 END + 0.15 * hhi + CASE WHEN stale_ms > 0 THEN 0.10 / (1 + stale_ms / 2000) ELSE 0 END + 0.10 * bots, 0), 1) AS efficiency FROM sc),
vs AS (SELECT *, list_filter([CASE WHEN (type = 2 AND rate >= 5 OR type = 3) AND rate > 5 AND update_ms < 5000 AND spread_bps < 500 THEN 'book_imbalance' END, CASE WHEN type = 2 AND rate > 10 AND spread_bps < 200 AND update_ms < 2000 THEN 'microprice_dislocation' END,
  CASE WHEN type IN (1, 2) THEN 'wallet_follow' END, CASE WHEN type = 2 OR type = 3 AND rate > 3 THEN 'large_trade_reaction' END, CASE WHEN gaps_1h > 0.5 AND coalesce(gap_half_life_ms > 2000, type <> 3) THEN 'complement_arb' END, CASE WHEN type IN (1, 2) THEN 'cross_market_consistency' END,
  CASE WHEN type IN (1, 2) THEN 'stale_book' END, CASE WHEN type = 1 THEN 'resolution_convergence' END, CASE WHEN type = 1 THEN 'new_market_listing' END, CASE WHEN type IN (1, 2) AND bots < 0.7 THEN 'cascade_detection' END], lambda x: x IS NOT NULL) AS strategies FROM ty)"""
_SIG = f"{sql.TRADES}, sig AS (SELECT 's' || token AS strategy, market, side, ts, event_id, ticks / 1000 AS ev, size / 50 AS strength, size, ticks / 100 AS target, token + 1 AS h FROM v_trades)"
_TESTED = f"""{_REG}, hr AS (SELECT tick, regime, coalesce(lag(regime) OVER (ORDER BY tick), '') AS assumed FROM reg), en AS (SELECT market, min(ts) + (max(ts) - min(ts)) // 2 AS fin FROM v_trades WHERE market < 2 GROUP BY market),
sg AS (SELECT 's' || token AS strategy, v.market, side, ts, event_id, ts * 1000000 + event_id AS pos, CASE WHEN ticks / 1000 < 0.02 THEN 'min_ev' WHEN size <= 0 OR size / 50 > 1 THEN 'strength' WHEN size > 40 THEN 'max_size' END AS bf,
  CASE WHEN assumed <> '' AND assumed <> regime THEN 'regime' WHEN ticks / 1000 - size / 500 < -0.10 THEN 'ci_low' WHEN ts >= fin THEN 'inactive' WHEN ticks / 100 <= 0 OR ticks / 100 >= 1 THEN 'target' WHEN ticks / 100 + 0.03 >= 1 THEN 'target' END AS af
  FROM v_trades v JOIN hr ON hr.tick = v.ts // 3600000 LEFT JOIN en ON en.market = v.market),
nd AS (SELECT strategy, market, side, ts, min(event_id) AS event_id FROM sg WHERE bf IS NULL AND af IS NULL GROUP BY ALL),
nx AS (SELECT *, min(ts) OVER (PARTITION BY strategy, market, side ORDER BY ts RANGE BETWEEN {REPEAT} FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM nd),
kp AS (SELECT strategy, market, side, min(ts) AS ts FROM nd GROUP BY ALL UNION ALL SELECT nx.strategy, nx.market, nx.side, nx.nt FROM kp JOIN nx ON kp.strategy = nx.strategy AND kp.market = nx.market AND kp.side = nx.side AND kp.ts = nx.ts WHERE nx.nt IS NOT NULL),
kq AS (SELECT nd.*, nd.ts * 1000000 + nd.event_id AS kpos FROM kp JOIN nd ON kp.strategy = nd.strategy AND kp.market = nd.market AND kp.side = nd.side AND kp.ts = nd.ts),
tested AS (SELECT sg.*, kq.ts AS lk FROM sg ASOF LEFT JOIN kq ON sg.strategy = kq.strategy AND sg.market = kq.market AND sg.side = kq.side AND sg.pos > kq.kpos)"""
_EXE = f"""{sql.TRADES}, {sql.LEVELS}, asks AS (SELECT *, sum(size) OVER (PARTITION BY book ORDER BY level ROWS UNBOUNDED PRECEDING) AS cum, min(price) OVER (PARTITION BY book) AS first FROM v_levels WHERE side = 'ask'),
o AS (SELECT event_id, market, event_id % 200 + 1 AS book, size * 3 AS want FROM v_trades WHERE side = 'BUY'), bks AS (SELECT DISTINCT book FROM v_levels),
x AS (SELECT o.event_id, o.market, o.book, o.want, coalesce(sum(greatest(0, least(a.size, want - (cum - a.size)))), 0) AS filled, coalesce(sum(greatest(0, least(a.size, want - (cum - a.size))) * a.price), 0) AS cost, any_value(first) AS first
  FROM o JOIN bks USING (book) LEFT JOIN asks a ON a.book = o.book GROUP BY ALL),
ex AS (SELECT event_id, market, book, CAST(filled AS DOUBLE) AS filled, CASE WHEN filled > 0 THEN cost / filled END AS vwap, cost * 0.02 AS fee, CASE WHEN filled > 0 THEN cost / filled - first END AS slippage, filled < want AS partial FROM x)"""
_QD = "q AS (SELECT p_name AS question, p_type AS category, min(p_partkey) AS market FROM part GROUP BY 1, 2)"
def similar(q: str) -> str:
    """pairs of the questions in q (market, category, question) that share a word."""
    return f"""{q}, t AS (SELECT market, category, {_TOK.format('question')} AS w FROM q), tt AS (SELECT * FROM t WHERE len(w) > 0),
u AS (SELECT market, len(w) AS n, unnest(w) AS term FROM tt), c AS (SELECT market, n, term, count(*) / n AS tf FROM u GROUP BY market, n, term),
pr AS (SELECT DISTINCT x.market AS a, y.market AS b FROM c x JOIN c y ON x.term = y.term AND x.market < y.market),
sh AS (SELECT pr.a, pr.b, sum(x.tf * y.tf) * ln(5.0 / 3) * ln(5.0 / 3) AS dot, count(*) AS k, sum(x.tf * x.tf) AS sa, sum(y.tf * y.tf) AS sb, sum(x.tf) AS share FROM pr JOIN c x ON x.market = pr.a JOIN c y ON y.market = pr.b AND y.term = x.term GROUP BY ALL),
al AS (SELECT market, sum(tf * tf) AS s, count(*) AS k FROM c GROUP BY 1),
sm AS (SELECT sh.a, sh.b, sh.share AS shared, 0.4 * sh.k / (p.k + q.k - sh.k) + 0.6 * dot / sqrt(((p.s - sa) * ln(2) * ln(2) + sa * ln(5.0 / 3) * ln(5.0 / 3)) * ((q.s - sb) * ln(2) * ln(2) + sb * ln(5.0 / 3) * ln(5.0 / 3))) AS similarity
  FROM sh JOIN al p ON p.market = sh.a JOIN al q ON q.market = sh.b),
pairs AS (SELECT a, b, shared, similarity, CASE WHEN similarity >= 0.65 AND x.category = y.category THEN 'same_event' WHEN similarity >= 0.5 AND x.category = y.category AND shared >= 0.4 THEN 'complementary' WHEN similarity >= 0.45 AND x.category <> y.category THEN 'causal' ELSE 'semantic' END AS kind
  FROM sm JOIN t x ON x.market = a JOIN t y ON y.market = b)"""


_SIM = similar(_QD)
_REACH = f"""{_SIM}, ed AS (SELECT a, b FROM pairs WHERE similarity >= 0.34 UNION SELECT b, a FROM pairs WHERE similarity >= 0.34),
reach AS (SELECT market AS id, market AS node FROM q UNION SELECT reach.id, ed.b FROM reach JOIN ed ON ed.a = reach.node), cl AS (SELECT id, min(node) AS cluster FROM reach GROUP BY id),
members AS (SELECT p_partkey AS id, p_name AS question, cluster FROM part JOIN q ON p_name = q.question AND p_type = q.category JOIN cl ON cl.id = q.market)"""


def _place() -> str:
    rules = [f"WHEN contains(x, '{m}') THEN {i}" for names in (X.MONTHS, X.MONTHS_SHORT) for i, m in enumerate(names, 1)]
    rules += [f"WHEN contains(x, 'q{q}') THEN {3 * q}" for q in range(1, 5)]
    rules += ["WHEN regexp_matches(x, '20[0-9][0-9]') THEN CAST(regexp_extract(x, '20([0-9][0-9])', 1) AS BIGINT) * 12", "WHEN contains(x, 'end of year') OR contains(x, 'eoy') THEN 12", "WHEN contains(x, 'mid-year') OR contains(x, 'midyear') THEN 6"]
    return "CASE " + " ".join(rules) + " END"


QUERIES = {f.__name__: f for f in (book_metrics, vwap_sweep, rolling_stats, volatility, autocorrelation, linreg, bh_adjust, percentile_rank, asof_backward, forward_returns, feature_z, regime_ticks, transition_matrix, regime_spans, regime_confirmed, regime_durations, large_trades, impact_cube, market_types, edge_map, viable_strategies, viability_matrix, signal_filter, paper_execute, attribution_rollup, token_df, tfidf, question_classes, similarity_pairs, question_clusters, cluster_descriptions, temporal_order, sessions, source_health, dedup)}


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)


_IMB = "CASE WHEN {0} + {1} = 0 THEN 0.0 ELSE ({0} - {1}) / ({0} + {1}) END"

ORACLE_SQL = {
    "book_metrics": f"""WITH {sql.LEVELS}, a AS (SELECT book, max(price) FILTER (side = 'bid') AS b, min(price) FILTER (side = 'ask') AS k, coalesce(max(size) FILTER (side = 'bid' AND level = 1), 0) AS bs, coalesce(max(size) FILTER (side = 'ask' AND level = 1), 0) AS ks,
        coalesce(sum(size / level) FILTER (side = 'bid' AND level <= 5), 0) AS b5, coalesce(sum(size / level) FILTER (side = 'ask' AND level <= 5), 0) AS k5, coalesce(sum(size / (level - 1)) FILTER (side = 'bid' AND level BETWEEN 2 AND 5), 0) AS bd,
        coalesce(sum(size / (level - 1)) FILTER (side = 'ask' AND level BETWEEN 2 AND 5), 0) AS kd, coalesce(CAST(sum(size) FILTER (side = 'bid' AND level <= 5) AS DOUBLE), 0) AS bid_depth5, coalesce(CAST(sum(size) FILTER (side = 'ask' AND level <= 5) AS DOUBLE), 0) AS ask_depth5,
        coalesce(sum(size * size) FILTER (side = 'bid' AND level <= 5) / (sum(size) FILTER (side = 'bid' AND level <= 5) * sum(size) FILTER (side = 'bid' AND level <= 5)), 0) AS bid_hhi FROM v_levels GROUP BY book),
      m AS (SELECT *, coalesce((b + k) / 2, 0) AS mid FROM a),
      l AS (SELECT v.book, sum(CASE WHEN v.side = 'bid' AND abs(v.price - m.b) <= m.b * 0.05 * (1 + 1e-9) THEN v.size ELSE 0 END) AS bid_depth_5pct, sum(CASE WHEN level <= 5 AND mid > 0 THEN v.size / (1 + 100 * abs(mid - v.price) / mid) ELSE 0 END) AS s FROM v_levels v JOIN m USING (book) GROUP BY ALL)
      SELECT book, {_r('mid')}, round(coalesce(k - b, 0), 6) + 0.0 AS spread, round(CASE WHEN b IS NULL OR k IS NULL THEN 'nan'::DOUBLE ELSE (ks * b + bs * k) / (bs + ks) END, 6) + 0.0 AS microprice, round({_IMB.format('bs', 'ks')}, 6) + 0.0 AS imbalance,
        round({_IMB.format('b5', 'k5')}, 6) + 0.0 AS imbalance5, round({_IMB.format('bd', 'kd')}, 6) + 0.0 AS deep_imbalance, {_r('bid_depth5', 'ask_depth5')}, CAST(bid_depth_5pct AS DOUBLE) AS bid_depth_5pct, round(CASE WHEN mid <= 0 THEN 0.0 ELSE s / (s + 10000) END, 6) + 0.0 AS liquidity, {_r('bid_hhi')} FROM m JOIN l USING (book)""",
    "vwap_sweep": f"""WITH {sql.LEVELS}, c AS (SELECT *, sum(size) OVER (PARTITION BY book ORDER BY level ROWS UNBOUNDED PRECEDING) - size AS before FROM v_levels WHERE side = 'ask'),
      t AS (SELECT book, CAST(sum(greatest(0, least(size, 60 - before))) AS DOUBLE) AS filled, count(*) FILTER (before < 60) AS used, sum(greatest(0, least(size, 60 - before)) * price) AS cost FROM c GROUP BY book)
      SELECT b.book, coalesce(filled, 0) AS filled, coalesce(used, 0) AS used, round(CASE WHEN coalesce(filled, 0) < 60 THEN 'nan'::DOUBLE ELSE cost / 60 END, 6) + 0.0 AS vwap FROM (SELECT DISTINCT book FROM v_levels) b LEFT JOIN t USING (book)""",
    "rolling_stats": f"""WITH {sql.PRICES}, w AS (SELECT *, count(*) OVER f AS k, avg(price) OVER f AS mean, stddev_samp(price) OVER f AS sd FROM v_prices WINDOW f AS (PARTITION BY series ORDER BY ts, event_id ROWS 19 PRECEDING))
      SELECT event_id, series, {_r('mean', 'sd')}, round(CASE WHEN sd = 0 THEN CASE WHEN mean = 0 THEN 0.0 WHEN mean > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE mean / sd * 15.874507866387544 END, 6) + 0.0 AS sharpe FROM w WHERE k = 20""",
    "volatility": f"""WITH {sql.PRICES}, l AS (SELECT *, lag(price) OVER (PARTITION BY series ORDER BY ts, event_id) AS p0 FROM v_prices), x AS (SELECT series, CASE WHEN price > 0 AND p0 > 0 THEN ln(price / p0) END AS r FROM l)
      SELECT series, round(CASE WHEN count(*) < 3 OR count(r) < 2 THEN 0.0 ELSE stddev_samp(r) END, 6) + 0.0 AS volatility FROM x GROUP BY series""",
    "autocorrelation": f"""WITH {sql.PRICES}, d AS (SELECT series, ts, event_id, price - avg(price) OVER (PARTITION BY series) AS d FROM v_prices), e AS (SELECT *, lag(d) OVER (PARTITION BY series ORDER BY ts, event_id) AS e FROM d)
      SELECT series, round(CASE WHEN count(*) <= 2 OR sum(d * d) = 0 THEN 0.0 ELSE sum(d * e) / sum(d * d) END, 6) + 0.0 AS autocorrelation FROM e GROUP BY series""",
    "linreg": f"""WITH {sql.PRICES}, a AS (SELECT series, count(*) AS n, regr_sxx(price, event_id) AS sxx, regr_syy(price, event_id) AS syy, regr_sxy(price, event_id) AS sxy, avg(event_id) AS mx, avg(price) AS my FROM v_prices GROUP BY series),
      b AS (SELECT *, sxy / sxx AS slope, greatest(syy - sxy * sxy / sxx, 0) AS rest FROM a), c AS (SELECT *, my - slope * mx AS intercept, 1 - rest / syy AS r2, slope / sqrt(rest / (n - 2) / sxx) AS t FROM b)
      SELECT series, round(slope, 9) + 0.0 AS slope, {_r('intercept', 'r2', 't')}, round({sql.p_value('t', 'n - 2')}, 6) + 0.0 AS p FROM c""",
    "bh_adjust": f"""WITH a AS (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1 HAVING count(*) >= 2), b AS (SELECT *, (m - 50.0) / (sd / sqrt(n)) AS t FROM a),
      c AS (SELECT user_id, round({sql.p_value('t', 'n - 1')}, 9) AS p FROM b), d AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, user_id) AS raw, least(p * count(*) OVER (), 1.0) AS bonferroni FROM c)
      SELECT user_id, {_r('p', 'bonferroni')}, round(least(min(raw) OVER (ORDER BY p, user_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) + 0.0 AS bh FROM d""",
    "percentile_rank": f"WITH {sql.PRICES} SELECT event_id, round((rank() OVER (PARTITION BY series ORDER BY price) - 1) / count(*) OVER (PARTITION BY series), 6) + 0.0 AS rank FROM v_prices",
    "asof_backward": f"""WITH {sql.TRADES}, b AS (SELECT event_id, token, ts FROM v_trades WHERE side = 'BUY'), s AS (SELECT token, ts, max(ticks) AS price FROM v_trades WHERE side = 'SELL' GROUP BY ALL),
      j AS (SELECT b.event_id, b.ts, s.price, s.ts AS pts FROM b ASOF LEFT JOIN s ON b.token = s.token AND b.ts >= s.ts)
      SELECT event_id, CASE WHEN ts - pts <= 1800000 THEN price END AS price, CASE WHEN ts - pts <= 1800000 THEN pts END AS price_ts FROM j""",
    "forward_returns": f"""WITH {sql.PRICES}, a AS (SELECT series, event_id, ts + 3600000 AS ts, price AS p0 FROM v_prices WHERE price > 0), s AS (SELECT series, ts, max(price) AS price FROM v_prices WHERE price > 0 GROUP BY ALL),
      b AS (SELECT a.*, s.price AS bp, s.ts AS bt FROM a ASOF LEFT JOIN s ON a.series = s.series AND a.ts >= s.ts), f AS (SELECT b.*, s.price AS fp, s.ts AS ft FROM b ASOF LEFT JOIN s ON b.series = s.series AND b.ts <= s.ts),
      x AS (SELECT *, ft IS NOT NULL AND (bt IS NULL OR ft - ts <= ts - bt) AS fwd FROM f), y AS (SELECT event_id, p0, CASE WHEN fwd THEN fp ELSE bp END AS p, abs(ts - CASE WHEN fwd THEN ft ELSE bt END) AS gap FROM x)
      SELECT event_id, round((p - p0) / p0, 6) + 0.0 AS forward_return FROM y WHERE gap <= 900000""",
    "feature_z": f"""WITH {sql.PRICES}, w AS (SELECT *, count(*) OVER f AS k, avg(price) OVER f AS m, stddev_samp(price) OVER f AS sd FROM v_prices WINDOW f AS (PARTITION BY series ORDER BY ts, event_id ROWS 119 PRECEDING))
      SELECT event_id, round(CASE WHEN k < 5 OR sd = 0 THEN 0.0 ELSE (price - m) / sd END, 6) + 0.0 AS z FROM w""",
    "regime_ticks": f"WITH {_REG} SELECT tick, {_r('volume_z', 'active_z', 'spread_z')}, resolutions, new_markets, regime, {_r('confidence')} FROM reg",
    "transition_matrix": f"""WITH {_REG}, st AS (SELECT lag(regime) OVER (ORDER BY tick) AS f, regime AS t FROM reg), d AS (SELECT unnest([{', '.join(f"'{x}'" for x in REGIMES)}]) AS s), c AS (SELECT f, t, count(*) AS n FROM st WHERE f IS NOT NULL GROUP BY ALL),
      g AS (SELECT x.s AS from_state, y.s AS to_state, coalesce(c.n, 0) AS n FROM d x CROSS JOIN d y LEFT JOIN c ON c.f = x.s AND c.t = y.s)
      SELECT from_state, to_state, n, round(CASE WHEN sum(n) OVER (PARTITION BY from_state) = 0 THEN 0.0 ELSE n / sum(n) OVER (PARTITION BY from_state) END, 6) + 0.0 AS share FROM g""",
    "regime_spans": f"""WITH {_REG}, ch AS (SELECT tick * 3600000 AS ts, regime FROM (SELECT *, lag(regime) OVER (ORDER BY tick) AS o FROM reg) WHERE o IS NULL OR o <> regime)
      SELECT ts AS start, coalesce(lead(ts) OVER (ORDER BY ts), {1 << 42}) AS "end", regime AS state FROM ch UNION ALL SELECT 0, min(ts), 'normal' FROM ch""",
    "large_trades": f"WITH {_LARGE} SELECT event_id, market, round(z, 6) + 0.0 AS z FROM large WHERE z >= 2.0",
    "impact_cube": f"""WITH {_LARGE}, nx AS (SELECT event_id, lead(ticks) OVER (PARTITION BY token ORDER BY ts, event_id) AS nt FROM v_trades), b AS (SELECT market, side, CASE WHEN side = 'BUY' THEN nt < ticks ELSE nt > ticks END AS back FROM large JOIN nx USING (event_id) WHERE z >= 1.0 AND nt IS NOT NULL)
      SELECT market, side, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN avg(CASE WHEN back THEN 1.0 ELSE 0.0 END) END, 6) + 0.0 AS rate FROM b GROUP BY CUBE (market, side)""",
    "market_types": f"WITH {_TYPES} SELECT market, {_r('rate')}, round(dispersion, 3) + 0.0 AS dispersion, {_r('hhi', 'bots')}, {_r('spread_bps', digits=4)}, {_r('update_ms', digits=3)}, gap_half_life_ms, gaps_1h, dominant, {_r('score1', 'score2', 'score3')}, CAST(type AS BIGINT) AS type, {_r('confidence', 'efficiency')} FROM ty",
    "edge_map": f"""WITH {_TYPES}, w AS (SELECT *, (1 - efficiency) * (1 - efficiency) * least(greatest(len(strategies) / 2, 0.1), 1.0) AS weight FROM vs WHERE len(strategies) > 0)
      SELECT market, round((1 - efficiency) * 0.05, 6) + 0.0 AS edge, round(least(weight / sum(weight) OVER () * 9000.0, 1000.0), 6) + 0.0 AS allocation, CASE WHEN bool_or(confidence > 0.5) OVER () THEN 'trade_actively' ELSE 'trade_selectively' END AS label FROM w""",
    "viable_strategies": f"WITH {_TYPES} SELECT market, CAST(type AS BIGINT) AS type, array_to_string(strategies, ',') AS strategies FROM vs",
    "viability_matrix": f"""WITH {_SIG}, d AS (SELECT CAST(unnest([1, 2, 3, 5, 10, 15, 20, 30]) AS BIGINT) AS delay_s)
      SELECT strategy, delay_s, count(*) AS signals, count(*) FILTER (ev * exp(-0.693147 * delay_s / h) > 0.02 + 0.001 * size / 100 * 0.03 + 0.0005 * size / 100) AS viable FROM sig CROSS JOIN d GROUP BY ALL""",
    "signal_filter": f"""WITH RECURSIVE {_TESTED} SELECT event_id, CASE WHEN bf IS NOT NULL THEN bf WHEN ts - lk < {REPEAT} THEN 'duplicate' ELSE af END AS filter FROM tested""",
    "paper_execute": f"WITH {_EXE} SELECT event_id, book, filled, {_r('vwap', 'fee', 'slippage', digits=9)}, partial FROM ex",
    "attribution_rollup": f"WITH {_EXE} SELECT market, count(*) AS n, sum(filled) AS filled, round(sum(fee), 4) + 0.0 AS fees, round(avg(slippage), 6) + 0.0 AS slippage FROM ex GROUP BY ROLLUP (market)",
    "token_df": f"WITH t AS (SELECT unnest(list_distinct({_TOK.format('p_name')})) AS term FROM part) SELECT term, count(*) AS df FROM t GROUP BY 1",
    "tfidf": f"""WITH t AS (SELECT p_partkey AS market, {_TOK.format('p_name')} AS w FROM part), n AS (SELECT count(*) AS docs FROM t), u AS (SELECT market, len(w) AS l, unnest(w) AS term FROM t), c AS (SELECT market, l, term, count(*) AS tf FROM u GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
      SELECT market, term, round(tf / l * ln(1 + docs / (1 + df)), 6) + 0.0 AS weight FROM c JOIN d USING (term) CROSS JOIN n""",
    "similarity_pairs": f"WITH {_SIM} SELECT a, b, {_r('shared', 'similarity')}, kind FROM pairs WHERE similarity >= 0.3",
    "question_classes": f"WITH {_QD} SELECT p_partkey AS market, q.market AS class FROM part JOIN q ON p_name = question AND p_type = category",
    "question_clusters": f"WITH RECURSIVE {_REACH} SELECT id, cluster FROM members",
    "cluster_descriptions": f"""WITH RECURSIVE {_REACH}, n AS (SELECT cluster, count(*) AS n FROM members GROUP BY 1), e AS (SELECT cluster, unnest(list_distinct({_TOK.format('question')})) AS word FROM members), d AS (SELECT cluster, word, count(*) AS df FROM e GROUP BY ALL),
      k AS (SELECT cluster, n, word, df, row_number() OVER (PARTITION BY cluster ORDER BY df DESC, word) AS k FROM d JOIN n USING (cluster) WHERE df >= greatest(2, ceil(n / 2))), w AS (SELECT cluster, string_agg(word, ' ' ORDER BY k) AS words FROM k WHERE k <= 5 GROUP BY 1)
      SELECT n.cluster, n.n, coalesce(words, 'related markets') AS words FROM n LEFT JOIN w ON w.cluster = n.cluster""",
    "regime_confirmed": f"WITH {_CONFIRMED} SELECT tick, regime, current FROM conf",
    "regime_durations": f"""WITH {_CONFIRMED}, ch AS (SELECT tick * 3600000 AS ts, current FROM (SELECT *, lag(current) OVER (ORDER BY tick) AS o FROM conf) WHERE o IS NULL OR o <> current), sp AS (SELECT current, lead(ts) OVER (ORDER BY ts) - ts AS d FROM ch),
      dm AS (SELECT unnest([{', '.join(f"'{x}'" for x in REGIMES)}]) AS state) SELECT state, count(d) AS n, round(coalesce(avg(d), 0), 3) + 0.0 AS mean_ms FROM dm LEFT JOIN sp ON current = state AND d IS NOT NULL GROUP BY state""",
    "temporal_order": f"WITH d AS (SELECT item_id, lower(text) AS x FROM benchmark) SELECT item_id, CAST({_place()} AS BIGINT) AS place FROM d",
    "sessions": """WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a)
      SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, max(value) AS peak FROM b GROUP BY user_id, k""",
    "source_health": f"WITH {sql.PRICES}, h AS (SELECT series, count(*) AS n, max(ts) AS last FROM v_prices GROUP BY 1), m AS (SELECT max(ts) AS now FROM v_prices) SELECT series, n, now - last AS age_ms, CASE WHEN now - last > 600000 THEN 'stale' ELSE 'ok' END AS status FROM h CROSS JOIN m",
    "dedup": f"""WITH RECURSIVE {sql.TRADES}, nd AS (SELECT wallet, token, ts, min(event_id) AS event_id FROM v_trades GROUP BY ALL),
      nx AS (SELECT *, min(ts) OVER (PARTITION BY wallet, token ORDER BY ts RANGE BETWEEN {DEDUP} FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM nd),
      kp AS (SELECT wallet, token, min(ts) AS ts FROM nd GROUP BY ALL UNION ALL SELECT nx.wallet, nx.token, nx.nt FROM kp JOIN nx ON kp.wallet = nx.wallet AND kp.token = nx.token AND kp.ts = nx.ts WHERE nx.nt IS NOT NULL)
      SELECT event_id, nd.wallet, nd.token FROM kp JOIN nd ON kp.wallet = nd.wallet AND kp.token = nd.token AND kp.ts = nd.ts""",
}
