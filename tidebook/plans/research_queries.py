"""Queries on simulated copying, regimes, baskets, correlation and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluators, research, series, wallets
from ..sources import views
from . import market_queries as M
from . import sql
from . import wallet_queries as Q
from .market_queries import r_expr
from .wallet_queries import pairs, r


def copy_simulation(spark, sf_dir):
    return research.copied(views.trades(spark, sf_dir), 3.0).select("wallet", "token", "entry_id", "exit_id", "size", r("pnl", 9), "hold_ms")


def copy_summary(spark, sf_dir):
    return research.copy_summary(research.copied(views.trades(spark, sf_dir), 3.0)).select("wallet", "closed", "wins", r("pnl"), r("hold_ms", 2))


def _profile(spark, sf_dir) -> DataFrame:
    return research.regime_profile(views.trades(spark, sf_dir), M.regime_spans(spark, sf_dir))


def regime_profile(spark, sf_dir):
    return _profile(spark, sf_dir).select("wallet", "regime", "n", r("sharpe"), r("robustness"), "sensitive")


def regime_consistency(spark, sf_dir):
    return research.regime_consistency(_profile(spark, sf_dir)).select("wallet", "regimes", r("consistency"), "robust")


def _class(spark, sf_dir) -> DataFrame:
    t = views.trades(spark, sf_dir)
    steady = research.regime_consistency(_profile(spark, sf_dir)).select("wallet", "consistency")
    return wallets.classify(wallets.statistics(pairs(spark, sf_dir)), t, wallets.market_maker_score(t), wallets.round_trip_rate(t), steady)


def wallet_class(spark, sf_dir):
    return _class(spark, sf_dir).select("wallet", "trades", "class", r("confidence"))


LATENCY = 3 * M.HOUR


def _advice(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The advice, and the curve that it rests on."""
    t = views.trades(spark, sf_dir)
    curve = wallets.delay_curve(pairs(spark, sf_dir), t)
    return wallets.delay_advice(t.select("wallet").distinct(), curve, LATENCY), curve


def delay_advice(spark, sf_dir):
    return _advice(spark, sf_dir)[0].select("wallet", "n", r("ir"), "advice", "best_ms")


def wallet_score(spark, sf_dir):
    t, p = views.trades(spark, sf_dir), pairs(spark, sf_dir)
    out = wallets.follow_score(wallets.statistics(p), wallets.drawdown_and_streak(p), _advice(spark, sf_dir)[0], _profile(spark, sf_dir), t)
    return out.select("wallet", r("score", 5), "recommendation")


def follow_parameters(spark, sf_dir):
    advice, curve = _advice(spark, sf_dir)
    return wallets.follow_parameters(views.trades(spark, sf_dir), advice, curve, 10_000.0, LATENCY).select("wallet", "delay_ms", r("least_size"), r("allocation"))


def _gated(spark, sf_dir) -> DataFrame:
    """wallet, gate, class, confidence, n, t, win_rate, advice, halflife_ms."""
    advice, curve = _advice(spark, sf_dir)
    half = wallets.half_life(curve).select("wallet", "halflife_ms")
    rows = _class(spark, sf_dir).join(advice, "wallet").join(half, "wallet", "left")
    return rows.withColumn("gate", evaluators.follow_gate(F.col("class"), F.col("halflife_ms"), F.col("advice") == "follow", LATENCY))


def wallet_gate(spark, sf_dir):
    """Whether a wallet's trades are followed, faded or left, and how strong a signal of theirs would be."""
    strength = evaluators.follow_strength(F.coalesce("t", F.lit(0.0)), F.coalesce("win_rate", F.lit(0.0)), F.lit(0.05), F.col("confidence"))
    return _gated(spark, sf_dir).select("wallet", "gate", r_expr(strength, "strength"))


def market_heat(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    now = t.agg(F.max("ts")).first()[0] or 0
    return evaluators.heat(t, _class(spark, sf_dir), now, 24 * M.HOUR).select("market", r("heat"))


def partition_check(spark, sf_dir):
    return research.partition_check(_members(spark, sf_dir)).select("cluster", "n", r("total"), r("violation"), r("executable"), "tradeable")


def _members(spark, sf_dir) -> DataFrame:
    best = views.levels(spark, sf_dir).where("level = 1")
    side = lambda s: best.where(F.col("side") == s)
    b = side("bid").select("book", (F.col("ticks") / 200).alias("bid"), F.col("size").alias("bid_size"))
    a = side("ask").select("book", (F.col("ticks") / 200).alias("ask"), F.col("size").alias("ask_size"))
    return b.join(a, "book").withColumns({"cluster": F.expr("book div 2"), "mid": (F.col("bid") + F.col("ask")) / 2})


def return_correlation(spark, sf_dir):
    order = ["ts", "event_id"]
    p = series.lagged(views.prices(spark, sf_dir), ["series"], order, {"a": "price"}).withColumn("a", F.col("price") - F.col("a"))
    p = series.lagged(p, ["series"], order, {"b": "a"}).where("a is not null and b is not null")
    return research.return_correlation(p, "series", "a", "b").select("series", "n", r("correlation"))


def signal_kills(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    now = t.agg(F.max("ts").alias("now"))
    last = t.groupBy("token").agg((F.max_by("ticks", "event_id") / 100).alias("mid")).join(F.broadcast(now)).withColumn("regime_now", F.lit("normal"))
    s = t.select("event_id", "token", "ts", (F.col("ticks") / 1000).alias("ev"), (F.col("ticks") / 100).alias("target"), F.lit(864_000_000.0).alias("half_life_ms"), F.when(F.col("size") % 7 == 0, "high_volatility").otherwise("normal").alias("regime"))
    return research.kills(s, last, 2_000_000_000, 0.4, 0.02)


def bootstrap_interval(spark, sf_dir):
    return research.bootstrap(views.prices(spark, sf_dir), "series", ["ts", "event_id"], "price").select("series", "n", r("low"), r("high"))


QUERIES = {f.__name__: f for f in (copy_simulation, copy_summary, regime_profile, regime_consistency, wallet_class, delay_advice, wallet_score, follow_parameters, wallet_gate, market_heat, partition_check, return_correlation, signal_kills, bootstrap_interval)}

_COPY = f"""{sql.TRADES}, t1 AS (SELECT *, lag(side) OVER (PARTITION BY wallet, token ORDER BY ts, event_id) AS p FROM v_trades), t2 AS (SELECT * FROM t1 WHERE p IS NULL OR p <> side),
t3 AS (SELECT *, lead(event_id) OVER w AS exit_id, lead(ticks) OVER w AS et, lead(ts) OVER w AS ets, lead(size) OVER w AS es FROM t2 WINDOW w AS (PARTITION BY wallet, token ORDER BY ts, event_id)),
t4 AS (SELECT wallet, token, event_id AS entry_id, exit_id, least(size, es) AS size, (greatest(et / 100 - 0.003, 0.01) - least(ticks / 100 + 0.003, 0.99)) * least(size, es) AS g, ets - ts AS hold_ms FROM t3 WHERE side = 'BUY' AND exit_id IS NOT NULL),
cp AS (SELECT *, g - greatest(g, 0) * 0.02 AS pnl FROM t4)"""
_SPANS = M.ORACLE_SQL["regime_spans"].removeprefix("WITH ").replace(f"{sql.TRADES},", "", 1)
_HEAD, _TAIL = _SPANS.split("\n      SELECT ts AS start")

_PROFILE = f"""{_HEAD}, sp AS (SELECT ts AS start{_TAIL}), tr AS (SELECT v.*, coalesce(sp.state, 'normal') AS regime FROM v_trades v LEFT JOIN sp ON v.ts >= sp.start AND v.ts < sp."end"),
{sql.pairs("tr", ("wallet", "regime", "market", "token"))},
pe AS (SELECT wallet, regime, count(*) AS n, sum(pnl_ticks) / count(*) / 100 AS m, CASE WHEN min(pnl_ticks) = max(pnl_ticks) THEN 0.0 ELSE stddev_samp(pnl_ticks / 100) END AS sd FROM pairs GROUP BY wallet, regime),
pf AS (SELECT *, CASE WHEN n < 2 THEN 0.0 WHEN sd = 0 THEN CASE WHEN m = 0 THEN 0.0 WHEN m > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE m / sd END AS sharpe, CASE WHEN n >= 5 THEN least(1.0, n / 30) ELSE 0.0 END AS w FROM pe),
pg AS (SELECT *, sum(w) OVER p AS tw, sum(CASE WHEN sharpe > 0 THEN w ELSE 0 END) OVER p AS pw, max(CASE WHEN n >= 10 THEN sharpe END) OVER p AS hi, min(CASE WHEN n >= 10 THEN sharpe END) OVER p AS lo, count(*) FILTER (n >= 10) OVER p AS k FROM pf WINDOW p AS (PARTITION BY wallet)),
prof AS (SELECT wallet, regime, n, sharpe, CASE WHEN tw > 0 THEN pw / tw ELSE 0 END AS robustness, coalesce(k >= 2 AND (hi - lo > 1 OR (hi > 0.3 AND lo < -0.3)), false) AS sensitive FROM pg),
pc AS (SELECT wallet, count(*) FILTER (n >= 5) AS regimes, avg(sharpe) FILTER (n >= 5) AS m, stddev_samp(sharpe) FILTER (n >= 5) AS sd, count(*) AS al, count(*) FILTER (n >= 5 AND sharpe > 0) AS good FROM prof GROUP BY wallet),
cons AS (SELECT wallet, regimes, CASE WHEN regimes < 2 THEN 0.5 WHEN m = 0 THEN 0.0 ELSE least(greatest(1 - abs(sd / m), 0), 1) END AS consistency, al >= 2 AND 3 * good >= 2 * al AS robust FROM pc)"""
_PROFILE_ALONE = f"WITH {sql.TRADES}, {_PROFILE}"
_CURVE = Q._CURVE.split(sql.PAIRS + ",")[1]
_CLASS = f"""{Q._STATS},
      e AS (SELECT wallet, market, count(*) AS k, count(*) FILTER (side = 'BUY') AS b, count(DISTINCT token) AS tk FROM v_trades GROUP BY ALL),
      mm AS (SELECT wallet, coalesce(avg(CASE WHEN k >= 4 THEN 0.6 * (1 - abs(2 * b - k) / k) + 0.4 * CASE WHEN tk >= 2 THEN 1.0 ELSE 0.0 END END), 0) AS mm, avg(CASE WHEN tk >= 2 THEN 1.0 ELSE 0.0 END) AS trip FROM e GROUP BY wallet),
      tc AS (SELECT wallet, count(*) AS trades FROM v_trades GROUP BY wallet), rc AS ({_PROFILE_ALONE} SELECT wallet, consistency FROM cons),
      c1 AS (SELECT tc.wallet, trades, coalesce(median_hold_ms, 0) / 1000 AS hold, coalesce(win_rate, 0) AS win, coalesce(sharpe, 0) AS ratio, trip, mm, n, p, coalesce(rc.consistency, 0.5) AS cs FROM tc LEFT JOIN s USING (wallet) JOIN mm USING (wallet) LEFT JOIN rc USING (wallet)),
      c2 AS (SELECT *, list_sort(list_filter([CASE WHEN hold > 0 AND hold < 300 THEN {{'s': round(-(0.5 * (1 - hold / 300) + 0.5 * greatest((win - 0.5) * 5, 0)), 12), 'i': 0, 'name': 'sniper'}} END, CASE WHEN trip > 0.3 THEN {{'s': round(-trip, 12), 'i': 1, 'name': 'arbitrageur'}} END,
        CASE WHEN mm > 0.5 THEN {{'s': round(-mm, 12), 'i': 2, 'name': 'market_maker'}} END, CASE WHEN hold > 3600 THEN {{'s': round(-(0.4 * least(1, hold / 14400) + 0.6 * least(greatest(ratio / 2, 0), 1)), 12), 'i': 3, 'name': 'swing'}} END,
        CASE WHEN ratio < 0.3 THEN {{'s': round(-0.8 * greatest(1 - ratio / 0.3, 0), 12), 'i': 4, 'name': 'noise'}} END], lambda x: x IS NOT NULL)) AS c FROM c1),
      cls AS (SELECT wallet, trades, CASE WHEN trades < 2 THEN 'unclassified' WHEN trades < 30 THEN CASE WHEN hold > 0 AND hold < 300 AND win > 0.6 THEN 'sniper' WHEN trip > 0.5 THEN 'arbitrageur' WHEN mm > 0.7 THEN 'market_maker' WHEN hold > 3600 AND ratio > 1.0 THEN 'swing' ELSE 'unclassified' END
          ELSE coalesce(c[1].name, 'unclassified') END AS class,
        CASE WHEN trades < 2 THEN 0.0 WHEN trades < 30 THEN trades / 30 * 0.3 WHEN len(c) = 0 THEN 0.3 ELSE least(1.0, -c[1].s * least(1.0, trades / 30) + CASE WHEN p < 0.05 AND n >= 30 THEN 0.15 ELSE 0 END + 0.1 * cs) END AS confidence FROM c2)"""
_ADVICE = f"""{_CURVE},
      adv AS (SELECT w.wallet, coalesce(c.n, 0) AS k, coalesce(c.ir, 0) AS ir, c.t AS ct, c.win_rate AS cw, CASE WHEN coalesce(c.n, 0) < 5 THEN 'shadow_only' WHEN c.p < 0.05 AND c.mean_pnl > 0 THEN 'follow' WHEN c.mean_pnl < 0 AND c.t < -1.645 THEN 'fade' WHEN c.mean_pnl > 0 THEN 'shadow_only' ELSE 'ignore' END AS advice,
          bs.best_ms
        FROM (SELECT DISTINCT wallet FROM v_trades) w LEFT JOIN curve c ON c.wallet = w.wallet AND c.delay_ms = {LATENCY}
        LEFT JOIN (SELECT wallet, delay_ms AS best_ms, row_number() OVER (PARTITION BY wallet ORDER BY mean_pnl DESC, delay_ms) AS rk FROM curve WHERE p < 0.05 AND mean_pnl > 0) bs ON bs.wallet = w.wallet AND bs.rk = 1)"""

ORACLE_SQL = {
    "regime_consistency": f"{_PROFILE_ALONE} SELECT wallet, regimes, round(consistency, 6) + 0.0 AS consistency, robust FROM cons",
    "wallet_class": f"{_CLASS} SELECT wallet, trades, class, round(confidence, 6) + 0.0 AS confidence FROM cls",
    "delay_advice": f"WITH {sql.PAIRS}, {_ADVICE} SELECT wallet, k AS n, round(ir, 6) + 0.0 AS ir, advice, best_ms FROM adv",
    "follow_parameters": f"""WITH {sql.PAIRS}, {_ADVICE}, q AS (SELECT wallet, list_sort(list(ticks * size)) AS x FROM v_trades GROUP BY wallet)
      SELECT adv.wallet, coalesce(best_ms, {LATENCY}) AS delay_ms, round(x[len(x) // 4 + 1] / 100, 6) + 0.0 AS least_size, round(CASE WHEN c.win_rate > 0.5 AND c.ir > 0 THEN least(0.1, 0.25 * c.ir) ELSE 0.02 END * 10000.0, 6) + 0.0 AS allocation
      FROM adv JOIN q USING (wallet) LEFT JOIN curve c ON c.wallet = adv.wallet AND c.delay_ms = coalesce(best_ms, {LATENCY})""",
    "wallet_gate": f"""{_CLASS}, {_ADVICE}, hl AS ({Q.ORACLE_SQL["delay_halflife"].split(" SELECT wallet, round(hl")[0]} SELECT wallet, hl FROM h2)
      SELECT cls.wallet, CASE class WHEN 'sniper' THEN CASE WHEN coalesce(hl, 0) > {LATENCY} AND advice = 'follow' THEN 'follow' ELSE 'skip' END WHEN 'swing' THEN 'follow' WHEN 'market_maker' THEN 'fade' WHEN 'noise' THEN 'skip' ELSE CASE WHEN advice = 'follow' THEN 'follow' ELSE 'skip' END END AS gate,
        round(least(greatest(0.35 * least(1, abs(coalesce(ct, 0)) / 3) + 0.25 * greatest(0, (coalesce(cw, 0) - 0.5) * 3.33) + 0.25 * confidence + 0.15 * 0.5, 0.01), 1), 6) + 0.0 AS strength FROM cls JOIN adv USING (wallet) LEFT JOIN hl USING (wallet)""",
    "market_heat": f"""{_CLASS}, rec AS (SELECT DISTINCT market, wallet FROM v_trades WHERE ts > (SELECT max(ts) FROM v_trades) - 86400000)
      SELECT market, round(sum(CASE WHEN class IN ('sniper', 'swing') THEN 2.0 WHEN class = 'arbitrageur' THEN 1.5 WHEN class = 'market_maker' THEN 0.5 ELSE 0.3 END * confidence), 6) + 0.0 AS heat FROM rec JOIN cls USING (wallet) GROUP BY market""",
    "wallet_score": f"""{Q._STATS}, {_ADVICE}, rob AS ({_PROFILE_ALONE} SELECT DISTINCT wallet, robustness FROM prof),
      c AS (SELECT *, sum(pnl_ticks) OVER w AS cum, count(*) FILTER (pnl_ticks >= 0) OVER w AS wins FROM pairs WINDOW w AS (PARTITION BY wallet ORDER BY exit_ts, exit_id, entry_id ROWS UNBOUNDED PRECEDING)),
      q AS (SELECT wallet, max(k) AS streak FROM (SELECT wallet, wins, count(*) FILTER (pnl_ticks < 0) AS k FROM c GROUP BY ALL) GROUP BY wallet),
      nw AS (SELECT max(ts) AS now_ts FROM v_trades), lt AS (SELECT wallet, max(ts) AS last, count(*) AS trades FROM v_trades GROUP BY wallet),
      z AS (SELECT s.wallet, advice, round(0.35 * CASE WHEN adv.k >= 2 THEN least(greatest(adv.ir / 2, 0), 1) ELSE 0 END
        + 0.20 * CASE WHEN trades >= 5 THEN 0.4 * 4 * greatest(win_rate - 0.5, 0) + 0.3 * greatest(1 - streak / 10, 0) + 0.3 * least(greatest(sharpe / 2, 0), 1) ELSE 0 END
        + 0.15 * least(greatest(CASE WHEN isnan(t) THEN 0 ELSE t END / 3, 0), 1) + 0.10 * CASE WHEN trades >= 2 THEN 0.7 * least(greatest(sharpe / 2, 0), 1) + CASE WHEN pnl_ticks > 0 THEN 0.15 ELSE 0 END ELSE 0 END
        + 0.10 * coalesce(robustness, 0.5) + 0.05 * least(1, trades / 30)
        + 0.05 * CASE WHEN now_ts = last THEN 1 WHEN (now_ts - last) / 86400000 >= 30 THEN 0 ELSE exp(-0.693 * ((now_ts - last) / 86400000) / 10) END, 9) AS score
        FROM s JOIN q USING (wallet) JOIN lt USING (wallet) CROSS JOIN nw LEFT JOIN adv USING (wallet) LEFT JOIN rob USING (wallet))
      SELECT wallet, round(score, 5) + 0.0 AS score, CASE WHEN advice = 'fade' AND score < 0.3 THEN 'fade' WHEN advice = 'follow' AND score >= 0.4 THEN 'follow' WHEN score >= 0.6 THEN 'follow' WHEN score >= 0.15 THEN 'shadow_only' ELSE 'ignore' END AS recommendation FROM z""",
    "copy_simulation": f"WITH {_COPY} SELECT wallet, token, entry_id, exit_id, size, round(pnl, 9) + 0.0 AS pnl, hold_ms FROM cp",
    "copy_summary": f"WITH {_COPY} SELECT wallet, count(*) AS closed, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 6) + 0.0 AS pnl, round(avg(hold_ms), 2) + 0.0 AS hold_ms FROM cp GROUP BY wallet",
    "regime_profile": f"{_PROFILE_ALONE} SELECT wallet, regime, n, round(sharpe, 6) + 0.0 AS sharpe, round(robustness, 6) + 0.0 AS robustness, sensitive FROM prof",
    "partition_check": f"""WITH {sql.LEVELS}, b AS (SELECT book, ticks / 200 AS bid, size AS bs FROM v_levels WHERE side = 'bid' AND level = 1), a AS (SELECT book, ticks / 200 AS ask, size AS az FROM v_levels WHERE side = 'ask' AND level = 1),
      m AS (SELECT book // 2 AS cluster, (bid + ask) / 2 AS mid, * FROM b JOIN a USING (book)), c AS (SELECT cluster, count(*) AS n, sum(mid) AS total, sum(bid) AS bids, sum(ask) AS asks, min(bs) AS bd, min(az) AS ad FROM m WHERE mid > 0 GROUP BY 1),
      x AS (SELECT *, abs(total - 1) AS violation, greatest(CASE WHEN total > 1 THEN bids - 1 ELSE 1 - asks END - 0.02 * n, 0) AS executable, CASE WHEN total > 1 THEN bd ELSE ad END AS dp FROM c)
      SELECT cluster, n, round(total, 6) + 0.0 AS total, round(violation, 6) + 0.0 AS violation, round(executable, 6) + 0.0 AS executable, executable > 0.005 AND dp >= 50 AS tradeable FROM x WHERE n >= 2 AND violation >= 0.001""",
    "return_correlation": f"""WITH {sql.PRICES}, d AS (SELECT *, price - lag(price) OVER (PARTITION BY series ORDER BY ts, event_id) AS a FROM v_prices), e AS (SELECT *, lag(a) OVER (PARTITION BY series ORDER BY ts, event_id) AS b FROM d)
      SELECT series, count(*) AS n, round(CASE WHEN count(*) < 5 THEN 0.0 ELSE corr(a, b) END, 6) + 0.0 AS correlation FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY series""",
    "signal_kills": f"""WITH {sql.TRADES}, n AS (SELECT max(ts) AS now FROM v_trades), l AS (SELECT token, arg_max(ticks, event_id) / 100 AS mid FROM v_trades GROUP BY 1),
      k AS (SELECT event_id, CASE WHEN now - ts >= 2000000000 THEN 'time_elapsed' WHEN abs(mid - ticks / 100) >= 0.4 THEN 'price_moved' WHEN size % 7 = 0 THEN 'regime_changed' WHEN (CASE WHEN now - ts <= 0 THEN ticks / 1000 ELSE ticks / 1000 * exp(-0.693147 * (now - ts) / 864000000.0) END) < 0.02 THEN 'ev_decayed' END AS reason FROM v_trades JOIN l USING (token) CROSS JOIN n)
      SELECT event_id, reason FROM k WHERE reason IS NOT NULL""",
}
