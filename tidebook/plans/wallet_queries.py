"""Queries on participants and their trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fifo, wallets
from ..sources import views
from . import sql

KEYS = ["wallet", "market", "token"]
ORDER = ["ts", "event_id"]


def r(column: str, digits: int = 6) -> Column:
    return (F.round(column, digits) + 0.0).alias(column)


def r_expr(c: Column, name: str, digits: int = 6) -> Column:
    return (F.round(c, digits) + 0.0).alias(name)


def pairs(spark, sf_dir: str) -> DataFrame:
    return fifo.match(views.trades(spark, sf_dir), KEYS, ORDER)


def fifo_match(spark, sf_dir):
    return pairs(spark, sf_dir)


def wallet_stats(spark, sf_dir):
    s = wallets.statistics(pairs(spark, sf_dir))
    return s.select("wallet", "n", "pnl_ticks", "median_hold_ms", r("avg_hold_ms", 3), *(r(c) for c in ("win_rate", "avg_size", "sharpe", "sortino", "t", "p", "d")))


def top_wallets(spark, sf_dir):
    s = wallets.statistics(pairs(spark, sf_dir)).where("n >= 5")
    return s.orderBy(F.desc("pnl_ticks"), "wallet").limit(20).select("wallet", "n", "pnl_ticks", r("win_rate"))


def wallet_hhi(spark, sf_dir):
    return wallets.concentration(views.trades(spark, sf_dir)).select("wallet", r("hhi"), "top")


def active_hours(spark, sf_dir):
    return wallets.active_hours(views.trades(spark, sf_dir))


def round_trip_rate(spark, sf_dir):
    return wallets.round_trip_rate(views.trades(spark, sf_dir)).select("wallet", r("rate"))


def mm_score(spark, sf_dir):
    return wallets.market_maker_score(views.trades(spark, sf_dir)).select("wallet", r("score"))


def timing_pattern(spark, sf_dir):
    return wallets.timing(views.trades(spark, sf_dir)).select("wallet", "peak_hour", "peak_day", r("hour_hhi"), r("day_hhi"))


def clustering(spark, sf_dir):
    return wallets.clustering(views.trades(spark, sf_dir)).select("wallet", r("score"))


def drawdown_streak(spark, sf_dir):
    return wallets.drawdown_and_streak(pairs(spark, sf_dir))


def delay_curve(spark, sf_dir):
    curve = wallets.delay_curve(pairs(spark, sf_dir), views.trades(spark, sf_dir))
    return curve.select("wallet", "delay_ms", "n", r("mean_pnl", 9), r("win_rate"))


def delay_halflife(spark, sf_dir):
    curve = wallets.delay_curve(pairs(spark, sf_dir), views.trades(spark, sf_dir))
    return wallets.half_life(curve).select("wallet", r("halflife_ms", 3), r("breakeven_ms", 3))


def positions(spark, sf_dir):
    return wallets.positions(views.trades(spark, sf_dir)).select("wallet", "market", "token", "size", r("avg_entry"), r("unrealized"))


_STATS = f"""WITH {sql.PAIRS},
a AS (SELECT wallet, count(*) AS n, CAST(sum(pnl_ticks) AS BIGINT) AS pnl_ticks, avg(CASE WHEN pnl_ticks > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
    avg(exit_ts - entry_ts) AS avg_hold_ms, list_sort(list(exit_ts - entry_ts)) AS holds, avg(size) AS avg_size,
    avg(pnl_ticks / 100) AS m, stddev_samp(pnl_ticks / 100) AS sd,
    sqrt(sum(CASE WHEN pnl_ticks < 0 THEN (pnl_ticks / 100) * (pnl_ticks / 100) ELSE 0 END) / count(*)) AS down
  FROM pairs GROUP BY wallet),
b AS (SELECT *, CASE WHEN n < 2 THEN 'nan'::DOUBLE WHEN sd = 0 THEN CASE WHEN m = 0 THEN 0.0 WHEN m > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE m / (sd / sqrt(n)) END AS t FROM a),
s AS (SELECT wallet, n, pnl_ticks, holds[CAST(floor(n * 0.5) AS BIGINT) + 1] AS median_hold_ms, win_rate, avg_hold_ms, avg_size,
    CASE WHEN n < 2 THEN 0.0 WHEN sd = 0 THEN CASE WHEN m = 0 THEN 0.0 WHEN m > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE m / sd END AS sharpe,
    CASE WHEN n < 2 THEN 0.0 WHEN down = 0 THEN CASE WHEN m > 0 THEN 'inf'::DOUBLE ELSE 0.0 END ELSE m / down END AS sortino, t,
    CASE WHEN n < 2 THEN 'nan'::DOUBLE WHEN sd = 0 THEN CASE WHEN m > 0 THEN 0.0 ELSE 1.0 END ELSE {sql.p_value("t", "n - 1")} END AS p,
    CASE WHEN n < 2 THEN 'nan'::DOUBLE WHEN sd = 0 THEN 0.0 ELSE m / sd END AS d FROM b)"""

_DELAYS = (1, 2, 3, 5, 10, 15, 20, 30, 45, 60)
_CURVE = f"""{sql.PAIRS},
dl AS (SELECT unnest([{", ".join(f"{d * 3600000}" for d in _DELAYS)}]) AS delay_ms),
x AS (SELECT p.*, d.delay_ms, p.entry_ts + d.delay_ms AS at_ts FROM pairs p CROSS JOIN dl d WHERE p.entry_ts + d.delay_ms < p.exit_ts),
ser AS (SELECT token, ts, max(ticks) AS ticks FROM v_trades GROUP BY ALL),
bk AS (SELECT x.*, s.ticks AS bt, s.ts AS bts FROM x ASOF LEFT JOIN ser s ON x.token = s.token AND x.at_ts >= s.ts),
fw AS (SELECT b.*, s.ticks AS ft, s.ts AS fts FROM bk b ASOF LEFT JOIN ser s ON b.token = s.token AND b.at_ts <= s.ts),
pr AS (SELECT *, CASE WHEN fts IS NOT NULL AND (bts IS NULL OR fts - at_ts <= at_ts - bts) THEN ft ELSE bt END AS pt,
    CASE WHEN fts IS NOT NULL AND (bts IS NULL OR fts - at_ts <= at_ts - bts) THEN fts ELSE bts END AS pts FROM fw),
c0 AS (SELECT wallet, CAST(delay_ms AS BIGINT) AS delay_ms, count(*) AS n, sum((exit_ticks - pt) * size) / count(*) / 100 AS m,
    CASE WHEN min((exit_ticks - pt) * size) = max((exit_ticks - pt) * size) THEN 0.0 ELSE stddev_samp((exit_ticks - pt) * size / 100) END AS sd,
    avg(CASE WHEN exit_ticks > pt THEN 1.0 ELSE 0.0 END) AS w FROM pr WHERE abs(pts - at_ts) <= 43200000 GROUP BY wallet, delay_ms),
curve AS (SELECT wallet, delay_ms, n, m AS mean_pnl, CASE WHEN n < 2 THEN 0.0 ELSE w END AS win_rate, CASE WHEN n < 2 THEN 0.0 WHEN sd > 0 THEN m / sd WHEN m > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS ir,
    CASE WHEN n < 2 THEN 0.0 WHEN sd = 0 THEN CASE WHEN m = 0 THEN 0.0 WHEN m > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE m / (sd / sqrt(n)) END AS t,
    CASE WHEN n < 2 THEN 1.0 WHEN sd = 0 THEN CASE WHEN m > 0 THEN 0.0 ELSE 1.0 END ELSE {sql.p_value("(m / (sd / sqrt(n)))", "(n - 1)")} END AS p FROM c0)"""

_HALF = f"""{_CURVE},
h1 AS (SELECT *, lag(mean_pnl) OVER w AS p0, lag(delay_ms) OVER w AS d0, first_value(mean_pnl) OVER w AS first FROM curve WINDOW w AS (PARTITION BY wallet ORDER BY delay_ms)),
h2 AS (SELECT wallet, max(first) AS first,
    min(CASE WHEN first > 0 AND p0 IS NOT NULL AND mean_pnl <= first / 2 AND p0 > first / 2 THEN d0 + (p0 - first / 2) / (p0 - mean_pnl) * (delay_ms - d0) END) AS hl,
    min(CASE WHEN first > 0 AND p0 > 0 AND mean_pnl <= 0 THEN d0 + p0 / (p0 - mean_pnl) * (delay_ms - d0) END) AS be FROM h1 GROUP BY wallet)"""

QUERIES = {f.__name__: f for f in (fifo_match, wallet_stats, top_wallets, wallet_hhi, active_hours, round_trip_rate, mm_score, timing_pattern, clustering, drawdown_streak, delay_curve, delay_halflife, positions)}

ORACLE_SQL = {
    "fifo_match": f"WITH {sql.PAIRS} SELECT * FROM pairs",
    "wallet_stats": f"{_STATS} SELECT wallet, n, pnl_ticks, median_hold_ms, round(avg_hold_ms, 3) + 0.0 AS avg_hold_ms, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('win_rate', 'avg_size', 'sharpe', 'sortino', 't', 'p', 'd'))} FROM s",
    "top_wallets": f"{_STATS} SELECT wallet, n, pnl_ticks, round(win_rate, 6) + 0.0 AS win_rate FROM s WHERE n >= 5 ORDER BY pnl_ticks DESC, wallet LIMIT 20",
    "wallet_hhi": f"""WITH {sql.TRADES}, e AS (SELECT wallet, market, sum(ticks * size) AS notional FROM v_trades GROUP BY ALL),
      s AS (SELECT *, notional / sum(notional) OVER (PARTITION BY wallet) AS share, row_number() OVER (PARTITION BY wallet ORDER BY notional DESC, market) AS rk FROM e)
      SELECT wallet, round(sum(share * share), 6) + 0.0 AS hhi, string_agg(CAST(market AS VARCHAR), ',' ORDER BY rk) FILTER (rk <= 5) AS top FROM s GROUP BY wallet""",
    "active_hours": f"""WITH {sql.TRADES}, w AS (SELECT DISTINCT wallet FROM v_trades), h AS (SELECT CAST(unnest(range(24)) AS BIGINT) AS hour),
      c AS (SELECT wallet, (ts // 3600000) % 24 AS hour, count(*) AS trades FROM v_trades GROUP BY ALL)
      SELECT w.wallet, h.hour, coalesce(c.trades, 0) AS trades FROM w CROSS JOIN h LEFT JOIN c ON c.wallet = w.wallet AND c.hour = h.hour""",
    "round_trip_rate": f"WITH {sql.TRADES}, e AS (SELECT wallet, market, count(DISTINCT token) AS k FROM v_trades GROUP BY ALL) SELECT wallet, round(avg(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS rate FROM e GROUP BY wallet",
    "mm_score": f"""WITH {sql.TRADES}, e AS (SELECT wallet, market, count(*) AS n, count(*) FILTER (side = 'BUY') AS b, count(DISTINCT token) AS k FROM v_trades GROUP BY ALL)
      SELECT wallet, round(coalesce(avg(CASE WHEN n >= 4 THEN 0.6 * (1 - abs(2 * b - n) / n) + 0.4 * CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END END), 0), 6) + 0.0 AS score FROM e GROUP BY wallet""",
    "timing_pattern": f"""WITH {sql.TRADES}, h AS (SELECT wallet, (ts // 3600000) % 24 AS bin, count(*) AS n FROM v_trades GROUP BY ALL),
      d AS (SELECT wallet, (ts // 86400000 + 4) % 7 AS bin, count(*) AS n FROM v_trades GROUP BY ALL),
      hh AS (SELECT wallet, arg_min(bin, -n * 100 + bin) AS peak_hour, sum(n * n) / (sum(n) * sum(n)) AS hour_hhi FROM h GROUP BY wallet),
      dd AS (SELECT wallet, arg_min(bin, -n * 100 + bin) AS peak_day, sum(n * n) / (sum(n) * sum(n)) AS day_hhi FROM d GROUP BY wallet)
      SELECT wallet, peak_hour, peak_day, round(hour_hhi, 6) + 0.0 AS hour_hhi, round(day_hhi, 6) + 0.0 AS day_hhi FROM hh JOIN dd USING (wallet)""",
    "clustering": f"""WITH {sql.TRADES}, g AS (SELECT wallet, ts - lag(ts) OVER (PARTITION BY wallet ORDER BY ts, event_id) AS gap FROM v_trades)
      SELECT wallet, round(CASE WHEN count(*) < 3 OR avg(gap) = 0 THEN 0.0 ELSE var_pop(gap) / (avg(gap) * avg(gap)) END, 6) + 0.0 AS score FROM g GROUP BY wallet""",
    "drawdown_streak": f"""WITH {sql.PAIRS}, c AS (SELECT *, sum(pnl_ticks) OVER w AS cum, count(*) FILTER (pnl_ticks >= 0) OVER w AS wins FROM pairs WINDOW w AS (PARTITION BY wallet ORDER BY exit_ts, exit_id, entry_id ROWS UNBOUNDED PRECEDING)),
      m AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY wallet ORDER BY exit_ts, exit_id, entry_id ROWS UNBOUNDED PRECEDING)) - cum AS fall FROM c),
      l AS (SELECT wallet, wins, count(*) FILTER (pnl_ticks < 0) AS k FROM c GROUP BY ALL)
      SELECT m.wallet, CAST(max(fall) AS BIGINT) AS max_drawdown, any_value(q.loss_streak) AS loss_streak FROM m JOIN (SELECT wallet, max(k) AS loss_streak FROM l GROUP BY wallet) q USING (wallet) GROUP BY m.wallet""",
    "delay_curve": f"WITH {_CURVE} SELECT wallet, delay_ms, n, round(mean_pnl, 9) + 0.0 AS mean_pnl, round(win_rate, 6) + 0.0 AS win_rate FROM curve",
    "delay_halflife": f"WITH {_HALF} SELECT wallet, round(hl, 3) + 0.0 AS halflife_ms, round(CASE WHEN first <= 0 THEN 0.0 ELSE be END, 3) + 0.0 AS breakeven_ms FROM h2",
    "positions": f"""WITH {sql.TRADES}, l AS (SELECT token, arg_max(ticks, event_id) AS mark FROM v_trades GROUP BY token),
      p AS (SELECT wallet, market, token, CAST(sum(size) AS BIGINT) AS size, sum(size * ticks) / sum(size) / 100 AS avg_entry FROM v_trades WHERE side = 'BUY' GROUP BY ALL)
      SELECT wallet, market, p.token, size, round(avg_entry, 6) + 0.0 AS avg_entry, round((mark / 100 - avg_entry) * size - 0.02 * avg_entry * size, 6) + 0.0 AS unrealized FROM p JOIN l ON p.token = l.token""",
}
