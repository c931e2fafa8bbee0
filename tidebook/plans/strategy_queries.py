"""Queries on signals and their outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import strategies
from ..sources import views
from . import sql
from .wallet_queries import r


def imbalance_signals(spark, sf_dir):
    return strategies.imbalance_signals(views.books(spark, sf_dir), least=0.2).select("book", "side", r("ev", 9), r("size"), r("strength"))


def _shadow(spark, sf_dir) -> DataFrame:
    t = views.trades(spark, sf_dir).withColumn("next", F.lead("ticks").over(W.partitionBy("token").orderBy("ts", "event_id"))).where("next is not null")
    s = t.select("event_id", "token", "side", (F.col("ticks") / 100).alias("mid"), F.lit(0.03).alias("spread"), "size", (F.col("ticks") / 1000).alias("ev"), (F.col("token") + 1).cast("double").alias("half_life_s"), (F.col("next") / 100).alias("outcome"))
    return strategies.shadow(s).withColumns({c: F.round(c, 9) for c in ("ideal", "actual")})


def shadow_records(spark, sf_dir):
    return _shadow(spark, sf_dir).select("event_id", r("ideal"), r("actual"), "attribution")


def shadow_report(spark, sf_dir):
    return strategies.shadow_report(_shadow(spark, sf_dir), "token").select("token", "n", r("ideal"), r("actual"), r("accuracy"), *(f"{a}_signal_{b}_exec" for a in ("good", "bad") for b in ("good", "bad")))


def price_enrichment(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    return strategies.enriched(t.drop("ticks"), t, 1_800_000).select("event_id", "ticks", "price_id")


def gap_persistence(spark, sf_dir):
    g = views.trades(spark, sf_dir).select("market", "event_id", "ts", (F.col("ticks") % 5).alias("book_hash"), (F.col("ticks") - 50).alias("profit"))
    return strategies.gap_persistence(g).select("event_id", "market", "seen")


QUERIES = {f.__name__: f for f in (imbalance_signals, shadow_records, shadow_report, price_enrichment, gap_persistence)}

_SHADOW = f"""{sql.TRADES}, n AS (SELECT *, lead(ticks) OVER (PARTITION BY token ORDER BY ts, event_id) AS nx FROM v_trades),
s AS (SELECT event_id, token, CASE WHEN side = 'BUY' THEN 1.0 ELSE -1.0 END AS d, ticks / 100 AS mid, size, ticks / 1000 AS ev, token + 1.0 AS h, nx / 100 AS o FROM n WHERE nx IS NOT NULL),
x AS (SELECT *, round(d * (o - mid), 9) AS ideal, round(d * (o - (mid + d * (ev - ev * exp(-0.693147 * 3.0 / h) + 0.015))) - (0.02 + 0.001 * size / 100 * 0.03 + 0.0005 * size / 100), 9) AS actual FROM s),
sh AS (SELECT *, CASE WHEN ideal > 0 THEN 'good' ELSE 'bad' END || '_signal_' || CASE WHEN actual > 0 THEN 'good' ELSE 'bad' END || '_exec' AS attribution FROM x)"""
_NAMES = [f"{a}_signal_{b}_exec" for a in ("good", "bad") for b in ("good", "bad")]

ORACLE_SQL = {
    "imbalance_signals": f"""WITH {sql.LEVELS}, a AS (SELECT book, max(price) FILTER (side = 'bid') AS b, min(price) FILTER (side = 'ask') AS k, coalesce(sum(size * [12, 6, 4, 3][level - 1]) FILTER (side = 'bid' AND level BETWEEN 2 AND 5), 0) AS bd, coalesce(sum(size * [12, 6, 4, 3][level - 1]) FILTER (side = 'ask' AND level BETWEEN 2 AND 5), 0) AS kd,
        CAST(sum(size) FILTER (side = 'bid' AND level <= 5) AS DOUBLE) AS b5, CAST(sum(size) FILTER (side = 'ask' AND level <= 5) AS DOUBLE) AS k5 FROM v_levels GROUP BY book),
      i AS (SELECT *, k - b AS spread, CASE WHEN bd + kd = 0 THEN 0.0 ELSE (bd - kd) / (bd + kd) END AS imb FROM a WHERE b IS NOT NULL AND k IS NOT NULL),
      e AS (SELECT *, abs(imb) * spread * 5 - spread / 2 - 0.02 AS ev, CASE WHEN imb > 0 THEN b5 ELSE k5 END AS depth FROM i WHERE abs(imb) >= 0.2)
      SELECT book, CASE WHEN imb > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(ev, 9) + 0.0 AS ev, round(greatest(least(abs(imb) * depth, 100), 1), 6) + 0.0 AS size,
        round(greatest(least(0.40 * greatest(least((abs(imb) - 0.2) / 0.8, 1), 0) + 0.35 * greatest(least(ev / 0.05, 1), 0) + 0.25 * greatest(least(depth / 500, 1), 0), 1), 0.01), 6) + 0.0 AS strength FROM e WHERE ev > 0""",
    "shadow_records": f"WITH {_SHADOW} SELECT event_id, round(ideal, 6) + 0.0 AS ideal, round(actual, 6) + 0.0 AS actual, attribution FROM sh",
    "shadow_report": f"WITH {_SHADOW} SELECT token, count(*) AS n, round(avg(ideal), 6) + 0.0 AS ideal, round(avg(actual), 6) + 0.0 AS actual, round(avg(CASE WHEN ideal > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy, {', '.join(f'''count(*) FILTER (attribution = '{n}') AS {n}''' for n in _NAMES)} FROM sh GROUP BY token",
    "price_enrichment": f"""WITH {sql.TRADES}, l AS (SELECT * FROM v_trades),
      c AS (SELECT l.event_id, t.ticks, t.event_id AS price_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(t.ts - l.ts) + CASE WHEN abs(t.size - l.size) / greatest(t.size, l.size) > 0.2 THEN 10000 ELSE 0 END, t.ts, t.event_id) AS k
        FROM l JOIN v_trades t ON t.token = l.token AND t.event_id <> l.event_id AND t.ts BETWEEN l.ts - 1800000 AND l.ts + 1800000)
      SELECT l.event_id, c.ticks, c.price_id FROM l LEFT JOIN c ON c.event_id = l.event_id AND c.k = 1""",
    "gap_persistence": f"""WITH {sql.TRADES}, g AS (SELECT event_id, market, ts, ticks - 50 AS profit, ticks % 5 AS h, lag(ticks % 5) OVER (PARTITION BY market ORDER BY ts, event_id) AS p FROM v_trades)
      SELECT event_id, market, CAST(sum(CASE WHEN (p IS NULL OR p <> h) AND profit > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY market ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen FROM g""",
}
