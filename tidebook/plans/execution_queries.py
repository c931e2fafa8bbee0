"""Queries on paper positions, consistency between markets, and strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, evaluators, positions
from ..sources import views
from . import market_queries as M
from . import sql
from .market_queries import r_expr
from .wallet_queries import r

# -- positions ---------------------------------------------------------------------------------------------------


def _executions(spark, sf_dir) -> DataFrame:
    t = views.trades(spark, sf_dir)
    price = F.col("ticks") / 100
    return t.select("event_id", "market", "token", F.concat(F.lit("s"), F.col("wallet") % 4).alias("strategy"), F.col("side").alias("direction"), "size", price.alias("price"), (0.02 * price * F.col("size")).alias("fee"), (F.col("ticks") / 1000).alias("ev"), "ts")


def _ends(spark, sf_dir) -> DataFrame:
    """Two of the markets are resolved half-way."""
    return views.trades(spark, sf_dir).where("market < 2").groupBy("market").agg((F.min("ts") + F.floor((F.max("ts") - F.min("ts")) / 2)).cast("long").alias("ts"), F.max(F.col("market").cast("double")).alias("price"))


def _lifecycle(spark, sf_dir) -> DataFrame:
    return positions.lifecycle(_executions(spark, sf_dir), _ends(spark, sf_dir))


def _held(spark, sf_dir) -> DataFrame:
    t = views.trades(spark, sf_dir)
    now = t.agg(F.max("ts")).first()[0] or 0
    return positions.marked(_lifecycle(spark, sf_dir), t.groupBy("token").agg((F.max_by("ticks", F.struct("ts", "event_id")) / 100).alias("mark")), F.lit(now))


def position_lifecycle(spark, sf_dir):
    return _lifecycle(spark, sf_dir).select(*positions.KEY, F.col("epoch").cast("long").alias("epoch"), "fills", "size", r("entry"), r("fee", 4), r("ev"), "opened_at", "exit", "closed_at")


def position_closes(spark, sf_dir):
    return positions.closes(_lifecycle(spark, sf_dir)).select(*positions.KEY, "size", r("entry"), "exit", r("gross", 4), r("net", 4), "holding_ms", r("realized_ev"), r("ev_error"))


def open_positions(spark, sf_dir):
    return _held(spark, sf_dir).orderBy(F.desc("unrealized")).select(*positions.KEY, "size", r("entry"), "mark", r("unrealized", 4), "age_ms", r("ev"))


def position_excursions(spark, sf_dir):
    """How far the token's price went for and against each position, open or closed, while it was held."""
    t = views.trades(spark, sf_dir)
    found = positions.excursions(_executions(spark, sf_dir), _ends(spark, sf_dir), t.select("token", "ts", "event_id", (F.col("ticks") / 100).alias("mark")))
    rows = _lifecycle(spark, sf_dir).join(found, [*positions.KEY, "epoch"])
    return rows.select(*positions.KEY, F.col("epoch").cast("long").alias("epoch"), F.col("closed_at").isNull().alias("open"), r("favorable"), r("adverse"))


def pnl_by_strategy(spark, sf_dir):
    out = positions.profit_by_strategy(positions.closes(_lifecycle(spark, sf_dir)), _held(spark, sf_dir))
    return out.select("strategy", "trades", "wins", "losses", r("realized", 4), r("unrealized", 4), r("total", 4), r("mean", 4), r("win_rate"), r("t"), r("p"), "significant")


# -- consistency -------------------------------------------------------------------------------------------------


def _markets(spark, sf_dir) -> DataFrame:
    """Markets with a dated question, some of them on a step that others depend on, and quotes at different heights."""
    month = F.element_at(F.array(*map(F.lit, X.MONTHS)), (F.col("market") % 12 + 1).cast("int"))
    step = F.element_at(F.array(F.lit(" primary"), F.lit(" election"), F.lit("")), (F.col("market") % 3 + 1).cast("int"))
    q = views.questions(spark, sf_dir).withColumn("name", F.col("question")).withColumn("question", F.concat("question", step, F.lit(" by "), month))
    k = (50 + 10 * (F.col("book") % 7)) / 100
    quotes = checks.quotes(views.books(spark, sf_dir)).select(F.col("book").alias("market"), *((F.col(c) * k).alias(c) for c in ("mid", "bid", "ask", "bid_fill", "ask_fill")), "bid_size", "ask_size")
    return q.join(quotes, "market")


SILENCE = 2 * M.HOUR


def _violations(spark, sf_dir) -> DataFrame:
    t = views.trades(spark, sf_dir)
    seen = t.select(F.col("token").alias("check_id"), (F.floor(F.col("ts") / 60_000) * 60_000).alias("ts"), (F.col("ticks") / 100).alias("magnitude"), (F.col("size") % 5 == 0).alias("tradeable"))
    return checks.violations(seen, SILENCE)


def violations(spark, sf_dir):
    return _violations(spark, sf_dir).select("check_id", F.col("k").cast("long").alias("k"), "first_ts", "last_ts", "n", "peak", "tradeable", "resolved_at")


def violation_persistence(spark, sf_dir):
    now = views.trades(spark, sf_dir).agg(F.max("ts")).first()[0] or 0
    return checks.persistence(_violations(spark, sf_dir), now, 48 * M.HOUR).select("active", "resolved", "median_ms", r("mean_ms", 3), r("tradeable"))


# -- strategies --------------------------------------------------------------------------------------------------


def _binary(spark, sf_dir) -> DataFrame:
    """Markets of two outcomes: even books and the odd ones after them, at half their price."""
    b = views.books(spark, sf_dir)
    half = lambda c, name: F.transform(c, lambda x: F.struct((x["price"] / 2).alias("price"), x["size"].alias("size"))).alias(name)
    side = lambda k, name: b.where(F.col("book") % 2 == k).select(F.expr("book div 2").alias("market"), half("bids", f"{name}_bids"), half("asks", f"{name}_asks"))
    m = F.col("market")
    return side(0, "yes").join(side(1, "no"), "market").withColumns({"updates": 1 + m % 6, "stability_ms": 1000 * (m % 9), "rate": (5 + m % 20).cast("double"), "update_ms": (500 * (m % 6)).cast("double"), "type": m % 4})


def complement_signals(spark, sf_dir):
    return evaluators.complement_arbitrage(_binary(spark, sf_dir), 40.0, 100.0, depth=20.0).select("market", r("raw"), r("ev"), r("size"), r("strength"))


def microprice_signals(spark, sf_dir):
    return evaluators.microprice_dislocation(_binary(spark, sf_dir), 100.0, threshold=0.2, spread_bps=6_000.0).select("market", "outcome", r("deviation"), r("ev"), r("size"), r("strength"))


def complement_gaps(spark, sf_dir):
    from ..functions import book as B

    b = _binary(spark, sf_dir)
    gap = evaluators.complement_gap(B.mid(F.col("yes_bids"), F.col("yes_asks")), B.mid(F.col("no_bids"), F.col("no_asks")))
    profit = evaluators.complement_profit(B.best(F.col("yes_asks"), "price"), B.best(F.col("no_asks"), "price"))
    return b.select("market", r_expr(gap, "gap"), r_expr(profit, "executable"), r_expr(evaluators.slip_probability(F.col("stability_ms"), 40.0), "slip"))


def book_features(spark, sf_dir):
    return evaluators.features(views.books(spark, sf_dir)).select("book", r("microprice_deviation"), r("queue_depth_ratio"), r("book_fragility"))


def spread_regimes(spark, sf_dir):
    return M.feature_z(spark, sf_dir).select("event_id", evaluators.spread_regime(F.col("z")).alias("regime"))


def sensitivity(spark, sf_dir):
    t = views.trades(spark, sf_dir)
    s = evaluators.sensitivity(t.select("event_id", (F.col("ticks") / 1000).alias("edge"), "size", F.lit(0.03).alias("spread"), (F.col("ticks") / 100).alias("mid")))
    return s.select("event_id", *(r(c, 9) for c in ("edge_less", "edge_more", "size_less", "size_more")), "robust")


def calendar(spark, sf_dir):
    """Days and ISO times of trades, and hours to the last of all."""
    t = views.trades(spark, sf_dir)
    end = t.agg(F.max("ts").alias("end"))
    at = F.timestamp_millis("ts")
    return t.join(F.broadcast(end)).select("event_id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), r_expr((F.col("end") - F.col("ts")) / 3_600_000, "hours_left"))


QUERIES = {f.__name__: f for f in (position_lifecycle, position_closes, open_positions, position_excursions, pnl_by_strategy, violations, violation_persistence, complement_signals, microprice_signals, complement_gaps, book_features, spread_regimes, sensitivity, calendar)}

_POS = f"""{sql.TRADES}, ex AS (SELECT event_id, market, token, 's' || (wallet % 4) AS strategy, side AS direction, size, ticks / 100 AS price, 0.02 * ticks / 100 * size AS fee, ticks / 1000 AS ev, ts FROM v_trades),
rs AS (SELECT market, min(ts) + (max(ts) - min(ts)) // 2 AS ts, CAST(market AS DOUBLE) AS price FROM v_trades WHERE market < 2 GROUP BY market),
po AS (SELECT ex.market, token, strategy, direction, CASE WHEN rs.ts <= ex.ts THEN 1 ELSE 0 END AS epoch, count(*) AS fills, CAST(sum(size) AS BIGINT) AS size, sum(size * ex.price) / sum(size) AS entry, sum(fee) AS fee, arg_min(ev, ex.ts * 1000000 + event_id) AS ev, min(ex.ts) AS opened_at,
  CASE WHEN any_value(rs.ts) IS NOT NULL AND epoch = 0 THEN any_value(rs.price) END AS exit, CASE WHEN epoch = 0 THEN any_value(rs.ts) END AS closed_at FROM ex LEFT JOIN rs ON rs.market = ex.market GROUP BY ex.market, token, strategy, direction, epoch),
cl AS (SELECT *, CASE WHEN direction = 'BUY' THEN exit - entry ELSE entry - exit END AS d, closed_at - opened_at AS holding_ms FROM po WHERE closed_at IS NOT NULL),
mk AS (SELECT token, arg_max(ticks, ts * 1000000 + event_id) / 100 AS mark FROM v_trades GROUP BY token), nw AS (SELECT max(ts) AS now FROM v_trades),
hd AS (SELECT po.*, mark, CASE WHEN direction = 'BUY' THEN mark - entry ELSE entry - mark END * size - fee AS unrealized, now - opened_at AS age_ms FROM po JOIN mk USING (token) CROSS JOIN nw WHERE closed_at IS NULL)"""
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _lead() -> str:
    rules = []
    for before, after in checks.CONDITIONS:
        for value, (p, o) in (("true", ("aw", "bw")), ("false", ("bw", "aw"))):
            rules.append(f"WHEN list_has_any({p}, {_LIST(before)}) AND list_has_any({o}, {_LIST(after)}) AND NOT list_has_any({p}, {_LIST(after)}) AND NOT list_has_any({o}, {_LIST(before)}) THEN {value}")
    return "CASE " + " ".join(rules) + " END"


_MQ = f"""{sql.LEVELS}, lv AS (SELECT *, sum(size) OVER (PARTITION BY book, side ORDER BY level ROWS UNBOUNDED PRECEDING) AS cum FROM v_levels),
sd AS (SELECT book, side, max(CASE WHEN level = 1 THEN price END) AS p, max(CASE WHEN level = 1 THEN size END) AS z, CASE WHEN sum(size) >= 100 THEN sum(greatest(0, least(size, 100 - (cum - size))) * price) / 100 ELSE max(CASE WHEN level = 1 THEN price END) END AS f FROM lv GROUP BY ALL),
qt AS (SELECT coalesce(b.book, a.book) AS book, b.p AS bid, b.z AS bid_size, b.f AS bid_fill, a.p AS ask, a.z AS ask_size, a.f AS ask_fill, coalesce((b.p + a.p) / 2, 0) AS mid FROM (SELECT * FROM sd WHERE side = 'bid') b FULL JOIN (SELECT * FROM sd WHERE side = 'ask') a ON a.book = b.book),
mq AS (SELECT p_partkey AS market, p_name AS name, p_type AS category, p_name || [' primary', ' election', ''][p_partkey % 3 + 1] || ' by ' || {_LIST(X.MONTHS)}[p_partkey % 12 + 1] AS question, (50 + 10 * (p_partkey % 7)) / 100 AS k, mid * k AS mid, bid * k AS bid, ask * k AS ask, bid_fill * k AS bid_fill, ask_fill * k AS ask_fill, bid_size, ask_size FROM part JOIN qt ON book = p_partkey)"""
_RES = "round(violation, 6) + 0.0 AS violation, round(greatest(coalesce(raw, 0), 0), 6) + 0.0 AS executable, tradeable, round(CASE WHEN tradeable THEN raw * 100 ELSE 0 END, 4) + 0.0 AS profit"
_VIO = f"""{sql.TRADES}, o AS (SELECT token AS check_id, ts // 60000 * 60000 AS ts, max(ticks / 100) AS m, bool_or(size % 5 = 0) AS t FROM v_trades GROUP BY ALL),
o1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY check_id ORDER BY ts) <= {SILENCE} THEN 0 ELSE 1 END AS nw FROM o), o2 AS (SELECT *, sum(nw) OVER (PARTITION BY check_id ORDER BY ts) AS k FROM o1),
ru AS (SELECT check_id, CAST(k AS BIGINT) AS k, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(m) AS peak, bool_or(t) AS tradeable FROM o2 GROUP BY ALL), tk AS (SELECT DISTINCT ts AS at FROM o),
vi AS (SELECT ru.*, tk.at AS resolved_at FROM ru ASOF LEFT JOIN tk ON ru.last_ts + {SILENCE} < tk.at)"""
_BIN = f"""{sql.LEVELS}, bk AS (SELECT book, max(price / 2) FILTER (side = 'bid') AS b, min(price / 2) FILTER (side = 'ask') AS a, max(size) FILTER (side = 'bid' AND level = 1) AS bz, max(size) FILTER (side = 'ask' AND level = 1) AS az FROM v_levels GROUP BY book),
bn AS (SELECT y.book // 2 AS market, y.b AS yb, y.a AS ya, y.bz AS ybz, y.az AS yaz, n.b AS nb, n.a AS na, n.az AS naz, coalesce(y.a - y.b, 0) AS ys, coalesce(n.a - n.b, 0) AS ns, coalesce((y.a + y.b) / 2, 0) AS ym, coalesce((n.a + n.b) / 2, 0) AS nm, 1 - y.a - n.a - 0.04 AS raw,
  1 + market % 6 AS updates, 1000 * (market % 9) AS st, CASE WHEN st <= 0 THEN 1.0 ELSE 40.0 / (st + 40.0) END AS slip, 5 + market % 20 AS rate, 500 * (market % 6) AS upd, market % 4 AS type FROM bk y JOIN bk n ON n.book = y.book + 1 WHERE y.book % 2 = 0)"""
_UNIT = "least(greatest({}, 0), 1)"


def _round(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)


ORACLE_SQL = {
    "position_lifecycle": f"WITH {_POS} SELECT market, token, strategy, direction, CAST(epoch AS BIGINT) AS epoch, fills, size, {_round('entry')}, {_round('fee', digits=4)}, {_round('ev')}, opened_at, exit, closed_at FROM po",
    "position_closes": f"WITH {_POS} SELECT market, token, strategy, direction, size, {_round('entry')}, exit, round(d * size, 4) + 0.0 AS gross, round(d * size - fee, 4) + 0.0 AS net, holding_ms, round(d, 6) + 0.0 AS realized_ev, round(ev - d, 6) + 0.0 AS ev_error FROM cl",
    "open_positions": f"WITH {_POS} SELECT market, token, strategy, direction, size, {_round('entry')}, mark, {_round('unrealized', digits=4)}, age_ms, {_round('ev')} FROM hd",
    "position_excursions": f"""WITH {_POS}, fl AS (SELECT ex.*, ex.ts * 1000000 + event_id AS pos, CASE WHEN rs.ts <= ex.ts THEN 1 ELSE 0 END AS epoch, CASE WHEN rs.ts > ex.ts THEN rs.ts END AS fin FROM ex LEFT JOIN rs ON rs.market = ex.market),
      f2 AS (SELECT *, sum(size * price) OVER w / sum(size) OVER w AS entry, lead(pos) OVER (PARTITION BY market, token, strategy, direction, epoch ORDER BY pos) AS nx FROM fl WINDOW w AS (PARTITION BY market, token, strategy, direction, epoch ORDER BY pos ROWS UNBOUNDED PRECEDING)),
      mm AS (SELECT token AS tk, ts AS mts, ts * 1000000 + event_id AS mp, ticks / 100 AS mark FROM v_trades),
      xx AS (SELECT market, token, strategy, direction, epoch, bool_and(fin IS NULL) AS open, max(CASE WHEN direction = 'BUY' THEN mark - entry ELSE entry - mark END) AS f, max(CASE WHEN direction = 'BUY' THEN entry - mark ELSE mark - entry END) AS a
        FROM f2 JOIN mm ON tk = token AND mp >= pos AND (nx IS NULL OR mp < nx) AND (fin IS NULL OR mts <= fin) GROUP BY ALL)
      SELECT market, token, strategy, direction, CAST(epoch AS BIGINT) AS epoch, open, round(greatest(f, 0), 6) + 0.0 AS favorable, round(greatest(a, 0), 6) + 0.0 AS adverse FROM xx""",
    "pnl_by_strategy": f"""WITH {_POS}, n AS (SELECT *, d * size - fee AS net FROM cl), g AS (SELECT strategy, count(*) AS trades, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net <= 0) AS losses, sum(net) AS realized, avg(net) AS mean, stddev_samp(net) AS sd FROM n GROUP BY 1),
      u AS (SELECT strategy, sum(unrealized) AS unrealized FROM hd GROUP BY 1), x AS (SELECT g.*, coalesce(unrealized, 0) AS unrealized, realized + coalesce(unrealized, 0) AS total, wins / trades AS win_rate, CASE WHEN trades < 2 THEN 0.0 ELSE mean / (sd / sqrt(trades)) END AS t FROM g LEFT JOIN u USING (strategy)),
      y AS (SELECT *, CASE WHEN trades < 2 THEN 1.0 ELSE {sql.p_value('t', '(trades - 1)')} END AS p FROM x) SELECT strategy, trades, wins, losses, {_round('realized', 'unrealized', 'total', 'mean', digits=4)}, {_round('win_rate', 't', 'p')}, p < 0.05 AS significant FROM y""",
    "violations": f"WITH {_VIO} SELECT check_id, k, first_ts, last_ts, n, peak, tradeable, resolved_at FROM vi",
    "violation_persistence": f"""WITH {_VIO}, nw AS (SELECT max(ts) AS now FROM v_trades), w AS (SELECT vi.*, CASE WHEN resolved_at IS NULL THEN now - first_ts ELSE last_ts - first_ts END AS d FROM vi CROSS JOIN nw WHERE resolved_at IS NULL OR resolved_at > now - {48 * M.HOUR})
      SELECT count(*) FILTER (resolved_at IS NULL) AS active, count(resolved_at) AS resolved, coalesce(list_sort(list(d))[count(*) // 2 + 1], 0) AS median_ms, round(coalesce(avg(d), 0), 3) + 0.0 AS mean_ms, round(coalesce(avg(CASE WHEN tradeable THEN 1.0 ELSE 0.0 END), 0), 6) + 0.0 AS tradeable FROM w""",
    "complement_signals": f"""WITH {_BIN}, e AS (SELECT *, raw - 0.5 * ys - 0.5 * ns AS ev FROM bn WHERE raw >= 0.005 AND updates >= 2 AND slip <= 0.05 AND least(yaz, naz) >= 20)
      SELECT market, {_round('raw', 'ev')}, CAST(greatest(1, least(yaz, naz, 100)) AS DOUBLE) AS size, round(least(greatest(0.40 * least(1, ev / 0.03) + 0.30 * least(1, updates / 5) + 0.30 * (1 - slip), 0.01), 1), 6) + 0.0 AS strength FROM e WHERE ev >= 0.001""",
    "microprice_signals": f"""WITH {_BIN}, d AS (SELECT *, ys / ym * 10000 AS bps, ((yaz * yb + ybz * ya) / (ybz + yaz) - ym) / ys AS deviation FROM bn WHERE rate >= 10 AND upd <= 2000 AND type <> 3 AND yb IS NOT NULL AND ya IS NOT NULL AND ym > 0 AND ym < 1 AND ys > 0),
      e AS (SELECT *, CASE WHEN deviation > 0 THEN 'yes' ELSE 'no' END AS outcome, abs(deviation) * ys * 5 - CASE WHEN deviation > 0 THEN ys ELSE ns END / 2 - 0.02 AS ev FROM d WHERE bps <= 6000 AND abs(deviation) >= 0.2 AND (deviation > 0 OR (na IS NOT NULL AND nm > 0 AND nm < 1)))
      SELECT market, outcome, {_round('deviation', 'ev')}, round(least(greatest(least(greatest((abs(deviation) - 0.2) / 0.2, 0.1), 1) * 100, 1), 100), 6) + 0.0 AS size,
        round(least(greatest(0.35 * {_UNIT.format('(abs(deviation) - 0.2) / 0.4')} + 0.30 * {_UNIT.format('ev / 0.03')} + 0.20 * {_UNIT.format('rate / 50')} + 0.15 * {_UNIT.format('1 - bps / 6000')}, 0.01), 1), 6) + 0.0 AS strength FROM e WHERE ev >= 0.01""",
    "complement_gaps": f"WITH {_BIN} SELECT market, round(abs(ym + nm - 1), 6) + 0.0 AS gap, round(coalesce(raw, 'nan'::DOUBLE), 6) + 0.0 AS executable, round(slip, 6) + 0.0 AS slip FROM bn",
    "book_features": f"""WITH {sql.LEVELS}, bk AS (SELECT book, max(price) FILTER (side = 'bid') AS b, min(price) FILTER (side = 'ask') AS a, coalesce(max(size) FILTER (side = 'bid' AND level = 1), 0) AS bz, coalesce(max(size) FILTER (side = 'ask' AND level = 1), 0) AS az FROM v_levels GROUP BY book),
      d AS (SELECT x.book, x.size + y.size AS d FROM v_levels x JOIN v_levels y ON x.book = y.book AND x.level = y.level AND x.side = 'bid' AND y.side = 'ask' WHERE x.level <= 5), h AS (SELECT book, sum(d * d) / (sum(d) * sum(d)) AS fr FROM d GROUP BY book)
      SELECT bk.book, round(CASE WHEN a - b > 0 THEN ((az * b + bz * a) / (bz + az) - (a + b) / 2) / (a - b) ELSE 0 END, 6) + 0.0 AS microprice_deviation, round(CASE WHEN az <= 0 THEN CASE WHEN bz > 0 THEN 10.0 ELSE 1.0 END ELSE least(10.0, bz / az) END, 6) + 0.0 AS queue_depth_ratio, round(coalesce(fr, 1), 6) + 0.0 AS book_fragility FROM bk LEFT JOIN h ON h.book = bk.book""",
    "spread_regimes": f"SELECT event_id, CAST(CASE WHEN z < -0.5 THEN 0 WHEN z > 0.5 THEN 2 ELSE 1 END AS BIGINT) AS regime FROM ({M.ORACLE_SQL['feature_z']})",
    "sensitivity": f"""WITH {sql.TRADES}, s AS (SELECT event_id, ticks / 1000 AS e, 0.02 + size * (0.00001 * 0.03 + 0.000005) AS c1, 0.02 + 0.5 * size * (0.00001 * 0.03 + 0.000005) AS c2, 0.02 + 1.5 * size * (0.00001 * 0.03 + 0.000005) AS c3 FROM v_trades),
      x AS (SELECT event_id, e * 0.9 - c1 AS edge_less, e * 1.1 - c1 AS edge_more, (e - c2) * 0.5 AS size_less, (e - c3) * 1.5 AS size_more FROM s) SELECT event_id, {_round('edge_less', 'edge_more', 'size_less', 'size_more', digits=9)}, edge_less > 0 AND edge_more > 0 AND size_less > 0 AND size_more > 0 AS robust FROM x""",
    "calendar": f"WITH {sql.TRADES} SELECT event_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, round(((SELECT max(ts) FROM v_trades) - ts) / 3600000, 6) + 0.0 AS hours_left FROM v_trades",
}
