"""Queries on the graph of markets: edges, clusters, checks of prices over both, and moves that travel along edges.

Markets are the parts that a user's number points to; the trades of that user are the market's prices. Times are hours
where an exchange has seconds, as prices are hours apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, graph, series, signals
from ..sources import views
from ..sources.shared import written
from . import execution_queries as E
from . import market_queries as M
from . import sql
from .market_queries import HOUR
from .wallet_queries import r

DAY = 24 * HOUR
#: How far prices count for correlation; how far apart steps may be; in what time an update is followed; a move; an order's time.
PAST, APART, FOLLOWED, REACH, EXEC = 40 * DAY, 3 * HOUR, 6 * HOUR, 12 * HOUR, 2 * HOUR
SILENCE = 36 * HOUR


def _now(prices: DataFrame) -> int:
    return prices.agg(F.max("ts")).first()[0] or 0


def _active(spark, sf_dir) -> DataFrame:
    """Markets with a dated question and quotes that have prices."""
    return E._markets(spark, sf_dir).join(views.mids(spark, sf_dir).select(F.col("series").alias("market")).distinct(), "market")


def _edges(spark, sf_dir) -> DataFrame:
    p = views.mids(spark, sf_dir)
    pairs = graph.similar_pairs(_active(spark, sf_dir), "market", 0.35)
    return written(graph.market_edges(pairs, graph.returns(p, _now(p), PAST), p, APART, FOLLOWED), "edges")


def market_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("source", "target", "kind", r("strength"), r("correlation"), "lag_ms")


def _clustered(spark, sf_dir, edges: DataFrame | None = None) -> DataFrame:
    m = written(_active(spark, sf_dir), "active")
    return m.join(graph.edge_clusters(m, edges if edges is not None else _edges(spark, sf_dir)), "market")


def graph_clusters(spark, sf_dir):
    """Clusters of two markets or more: how far their prices are from adding up to 1, and the words they share."""
    m = written(_clustered(spark, sf_dir), "members")
    words = graph.descriptions(m).select("cluster", "words")
    return graph.cluster_scores(m).join(words, "cluster").select("cluster", "n", r("violation"), r("score"), "words")


_TELLING = sorted({w for pair in checks.CONDITIONS for words in pair for w in words})


def _kinds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Markets with their cluster, and what the questions of linked ones say about their prices."""
    e = _edges(spark, sf_dir)
    m = written(_clustered(spark, sf_dir, e), "members")
    words = m.select("market", X.tokens(F.col("question")).alias("words"))
    pairs = graph.linked_pairs(e, m.select("market", "cluster"), words, checks.SHARED, _TELLING)
    return m, written(checks.pair_kinds(m, pairs), "kinds")


def _pair_checks(spark, sf_dir) -> DataFrame:
    m, kinds = _kinds(spark, sf_dir)
    return checks.priced(kinds, m)


def consistency_pairs(spark, sf_dir):
    return _pair_checks(spark, sf_dir).select("check_id", "kind", "high", "low", r("violation"), r("executable"), "tradeable", r("profit", 4))


def consistency_partitions(spark, sf_dir):
    return checks.partitions(_clustered(spark, sf_dir)).select("check_id", r("violation"), r("executable"), "tradeable", r("profit", 4))


def consistency_report(spark, sf_dir):
    each = ["check_id", "kind", "tradeable", "profit"]
    m, kinds = _kinds(spark, sf_dir)
    every = checks.priced(kinds, m).select(*each).unionByName(checks.partitions(m).select(*each))
    return checks.report(every).select("kind", "n", "tradeable", r("profit", 4))


def _daily(spark, sf_dir) -> DataFrame:
    """market, ts, mid: each market's last price at the end of each day, from its first to the last of all."""
    p = views.mids(spark, sf_dir)
    end = lambda ts: (F.floor(ts / DAY) + 1) * DAY
    first = p.groupBy("series").agg(end(F.min("ts")).alias("first"))
    last = (_now(p) // DAY + 1) * DAY
    days = first.select("series", F.explode(F.sequence("first", F.lit(last), F.lit(DAY))).alias("ts"))
    at = p.groupBy("series", "ts").agg(F.max_by("price", "event_id").alias("mid"))
    return series.asof(days, at, "series", "ts", "mid", bucket=8 * DAY).select(F.col("series").alias("market"), "ts", "mid")


def _sightings(spark, sf_dir, kinds: DataFrame) -> DataFrame:
    return checks.sightings(kinds, written(_daily(spark, sf_dir), "days"))


def check_violations(spark, sf_dir):
    """How long contradictions between markets have lasted, looked at once a day."""
    _, kinds = _kinds(spark, sf_dir)
    v = checks.violations(_sightings(spark, sf_dir, kinds), SILENCE)
    return v.select("check_id", F.col("k").cast("long").alias("k"), "first_ts", "last_ts", "n", r("peak"), "tradeable", "resolved_at")


def consistency_signals(spark, sf_dir):
    """Of pairs whose contradiction has been seen for two days or more and lasts."""
    m, kinds = _kinds(spark, sf_dir)
    pairs = written(checks.priced(kinds, m), "priced")
    runs = checks.violations(_sightings(spark, sf_dir, kinds), SILENCE).where("resolved_at is null").select("check_id", "first_ts", "last_ts", "n")
    now = (_now(views.mids(spark, sf_dir)) // DAY + 1) * DAY
    ends = pairs.select("check_id", F.explode(F.array(*(F.struct(F.col(c).alias("market"), F.lit(sold).alias("sold")) for c, sold in (("high", True), ("low", False))))).alias("x")).select("check_id", "x.*")
    quotes = m.select("market", "bid_size", "ask_size", F.coalesce(F.col("ask") - F.col("bid"), F.lit(0.0)).alias("spread"))
    legs = ends.join(quotes, "market").select("check_id", "market", F.when(F.col("sold"), F.col("bid_size")).otherwise(F.col("ask_size")).alias("deep"), F.round("spread", 9).alias("spread"), F.lit(100.0).alias("size"))
    found = signals.consistency(pairs, legs, runs, now, 80.0, age_ms=2 * DAY)
    return found.select("check_id", "legs", r("ev"), r("reverting"), "size", r("strength"), r("worst_loss", 4), "worst_leg", r("hold_ms", 2))


def _propagated(spark, sf_dir, edges: DataFrame | None = None) -> DataFrame:
    p = views.mids(spark, sf_dir)
    pending = graph.awaited(graph.moves(p), edges if edges is not None else _edges(spark, sf_dir), p)
    return written(graph.propagation(written(pending, "pending"), p, _now(p), REACH), "propagated")


def pending_moves(spark, sf_dir):
    """Every move and each neighbour that it should reach: resolved, expired or open."""
    return _propagated(spark, sf_dir).select("source", "target", "event_id", r("move"), r("base"), "status", "lag", r("target_move"))


def propagation_lags(spark, sf_dir):
    return _propagated(spark, sf_dir).where("status = 'resolved'").select("source", "target", "event_id", "lag", r("efficiency"))


def pair_stats(spark, sf_dir):
    s = graph.pair_stats(_propagated(spark, sf_dir), EXEC)
    return s.select("source", "target", "n", "p25", "median", "p75", r("mean_lag", 3), r("median_efficiency"), r("efficiency"), "exploitable", "updated")


def edge_at_lag(spark, sf_dir):
    e = _propagated(spark, sf_dir)
    return graph.edge_at_lag(e, graph.pair_stats(e, EXEC)).select("source", "target", r("edge"))


def exploitable_pairs(spark, sf_dir):
    """A report of the 20 slowest."""
    p = graph.pair_stats(_propagated(spark, sf_dir), EXEC).where("exploitable")
    return p.orderBy(F.desc("median"), "source", "target").limit(20).select("source", "target", "n", "median")


def propagation_report(spark, sf_dir):
    e = _propagated(spark, sf_dir)
    return graph.propagation_report(e, graph.pair_stats(e, EXEC))


def stale_book_signals(spark, sf_dir):
    """Of moves that are still open at the end, towards markets whose prices are older than twice their usual age."""
    p = views.mids(spark, sf_dir)
    now = _now(p)
    events = _propagated(spark, sf_dir)
    stats = written(graph.pair_stats(events, EXEC), "stats")
    pending = events.where("status = 'open'").select("source", "target", "move", "correlation", F.col("ts").alias("move_ts"))
    ends = p.groupBy("series").agg(F.max("ts").alias("updated_at"), ((F.max("ts") - F.min("ts")) / (F.count("*") - 1)).alias("interval_ms"))
    states = _active(spark, sf_dir).join(ends.withColumnRenamed("series", "market"), "market")
    spread = F.coalesce(F.col("ask") - F.col("bid"), F.lit(0.0))
    states = states.select("market", "updated_at", F.coalesce("interval_ms", F.lit(0.0)).alias("interval_ms"), F.col("mid").alias("yes_mid"), spread.alias("yes_spread"), (1 - F.col("mid")).alias("no_mid"), spread.alias("no_spread"))
    found = signals.stale_book(pending, stats, graph.edge_at_lag(events, stats), states, now, float(EXEC), 100.0, events=3, correlated=0.2, times=0.5, least=-0.6)
    return found.select("source", "target", "outcome", r("ev"), r("size"), r("strength"), "hold_ms")


QUERIES = {f.__name__: f for f in (market_edges, graph_clusters, consistency_pairs, consistency_partitions, consistency_report, check_violations, consistency_signals, pending_moves, propagation_lags, pair_stats, edge_at_lag, exploitable_pairs, propagation_report, stale_book_signals)}

_ACT = f"""{sql.TRADES}, {E._MQ}, v_mids AS (SELECT wallet + 1 AS market, event_id, ts, ticks / 100 AS mid FROM v_trades), act AS (SELECT * FROM mq WHERE market IN (SELECT market FROM v_mids)), nw AS (SELECT max(ts) AS now FROM v_mids)"""
_EDGES = f"""{_ACT}, {M.similar("q AS (SELECT market, category, question FROM act)")}, gp AS (SELECT * FROM pairs WHERE similarity >= 0.35),
bf AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts DESC, event_id DESC) AS k FROM v_mids), l0 AS (SELECT *, lag(mid) OVER (PARTITION BY market ORDER BY ts, event_id) AS was FROM bf WHERE k <= 500),
stp AS (SELECT market, event_id, ts, mid - was AS ch FROM l0 CROSS JOIN nw WHERE was > 0 AND mid > 0 AND ts >= now - {PAST}), en AS (SELECT market FROM stp GROUP BY market HAVING count(*) >= 5), s2 AS (SELECT market, ts, arg_max(ch, event_id) AS other FROM stp GROUP BY ALL),
la AS (SELECT a, b, stp.ts + {APART} AS at, ch FROM gp JOIN stp ON stp.market = a WHERE a IN (SELECT market FROM en) AND b IN (SELECT market FROM en)),
me AS (SELECT la.a, la.b, la.ch, s2.other FROM la ASOF JOIN s2 ON la.b = s2.market AND la.at >= s2.ts WHERE la.at - s2.ts <= {2 * APART}), co AS (SELECT a, b, CASE WHEN count(*) >= 5 THEN corr(ch, other) END AS cr FROM me GROUP BY ALL),
e1 AS (SELECT gp.a, gp.b, CASE WHEN gp.kind = 'semantic' AND abs(coalesce(cr, 0)) > 0.5 THEN 'correlated' ELSE gp.kind END AS kind, gp.similarity * CASE WHEN gp.kind = 'causal' THEN 0.8 ELSE 1.0 END AS strength, CASE WHEN cr IS NULL OR isnan(cr) THEN 0.0 ELSE cr END AS correlation FROM gp LEFT JOIN co ON co.a = gp.a AND co.b = gp.b),
eg AS (SELECT a AS source, b AS target, kind, strength, correlation FROM e1 UNION ALL SELECT b, a, kind, strength, correlation FROM e1)"""
_LAGS = f"""{_EDGES}, up AS (SELECT DISTINCT market, ts FROM v_mids), lf AS (SELECT source, target, m.ts AS t0, m.event_id, m.ts + {FOLLOWED - 1} AS at FROM eg JOIN v_mids m ON m.market = source),
lh AS (SELECT source, target, t0, event_id, up.ts - t0 AS lag FROM lf ASOF JOIN up ON lf.target = up.market AND lf.at >= up.ts), lk AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY t0 DESC, event_id DESC) AS k FROM lh WHERE lag > 0 AND lag < {FOLLOWED}),
ll AS (SELECT source, target, list_sort(list(lag)) AS x FROM lk WHERE k <= 200 GROUP BY ALL)"""
_CL = f"""{_EDGES}, sg AS (SELECT source, target FROM eg WHERE strength >= 0.3 AND kind IN ('same_event', 'complementary', 'correlated')), reach AS (SELECT market AS id, market AS node FROM act UNION SELECT reach.id, sg.target FROM reach JOIN sg ON sg.source = reach.node),
cl AS (SELECT id AS market, min(node) AS cluster FROM reach GROUP BY id)"""
_CHECKS = f"""{_CL}, mx AS (SELECT act.*, cl.cluster, {M._TOK.format("question")} AS w, lower(question) AS x FROM act JOIN cl ON cl.market = act.market), mw AS (SELECT *, CAST({M._place()} AS BIGINT) AS place FROM mx),
lp AS (SELECT x.market AS a, y.market AS b FROM cl x JOIN cl y ON x.cluster = y.cluster AND x.market < y.market UNION SELECT least(source, target), greatest(source, target) FROM eg),
pq AS (SELECT e.a, e.b, a.place AS ap, b.place AS bp, list_distinct(a.w) AS aw, list_distinct(b.w) AS bw, a.category = b.category AS same, len(list_filter(b.w, lambda y: list_contains(a.w, y))) / greatest(len(a.w), len(b.w), 1) AS bags FROM lp e JOIN mw a ON a.market = e.a JOIN mw b ON b.market = e.b),
ps AS (SELECT *, len(list_intersect(aw, bw)) / greatest(len(aw), len(bw), 1) AS sets, CASE WHEN ap <> bp THEN ap < bp END AS af, CASE WHEN len(list_intersect(aw, bw)) > 0 THEN {E._lead()} END AS lead FROM pq),
ks AS (SELECT 'subset_superset' AS kind, a, b, af AS ah FROM ps WHERE sets >= 0.4 AND af IS NOT NULL UNION ALL SELECT 'conditional', a, b, NOT lead FROM ps WHERE lead IS NOT NULL UNION ALL SELECT 'temporal', a, b, af FROM ps WHERE bags >= 0.4 AND af IS NOT NULL AND same),
h0 AS (SELECT kind, CASE WHEN ah THEN a ELSE b END AS high, CASE WHEN ah THEN b ELSE a END AS low FROM ks), hl AS (SELECT kind || ':' || array_to_string(list_sort([CAST(high AS VARCHAR), CAST(low AS VARCHAR)]), ',') AS check_id, kind, high, low FROM h0),
pc AS (SELECT hl.*, h.mid - l.mid AS violation, h.bid_fill - l.ask_fill - 0.04 AS raw, coalesce(raw > 0.005 AND h.bid_size >= 50 AND l.ask_size >= 50, false) AS tradeable
  FROM hl JOIN mw h ON h.market = high JOIN mw l ON l.market = low WHERE h.mid > 0 AND l.mid > 0 AND h.mid > l.mid),
pa AS (SELECT cluster, count(*) AS n, sum(mid) AS total, sum(coalesce(bid_fill, 0)) AS bfl, sum(coalesce(ask_fill, 0)) AS kf, min(coalesce(bid_size, 0)) AS bz, min(coalesce(ask_size, 0)) AS kz FROM mw WHERE mid > 0 GROUP BY 1),
pt AS (SELECT 'exhaustive_partition:' || cluster AS check_id, round(abs(total - 1), 9) AS violation, round(CASE WHEN total > 1 THEN bfl - 1 ELSE 1 - kf END - 0.02 * n, 9) AS raw, raw > 0.005 AND CASE WHEN total > 1 THEN bz ELSE kz END >= 50 AS tradeable FROM pa WHERE n >= 2 AND round(abs(total - 1), 9) >= 0.001)"""
_SEEN = f"""{_CHECKS}, d0 AS (SELECT market, (min(ts) // {DAY} + 1) * {DAY} AS f FROM v_mids GROUP BY market), d1 AS (SELECT market, unnest(range(f, (now // {DAY} + 1) * {DAY} + 1, {DAY})) AS ts FROM d0 CROSS JOIN nw),
lm AS (SELECT market, ts, arg_max(mid, event_id) AS mid FROM v_mids GROUP BY ALL), dy AS (SELECT d1.market, d1.ts, lm.mid FROM d1 ASOF JOIN lm ON d1.market = lm.market AND d1.ts >= lm.ts),
o AS (SELECT check_id, high, low, h.ts, h.mid - l.mid AS m, h.mid - l.mid - 0.04 > 0.005 AS t FROM hl JOIN dy h ON h.market = high JOIN dy l ON l.market = low AND l.ts = h.ts WHERE h.mid > 0 AND l.mid > 0 AND h.mid > l.mid),
o1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY check_id ORDER BY ts) <= {SILENCE} THEN 0 ELSE 1 END AS fresh FROM o), o2 AS (SELECT *, sum(fresh) OVER (PARTITION BY check_id ORDER BY ts) AS k FROM o1),
ru AS (SELECT check_id, CAST(k AS BIGINT) AS k, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(m) AS peak, bool_or(t) AS tradeable FROM o2 GROUP BY ALL), tk AS (SELECT DISTINCT ts AS at FROM o),
vi AS (SELECT ru.*, tk.at AS resolved_at FROM ru ASOF LEFT JOIN tk ON ru.last_ts + {SILENCE} < tk.at)"""
_PROP = f"""{_EDGES}, m0 AS (SELECT *, mid - lag(mid) OVER (PARTITION BY market ORDER BY ts, event_id) AS move FROM v_mids),
m1 AS (SELECT *, stddev_samp(move) OVER w AS sd, count(*) OVER w AS k FROM m0 WINDOW w AS (PARTITION BY market ORDER BY ts, event_id ROWS 498 PRECEDING)), mv AS (SELECT * FROM m1 WHERE k >= 11 AND sd > 0 AND abs(move) >= sd AND abs(move) >= 0.005),
pp AS (SELECT market, ts, mid, ts * 1000000 + event_id AS pos FROM v_mids), aw AS (SELECT source, target, mv.event_id, mv.ts, mv.ts * 1000000 + mv.event_id AS pos, move, correlation FROM mv JOIN eg ON source = market WHERE abs(correlation) >= 0.2),
ab AS (SELECT aw.*, pp.mid AS base FROM aw ASOF JOIN pp ON aw.target = pp.market AND aw.pos > pp.pos),
hit AS (SELECT source, target, ab.event_id, arg_min(pp.ts, pp.pos) AS t1, arg_min(pp.mid, pp.pos) AS m1 FROM ab JOIN pp ON pp.market = ab.target AND pp.pos > ab.pos AND pp.ts <= ab.ts + {REACH} WHERE sign(pp.mid - base) = sign(move) * sign(correlation) AND abs(pp.mid - base) >= 0.1 * abs(move) GROUP BY ALL),
prop AS (SELECT ab.*, CASE WHEN t1 IS NOT NULL THEN 'resolved' WHEN now - ab.ts > {REACH} THEN 'expired' ELSE 'open' END AS status, t1 - ab.ts AS lag, m1 - base AS target_move, least(abs(m1 - base) / abs(move), 5.0) AS efficiency
  FROM ab CROSS JOIN nw LEFT JOIN hit ON hit.source = ab.source AND hit.target = ab.target AND hit.event_id = ab.event_id),
pr5 AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY pos DESC) AS k FROM prop WHERE status = 'resolved'),
pst AS (SELECT source, target, count(*) AS n, list_sort(list(lag)) AS x, list_sort(list(efficiency)) AS y, avg(lag) AS mean_lag, avg(efficiency) AS efficiency, max(ts) AS updated, x[n // 4 + 1] AS p25, x[n // 2 + 1] AS median, x[3 * n // 4 + 1] AS p75, median > {EXEC} AS exploitable FROM pr5 WHERE k <= 500 GROUP BY ALL HAVING count(*) >= 3),
eal AS (SELECT prop.source, prop.target, avg(abs(target_move) - 0.02) AS edge FROM prop JOIN pst ON pst.source = prop.source AND pst.target = prop.target WHERE status = 'resolved' AND lag BETWEEN p25 AND p75 GROUP BY ALL)"""


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)


ORACLE_SQL = {
    "market_edges": f"WITH {_LAGS} SELECT eg.source, eg.target, kind, {_r('strength', 'correlation')}, coalesce(x[len(x) // 2 + 1], 0) AS lag_ms FROM eg LEFT JOIN ll ON ll.source = eg.source AND ll.target = eg.target",
    "graph_clusters": f"""WITH RECURSIVE {_CL}, mc AS (SELECT act.*, cluster FROM act JOIN cl ON cl.market = act.market), g AS (SELECT cluster, count(*) AS n, count(*) FILTER (mid > 0) AS k, sum(mid) FILTER (mid > 0) AS s FROM mc GROUP BY cluster HAVING count(*) >= 2),
      gv AS (SELECT *, CASE WHEN k >= 2 THEN abs(s - 1) ELSE 0.0 END AS violation FROM g), ew AS (SELECT cluster, unnest(list_distinct({M._TOK.format('question')})) AS word FROM mc), dw AS (SELECT cluster, word, count(*) AS df FROM ew GROUP BY ALL),
      kw AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY df DESC, word) AS k FROM dw JOIN g USING (cluster) WHERE df >= greatest(2, ceil(n / 2))), ww AS (SELECT cluster, string_agg(word, ' ' ORDER BY k) AS words FROM kw WHERE k <= 5 GROUP BY cluster)
      SELECT gv.cluster, n, {_r('violation')}, round(1 / (1 + 10 * violation), 6) + 0.0 AS score, coalesce(words, 'related markets') AS words FROM gv LEFT JOIN ww ON ww.cluster = gv.cluster""",
    "consistency_pairs": f"WITH RECURSIVE {_CHECKS} SELECT check_id, kind, high, low, {E._RES} FROM pc",
    "consistency_partitions": f"WITH RECURSIVE {_CHECKS} SELECT check_id, {E._RES} FROM pt",
    "consistency_report": f"WITH RECURSIVE {_CHECKS}, al2 AS (SELECT kind, tradeable, raw FROM pc UNION ALL SELECT 'exhaustive_partition', tradeable, raw FROM pt) SELECT kind, count(*) AS n, count(*) FILTER (tradeable) AS tradeable, round(sum(CASE WHEN tradeable THEN raw * 100 ELSE 0 END), 4) + 0.0 AS profit FROM al2 GROUP BY ROLLUP (kind)",
    "check_violations": f"WITH RECURSIVE {_SEEN} SELECT check_id, k, first_ts, last_ts, n, {_r('peak')}, tradeable, resolved_at FROM vi",
    "consistency_signals": f"""WITH RECURSIVE {_SEEN}, lgs AS (SELECT check_id, m.market, CASE WHEN m.market = high THEN m.bid_size ELSE m.ask_size END AS deep, round(coalesce(m.ask - m.bid, 0), 9) * 100 AS loss FROM pc JOIN mw m ON m.market IN (high, low)),
      pl AS (SELECT check_id, count(*) AS legs, min(coalesce(deep, 0)) AS deep, max(loss) AS loss FROM lgs GROUP BY check_id), wl AS (SELECT check_id, max(lgs.market) AS worst_leg FROM lgs JOIN pl USING (check_id) WHERE lgs.loss = pl.loss GROUP BY check_id)
      SELECT check_id, legs, round(raw, 6) + 0.0 AS ev, round(violation * 0.02, 6) + 0.0 AS reverting, 80.0::DOUBLE AS size,
        round(least(greatest(0.30 * least(1, violation / 0.10) + 0.25 * least(1, (last_ts - first_ts) / 60000) + 0.20 * least(1, vi.n / 10) + 0.25 * least(1, raw / 0.05), 0.01), 1), 6) + 0.0 AS strength,
        round(loss + 0.02 * 100, 4) + 0.0 AS worst_loss, worst_leg, round(least(violation / (0.02 + 1e-9) * 1000, 600000), 2) + 0.0 AS hold_ms
      FROM pc JOIN pl USING (check_id) JOIN wl USING (check_id) JOIN vi USING (check_id) CROSS JOIN nw WHERE pc.tradeable AND raw >= 0.005 AND resolved_at IS NULL AND (now // {DAY} + 1) * {DAY} - first_ts >= {2 * DAY} AND pl.deep >= 50""",
    "pending_moves": f"WITH {_PROP} SELECT source, target, event_id, {_r('move', 'base')}, status, lag, {_r('target_move')} FROM prop",
    "propagation_lags": f"WITH {_PROP} SELECT source, target, event_id, lag, {_r('efficiency')} FROM prop WHERE status = 'resolved'",
    "pair_stats": f"WITH {_PROP} SELECT source, target, n, p25, median, p75, {_r('mean_lag', digits=3)}, round(y[n // 2 + 1], 6) + 0.0 AS median_efficiency, {_r('efficiency')}, exploitable, updated FROM pst",
    "edge_at_lag": f"WITH {_PROP} SELECT source, target, {_r('edge')} FROM eal",
    "exploitable_pairs": f"WITH {_PROP} SELECT source, target, n, median FROM pst WHERE exploitable ORDER BY median DESC, source, target LIMIT 20",
    "propagation_report": f"""WITH {_PROP} SELECT (SELECT count(DISTINCT (source, target)) FROM prop WHERE status = 'resolved') AS pairs, (SELECT count(*) FROM prop WHERE status = 'resolved') AS events, (SELECT count(DISTINCT (source, event_id)) FROM prop WHERE status = 'open') AS open_moves,
      (SELECT count(*) FROM prop WHERE status = 'expired') AS expired, (SELECT count(*) FROM pst) AS with_stats, (SELECT count(*) FROM pst WHERE exploitable) AS exploitable""",
    "stale_book_signals": f"""WITH {_PROP}, sa AS (SELECT market, max(ts) AS upd, (max(ts) - min(ts)) / (count(*) - 1) AS gap FROM v_mids GROUP BY market),
      j AS (SELECT prop.source, prop.target, n, median, pst.efficiency AS eff, correlation AS c, move AS m, prop.ts AS move_ts, edge, now, now - upd AS stale, CASE WHEN gap > 0 THEN gap * 0.5 ELSE 30000 END AS lim, sign(move) * sign(correlation) > 0 AS up, CASE WHEN up THEN mid ELSE 1 - mid END AS price,
          abs(correlation) * abs(move) * (1 - pst.efficiency) - 0.02 - coalesce(ask - bid, 0) / 2 AS ev
        FROM prop JOIN pst ON pst.source = prop.source AND pst.target = prop.target JOIN sa ON sa.market = prop.target JOIN act ON act.market = prop.target LEFT JOIN eal ON eal.source = prop.source AND eal.target = prop.target CROSS JOIN nw WHERE status = 'open')
      SELECT source, target, CASE WHEN up THEN 'yes' ELSE 'no' END AS outcome, round(ev, 6) + 0.0 AS ev, round(greatest(1, 100 * CASE WHEN edge > 0 THEN least(greatest(edge / 0.05, 0.2), 1) ELSE 0.2 END), 6) + 0.0 AS size,
        round(least(greatest(0.25 * (least(abs(c), 1) + least(n / 100, 1) + least(greatest(ev / 0.05, 0), 1) + least(stale / (3 * lim), 1)), 0.01), 1), 6) + 0.0 AS strength, CAST(greatest(0, median - (now - move_ts)) AS BIGINT) AS hold_ms
      FROM j WHERE stale >= lim AND median > {EXEC} AND abs(c) >= 0.2 AND price > 0 AND price < 1 AND ev >= -0.6""",
}
