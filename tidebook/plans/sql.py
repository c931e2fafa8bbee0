"""Common table expressions of the oracle SQL: the views of tidebook.sources.views, and matched pairs."""

TRADES = """v_trades AS (
  SELECT event_id, user_id AS wallet, event_id % 8 AS token, (event_id % 8) // 2 AS market,
    CASE WHEN (event_id // 3) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
    1 + CAST(floor(value * 100) AS BIGINT) % 99 AS ticks,
    CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) + 1 AS size, epoch_us(ts) // 1000 AS ts
  FROM events)"""

LEVELS = """v_raw AS (
  SELECT l_partkey AS book, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
    1 + CAST(floor(l_extendedprice / l_quantity) AS BIGINT) % 45 AS t, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
v_sum AS (
  SELECT book, side, CASE WHEN side = 'bid' THEN t ELSE t + 46 END AS ticks, CAST(sum(q) AS BIGINT) AS size
  FROM v_raw GROUP BY ALL),
v_levels AS (
  SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY CASE WHEN side = 'bid' THEN -ticks ELSE ticks END) AS level,
    ticks / 100 AS price FROM v_sum)"""

PRICES = "v_prices AS (SELECT event_type AS series, event_id, epoch_us(ts) // 1000 AS ts, value AS price FROM events)"

def pairs(source: str = "v_trades", keys: tuple[str, ...] = ("wallet", "market", "token")) -> str:
    """Matched pairs of the trades in source, by keys."""
    k = ", ".join(keys)
    w = f"PARTITION BY {k} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING"
    return f"""f1 AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) OVER ({w}) AS net,
    sum(CASE WHEN side = 'BUY' THEN size ELSE 0 END) OVER ({w}) AS bought FROM {source}),
f2 AS (SELECT *, greatest(0, -min(net) OVER ({w})) AS short FROM f1),
f3 AS (SELECT *, size - (short - coalesce(lag(short) OVER (PARTITION BY {k} ORDER BY ts, event_id), 0)) AS used FROM f2),
f4 AS (SELECT *, sum(CASE WHEN side = 'SELL' THEN used ELSE 0 END) OVER ({w}) AS sold FROM f3),
pairs AS (
  SELECT {", ".join(f"b.{x}" for x in keys)}, b.event_id AS entry_id, s.event_id AS exit_id, b.ts AS entry_ts, s.ts AS exit_ts,
    b.ticks AS entry_ticks, s.ticks AS exit_ticks,
    CAST(least(b.bought, s.sold) - greatest(b.bought - b.size, s.sold - s.used) AS BIGINT) AS size,
    CAST((s.ticks - b.ticks) * (least(b.bought, s.sold) - greatest(b.bought - b.size, s.sold - s.used)) AS BIGINT) AS pnl_ticks
  FROM f4 b JOIN f4 s ON {" AND ".join(f"b.{x} = s.{x}" for x in keys)}
  WHERE b.side = 'BUY' AND s.side = 'SELL' AND s.used > 0 AND b.bought - b.size < s.sold AND s.sold - s.used < b.bought)"""


PAIRS = f"{TRADES},\n{pairs()}"


def cdf(x: str) -> str:
    """The approximation of tidebook.functions.stats.normal_cdf."""
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    tail = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x}) / 2) / 2)"
    return f"(CASE WHEN {x} < -8 THEN 0.0 WHEN {x} > 8 THEN 1.0 WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END)"


def p_value(t: str, df: str) -> str:
    return f"(1 - {cdf(f'(({t}) * (1 - 1 / (4.0 * ({df}))))')})"
