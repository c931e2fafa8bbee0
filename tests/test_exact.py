"""Cases that lie exactly on a limit or a tie, against the SQL and by hand."""

import random
from itertools import permutations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidebook.operators import research, strategies, wallets
from tidebook.plans import registry

TRADES = "event_id long, wallet long, token long, market long, side string, ticks long, size long, ts long"
LEVEL = "array<struct<price: double, size: double>>"


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over these tables."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, folder / f"{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder / table}.parquet'")
    got = registry.QUERIES[name](spark, str(folder)).toArrow()
    want = con.execute(registry.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    return tuple(sorted((tuple(r[c] for c in names) for r in t.to_pylist()), key=str) for t in (got, want))


def test_imbalance_on_the_limit(spark, tmp_path):
    """Levels 2 to 4 lean by one fifth exactly, which sums of thirds in doubles fall short of."""
    cases = [((1, 1, 6), (1, 2, 1)), ((6, 5, 12), (7, 2, 1)), ((9, 1, 9), (4, 8, 1)), ((11, 7, 12), (6, 10, 4))]
    side = lambda sizes, prices: [(p, float(s)) for p, s in zip(prices, (5, *sizes), strict=True)]
    books = [(k, side(b, (0.40, 0.39, 0.38, 0.37)), side(a, (0.50, 0.51, 0.52, 0.53))) for k, (b, a) in enumerate(cases)]
    got = strategies.imbalance_signals(spark.createDataFrame(books, f"book int, bids {LEVEL}, asks {LEVEL}"), least=0.2).collect()
    assert sorted((r.book, r.side) for r in got) == [(k, "BUY") for k in range(len(cases))]
    rows = []
    for k, (b, a) in enumerate(cases):
        rows += [(k, "O", float(s * t), float(s)) for s, t in zip((5, *b), (39, 38, 37, 36), strict=True)] + [(k, "F", float(s * t), float(s)) for s, t in zip((5, *a), (4, 5, 6, 7), strict=True)]
    lines = pa.table(dict(zip(("l_partkey", "l_linestatus", "l_extendedprice", "l_quantity"), map(list, zip(*rows, strict=True)), strict=True)))
    got, want = both(spark, tmp_path, "imbalance_signals", lineitem=lines)
    assert len(got) == len(cases) and [r[0] for r in got] == [r[0] for r in want]
    assert [x for r in got for x in r[1:] if isinstance(x, float)] == pytest.approx([x for r in want for x in r[1:] if isinstance(x, float)])


#: Profits in hundredths that add up to nothing, which doubles do in some orders only.
NOTHING = sorted(set(permutations((10, 20, -30, 70, -70))))


def trades(gains, size=1):
    """event_id, wallet, token, market, side, ticks, size, ts: a buy and a sale half a minute later for each gain, one wallet for each list."""
    rows = []
    for w, line in enumerate(gains):
        for k, g in enumerate(line):
            low = 50 - g // 2
            rows += [(len(rows), w, 0, 0, "BUY", low, size, 60_000 * k), (len(rows) + 1, w, 0, 0, "SELL", low + g, size, 60_000 * k + 30_000)]
    return rows


def test_profits_of_nothing_are_no_gain_in_a_regime(spark):
    t = spark.createDataFrame(trades(NOTHING), TRADES)
    spans = spark.createDataFrame([(0, 1 << 42, "normal")], "start long, end long, state string")
    got = research.regime_profile(t, spans).collect()
    assert len(got) == len(NOTHING) and {(r.n, r.sharpe, r.robustness, r.sensitive) for r in got} == {(5, 0.0, 0.0, False)}
    flat = research.regime_profile(spark.createDataFrame(trades([[7] * 9]), TRADES), spans).first()
    assert flat.sharpe == float("inf") and flat.robustness == 1.0


def curve(spark, gains):
    """The delay curve at one and two hours of pairs that leave hours later with these gains over the price of 50."""
    hour = 3_600_000
    rows = [(w, 0, 0, hour * w, hour * (w + 9), 50 + g, 1) for w, line in enumerate(gains) for g in line]
    pairs = spark.createDataFrame(rows, "wallet long, market long, token long, entry_ts long, exit_ts long, exit_ticks long, size long")
    prices = spark.createDataFrame([(0, hour * k, 50) for k in range(len(gains) + 9)], "token long, ts long, ticks long")
    return wallets.delay_curve(pairs, prices, [hour, 2 * hour])


def test_gains_of_nothing_are_ignored(spark):
    """A mean of exactly zero is neither a gain to be watched nor has it a half-life; it breaks even at once."""
    c = curve(spark, NOTHING).cache()
    assert {r.mean_pnl for r in c.collect()} == {0.0}
    ids = c.select("wallet").distinct()
    assert {(r.n, r.advice, r.best_ms) for r in wallets.delay_advice(ids, c, 3_600_000, [3_600_000, 7_200_000]).collect()} == {(5, "ignore", None)}
    assert {(r.halflife_ms, r.breakeven_ms) for r in wallets.half_life(c).collect()} == {(None, 0.0)}


def test_of_equal_means_the_first_delay_is_best(spark):
    lines = sorted(set(permutations((10, 20, 40, 30, 13))))
    c = curve(spark, lines).cache()
    best = wallets.delay_advice(c.select("wallet").distinct(), c, 3_600_000, [3_600_000, 7_200_000]).collect()
    assert len(best) == len(lines) and {(r.advice, r.best_ms) for r in best} == {("follow", 3_600_000)}


def test_prices_of_the_nearest_trades(spark):
    """Also at equal times, and without a row for each pair of trades."""
    rng = random.Random(11)
    rows = [(i, rng.randrange(2), rng.choice([rng.randrange(400_000), 1_000 * rng.randrange(40)]), rng.randrange(1, 60), rng.randrange(1, 99)) for i in range(300)]
    t = spark.createDataFrame(rows, "event_id long, token long, ts long, size long, ticks long")
    out = strategies.enriched(t.drop("ticks"), t, 30_000)
    got = {r.event_id: (r.ticks, r.price_id) for r in out.collect()}

    def best(row):
        i, token, ts, size, _ = row
        near = [(abs(u - ts) + 10_000 * (abs(s - size) / max(s, size) > 0.2), u, j, ticks) for j, k, u, s, ticks in rows if k == token and j != i and abs(u - ts) <= 30_000]
        return (min(near)[3], min(near)[2]) if near else (None, None)

    assert got == {r[0]: best(r) for r in rows}
    assert "min_by" not in out._jdf.queryExecution().optimizedPlan().toString()
