"""Operators against small cases and plain-Python folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import book as B
from tidebook.functions import stats as S
from tidebook.functions import text as X
from tidebook.operators import fifo, graph, series
from tidebook.sources import ledger
from tidebook.streaming import streams

TRADE = "k int, event_id long, side string, ticks long, size long, ts long"


def fold(rows):
    lots, out = [], []
    for _, i, side, ticks, size, _ in rows:
        if ticks <= 0:
            continue
        if side == "BUY":
            lots.append([i, ticks, size])
            continue
        while size and lots:
            m = min(size, lots[0][2])
            out.append((lots[0][0], i, m, (ticks - lots[0][1]) * m))
            size -= m
            lots[0][2] -= m
            if not lots[0][2]:
                lots.pop(0)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_fifo_is_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(1, i, rng.choice(["BUY", "SELL"]), rng.randint(0, 9), rng.randint(1, 9), 1000 + i // 2) for i in range(120)]
    got = fifo.match(spark.createDataFrame(rows, TRADE), ["k"], ["ts", "event_id"]).collect()
    assert sorted((r.entry_id, r.exit_id, r.size, r.pnl_ticks) for r in got) == fold(rows)


def test_fifo_cases(spark):
    rows = [(1, 1, "BUY", 40, 200, 1), (1, 2, "SELL", 50, 100, 2), (1, 3, "SELL", 60, 100, 3), (2, 4, "SELL", 50, 100, 1)]
    got = fifo.match(spark.createDataFrame(rows, TRADE), ["k"], ["ts", "event_id"]).collect()
    assert sum(r.pnl_ticks for r in got) == 3000 and all(r.k == 1 for r in got)
    assert fifo.match(spark.createDataFrame([], TRADE), ["k"], ["ts", "event_id"]).count() == 0


def test_t_test(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 5, 6, 7, 8)], "x double")
    n, m, sd = F.count("x"), F.avg("x"), F.stddev_samp("x")
    t, p = S.t_test(F.col("n"), F.col("m"), F.col("s"))
    r = df.agg(n.alias("n"), m.alias("m"), sd.alias("s")).select(t.alias("t"), p.alias("p"), S.cohens_d(F.col("m"), F.col("s")).alias("d")).first()
    assert r.t == pytest.approx(8.485, abs=1e-3) and r.p < 0.001 and r.d == pytest.approx(6 / math.sqrt(2.5))


def test_bh(spark):
    df = spark.createDataFrame(list(enumerate([0.002, 0.012, 0.03, 0.2, 0.9])), "id long, p double")
    got = [r.bh for r in series.adjusted(df, "id", "p").orderBy("id").collect()]
    assert got == pytest.approx([0.01, 0.03, 0.05, 0.25, 0.9], abs=1e-4)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_is_the_search(spark, direction):
    rng = random.Random(4)
    points = {rng.randrange(5_000): round(rng.random(), 3) for _ in range(40)}
    asked = [rng.randrange(-500, 6_000) for _ in range(60)] + list(points)[:5]

    def want(ts):
        ok = {"backward": [t for t in points if t <= ts], "forward": [t for t in points if t >= ts], "nearest": list(points)}[direction]
        best = min(ok, key=lambda t: (abs(t - ts), -t), default=None)
        return points[best] if best is not None and abs(best - ts) <= 300 else None

    right = spark.createDataFrame([("m", t, p) for t, p in points.items()], "k string, ts long, price double")
    left = spark.createDataFrame([("m", i, ts) for i, ts in enumerate(asked)], "k string, i int, ts long")
    for bucket in (70, 60_000):
        got = {r.i: r.price for r in series.asof(left, right, "k", "ts", "price", direction, 300, bucket).collect()}
        assert [got[i] for i in range(len(asked))] == [want(ts) for ts in asked]


def test_book(spark):
    lv = "array<struct<price:double,size:double>>"
    df = spark.createDataFrame([([(0.5, 10.0), (0.49, 20.0)], [(0.52, 30.0)]), ([], [(0.6, 5.0)])], f"bids {lv}, asks {lv}")
    b, a = F.col("bids"), F.col("asks")
    x, y = df.select(B.microprice(b, a).alias("m"), B.imbalance(b, a).alias("i"), B.vwap(a, F.lit(30.0)).alias("v"), B.vwap(a, F.lit(31.0)).alias("w"), B.herfindahl(b).alias("h")).collect()
    assert x.m == pytest.approx((30 * 0.5 + 10 * 0.52) / 40) and x.i == -0.5 and x.v == pytest.approx(0.52) and math.isnan(x.w) and x.h == pytest.approx(500 / 900)
    assert math.isnan(y.m) and y.i == -1.0 and y.h == 0.0


def test_text(spark):
    r = spark.range(1).select(X.tokens(F.lit("Will the Red Team win in 2024?")).alias("t"), X.temporal_order(F.lit("ends in March 2025")).alias("m"), X.temporal_order(F.lit("by 2025")).alias("y"), X.temporal_order(F.lit("never")).alias("n")).first()
    assert r.t == ["red", "team", "win"] and (r.m, r.y, r.n) == (3, 300, None)


def test_ledger(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"seq_num":1,"wall_clock":10,"entry":{"type":"position_opened","data":{"market_id":"m"}}}\n{ no\n\n')
    (tmp_path / "b.jsonl").write_text('{"seq_num":2,"wall_clock":11,"entry":{"type":"position_opened","data":{"market_id":"n"}}}\n{"seq_num":3,"wall_clock":12,"entry":{"type":"position_closed","data":{"market_id":"m"}}}\n')
    (tmp_path / "c.txt").write_text("{}")
    read = ledger.read_ledger(spark, str(tmp_path))
    assert read.count() == 3
    assert [r.market_id for r in ledger.open_positions(read).collect()] == ["n"]
    out = str(tmp_path / "out")
    ledger.append_ledger(spark.createDataFrame([(86_400_000, "signal", {"a": "b"}), (1, "system", {})], "wall_clock long, type string, data map<string,string>"), out, 5)
    assert ledger.file_digests(spark, out).count() >= 2


def test_raw_trades(spark):
    lines = spark.createDataFrame([('[{"event_type":"trade","market":"m","asset_id":"9","price":"0.31","size":"20","timestamp":"5"}]',), ("{ broken",), ('{"event_type":"book"}',)], "value string")
    (r,) = ledger.parse_trades(lines).collect()
    assert (r.market_id, r.side, r.price, r.notional, r.timestamp) == ("m", "BUY", 0.31, pytest.approx(6.2), 5)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    schema = "key string, source string, ts timestamp"
    spark.sql("select 'a' key, 's' source, timestamp'2024-01-01 00:00:01' ts union all select 'a', 's', timestamp'2024-01-01 00:00:02' union all select 'b', 's', timestamp'2024-01-01 00:10:00'").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted(r.key for r in run(streams.deduplicated(read(), ["key"]), "dd")) == ["a", "b"]
    assert max(r.n for r in run(streams.event_rate(read()), "rate", "complete")) == 2


def test_book_stream(spark, tmp_path):
    schema = "token string, ts timestamp, side string, price double, size double, full long"
    spark.createDataFrame([("t", 1, "bid", 0.4, 5.0, 1), ("t", 1, "ask", 0.6, 5.0, 1), ("t", 2, "bid", 0.5, 1.0, 0), ("t", 3, "ask", 0.6, 0.0, 0)], "token string, s long, side string, price double, size double, full long").selectExpr("token", "timestamp_seconds(s) ts", "side", "price", "size", "full").coalesce(1).write.parquet(str(tmp_path / "in"))
    (r,) = run(streams.book_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "bk", "update")
    assert (r.best_bid, r.best_ask, r.levels) == (0.5, 1.0, 2)


def test_bootstrap_is_the_sequential_generator():
    import numpy as np

    from tidebook.operators.research import bootstrap_interval

    values, seed, means = [0.5, -0.25, 1.75, 3.0], 42, []
    wrap = lambda x: ((x + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)
    for v in values:
        seed = wrap(seed * 1597 + math.floor(v * 1e8 + 0.5))
    seed = abs(seed) or 1
    for _ in range(500):
        total = 0.0
        for _ in values:
            seed = wrap(seed * 1664525 + 1013904223)
            total += values[(seed & 0xFFFFFFFF) % 4]
        means.append(total / 4)
    means.sort()
    assert bootstrap_interval(np.array(values), draws=500) == pytest.approx((means[12], means[487]))
    assert math.isnan(bootstrap_interval(np.array([]))[0]) and bootstrap_interval(np.array([2.0])) == (2.0, 2.0)


def test_bootstrap_in_chunks(spark):
    import numpy as np

    from tidebook.operators import research

    rng = random.Random(2)
    rows = [(k, i, round(rng.gauss(0, 3), 4)) for k, n in (("a", 1), ("b", 23), ("c", 150)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(3)
    got = {r.k: r for r in research.bootstrap(df, "k", ["i"], "v", draws=200, chunk=7, block=30).collect()}
    for k in "abc":
        values = np.array([v for x, _, v in rows if x == k])
        low, high = research.bootstrap_interval(values, draws=200)
        assert (got[k].n, got[k].low, got[k].high) == (len(values), pytest.approx(low), pytest.approx(high))


def test_adjusted_is_the_step_up(spark):
    rng = random.Random(5)
    ps = [round(rng.random() ** 3, 3) for _ in range(300)] + [0.0, 1.0, 1.0]
    got = {r.id: r for r in series.adjusted(spark.createDataFrame(list(enumerate(ps)), "id long, p double").repartition(3), "id", "p").collect()}
    least, m = 1.0, len(ps)
    for rank, (p, i) in reversed(list(enumerate(sorted((p, i) for i, p in enumerate(ps)), 1))):
        least = min(least, p * m / rank)
        assert got[i].bh == pytest.approx(least) and got[i].bonferroni == pytest.approx(min(1.0, p * m))


def test_quantiles_are_those_of_sorted_lists(spark):
    rng = random.Random(7)
    rows = [(k, rng.randint(0, 9)) for k in range(5) for _ in range(k * 7 + 1)]
    got = {r.k: r for r in series.quantiles(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", {"a": (1, 4), "b": (1, 2), "c": (3, 4)}).collect()}
    for k in range(5):
        x = sorted(v for q, v in rows if q == k)
        assert (got[k].a, got[k].b, got[k].c) == (x[len(x) // 4], x[len(x) // 2], x[3 * len(x) // 4])


@pytest.mark.parametrize("ticks", [1, 2, 3])
def test_confirmed_is_the_fold(spark, ticks):
    rng = random.Random(9)
    states = [rng.choice("nab") for _ in range(80)]
    got = [r.current for r in series.confirmed(spark.createDataFrame([(0, i, s) for i, s in enumerate(states)], "k int, i int, s string"), "k", "i", "s", ticks, "n").orderBy("i").collect()]
    now, candidate, count, want = "n", None, 0, []
    for s in states:
        if s == now:
            candidate, count = None, 0
        else:
            candidate, count = s, count + 1 if s == candidate else 1
            if count >= ticks:
                now, candidate, count = s, None, 0
        want.append(now)
    assert got == want


def test_gates(spark):
    from tidebook.operators.research import gates

    rows = [(0.01, 50, 0.5, 0.9, False, 0.1, 0.8, 1.0), (0.2, 50, 0.5, 0.9, False, 0.1, 0.8, 1.0), (0.2, 5, 0.1, 0.9, True, 0.1, 0.8, 1.0)]
    df = spark.createDataFrame(rows, "p double, n long, d double, oos_sharpe double, cliff boolean, sensitivity double, regimes_robust double, pnl_after_costs double")
    assert [r.verdict for r in gates(df).collect()] == ["validated", "marginal", "rejected"]


def test_similar_pairs_misses_none(spark):
    rng = random.Random(8)
    rare = ["alpha", "bravo", "carol", "delta", "eagle", "fjord", "gamma", "hotel", "india", "jumbo", "karma", "lemon"]
    rows = [(i, "x", " ".join(["market"] * rng.randint(0, 2) + rng.choices(rare, k=rng.randint(1, 6)))) for i in range(60)] + [(90, "x", ""), (91, "x", "the of")]
    df = spark.createDataFrame(rows, "id long, category string, question string")
    words = df.select("id", X.tokens(F.col("question")).alias("w")).where(F.size("w") > 0)
    both = words.select(F.col("id").alias("a"), F.col("w").alias("wa")).crossJoin(words.select(F.col("id").alias("b"), F.col("w").alias("wb"))).where("a < b and arrays_overlap(wa, wb)")
    scored = {(x.a, x.b): x.s for x in both.select("a", "b", X.pair_similarity(F.col("wa"), F.col("wb")).alias("s")).collect()}
    for least in (0.2, 0.35, 0.7):
        assert {(x.a, x.b) for x in graph.similar_pairs(df, "id", least).collect()} == {k for k, s in scored.items() if s >= least}
    long = [(i, "x", f"market {' '.join(w * 2 for w in rare)} {'abcdefgh'[i] * 3}") for i in range(8)] + [(20 + i, "y", "market " + " ".join(rng.sample(rare, 3))) for i in range(20)]
    told = graph._telling_words(spark.createDataFrame(long, "id long, category string, question string").withColumn("words", X.tokens(F.col("question"))), 0.35)
    assert told.where("word = 'market'").count() == 0
