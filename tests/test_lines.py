"""Lines cut into buckets and blocks, suppression chains, dyadic parts and moves along edges, against plain folds."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidebook.operators import chains, checks, engine, graph, markets, positions, ranges, series
from tidebook.sources import messages

ORDER = ["ts", "event_id"]


def line(spark, rng, n=150, keys="ab", step=400):
    rows, ts = [], 0
    for i in range(n):
        ts += rng.choice([0, 0, rng.randrange(step), rng.randrange(3 * step)])
        rows.append((rng.choice(keys), ts, i, rng.choice([None, rng.randrange(100)])))
    return rows, spark.createDataFrame(rows, "k string, ts long, event_id long, v int").repartition(3)


@pytest.mark.parametrize("bucket", [150, 10_000_000])
def test_lines_are_those_of_a_whole_sort(spark, bucket, monkeypatch):
    rng = random.Random(bucket)
    rows, df = line(spark, rng)
    monkeypatch.setattr(series.blocks, "__defaults__", (bucket, 7))
    by = ["k"]
    num = {r.event_id: r.at for r in series.numbered(df, by, ORDER, bucket, "at").collect()}
    lag = {r.event_id: r.was for r in series.lagged(df, by, ORDER, {"was": "v"}, 2, bucket).collect()}
    lead = {r.event_id: r.was for r in series.lagged(df, by, ORDER, {"was": "v"}, 1, bucket, ahead=True).collect()}
    roll = {r.event_id: (r.n, r.s) for r in series.framed(df, by, ORDER, 4, lambda f: {"n": F.count("*").over(f), "s": F.sum("v").over(f)}, bucket).collect()}
    carry = {r.event_id: (r.a, r.b) for r in series.carried(series.carried(df, by, ORDER, F.col("v"), "a", bucket), by, ORDER, F.col("v"), "b", bucket, inclusive=True).collect()}
    total = {r.event_id: r.s for r in series.summed(df, by, ORDER, F.col("v"), "s", bucket).collect()}
    trail = {r.event_id: r.s for r in series.trailing(df, by, ORDER, F.lit(1).cast("long"), "s", 700, bucket).collect()}
    kept = {r.event_id for r in series.buffered(df, by, ORDER, 5, bucket).collect()}
    for k in "ab":
        own = sorted(r for r in rows if r[0] == k)
        for i, (_, ts, e, v) in enumerate(own):
            values = [x[3] for x in own]
            assert num[e] == i and lag[e] == (values[i - 2] if i > 1 else None) and lead[e] == (values[i + 1] if i + 1 < len(own) else None)
            frame = values[max(0, i - 3) : i + 1]
            assert roll[e] == (len(frame), sum(x for x in frame if x is not None) if any(x is not None for x in frame) else None)
            seen = [x for x in values[:i] if x is not None]
            assert carry[e] == (seen[-1] if seen else None, v if v is not None else seen[-1] if seen else None)
            assert total[e] == sum(x for x in values[: i + 1] if x is not None)
            assert trail[e] == sum(1 for x in own[: i + 1] if x[1] > ts - 700)
            assert (e in kept) == (i >= len(own) - 5)


def test_ranks_and_rolling_values(spark):
    rng = random.Random(3)
    rows = [("a", i, i, float(rng.choice([1, 2, 2, 7, 50]))) for i in range(60)] + [("b", i, i, 5.0) for i in range(4)] + [("b", 9, 9, None)]
    df = spark.createDataFrame(rows, "k string, ts long, event_id long, v double")
    got = {(r.k, r.ts): r.rank for r in series.percentile_rank(df, "k", "v", 4).collect()}
    for k, ts, _, v in rows:
        own = [x[3] for x in rows if x[0] == k and x[3] is not None]
        assert got[k, ts] == (None if v is None else pytest.approx(sum(x < v for x in own) / len(own)))
    rolled = {r.ts: r for r in series.rolling(df.where("k = 'a'"), ["k"], ORDER, "v", 5, 1.0).collect()}
    values = [r[3] for r in rows if r[0] == "a"]
    assert sorted(rolled) == list(range(4, 60)) and rolled[30].sd == pytest.approx(statistics.stdev(values[26:31]))


def kept_rows(rows, window, able=lambda r: True):
    """A fold over rows (key, ts, id): kept ids, and what was kept last before each."""
    last, kept, before = {}, set(), {}
    for r in sorted(rows):
        k, ts, i = r[:3]
        before[i] = last.get(k)
        if able(r) and (k not in last or ts >= last[k] + window):
            kept.add(i)
            last[k] = ts
    return kept, before


@pytest.mark.parametrize("seed", range(3))
def test_suppression_is_the_fold(spark, seed):
    rng = random.Random(seed)
    rows, ts = [], 0
    for i in range(220):
        ts += rng.choice([0, 1, 2, 3, 4, 4, 4, 30])
        rows.append((rng.choice("ab"), ts, i, rng.random() < 0.7))
    df = spark.createDataFrame(rows, "k string, ts long, event_id long, ok boolean").repartition(3)
    for able, test in ((None, lambda r: True), (F.col("ok"), lambda r: r[3])):
        want, before = kept_rows(rows, 7, test)
        got = chains.suppressed(df, ["k"], "ts", "event_id", 7, able).collect()
        assert len(got) == len(rows) and {r.event_id for r in got if r.kept} == want
        assert {r.event_id: r.last_kept for r in got} == before


def test_suppression_lets_every_window_of_a_chain_through(spark):
    rows = [("s", 3_000 * i, i) for i in range(200)]
    got = chains.suppressed(spark.createDataFrame(rows, "k string, ts long, event_id long"), ["k"], "ts", "event_id", 5_000)
    assert sorted(r.event_id for r in got.where("kept").collect()) == list(range(0, 200, 2))
    assert chains.suppressed(spark.createDataFrame([], "k string, ts long, event_id long"), ["k"], "ts", "event_id", 5).count() == 0


def test_signal_filter_counts_from_the_last_that_passed(spark):
    # Every third signal is too small; it neither passes nor makes the next one a duplicate.
    rows = [("s", "m", "BUY", 3_000 * i, i, 0.01 if i % 3 == 0 else 0.5, 0.5, 10.0, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "strategy string, market string, side string, ts long, event_id long, ev double, strength double, size double, target double")
    got = [r["filter"] for r in markets.signal_filter(df).orderBy("event_id").collect()]
    assert got == ["min_ev", None, "duplicate", "min_ev", None, "duplicate", "min_ev", None, "duplicate", "min_ev"]


def test_parts_cover_a_stretch_once(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(a - 2, 70, 5)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("p", ranges.parts_between(F.col("a"), F.col("b"), 8))
    for r in df.collect():
        covered = sorted(x for p in r.p for x in range(p.place << p.level, (p.place + 1) << p.level))
        assert covered == list(range(r.a, r.b + 1)) and len(r.p) <= 2 * max(r.b - r.a + 1, 1).bit_length()


def test_extremes_and_intervals(spark):
    rng = random.Random(6)
    points = [(k, i, rng.random()) for k in "xy" for i in range(0, 300)]
    spans = [(rng.choice("xy"), i, a := rng.randrange(300), a + rng.choice([-1, 0, 3, 80, 250])) for i in range(60)] + [("z", 99, 0, 5)]
    p = spark.createDataFrame(points, "k string, at long, value double")
    s = spark.createDataFrame(spans, "k string, i long, first long, last long")
    got = {r.i: (r.lo, r.hi) for r in ranges.extremes(s, p, ["k"], ["i"], 8).collect()}
    for k, i, a, b in spans:
        own = [v for q, at, v in points if q == k and a <= at <= b]
        assert got[i] == ((min(own), max(own)) if own else (None, None))
    asked = spark.createDataFrame([("x", 1, 17), ("x", 2, 299), ("y", 3, 0)], "k string, q long, at long")
    held = {(r.q, r.i) for r in ranges.holding(asked, s.where("first <= last"), ["k"]).collect()}
    assert held == {(q, i) for k, q, at in [("x", 1, 17), ("x", 2, 299), ("y", 3, 0)] for key, i, a, b in spans if key == k and a <= at <= b}


def test_excursions_are_the_fold(spark):
    rng = random.Random(11)
    marks = [("t", 10 * i, i, rng.randrange(1, 100) / 100) for i in range(120)]
    fills = [("m", "t", "s", rng.choice(["BUY", "SELL"]), 10 * i, i, rng.randrange(1, 9), marks[i][3], 0.0, 0.1) for i in sorted(rng.sample(range(120), 20))]
    ends = [("m", 555, 1.0)]
    ex = spark.createDataFrame(fills, "market string, token string, strategy string, direction string, ts long, event_id long, size long, price double, fee double, ev double")
    got = {(r.direction, r.epoch): (r.favorable, r.adverse) for r in positions.excursions(ex, spark.createDataFrame(ends, "market string, ts long, price double"), spark.createDataFrame(marks, "token string, ts long, event_id long, mark double")).collect()}
    want = {}
    for direction in ("BUY", "SELL"):
        for epoch in (0, 1):
            own = [f for f in fills if f[3] == direction and (f[4] >= 555) == bool(epoch)]
            cost = held = 0
            best = worst = 0.0
            for k, f in enumerate(own):
                cost, held = cost + f[6] * f[7], held + f[6]
                stop = own[k + 1][4] if k + 1 < len(own) else (556 if epoch == 0 else math.inf)
                for _, ts, _, mark in marks:
                    if f[4] <= ts < stop:
                        d = mark - cost / held if direction == "BUY" else cost / held - mark
                        best, worst = max(best, d), max(worst, -d)
            if own:
                want[direction, epoch] = (pytest.approx(best), pytest.approx(worst))
    assert got == want


def test_books_at_are_the_replayed_ones(spark):
    rng = random.Random(2)
    parsed, state, want = [], {}, {}
    none = []
    for i in range(160):
        token = rng.choice("pq")
        if rng.random() < 0.1:
            sides = {s: [(round(rng.random(), 2) + 0.01, float(rng.randint(1, 9))) for _ in range(3)] for s in ("bid", "ask")}
            state[token] = {(s, p): z for s in sides for p, z in sides[s]}
            parsed.append((i, 0, token, 5 * i, "book", sides["bid"], sides["ask"], None, None, None))
        else:
            side, price, size = rng.choice(["bid", "ask"]), rng.randint(1, 9) / 10, float(rng.choice([0, 0, 3, 4]))
            state.setdefault(token, {})[side, price] = size
            parsed.append((i, 0, token, 5 * i, "change", none, none, price, size, side))
        for t in "pq":
            own = state.get(t, {})
            best = lambda s, o, own=own: sorted(((p, z) for (q, p), z in own.items() if q == s and z > 0), key=lambda x: o * x[0])[:3]
            want[t, i] = (best("bid", -1), best("ask", 1))
    lv = "array<struct<price: double, size: double>>"
    df = spark.createDataFrame(parsed, f"seq long, pos int, token_id string, ts long, kind string, bids {lv}, asks {lv}, price double, size double, side string").repartition(3)
    asked = spark.createDataFrame([(f"{t}{i}", t, 5 * i, i, 0) for t in "pq" for i in range(160)], "id string, token_id string, ts long, seq long, pos int")
    for r in messages.books_at(asked, df, 3).collect():
        assert ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) == want[r.token_id, r.seq]


def test_moves_travel_as_when_they_are_followed_one_by_one(spark):
    rng = random.Random(4)
    prices = [(rng.choice("abc"), 1_000 * i + rng.choice([0, 1]), i, rng.randrange(1, 100) / 100) for i in range(300)]
    edges = [("a", "b", 0.9), ("b", "a", 0.9), ("a", "c", -0.5), ("c", "a", -0.5), ("b", "c", 0.1)]
    p = spark.createDataFrame(prices, "series string, ts long, event_id long, price double")
    e = spark.createDataFrame(edges, "source string, target string, correlation double")
    found = graph.moves(p)
    now, within = 300_000, 20_000
    got = {(r.source, r.target, r.event_id): (r.status, r.lag, r.target_move) for r in graph.propagation(graph.awaited(found, e, p), p, now, within, parts=8).collect()}
    want, last, changes, pending = {}, {}, {}, []
    for s, ts, i, price in sorted(prices, key=lambda r: (r[1], r[2])):
        was = last.get(s)
        last[s] = price
        for x in [x for x in pending if x["target"] == s]:
            moved = price - x["base"]
            if ts - x["ts"] > within:
                pending.remove(x)
            elif moved * x["sign"] > 0 and abs(moved) >= 0.1 * abs(x["move"]):
                want[x["key"]] = ("resolved", ts - x["ts"], pytest.approx(moved))
                pending.remove(x)
        if was is None:
            continue
        changes.setdefault(s, []).append(price - was)
        recent = changes[s][-499:]
        if len(recent) < 10 or abs(price - was) < 0.005 or abs(price - was) < statistics.stdev(recent):
            continue
        for source, target, corr in edges:
            if source == s and abs(corr) >= 0.2 and target in last:
                key = (s, target, i)
                want[key] = ("expired" if now - ts > within else "open", None, None)
                pending.append({"key": key, "target": target, "ts": ts, "base": last[target], "move": price - was, "sign": math.copysign(1, price - was) * math.copysign(1, corr)})
    assert got == want and {v[0] for v in want.values()} >= {"resolved", "expired"}


def test_correlations_align_steps(spark):
    rng = random.Random(8)
    prices = [(s, 5_000 * i + rng.randrange(5_000), 3 * i + k, rng.randrange(0, 90) / 100) for i in range(80) for k, s in enumerate("abc") if rng.random() < 0.8] + [("d", 1, 999, 0.5)]
    now, within, tol = 400_000, 300_000, 4_000
    p = spark.createDataFrame(prices, "series string, ts long, event_id long, price double")
    steps = graph.returns(p, now, within)
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]
    got = {(r.a, r.b): r.correlation for r in graph.correlations(spark.createDataFrame(pairs, "a string, b string"), steps, tol).collect()}

    def own(s):
        x = sorted((ts, i, v) for q, ts, i, v in prices if q == s)
        return [(b[0], b[2] - a[2]) for a, b in zip(x[:-1], x[1:], strict=True) if a[2] > 0 and b[2] > 0 and b[0] >= now - within]

    for a, b in pairs:
        ra, rb, met, k = own(a), own(b), [], 0
        if len(ra) >= 5 and len(rb) >= 5:
            for ts, x in ra:
                while k < len(rb) - 1 and rb[k + 1][0] <= ts + tol:
                    k += 1
                if abs(rb[k][0] - ts) <= tol:
                    met.append((x, rb[k][1]))
        want = statistics.correlation(*zip(*met, strict=True)) if len(met) >= 5 else 0.0
        assert got[a, b] == pytest.approx(want)


def test_linked_pairs_lose_no_check(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "primary", "election", "round", "final", "win", "january", "march", "may", "june"]
    rows = [(i, rng.choice("xy"), " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(60)]
    m = spark.createDataFrame(rows, "market long, category string, question string")
    from tidebook.functions import text as X

    members = m.select("market", (F.col("market") % 3).alias("cluster"))
    edges = spark.createDataFrame([(0, 1), (1, 0), (5, 4)], "source long, target long")
    told = sorted({w for pair in checks.CONDITIONS for some in pair for w in some})
    few = graph.linked_pairs(edges, members, m.select("market", X.tokens(F.col("question")).alias("words")), checks.SHARED, told)
    every = members.alias("x").join(members.alias("y"), F.expr("x.cluster = y.cluster and x.market < y.market")).selectExpr("x.market a", "y.market b").unionByName(spark.createDataFrame([(0, 1), (4, 5)], "a long, b long"))
    kinds = lambda pairs: sorted((r.check_id, r.kind, r.high, r.low) for r in checks.pair_kinds(m, pairs.distinct()).collect())
    assert kinds(few) == kinds(every) and few.count() == few.distinct().count()


def test_reactions_and_gates(spark):
    large = spark.createDataFrame([(1, "t", 1_000, 1), (2, "t", 9_000, -1), (3, "u", 1_000, 1)], "event_id long, token string, ts long, direction int")
    quotes = spark.createDataFrame([("t", 500, 0, 0.40), ("t", 1_000, 1, 0.50), ("t", 7_000, 2, 0.45), ("t", 20_000, 3, 0.30)], "token string, ts long, event_id long, mid double")
    got = {r.event_id: r for r in engine.reactions(large, quotes, 40_000, (2_000, 8_000, 100_000)).collect()}
    assert got[1].pre == 0.4 and got[1].impacts == [pytest.approx(0.1), pytest.approx(0.05), None]
    assert got[2].impacts[0] == pytest.approx(0.0) and got[3].pre is None and got[3].impacts == [None, None, None]
    signals = spark.createDataFrame([("s", i, "m", "BUY", ts, 0.5, 10.0, 0.5, 0.5) for i, ts in enumerate([0, 100, 250, 400, 900, 1_000, 9_000])], "strategy string, event_id long, market string, side string, ts long, ev double, size double, strength double, target double")
    settings = spark.createDataFrame([("s", True, 300, [], 2, 0.02, 40.0)], "strategy string, enabled boolean, cooldown_ms long, allowed array<string>, max_positions long, min_ev double, max_size double")
    losses = spark.createDataFrame([("s", 100)], "strategy string, ts long")
    held = spark.createDataFrame([("s", 850, 1), ("s", 880, 1), ("s", 950, -1)], "strategy string, ts long, change int")
    regimes = spark.createDataFrame([(0, "normal")], "tick long, regime string")
    viable = spark.createDataFrame([("m", ["s"])], "market string, strategies array<string>")
    gates = [r.gate for r in engine.gates(signals, settings, losses, held, regimes, viable, 700).orderBy("event_id").collect()]
    assert gates == [None, "cooldown", "cooldown", "duplicate", "concurrent", None, None]
