"""Metadata, feeds, transfer logs, wallet events, state machines and features, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import numbers
from tidebook.operators import capture, feeds, machines, series
from tidebook.sources import metadata


def test_large_hexadecimal_numbers(spark):
    rng = random.Random(1)
    words = ["0", "f", "F" * 64, "0" * 64, "1" + "0" * 63, "00000000000000000000000000000000000000000000000000000000000f4240"] + ["".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.randint(1, 64))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words + ["", "xyz", "1" * 65, None]], "w string").withColumn("d", numbers.decimal_of_hex(F.col("w")))
    for r in df.collect():
        assert r.d == (str(int(r.w, 16)) if r.w in words else None)
    got = spark.createDataFrame([("7d",), ("45d",), ("1d",), ("x",), ("",), (None,)], "p string").select("p", numbers.period_ms(F.col("p")).alias("ms")).collect()
    assert [r.ms // 86_400_000 for r in got] == [7, 45, 1, 7, 7, 7]
    assert [r.n for r in spark.createDataFrame([("0x10",), ("ff",), ("zz",), (None,)], "x string").select(numbers.hex_to_long(F.col("x")).alias("n")).collect()] == [16, 255, None, None]


def test_market_metadata(spark):
    whole = {"id": "1", "conditionId": "c", "question": "Q?", "liquidity": "2000"}
    lines = [
        whole | {"clobTokenIds": '["7","8"]', "status": "Resolved", "resolution": "YES", "tags": ["a", "b"], "category": "x", "endDate": "2024"},
        whole | {"clobTokenIds": ["7", "8"], "status": "odd", "resolution": "MAYBE", "end_date": "2025"},
        whole | {"tokens": [{"outcome": "No", "token_id": "8"}, {"outcome": "yes", "tokenId": "7"}], "status": "paused"},
        whole | {"clobTokenIds": "[broken"},
        whole | {"liquidity": 5},
        {"condition_id": "d", "question": "R?", "liquidity": 1e6},
        {"question": "no id", "liquidity": 1e6},
        {"id": "9", "liquidity": 1e6},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)] + [(99, "{ no"), (98, None)], "n long, value string")
    got = {r.n: r for r in metadata.parse_markets(df).collect()}
    assert sorted(got) == [0, 1, 2, 5]
    assert all((got[i].yes_id, got[i].no_id) == ("7", "8") for i in (0, 1, 2)) and (got[5].market, got[5].yes_id) == ("d", "")
    assert [got[i].status for i in (0, 1, 2, 5)] == ["resolved", "active", "paused", "active"] and [got[i].resolution for i in (0, 1)] == ["YES", None]
    assert got[0].tags == ["a", "b"] and got[1].tags == [] and (got[0].end_date, got[1].end_date) == ("2024", "2025")


def test_feed_replays_to_every_snapshot(spark):
    rng = random.Random(3)
    rows, state = [], {}
    for ts in range(0, 40, 4):
        for m in "abcd":
            if rng.random() < 0.7:
                state[m] = (rng.choice(["active", "paused", "resolved"]), rng.choice([None, "YES"]))
                rows.append((ts, m, *state[m]))
    snapshots = spark.createDataFrame(rows, "ts long, market string, status string, resolution string").repartition(3)
    changes = feeds.market_events(feeds.versions(snapshots, ["market"], ["status", "resolution"]))
    known, events = {}, []
    for ts, m, status, resolution in rows:
        was = known.get(m)
        if was != (status, resolution):
            events.append((ts, m, "created" if was is None else "resolved" if status == "resolved" and was[0] != "resolved" else "changed"))
        known[m] = (status, resolution)
        at = {r.market: (r.status, r.resolution) for r in feeds.valid_at(changes, F.lit(ts)).collect()} if m == "d" else None
        assert at is None or at == known
    assert sorted((r.valid_from, r.market, r.event) for r in changes.collect()) == sorted(events)


def test_list_changes(spark):
    rng = random.Random(4)
    lists = {ts: {x for x in "abcdef" if rng.random() < 0.5} for ts in (5, 9, 30, 31, 77)}
    df = spark.createDataFrame([(ts, x) for ts, xs in lists.items() for x in [*xs, *xs]], "ts long, x string")
    want, before = set(), set()
    for ts in sorted(lists):
        want |= {(ts, x, "added") for x in lists[ts] - before} | {(ts, x, "removed") for x in before - lists[ts]}
        before = lists[ts]
    assert {tuple(r) for r in feeds.list_changes(df, "x").collect()} == want


def test_transfers(spark):
    pad = lambda a: "0x" + a.rjust(64, "0")
    data = "0x" + f"{(1 << 255) + 12345:064x}" + f"{2_500_000:064x}"
    log = lambda tx, i, a="aa", b="bb", topic=metadata.TRANSFER, d=data: json.dumps({"topics": [topic, pad("1"), pad(a), pad(b)], "data": d, "transactionHash": tx, "blockNumber": "0x1F", "logIndex": hex(i)})
    lines = [(0, 10, log("t", 0)), (1, 20, log("t", 0)), (2, 200, log("t", 0)), (3, 20, log("t", 1)), (4, 30, log("u", 0, "AA", "cc")), (5, 30, log("v", 0, "cc", "dd")), (6, 30, log("w", 0, topic="0x00")), (7, 30, log("x", 0, d="0x12")), (8, 30, "{ no"), (9, 30, log("y", 0, topic=metadata.TRANSFER.upper()))]
    tracked = spark.createDataFrame([("0x" + a.rjust(40, "0"),) for a in ("aa", "bb")], "wallet string")
    got = metadata.decode_transfers(spark.createDataFrame(lines, "seq long, ts long, value string"), tracked, 100).collect()
    assert sorted((r.tx_hash, r.log_index, r.ts, r.side) for r in got) == sorted([("t", 0, 10, "SELL"), ("t", 0, 10, "BUY"), ("t", 0, 200, "SELL"), ("t", 0, 200, "BUY"), ("t", 1, 20, "SELL"), ("t", 1, 20, "BUY"), ("u", 0, 30, "SELL"), ("y", 0, 30, "SELL"), ("y", 0, 30, "BUY")])
    assert {(r.token_id, r.size, r.block) for r in got} == {(str((1 << 255) + 12345), 2.5, 31)}


def test_wallet_events(spark):
    e = lambda seq, ts, source, wallet, tx, price=0.0, kind="wallet_tx": (seq, json.dumps({"timestamp_ingested": ts, "timestamp_source": ts - 1 if source == "clob_ws" else 0, "type": kind, "source": source, "parsed": {"wallet": wallet, "tx_hash": tx, "token_id": "k", "side": "SELL", "size": 2, "price": price, "mid_price": 0.7}}))
    lines = [e(0, 10, "chain", "W1", "a"), e(1, 11, "clob_ws", "w1", "a", 0.3), e(2, 12, "clob_ws", "w1", "a", 0.4), e(3, 13, "chain", "w1", "a"), e(4, 14, "chain", "w2", "resolution:m"), e(5, 14, "chain", "w1", "resolution:m"), e(6, 15, "chain", "w1", ""), e(7, 15, "clob_ws", "w1", ""), e(8, 16, "chain", "w9", "z", 0.9), e(9, 17, "x", "", "", 0.0, "book_snapshot"), (10, "{}"), (11, "no")]
    events = metadata.raw_events(spark.createDataFrame(lines, "seq long, value string"))
    got = metadata.wallet_trades(events, spark.createDataFrame([("w1",), ("w2",)], "wallet string")).collect()
    assert sorted((r.wallet, r.tx_hash, r.price, r.ts) for r in got) == [("w1", "", 0.0, 14), ("w1", "a", 0.4, 11), ("w1", "resolution:m", 0.0, 14), ("w2", "resolution:m", 0.0, 14)]
    index = metadata.price_index(events)
    assert sorted((r.ts, r.price) for r in index.collect()) == [(11, 0.3), (12, 0.4), (16, 0.9), (17, 0.7)]
    asked = spark.createDataFrame([("k", 5), ("k", 12), ("k", 15), ("k", 40), ("none", 12)], "token_id string, ts long")
    assert [r.price for r in series.price_at(asked, index, "token_id", 10).orderBy("token_id", "ts").collect()] == [0.3, 0.4, 0.4, 0.0, 0.0]


@pytest.mark.parametrize("block", [3, 256])
def test_machine_is_the_fold(spark, monkeypatch, block):
    monkeypatch.setattr(machines, "BLOCK", block)
    rng = random.Random(block)
    moves = machines.HYPOTHESIS
    rows = [(k, 10 * i, i, rng.choice([*moves, "unknown", None])) for k in "abc" for i in range(40 if k != "c" else 1)]
    got = machines.run(spark.createDataFrame(rows, "id string, ts long, event_id long, to string").repartition(4), ["id"], ["ts", "event_id"], "to", moves, "registered", bucket=70)
    seen = {(r.id, r.event_id): (r.before, r.after, r.accepted) for r in got.collect()}
    assert len(seen) == len(rows)
    last = {}
    for k, _, i, to in rows:
        before = last.get(k, "registered")
        last[k] = to if to in moves[before] else before
        assert seen[k, i] == (before, last[k], last[k] != before)
    assert {r.id: r.state for r in machines.final(got, ["id"], ["ts", "event_id"]).collect()} == last


def test_ticks_see_nothing_later(spark):
    trades = spark.createDataFrame([("m", 5, 2.0), ("m", 10, 3.0), ("m", 11, 4.0), ("m", 35, 1.0), ("n", 21, 7.0)], "market string, ts long, value double")
    at = capture.ticks(trades, 10)
    assert sorted((r.market, r.ts) for r in at.collect()) == [("m", 10), ("m", 20), ("m", 30), ("m", 40), ("n", 30), ("n", 40)]
    assert sorted((r.market, r.ts, r.volume, r.trades) for r in capture.counted(at, trades, 10).collect()) == [("m", 10, 5.0, 2.0), ("m", 20, 4.0, 1.0), ("m", 30, 0.0, 0.0), ("m", 40, 1.0, 1.0), ("n", 30, 7.0, 1.0), ("n", 40, 0.0, 0.0)]
    line = spark.createDataFrame([("m", 10, 1, 0.5), ("m", 10, 2, 0.6), ("m", 31, 3, 0.9)], "market string, ts long, event_id long, x double")
    assert sorted((r.market, r.ts, r.x) for r in capture.last_known(at, line, ["x"], 10).collect() if r.market == "m") == [("m", 10, 0.6), ("m", 20, 0.6), ("m", 30, 0.6), ("m", 40, 0.9)]
