"""Market metadata and transfer logs as they come from outside: JSON lines to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import decimal_of_hex, hex_to_long
from ..operators import chains

_MARKET = "id string, conditionId string, condition_id string, question string, clobTokenIds string, tokens array<struct<outcome: string, token_id: string, tokenId: string>>, status string, resolution string, endDate string, end_date string, category string, tags string, liquidity string"


def parse_markets(lines: DataFrame, least: float = 1_000.0) -> DataFrame:
    """The other columns of lines with market, condition_id, question, yes_id, no_id, status, resolution, end_date, category, tags.

    lines: value (JSON object). Left out are lines that do not parse, markets without an id or a question, with a list of tokens that
    cannot be read, or with less liquidity. The tokens are a list of two ids, as such or as text that holds one, or else those named
    YES and NO. A status is resolved or paused, or active; a resolution YES or NO or none.
    """
    keep = [c for c in lines.columns if c != "value"]
    m = lines.select(*keep, F.from_json("value", _MARKET).alias("m")).where("m is not null")
    of = lambda *names: F.coalesce(*(F.col(f"m.{n}") for n in names), F.lit(""))
    listed = F.col("m.clobTokenIds")
    ids = F.from_json(listed, "array<string>")
    named = lambda name: F.coalesce(F.get(F.filter("m.tokens", lambda t: F.upper(t["outcome"]) == name), 0)["token_id"], F.get(F.filter("m.tokens", lambda t: F.upper(t["outcome"]) == name), 0)["tokenId"], F.lit(""))
    has = F.coalesce(listed != "", F.lit(False))
    side = lambda k, name: F.when(has, F.coalesce(F.get(ids, k), F.lit(""))).otherwise(named(name))
    liquidity = F.coalesce(F.col("m.liquidity").try_cast("double"), F.when(F.col("m.liquidity").isNull(), 0.0))
    state = F.lower(F.coalesce("m.status", F.lit("active")))
    rows = m.where((liquidity >= least) & (~has | ids.isNotNull()))
    rows = rows.select(
        *keep,
        F.coalesce("m.id", "m.conditionId", "m.condition_id", F.lit("")).alias("market"),
        of("conditionId", "condition_id").alias("condition_id"),
        of("question").alias("question"),
        side(0, "YES").alias("yes_id"),
        side(1, "NO").alias("no_id"),
        F.when(state.isin("resolved", "paused"), state).otherwise("active").alias("status"),
        F.when(F.col("m.resolution").isin("YES", "NO"), F.col("m.resolution")).alias("resolution"),
        of("endDate", "end_date").alias("end_date"),
        of("category").alias("category"),
        F.coalesce(F.from_json("m.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
    )
    return rows.where("market <> '' and question <> ''")


#: Fixed value: the hash of the event's signature, TransferSingle(address,address,address,uint256,uint256).
TRANSFER = "0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"
_LOG = "address string, topics array<string>, data string, transactionHash string, blockNumber string, logIndex string"


def decode_transfers(lines: DataFrame, tracked: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """wallet, token_id, side, size, ts, tx_hash, block, log_index: transfers that a tracked wallet (column wallet) sent (SELL) or received (BUY).

    lines: seq, ts, value (JSON log entry). Left out are other events, entries with fewer than four topics or with less data than two
    words of 256 bits, and those of a transaction and index that came within ttl_ms of one that was kept. Ids are
    decimal; amounts are in millionths.
    """
    m = lines.select("seq", "ts", F.from_json("value", _LOG).alias("m"))
    word = F.regexp_replace(F.coalesce("m.data", F.lit("0x")), "^0x", "")
    topic = lambda k: F.get("m.topics", k)
    address = lambda k: F.lower(F.concat(F.lit("0x"), F.right(topic(k), F.lit(40))))
    good = (F.size("m.topics") >= 4) & (F.lower(topic(0)) == TRANSFER) & (topic(2) != "") & (topic(3) != "") & (F.length(word) >= 128)
    rows = m.where(F.coalesce(good, F.lit(False))).select(
        "seq", "ts", address(2).alias("sender"), address(3).alias("receiver"), F.substring(word, 1, 64).alias("id"), F.substring(word, 65, 64).alias("amount"),
        F.coalesce("m.transactionHash", F.lit("")).alias("tx_hash"), F.coalesce(hex_to_long(F.col("m.blockNumber")), F.lit(0)).alias("block"), F.coalesce(hex_to_long(F.col("m.logIndex")), F.lit(0)).alias("log_index"),
    )
    ends = F.array(F.struct(F.col("sender").alias("wallet"), F.lit("SELL").alias("side")), F.struct(F.col("receiver").alias("wallet"), F.lit("BUY").alias("side")))
    both = rows.withColumn("x", F.explode(ends)).withColumns({"wallet": F.col("x.wallet"), "side": F.col("x.side")}).drop("x")
    # Only logs with a tracked end count for repeats; both ends of one log stand or fall together.
    both = both.join(tracked.select("wallet").distinct(), "wallet", "left_semi")
    first = chains.suppressed(both.select("tx_hash", "log_index", "ts", "seq").distinct(), ["tx_hash", "log_index"], "ts", "seq", ttl_ms).where("kept").select("seq")
    kept = both.join(first, "seq", "left_semi")
    decoded = kept.withColumns({"token_id": decimal_of_hex(F.col("id")), "size": decimal_of_hex(F.col("amount")).cast("double") / 1_000_000}).where("token_id is not null and size is not null")
    return decoded.select("wallet", "token_id", "side", "size", "ts", "tx_hash", "block", "log_index")


_EVENT = "timestamp_ingested long, timestamp_source long, type string, source string, parsed struct<wallet: string, tx_hash: string, token_id: string, market_id: string, side: string, size: double, price: double, mid_price: double, block_number: long>"


def raw_events(lines: DataFrame) -> DataFrame:
    """seq and the fields of raw event lines (seq, value: JSON): ts, source_ts, type, source, wallet, tx_hash, token_id, market_id, side, size, price, mid_price, block; lines without a parsed event are left out."""
    m = lines.select("seq", F.from_json("value", _EVENT).alias("m")).where("m.parsed is not null")
    return m.select("seq", F.coalesce("m.timestamp_ingested", F.lit(0)).alias("ts"), F.coalesce("m.timestamp_source", F.lit(0)).alias("source_ts"), F.coalesce("m.type", F.lit("")).alias("type"), F.coalesce("m.source", F.lit("chain_listener")).alias("source"), "m.parsed.*").withColumnRenamed("block_number", "block")


def price_index(events: DataFrame) -> DataFrame:
    """token_id, ts, seq, price: prices of trades, and middle prices of whole books that came without one."""
    price = F.when(F.coalesce("price", F.lit(0.0)) > 0, F.col("price")).when((F.col("type") == "book_snapshot") & (F.col("mid_price") > 0), F.col("mid_price"))
    return events.where(F.coalesce("token_id", F.lit("")) != "").select("token_id", "ts", "seq", price.alias("price")).where("price is not null")


def wallet_trades(events: DataFrame, tracked: DataFrame, since: int = 0) -> DataFrame:
    """wallet, token_id, market_id, side, size, price, ts, tx_hash, source of tracked wallets' trades, each once whatever the number of sources.

    A trade is its transaction; that of a resolution is the same for all wallets, so there the wallet counts too, and without one
    wallet and time do. Of several events of a trade the last one of the exchange stands, or the first one if there is none.
    """
    rows = events.where(F.col("ts") >= since).withColumn("wallet", F.lower(F.coalesce("wallet", F.lit("")))).join(tracked.select("wallet").distinct(), "wallet", "left_semi")
    tx = F.coalesce("tx_hash", F.lit(""))
    key = F.when(tx == "", F.concat_ws(":", "wallet", F.col("ts").cast("string"))).when(tx.startswith("resolution:"), F.concat_ws(":", "wallet", tx)).otherwise(tx)
    own = F.col("source") == "clob_ws"
    rank = F.struct(own.cast("int"), F.when(own, F.col("seq")).otherwise(-F.col("seq")))
    fields = F.struct("wallet", F.coalesce("token_id", F.lit("")).alias("token_id"), F.coalesce("market_id", F.lit("")).alias("market_id"), F.coalesce("side", F.lit("BUY")).alias("side"), F.coalesce("size", F.lit(0.0)).alias("size"), F.coalesce("price", F.lit(0.0)).alias("price"), F.when(F.col("source_ts") > 0, F.col("source_ts")).otherwise(F.col("ts")).alias("ts"), tx.alias("tx_hash"), "source")
    return rows.groupBy(key.alias("_key")).agg(F.max_by(fields, rank).alias("x")).select("x.*")


