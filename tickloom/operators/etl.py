"""From vendor and exchange formats to the tape, compaction and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.sources.tape import epoch_ms, tape_order

LEVEL = "array<array<string>>"
AGG_TRADES = "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, timestamp long, is_buyer_maker boolean, is_best_match boolean"
#: Other spellings of the columns of best-quote files.
QUOTE_ALIASES = {"updateId": "update_id", "bestBidPrice": "best_bid_price", "bestBidQty": "best_bid_qty", "bestAskPrice": "best_ask_price", "bestAskQty": "best_ask_qty", "transactionTime": "transaction_time", "eventTime": "event_time"}
QUOTES = ("update_id", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty")


def read_agg_trades(spark: SparkSession, path: str) -> DataFrame:
    """Aggregate-trade CSV with or without a header row, times in ms whatever the unit of each file."""
    rows = spark.read.schema(AGG_TRADES.replace("agg_trade_id long", "agg_trade_id string")).option("mode", "PERMISSIVE").csv(path).select("*", F.col("_metadata.file_path").alias("_file"))
    rows = rows.where(F.col("agg_trade_id").rlike(r"^\d+$")).withColumn("agg_trade_id", F.col("agg_trade_id").cast("long"))
    top = rows.groupBy("_file").agg(F.max("timestamp").alias("_top"))  # one row a file
    return rows.join(top, "_file").withColumn("timestamp", epoch_ms(F.col("timestamp"), F.col("_top"))).drop("_top", "_file")


def agg_trades_to_tape(trades: DataFrame) -> DataFrame:
    """Trades with a maker flag as side-2 rows; a buyer who is the maker makes the quantity negative."""
    signed = F.when(F.col("is_buyer_maker"), -F.col("quantity")).otherwise(F.col("quantity"))
    return trades.select("timestamp", F.lit(2).cast("byte").alias("side"), F.col("price").cast("double").alias("price"), signed.cast("double").alias("quantity"), F.col("agg_trade_id").alias("arrival"))


def quotes_to_tape(quotes: DataFrame) -> DataFrame:
    """Best-quote updates as pairs of snapshot rows, bid then ask, in the order of the updates."""
    named = quotes.withColumnsRenamed({k: v for k, v in QUOTE_ALIASES.items() if k in quotes.columns})
    missing = [c for c in QUOTES if c not in named.columns]
    if missing or not {"transaction_time", "event_time"} & set(named.columns):
        raise ValueError(f"missing columns: {', '.join(missing) or 'transaction_time'}")
    at = F.col("transaction_time" if "transaction_time" in named.columns else "event_time")
    side = lambda s, p, q: F.struct(F.lit(s).cast("byte").alias("side"), F.col(p).cast("double").alias("price"), F.col(q).cast("double").alias("quantity"))
    rows = named.select(at.alias("timestamp"), F.col("update_id").alias("arrival"), F.posexplode(F.array(side(3, "best_bid_price", "best_bid_qty"), side(4, "best_ask_price", "best_ask_qty"))).alias("part", "_r"))
    return rows.select("timestamp", "_r.*", "arrival", "part")


def packed_levels(packed: Column, depth: int, prefix: str) -> list[Column]:
    """`price_qty|price_qty|...` as depth pairs of columns; null where a level is missing or has no underscore."""
    out = []
    for i in range(depth):
        item = F.try_element_at(F.split(packed, r"\|"), F.lit(i + 1))
        pair = F.split(item, "_")
        ok = F.contains(item, F.lit("_"))
        out += [F.when(ok, F.try_element_at(pair, F.lit(1)).try_cast("double")).alias(f"{prefix}_p_{i}"), F.when(ok, F.try_element_at(pair, F.lit(2)).try_cast("double")).alias(f"{prefix}_q_{i}")]
    return out


def second_volumes(trades: DataFrame, by: list[str], at: str, size: str, is_maker: Column) -> DataFrame:
    """Taker volumes per second: a buyer who is the maker means selling."""
    sec = F.floor(F.col(at) / 1000).cast("long")
    return trades.groupBy(*by, sec.alias("second")).agg(F.sum(F.when(~is_maker, F.col(size)).otherwise(0.0)).alias("taker_buy_vol"), F.sum(F.when(is_maker, F.col(size)).otherwise(0.0)).alias("taker_sell_vol"), F.sum(size).alias("size"))


def last_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. An aggregation, so it is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def align_seconds(depth: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """Depth by second with the second's volumes, 0 where there was no trade (the total size stays null)."""
    return depth.join(volumes, keys, "left").withColumn("taker_buy_vol", F.coalesce("taker_buy_vol", F.lit(0.0))).withColumn("taker_sell_vol", F.coalesce("taker_sell_vol", F.lit(0.0)))


def compacted(shards: DataFrame, partition: list[str], arrival: list[str]) -> DataFrame:
    """Rows of many small files dealt out by partition and sorted in tape order, ready to be written as one file each.

    Sorting within partitions keeps row-group statistics of time tight, so later time filters skip row groups.
    """
    return shards.repartition(*partition).sortWithinPartitions(*partition, *tape_order(arrival))


def write_day(tape: DataFrame, path: str, partition: list[str]) -> None:
    """Write days as partitions, replacing only those in the data (re-running a day is idempotent)."""
    tape.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def finished_days(tape: DataFrame, now_ms: int) -> DataFrame:
    """Only rows of UTC days that are over; an unfinished day must not be archived."""
    return tape.where(F.floor(F.col("timestamp") / 86_400_000) < now_ms // 86_400_000)


def backfill_trades(tape: DataFrame, trades: DataFrame, by: list[str], enough: int = 1000, force: bool = False) -> DataFrame:
    """Trades of each group replaced by `trades`, unless it has more than `enough` already; groups that are only in
    `trades` are created."""
    have = tape.groupBy(*by).agg(F.count_if(F.col("side") == 2).alias("_n"))
    keep = have.where(F.lit(not force) & (F.col("_n") > enough)).select(*by, F.lit(True).alias("_keep"))
    marked = tape.join(keep, by, "left").where(F.coalesce("_keep", F.lit(False)) | (F.col("side") != 2)).drop("_keep")
    new = trades.join(keep.select(*by), by, "left_anti")
    return marked.unionByName(new.select(*marked.columns))


def backfill_depth(tape: DataFrame, quotes: DataFrame, by: list[str], enough: int = 1000, force: bool = False) -> DataFrame:
    """Book rows of each group replaced by `quotes` under the same guards; trades stay."""
    have = tape.groupBy(*by).agg(F.count_if(F.col("side") != 2).alias("_n"))
    keep = have.where(F.lit(not force) & (F.col("_n") > enough)).select(*by, F.lit(True).alias("_keep"))
    marked = tape.join(keep, by, "left").where(F.coalesce("_keep", F.lit(False)) | (F.col("side") == 2)).drop("_keep")
    return marked.unionByName(quotes.join(keep.select(*by), by, "left_anti").select(*marked.columns))


def task_grid(spark: SparkSession, start: str, end: str, symbols: list[str], kinds: list[str], markets: list[str]) -> DataFrame:
    """Every (day, symbol, kind, market) to fetch; lists are configuration, so the product is small."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    for name, values in (("symbol", symbols), ("kind", kinds), ("market", markets)):
        days = days.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return days


def shard_completeness(shards: DataFrame, by: list[str], start: str) -> DataFrame:
    """Files found against files expected at the group's (upper) median interval over 24 hours."""
    step = F.col(start) - F.lag(start).over(W.partitionBy(*by).orderBy(start))
    per = shards.withColumn("_s", step).groupBy(*by).agg(F.count("*").alias("found"), F.sort_array(F.collect_list("_s")).alias("_all"))
    median = F.try_element_at("_all", (F.floor(F.size("_all") / 2) + 1).cast("int"))
    out = per.withColumn("median_ms", median).withColumn("expected", F.floor(86_400_000 / F.col("median_ms")).cast("long"))
    return out.withColumn("completion_pct", S.rounded(100.0 * F.col("found") / F.col("expected"), 2)).drop("_all")


def levels_of(message: Column, path: str, side: int) -> Column:
    """The [price, qty] pairs at a JSON path as tape entries of a side; malformed pairs become null and go."""
    pairs = F.from_json(F.get_json_object(message, path), LEVEL)
    entry = F.transform(F.coalesce(pairs, F.array().cast(LEVEL)), lambda x: F.struct(F.lit(side).cast("byte").alias("side"), F.try_element_at(x, F.lit(1)).try_cast("double").alias("price"), F.try_element_at(x, F.lit(2)).try_cast("double").alias("quantity")))
    return F.filter(entry, lambda e: e["price"].isNotNull() & e["quantity"].isNotNull())


def _rows(messages: DataFrame, ms: Column, entries: Column) -> DataFrame:
    kept = [c for c in messages.columns if c != "message"]
    out = messages.select(*kept, ms.cast("long").alias("timestamp"), F.posexplode(entries).alias("part", "_e"))
    return out.select(*kept, "timestamp", "_e.side", "_e.price", "_e.quantity", "part")


def _one(side: int, price: Column, qty: Column) -> Column:
    return F.array(F.struct(F.lit(side).cast("byte").alias("side"), price.try_cast("double").alias("price"), qty.try_cast("double").alias("quantity")))


def _field(path: str) -> Column:
    return F.get_json_object("message", path)


def binance_rows(messages: DataFrame) -> DataFrame:
    """Depth diffs and trades of a `message` column (JSON text) as tape rows; combined-stream wrappers are opened.
    A trade whose buyer is the maker is negative."""
    m = messages.withColumn("message", F.coalesce(_field("$.data"), F.col("message")))
    kind, qty = _field("$.e"), _field("$.q").try_cast("double")
    depth = F.concat(levels_of(F.col("message"), "$.b", 0), levels_of(F.col("message"), "$.a", 1))
    trade = _one(2, _field("$.p"), F.when(_field("$.m") == "true", -qty).otherwise(qty))
    return _rows(m.where(kind.isin("depthUpdate", "aggTrade", "trade")), _field("$.E").try_cast("long"), F.when(kind == "depthUpdate", depth).otherwise(trade))


def coincheck_rows(messages: DataFrame) -> DataFrame:
    """Order-book diffs [pair, {bids, asks, last_update_at}] and trades [[ts, id, pair, price, qty, side, ...], ...];
    a taker's sale is negative, seconds become ms, malformed trades go."""
    is_trade = F.col("message").startswith("[[")
    depth = F.concat(levels_of(F.col("message"), "$[1].bids", 0), levels_of(F.col("message"), "$[1].asks", 1))
    fields = F.from_json("message", LEVEL)
    at = lambda x, i: F.try_element_at(x, F.lit(i))
    sold = lambda x: F.when(at(x, 6) == "sell", -at(x, 5).try_cast("double")).otherwise(at(x, 5).try_cast("double"))
    book = _rows(messages.where(~is_trade), _field("$[1].last_update_at").try_cast("long") * 1000, depth)
    kept = [c for c in messages.columns if c != "message"]
    trades = messages.where(is_trade).select(*kept, F.posexplode(fields).alias("part", "_x"))
    trades = trades.select(*kept, (at(F.col("_x"), 1).try_cast("long") * 1000).alias("timestamp"), F.lit(2).cast("byte").alias("side"), at(F.col("_x"), 4).try_cast("double").alias("price"), sold(F.col("_x")).alias("quantity"), "part")
    return book.unionByName(trades.where("timestamp IS NOT NULL AND price IS NOT NULL AND quantity IS NOT NULL"))


def bitbank_rows(messages: DataFrame) -> DataFrame:
    """Depth diffs {a, b, t} and whole books {asks, bids, timestamp} and transactions; a taker's purchase is negative."""
    trade = F.array_compact(F.transform(F.coalesce(F.from_json(_field("$.transactions"), "array<struct<executed_at:long,price:string,amount:string,side:string>>"), F.array()), lambda x: F.struct(x["executed_at"].alias("ms"), F.lit(2).cast("byte").alias("side"), x["price"].try_cast("double").alias("price"), F.when(x["side"] == "buy", -x["amount"].try_cast("double")).otherwise(x["amount"].try_cast("double")).alias("quantity"))))
    kept = [c for c in messages.columns if c != "message"]
    trades = messages.select(*kept, F.posexplode(trade).alias("part", "_e")).select(*kept, F.col("_e.ms").alias("timestamp"), "_e.side", "_e.price", "_e.quantity", "part")
    m = F.col("message")
    diff = F.concat(levels_of(m, "$.b", 0), levels_of(m, "$.a", 1))
    whole = F.concat(levels_of(m, "$.bids", 3), levels_of(m, "$.asks", 4))
    book = _rows(messages.where(_field("$.transactions").isNull()), F.coalesce(_field("$.t"), _field("$.timestamp")).try_cast("long"), F.concat(whole, diff))
    return book.unionByName(trades)


def bitflyer_rows(messages: DataFrame) -> DataFrame:
    """Board diffs and snapshots with {price, size} levels, and executions with ISO times; a purchase is negative."""
    kind = "array<struct<price:double,size:double>>"
    pairs = lambda path, side: F.transform(F.coalesce(F.from_json(_field(path), kind), F.array().cast(kind)), lambda x: F.struct(F.lit(side).cast("byte").alias("side"), x["price"].alias("price"), x["size"].alias("quantity")))
    snap = _field("$.channel").startswith("lightning_board_snapshot")
    board = F.when(snap, F.concat(pairs("$.message.bids", 3), pairs("$.message.asks", 4))).otherwise(F.concat(pairs("$.message.bids", 0), pairs("$.message.asks", 1)))
    is_trade = _field("$.channel").startswith("lightning_executions")
    book = _rows(messages.where(~is_trade), F.unix_millis(F.try_to_timestamp(_field("$.time"))), board)
    done = F.from_json(_field("$.message"), "array<struct<exec_date:string,price:double,size:double,side:string>>")
    kept = [c for c in messages.columns if c != "message"]
    trades = messages.where(is_trade).select(*kept, F.posexplode(done).alias("part", "_x"))
    signed = F.when(F.col("_x.side") == "BUY", -F.col("_x.size")).otherwise(F.col("_x.size"))
    return book.unionByName(trades.select(*kept, F.unix_millis(F.try_to_timestamp("_x.exec_date")).alias("timestamp"), F.lit(2).cast("byte").alias("side"), F.col("_x.price").alias("price"), signed.alias("quantity"), "part"))


def gmo_rows(messages: DataFrame) -> DataFrame:
    """Whole books on every push (snapshot sides) and trades, with ISO times; a purchase is negative."""
    kind = "array<struct<price:string,size:string>>"
    pairs = lambda path, side: F.transform(F.coalesce(F.from_json(_field(path), kind), F.array().cast(kind)), lambda x: F.struct(F.lit(side).cast("byte").alias("side"), x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("quantity")))
    size = _field("$.size").try_cast("double")
    trade = _one(2, _field("$.price"), F.when(_field("$.side") == "BUY", -size).otherwise(size))
    entries = F.when(_field("$.channel") == "trades", trade).otherwise(F.concat(pairs("$.bids", 3), pairs("$.asks", 4)))
    return _rows(messages, F.unix_millis(F.try_to_timestamp(_field("$.timestamp"))), entries)


ADAPTERS = {"binance": binance_rows, "coincheck": coincheck_rows, "bitbank": bitbank_rows, "bitflyer": bitflyer_rows, "gmo": gmo_rows}


def timed_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a local time, a tab and a JSON message, as (local_time, message)."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("local_time"), F.get(parts, F.lit(1)).alias("message")).where("message IS NOT NULL")
