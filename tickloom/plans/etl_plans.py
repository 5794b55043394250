"""Registered ETL queries: vendor formats to the tape, compaction, backfills, joins by second."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import etl
from tickloom.session import table
from tickloom.sources.driver_tables import HOUR, tape_from_events, tape_sql
from tickloom.sources.tape import epoch_ms


def agg_trades(spark, sf_dir):
    """lineitem as aggregate trades: quantity and price, with the returned ones as the maker's."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("agg_trade_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("timestamp"), (F.col("l_returnflag") == "R").alias("is_buyer_maker"))


def aggtrades_to_tape(spark, sf_dir):
    return etl.agg_trades_to_tape(agg_trades(spark, sf_dir))


def bookticker_to_tape(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("updateId"), F.col("l_extendedprice").alias("bestBidPrice"), F.col("l_quantity").alias("bestBidQty"), (F.col("l_extendedprice") + 1.0).alias("bestAskPrice"), F.col("l_discount").alias("bestAskQty"), F.col("l_orderkey").alias("transactionTime"))
    return etl.quotes_to_tape(q)


def packed_depth(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").cast("string").alias("q")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "q"))), lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit("_"), x["q"])), "|").alias("bids"))
    return text.select("l_orderkey", *etl.packed_levels(F.col("bids"), 4, "b"))


def compact_day(spark, sf_dir):
    """Rows per venue and day after compaction, with the first and last in tape order."""
    t = tape_from_events(spark, sf_dir).withColumn("day", F.floor(F.col("timestamp") / 86_400_000).cast("long"))
    c = etl.compacted(t, ["venue", "day"], ["arrival"])
    order = F.struct("timestamp", -F.col("side"), "arrival")
    return c.groupBy("venue", "day").agg(F.count("*").alias("n"), F.min_by("arrival", order).alias("first_arrival"), F.max_by("arrival", order).alias("last_arrival"))


def finished_days(spark, sf_dir):
    t = tape_from_events(spark, sf_dir)
    return etl.finished_days(t, 1705708800000).groupBy("venue").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))


def backfill_trades(spark, sf_dir):
    """Trades of venues with at most 500 replaced by doubled ones."""
    t = tape_from_events(spark, sf_dir).drop("k")
    new = t.where("side = 2").withColumn("quantity", F.col("quantity") * 2)
    b = etl.backfill_trades(t, new, ["venue"], enough=500)
    return b.groupBy("venue", "side").agg(F.count("*").alias("n"), S.rounded(F.sum("quantity"), 4).alias("q"))


def backfill_depth(spark, sf_dir):
    t = tape_from_events(spark, sf_dir).drop("k")
    new = t.where("side = 2").withColumn("side", F.lit(3).cast("byte"))
    b = etl.backfill_depth(t, new, ["venue"], enough=2000)
    return b.groupBy("venue", "side").agg(F.count("*").alias("n"), S.rounded(F.sum("quantity"), 4).alias("q"))


def task_grid(spark, sf_dir):
    g = etl.task_grid(spark, "2024-01-30", "2024-02-02", ["BTCUSDT", "ETHUSDT"], ["aggTrades", "bookTicker"], ["um", "spot"])
    return g.withColumn("day", F.date_format("day", "yyyyMMdd"))


def dedupe_keep_last(spark, sf_dir):
    t = tape_from_events(spark, sf_dir, True).where("side IN (0, 1)")
    return etl.last_per(t.select("venue", "timestamp", "side", "price", "quantity", "arrival"), ["venue", "timestamp"], [F.col("arrival")])


def last_per_second_join(spark, sf_dir):
    """The last book row of each hour with the hour's taker volumes."""
    t = tape_from_events(spark, sf_dir, True)
    depth = etl.last_per(t.where("side IN (0, 1)").select("venue", F.floor(F.col("timestamp") / 1000).cast("long").alias("second"), "price", "arrival"), ["venue", "second"], [F.col("arrival")])
    tr = t.where("side = 2").withColumn("size", F.abs("quantity"))
    vols = etl.second_volumes(tr, ["venue"], "timestamp", "size", F.col("quantity") < 0)
    a = etl.align_seconds(depth, vols, ["venue", "second"])
    return a.select("venue", "second", "price", S.rounded("taker_buy_vol", 6).alias("taker_buy_vol"), S.rounded("taker_sell_vol", 6).alias("taker_sell_vol"), S.rounded("size", 6).alias("size"))


def shard_completeness(spark, sf_dir):
    t = tape_from_events(spark, sf_dir).where("side = 2")
    return etl.shard_completeness(t.select("venue", F.col("timestamp").alias("start")), ["venue"], "start")


def normalise_epoch(spark, sf_dir):
    t = tape_from_events(spark, sf_dir)
    out = None
    for unit, factor in (("s", 0.001), ("ms", 1.0), ("us", 1000.0)):
        x = t.select(F.lit(unit).alias("unit"), "arrival", F.floor(F.col("timestamp") * factor).cast("long").alias("raw"))
        top = x.agg(F.max("raw").alias("_top"))
        y = x.crossJoin(F.broadcast(top)).select("unit", "arrival", epoch_ms(F.col("raw"), F.col("_top")).alias("ms"))
        out = y if out is None else out.unionByName(y)
    return out


def symbol_normalise(spark, sf_dir):
    names = spark.createDataFrame([("btcusdt",), ("BTC-JPY",), ("eth_jpy",), ("XRPBTC",), ("SOLUSDC",)], "native string")
    return names.select("native", S.to_std(F.col("native")).alias("std"), S.to_native(S.to_std(F.col("native")), "", True).alias("binance"), S.to_native(S.to_std(F.col("native")), "_", True).alias("bitbank"))


def trade_label(spark, sf_dir):
    t = tape_from_events(spark, sf_dir).where("side = 2")
    return t.select("arrival", (F.col("quantity") < 0).alias("is_buyer_maker"), F.when(F.col("quantity") < 0, "SELL").otherwise("BUY").alias("label"), F.abs("quantity").alias("size"))


def union_tapes(spark, sf_dir):
    t = tape_from_events(spark, sf_dir)
    u = t.where("side = 2").unionByName(t.where("side IN (0, 1)"))
    return u.groupBy("venue").agg(F.count("*").alias("n"))


def human_sizes(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 4099 * 7).alias("bytes"))
    return s.select("o_orderkey", S.human_size(F.col("bytes")).alias("size"))


SIZE_SQL = "CASE " + " ".join(f"WHEN b < {1024.0 ** (p + 1)} THEN printf('%.2f', b / {1024.0**p}) || ' {u}'" for p, u in ((0, "B"), (1, "KB"), (2, "MB"), (3, "GB"))) + f" ELSE printf('%.2f', b / {1024.0**4}) || ' TB' END"
T, C = tape_sql(), tape_sql(True)
ALL = {
    "aggtrades_to_tape": (aggtrades_to_tape, "SELECT l_orderkey AS timestamp, CAST(2 AS TINYINT) AS side, l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, l_orderkey * 10 + l_linenumber AS arrival FROM lineitem"),
    "bookticker_to_tape": (bookticker_to_tape, "SELECT l_orderkey AS timestamp, CAST(3 AS TINYINT) AS side, l_extendedprice AS price, l_quantity AS quantity, l_orderkey * 10 + l_linenumber AS arrival, 0 AS part FROM lineitem UNION ALL SELECT l_orderkey, CAST(4 AS TINYINT), l_extendedprice + 1.0, l_discount, l_orderkey * 10 + l_linenumber, 1 FROM lineitem"),
    "packed_depth": (packed_depth, "WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, CAST(l_linenumber AS DOUBLE) AS p, CAST(CAST(min(l_quantity) AS INTEGER) AS DOUBLE) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT l_orderkey, " + ", ".join(f"max(p) FILTER (i = {i}) AS b_p_{i}, max(q) FILTER (i = {i}) AS b_q_{i}" for i in range(4)) + " FROM l GROUP BY l_orderkey"),
    "compact_day": (compact_day, f"WITH {T}, o AS (SELECT *, timestamp // 86400000 AS day, row_number() OVER (PARTITION BY venue, timestamp // 86400000 ORDER BY timestamp, side DESC, arrival) AS i FROM tape) SELECT venue, day, count(*) AS n, arg_min(arrival, i) AS first_arrival, arg_max(arrival, i) AS last_arrival FROM o GROUP BY venue, day"),
    "finished_days": (finished_days, f"WITH {T} SELECT venue, count(*) AS n, max(timestamp) AS last FROM tape WHERE timestamp // 86400000 < 1705708800000 // 86400000 GROUP BY venue"),
    "backfill_trades": (backfill_trades, f"WITH {T}, h AS (SELECT venue, count(*) FILTER (side = 2) > 500 AS keep FROM tape GROUP BY venue) SELECT venue, side, count(*) AS n, (round(sum(CASE WHEN side = 2 AND NOT keep THEN 2 * quantity ELSE quantity END), 4) + 0.0) AS q FROM tape JOIN h USING (venue) GROUP BY venue, side"),
    "backfill_depth": (backfill_depth, f"WITH {T}, h AS (SELECT venue, count(*) FILTER (side <> 2) > 2000 AS keep FROM tape GROUP BY venue), b AS (SELECT venue, side, quantity FROM tape JOIN h USING (venue) WHERE keep OR side = 2 UNION ALL SELECT venue, 3, quantity FROM tape JOIN h USING (venue) WHERE NOT keep AND side = 2) SELECT venue, CAST(side AS TINYINT) AS side, count(*) AS n, (round(sum(quantity), 4) + 0.0) AS q FROM b GROUP BY venue, side"),
    "task_grid": (task_grid, "SELECT strftime(d, '%Y%m%d') AS day, symbol, kind, market FROM (SELECT unnest(generate_series(DATE '2024-01-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS d), (SELECT unnest(['BTCUSDT', 'ETHUSDT']) AS symbol), (SELECT unnest(['aggTrades', 'bookTicker']) AS kind), (SELECT unnest(['um', 'spot']) AS market)"),
    "dedupe_keep_last": (dedupe_keep_last, f"WITH {C} SELECT venue, timestamp, side, price, quantity, arrival FROM tape WHERE side IN (0, 1) QUALIFY row_number() OVER (PARTITION BY venue, timestamp ORDER BY arrival DESC) = 1"),
    "last_per_second_join": (last_per_second_join, f"WITH {C}, d AS (SELECT venue, timestamp // 1000 AS second, price FROM tape WHERE side IN (0, 1) QUALIFY row_number() OVER (PARTITION BY venue, timestamp // 1000 ORDER BY arrival DESC) = 1), v AS (SELECT venue, timestamp // 1000 AS second, sum(CASE WHEN quantity >= 0 THEN quantity ELSE 0.0 END) AS b, sum(CASE WHEN quantity < 0 THEN -quantity ELSE 0.0 END) AS s, sum(abs(quantity)) AS size FROM tape WHERE side = 2 GROUP BY ALL) SELECT venue, second, price, (round(coalesce(b, 0.0), 6) + 0.0) AS taker_buy_vol, (round(coalesce(s, 0.0), 6) + 0.0) AS taker_sell_vol, (round(size, 6) + 0.0) AS size FROM d LEFT JOIN v USING (venue, second)"),
    "shard_completeness": (shard_completeness, f"WITH {T}, g AS (SELECT venue, timestamp - lag(timestamp) OVER (PARTITION BY venue ORDER BY timestamp) AS s FROM tape WHERE side = 2), p AS (SELECT venue, count(*) AS found, list_sort(list(s) FILTER (s IS NOT NULL)) AS l FROM g GROUP BY venue), m AS (SELECT venue, found, l[len(l) // 2 + 1] AS median_ms FROM p) SELECT *, 86400000 // median_ms AS expected, (round(100.0 * found / (86400000 // median_ms), 2) + 0.0) AS completion_pct FROM m"),
    "normalise_epoch": (normalise_epoch, f"WITH {T} SELECT 's' AS unit, arrival, CAST(floor(timestamp * 0.001::DOUBLE) AS BIGINT) * 1000 AS ms FROM tape UNION ALL SELECT 'ms', arrival, timestamp FROM tape UNION ALL SELECT 'us', arrival, timestamp FROM tape"),
    "symbol_normalise": (symbol_normalise, "SELECT * FROM (VALUES ('btcusdt', 'BTC_USDT', 'btcusdt', 'btc_usdt'), ('BTC-JPY', 'BTC_JPY', 'btcjpy', 'btc_jpy'), ('eth_jpy', 'ETH_JPY', 'ethjpy', 'eth_jpy'), ('XRPBTC', 'XRP_BTC', 'xrpbtc', 'xrp_btc'), ('SOLUSDC', 'SOL_USDC', 'solusdc', 'sol_usdc')) AS t(native, std, binance, bitbank)"),
    "trade_label": (trade_label, f"WITH {T} SELECT arrival, quantity < 0 AS is_buyer_maker, CASE WHEN quantity < 0 THEN 'SELL' ELSE 'BUY' END AS label, abs(quantity) AS size FROM tape WHERE side = 2"),
    "union_tapes": (union_tapes, f"WITH {T} SELECT venue, count(*) AS n FROM tape WHERE side IN (0, 1, 2) GROUP BY venue"),
    "human_sizes": (human_sizes, f"SELECT o_orderkey, {SIZE_SQL} AS size FROM (SELECT o_orderkey, o_orderkey * 4099 * 7 AS b FROM orders)"),
}
