"""Registered reconciliation, diagnostics, simulation-accounting and model queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import book, recon
from tickloom.operators import windows as win
from tickloom.plans.book_plans import BY, TOP1, levels_sql, tape, trades
from tickloom.plans.window_plans import FWD, TRADES, trade_rows
from tickloom.session import table
from tickloom.sources.driver_tables import HOUR, tape_from_events, tape_sql

BLACK = [("20240103", "cc", "*"), ("20240105", "*", "*"), ("20240110", "bj", "SIDE2")]
EDGES = [60_000, 600_000, 3_600_000, 14_400_000]


def blacklist_antijoin(spark, sf_dir):
    t = tape_from_events(spark, sf_dir).withColumn("day", F.date_format(F.timestamp_millis("timestamp"), "yyyyMMdd")).withColumn("symbol", F.concat(F.lit("SIDE"), F.col("side").cast("string")))
    b = spark.createDataFrame(BLACK, "day string, exchange string, symbol string")
    return recon.blacklisted(t, b, "day", "venue", "symbol").groupBy("venue", "day").agg(F.count("*").alias("n"))


def official_reconcile(spark, sf_dir):
    t = tape_from_events(spark, sf_dir).where("side = 2")
    r = recon.reconcile(t.where("k % 50 <> 0"), t, ["venue"], "quantity", "quantity")
    return r.select("venue", "n_local", "n_official", "n_diff_pct", "vol_diff_pct")


def ts_sets(spark, sf_dir):
    t = tape_from_events(spark, sf_dir, True)
    return t.where("venue = 'cc' AND side = 2").select("timestamp"), t.where("venue = 'um' AND side = 2").select("timestamp")


def ts_intersect(spark, sf_dir):
    a, b = ts_sets(spark, sf_dir)
    return a.intersect(b)


def ts_except(spark, sf_dir):
    a, b = ts_sets(spark, sf_dir)
    return a.subtract(b).withColumn("only", F.lit("cc")).unionByName(b.subtract(a).withColumn("only", F.lit("um")))


def ts_semi(spark, sf_dir):
    a, b = ts_sets(spark, sf_dir)
    return a.join(b.distinct(), "timestamp", "left_semi").groupBy("timestamp").agg(F.count("*").alias("n"))


def pool_match(spark, sf_dir):
    t = tape_from_events(spark, sf_dir, True).where("side = 2")
    a = t.where("venue = 'cc'").select("timestamp", "price", F.col("arrival").alias("cc_arrival"))
    b = t.where("venue = 'bj'").select("timestamp", "price", F.col("arrival").alias("bj_arrival"))
    return recon.pool_match(a, b, ["timestamp", "price"], "cc_arrival", "bj_arrival")


def dup_ts_stats(spark, sf_dir):
    return recon.duplicate_stats(tape_from_events(spark, sf_dir, True), BY, "timestamp")


def forward_rows(spark, sf_dir):
    t = trade_rows(spark, sf_dir).withColumn("gap_ms", win.gap_to_next(BY))
    f = win.forward_return(t.select("venue", "timestamp", "seq", "price", "gap_ms"), BY, HOUR)
    return f.where("fwd_bps IS NOT NULL").withColumn("fwd_bps", S.rounded("fwd_bps", 6))


def quantile_summary(spark, sf_dir):
    q = recon.quantile_summary(forward_rows(spark, sf_dir), BY, "fwd_bps")
    return q.select("venue", "n", *[S.rounded(c, 4).alias(c) for c in ("mean", "pos_pct", "p1", "p99", "tail_ratio")])


def gap_bucket_stats(spark, sf_dir):
    f = forward_rows(spark, sf_dir).where("gap_ms IS NOT NULL").withColumn("bucket", recon.gap_bucket(F.col("gap_ms"), EDGES))
    b = recon.bucket_stats(f, "bucket", "gap_ms", "fwd_bps")
    return b.select("bucket", "n", S.rounded("median_gap", 3).alias("median_gap"), S.rounded("median_value", 4).alias("median_value"), S.rounded("mean_value", 4).alias("mean_value"), S.rounded("std_value", 4).alias("std_value"), S.rounded("share", 6).alias("share"))


TOPS = ("imbalance", "spread_bps", "microprice")


def bucket_feature_means(spark, sf_dir):
    """Means of what the book shows at trades, and shares of time and of samples, by the gap to the next trade."""
    t = tape(spark, sf_dir)
    top = book.top1(trades(t), book.intervals(t, BY), BY).withColumn("gap_ms", win.gap_to_next(BY)).where("gap_ms IS NOT NULL")
    m = recon.bucket_means(top.withColumn("bucket", recon.gap_bucket(F.col("gap_ms"), EDGES)), "bucket", "gap_ms", list(TOPS))
    return m.select("bucket", "n", *[S.rounded(c, 6).alias(c) for c in ("sample_share", "time_share", "ratio", *(f"{c}_mean" for c in TOPS))])


def time_weighted_mean(spark, sf_dir):
    f = forward_rows(spark, sf_dir).where("gap_ms IS NOT NULL")
    w = recon.time_weighted(f, BY, "gap_ms", "fwd_bps")
    return w.select("venue", *[S.rounded(c, 4).alias(c) for c in ("weighted", "plain", "weight")])


def index_percentiles(spark, sf_dir):
    return recon.index_percentiles(tape_from_events(spark, sf_dir).select("venue", "quantity"), BY, "quantity")


def fills_of(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 10).alias("session"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))


def pnl_from_fills(spark, sf_dir):
    f = fills_of(spark, sf_dir)
    mid = f.groupBy("session").agg(F.max("price").alias("last_mid"))
    p = recon.pnl(f, ["session"], mid)
    return p.select("session", "n_fills", S.rounded("cash", 2).alias("cash"), S.rounded("inventory", 2).alias("inventory"), S.rounded("notional", 2).alias("notional"), S.rounded("pnl", 2).alias("pnl"), S.rounded("edge_bps", 4).alias("edge_bps"))


def daily_performance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 1000 - 300).alias("pnl"))
    p = recon.daily_performance(o, ["o_orderstatus"], "pnl")
    return p.select("o_orderstatus", "n_days", *[S.rounded(c, 4).alias(c) for c in ("mean", "std", "win_rate", "sharpe")])


def ohlc_resample(spark, sf_dir):
    o = recon.ohlc(tape(spark, sf_dir).where("side = 2"), BY, 6 * HOUR)
    d = recon.dense(o, BY, 6 * HOUR)
    return d.withColumn("volume", S.rounded("volume", 6))


def merge_tagged_stream(spark, sf_dir):
    """Market rows, placements and cancellations on one line by ns, then kind, then arrival."""
    t = tape_from_events(spark, sf_dir, True).select("venue", (F.col("timestamp") * 1_000_000).alias("ts_ns"), "arrival", "side")
    return recon.tagged_merge({"L2": t.where("side IN (0, 1, 3, 4)"), "PLACE": t.where("side = 2"), "CANCEL": t.where("side = 2 AND arrival % 3 = 0")}, BY).select("venue", "line", "ts_ns", "kind", "arrival")


def kway_merge(spark, sf_dir):
    from pyspark.sql import Window as W

    from tickloom.sources.tape import merged

    t = tape_from_events(spark, sf_dir, True)
    w = W.partitionBy(F.floor(F.col("timestamp") / 86_400_000)).orderBy(*merged(t, F.col("venue"), ["arrival"]))
    return t.select("arrival", F.floor(F.col("timestamp") / 86_400_000).cast("long").alias("day"), F.row_number().over(w).cast("long").alias("line"))


def venue_anchor(spark, sf_dir):
    """The latest of the venues' first times, and the skew between them."""
    per = tape_from_events(spark, sf_dir).groupBy("venue").agg(F.min("timestamp").alias("first"))
    return per.agg(F.max("first").alias("anchor"), ((F.max("first") - F.min("first")) > HOUR).alias("skewed"))


def linear_model_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = [F.col("embedding")[i].cast("double") for i in range(64)]
    score = S.linear_score(x, [0.01 * i for i in range(64)], [0.1 * (i - 3) for i in range(64)], 0.002)
    return e.select("vec_id", S.rounded(score, 6).alias("alpha_bps"), (F.abs(S.rounded(score, 6)) >= 500.0).alias("signals"))


def quote_price(spark, sf_dir):
    t = tape(spark, sf_dir)
    top = book.top1(trades(t), book.intervals(t, BY), BY)
    side = F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL")
    return top.select("venue", "seq", side.alias("side"), S.quote_price(side, F.col("best_bid"), F.col("best_ask"), F.lit(0.5), F.lit("improve_1_tick")).alias("improved"), S.quote_price(side, F.col("best_bid"), F.col("best_ask"), F.lit(0.5), F.lit("join_back")).alias("joined"))


def spec_validate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.coalesce(S.order_fault(F.col("l_extendedprice"), F.col("l_quantity") - 1, F.lit(0.25), F.lit(2.0), F.lit(20000.0)), F.lit("OK")).alias("fault"), S.round_price(F.col("l_extendedprice"), F.lit(0.25), F.col("l_linestatus").isin("O").cast("string")).alias("sell_price"), S.round_price(F.col("l_extendedprice"), F.lit(0.25), F.lit("buy")).alias("buy_price"), S.round_qty(F.col("l_quantity"), F.lit(2.0)).alias("qty"))


def spec_lookup(spark, sf_dir):
    o = tape_from_events(spark, sf_dir).select("venue", F.concat(F.lit("S"), F.col("side").cast("string")).alias("symbol")).distinct()
    v = spark.createDataFrame([("cc", "S2", 1.0, 0.001, 500.0), ("bj", "S0", 0.1, 0.01, 0.0)], "venue string, symbol string, tick double, lot double, least double")
    d = spark.createDataFrame([("S2", 0.5, 0.1, 5.0), ("S1", 0.25, 0.1, 0.0)], "symbol string, tick double, lot double, least double")
    return recon.spec_of(o, v, d)


def adverse_horizons(spark, sf_dir):
    """Trades as fills: their mid, and the mid just before 1, 5 and 30 hours later, as mean adverse bps."""
    t = tape(spark, sf_dir)
    top = book.top1(trades(t), book.intervals(t, BY), BY).select("venue", "timestamp", "seq", "mid")
    fills = top.select("venue", F.when(F.col("seq") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("mid").alias("mid_at_fill"), F.col("timestamp").alias("at0"))
    offsets = F.explode(F.array(*[F.lit(h) for h in (1, 5, 30)]))
    probes = fills.withColumn("hours", offsets).withColumn("at", F.col("at0") + F.col("hours") * HOUR)
    got = win.probe_as_of(probes, top, BY, "at", "mid", before_equal=True).withColumnRenamed("mid", "mid_later")
    return recon.adverse_selection(got, ["hours"]).withColumn("adverse_bps", S.rounded("adverse_bps", 4))


def session_verdict(spark, sf_dir):
    p = pnl_from_fills(spark, sf_dir)
    issues = [F.col("n_fills") < 6100, F.col("pnl") < 0, F.col("edge_bps") > 15000]
    n = reduce(lambda a, b: a + b, [i.cast("int") for i in issues])
    return p.select("session", n.alias("issues"), recon.verdict(n).alias("verdict"))


def replay_segments(spark, sf_dir):
    """Rows fed to each day-long segment: its own and a day of warm-up."""
    t = tape(spark, sf_dir)
    bounds = t.groupBy("venue").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    fed = recon.feed_segments(t, bounds, BY, 24 * HOUR, 24 * HOUR)
    n = fed.groupBy("venue", "segment").agg(F.count("*").alias("n_fed"), F.count_if("emits").alias("n_emit"))
    seg = recon.segments(bounds, BY, 24 * HOUR)
    return seg.join(n, ["venue", "segment"])


T, C = tape_sql(), tape_sql(True)
FROWS = f"WITH {T}{TRADES}, g AS (SELECT *, lead(timestamp) OVER (PARTITION BY venue ORDER BY seq) - timestamp AS gap_ms FROM t), f AS (SELECT venue, timestamp, seq, gap_ms, (round(ln({FWD.format(pick='arg_min(price, seq)', h=HOUR)} / price) * 10000.0, 6) + 0.0) AS fwd_bps FROM g a), r AS (SELECT * FROM f WHERE fwd_bps IS NOT NULL)"
FILLS = "WITH f AS (SELECT l_suppkey % 10 AS session, CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, l_extendedprice AS price, l_quantity AS qty FROM lineitem), p AS (SELECT session, count(*) AS n_fills, sum(-sg * price * qty) AS cash, sum(sg * qty) AS inventory, sum(abs(price * qty)) AS notional, max(price) AS last_mid FROM f GROUP BY session), q AS (SELECT *, cash + inventory * last_mid AS pnl FROM p), s AS (SELECT session, n_fills, (round(cash, 2) + 0.0) AS cash, (round(inventory, 2) + 0.0) AS inventory, (round(notional, 2) + 0.0) AS notional, (round(pnl, 2) + 0.0) AS pnl, (round(pnl / notional * 1e4, 4) + 0.0) AS edge_bps FROM q)"
PICK = "quantity > 0"
ALL = {
    "blacklist_antijoin": (blacklist_antijoin, f"WITH {T}, d AS (SELECT *, strftime(make_timestamp(timestamp * 1000), '%Y%m%d') AS day FROM tape) SELECT venue, day, count(*) AS n FROM d WHERE NOT ((day = '20240103' AND venue = 'cc') OR day = '20240105' OR (day = '20240110' AND venue = 'bj' AND side = 2)) GROUP BY venue, day"),
    "official_reconcile": (official_reconcile, f"WITH {T}, a AS (SELECT venue, count(*) AS n_official, sum(abs(quantity)) AS vo, count(*) FILTER (k % 50 <> 0) AS n_local, sum(abs(quantity)) FILTER (k % 50 <> 0) AS vl FROM tape WHERE side = 2 GROUP BY venue) SELECT venue, n_local, n_official, (round(100.0 * (n_local - n_official) / n_official, 4) + 0.0) AS n_diff_pct, (round(100.0 * (vl - vo) / vo, 4) + 0.0) AS vol_diff_pct FROM a"),
    "ts_intersect": (ts_intersect, f"WITH {C} SELECT timestamp FROM tape WHERE venue = 'cc' AND side = 2 INTERSECT SELECT timestamp FROM tape WHERE venue = 'um' AND side = 2"),
    "ts_except": (ts_except, f"WITH {C}, a AS (SELECT DISTINCT timestamp FROM tape WHERE venue = 'cc' AND side = 2), b AS (SELECT DISTINCT timestamp FROM tape WHERE venue = 'um' AND side = 2) SELECT timestamp, 'cc' AS only FROM a WHERE timestamp NOT IN (SELECT timestamp FROM b) UNION ALL SELECT timestamp, 'um' FROM b WHERE timestamp NOT IN (SELECT timestamp FROM a)"),
    "ts_semi": (ts_semi, f"WITH {C} SELECT timestamp, count(*) AS n FROM tape WHERE venue = 'cc' AND side = 2 AND timestamp IN (SELECT timestamp FROM tape WHERE venue = 'um' AND side = 2) GROUP BY timestamp"),
    "pool_match": (pool_match, f"WITH {C}, n AS (SELECT *, row_number() OVER (PARTITION BY venue, timestamp, price ORDER BY arrival) AS i FROM tape WHERE side = 2) SELECT a.timestamp, a.price, a.arrival AS cc_arrival, b.arrival AS bj_arrival FROM n a JOIN n b ON a.venue = 'cc' AND b.venue = 'bj' AND a.timestamp = b.timestamp AND a.price = b.price AND a.i = b.i"),
    "dup_ts_stats": (dup_ts_stats, f"WITH {C}, p AS (SELECT venue, timestamp, count(*) AS n FROM tape GROUP BY ALL) SELECT venue, count(*) AS n_ts, count(*) FILTER (n > 1) AS n_dup_ts, max(n) AS max_dup FROM p GROUP BY venue"),
    "quantile_summary": (quantile_summary, FROWS + " SELECT venue, count(*) AS n, (round(avg(fwd_bps), 4) + 0.0) AS mean, (round(100.0 * avg(CASE WHEN fwd_bps > 0 THEN 1 ELSE 0 END), 4) + 0.0) AS pos_pct, (round(quantile_cont(fwd_bps, 0.01), 4) + 0.0) AS p1, (round(quantile_cont(fwd_bps, 0.99), 4) + 0.0) AS p99, (round(abs(quantile_cont(fwd_bps, 0.01)) / greatest(quantile_cont(fwd_bps, 0.99), 1e-9), 4) + 0.0) AS tail_ratio FROM r GROUP BY venue"),
    "gap_bucket_stats": (gap_bucket_stats, FROWS + f", b AS (SELECT *, CASE WHEN gap_ms < {EDGES[0]} THEN 0 WHEN gap_ms < {EDGES[1]} THEN 1 WHEN gap_ms < {EDGES[2]} THEN 2 WHEN gap_ms < {EDGES[3]} THEN 3 ELSE 4 END AS bucket FROM r WHERE gap_ms IS NOT NULL) SELECT bucket, count(*) AS n, (round(median(gap_ms), 3) + 0.0) AS median_gap, (round(median(fwd_bps), 4) + 0.0) AS median_value, (round(avg(fwd_bps), 4) + 0.0) AS mean_value, (round(stddev_pop(fwd_bps), 4) + 0.0) AS std_value, (round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) + 0.0) AS share FROM b GROUP BY bucket"),
    "bucket_feature_means": (bucket_feature_means, levels_sql() + TOP1 + f", r AS (SELECT *, lead(timestamp) OVER (PARTITION BY venue ORDER BY seq) - timestamp AS gap_ms FROM top), b AS (SELECT *, CASE WHEN gap_ms < {EDGES[0]} THEN 0 WHEN gap_ms < {EDGES[1]} THEN 1 WHEN gap_ms < {EDGES[2]} THEN 2 WHEN gap_ms < {EDGES[3]} THEN 3 ELSE 4 END AS bucket FROM r WHERE gap_ms IS NOT NULL), a AS (SELECT count(*) AS all_n, sum(gap_ms)::DOUBLE AS all_ms FROM b) SELECT bucket, count(*) AS n, (round(count(*) / any_value(all_n)::DOUBLE, 6) + 0.0) AS sample_share, (round(sum(gap_ms) / any_value(all_ms), 6) + 0.0) AS time_share, (round(sum(gap_ms) / any_value(all_ms) / (count(*) / any_value(all_n)::DOUBLE), 6) + 0.0) AS ratio, " + ", ".join(f"(round(avg({c}), 6) + 0.0) AS {c}_mean" for c in TOPS) + " FROM b, a GROUP BY bucket"),
    "time_weighted_mean": (time_weighted_mean, FROWS + ", w AS (SELECT *, greatest(0.001, least(10.0, gap_ms / 1000.0)) AS w FROM r WHERE gap_ms IS NOT NULL) SELECT venue, (round(sum(w * fwd_bps) / sum(w), 4) + 0.0) AS weighted, (round(avg(fwd_bps), 4) + 0.0) AS plain, (round(sum(w), 4) + 0.0) AS weight FROM w GROUP BY venue"),
    "index_percentiles": (index_percentiles, f"WITH {T}, o AS (SELECT venue, quantity, row_number() OVER (PARTITION BY venue ORDER BY quantity) - 1 AS i, count(*) OVER (PARTITION BY venue) AS n FROM tape WHERE {PICK}) SELECT venue, max(n) AS n, max(quantity) FILTER (i = floor(n * 0.5)) AS p50, max(quantity) FILTER (i = floor(n * 0.95)) AS p95, CASE WHEN max(n) > 100 THEN max(quantity) FILTER (i = floor(n * 0.99)) ELSE max(quantity) FILTER (i = floor(n * 0.95)) END AS p99 FROM o GROUP BY venue"),
    "pnl_from_fills": (pnl_from_fills, FILLS + " SELECT * FROM s"),
    "daily_performance": (daily_performance, "WITH d AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) / 1000 - 300 AS pnl FROM orders GROUP BY ALL) SELECT o_orderstatus, count(*) AS n_days, (round(avg(pnl), 4) + 0.0) AS mean, (round(stddev_samp(pnl), 4) + 0.0) AS std, (round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 4) + 0.0) AS win_rate, (round(avg(pnl) / stddev_samp(pnl) * sqrt(365.0), 4) + 0.0) AS sharpe FROM d GROUP BY o_orderstatus"),
    "ohlc_resample": (ohlc_resample, f"WITH {T}, c AS (SELECT venue, timestamp // {6 * HOUR} * {6 * HOUR} AS cell, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, (round(sum(abs(quantity)), 6) + 0.0) AS volume, count(*) AS n FROM tape WHERE side = 2 GROUP BY ALL), s AS (SELECT venue, unnest(range(min(cell), max(cell) + 1, {6 * HOUR})) AS cell FROM c GROUP BY venue) SELECT s.venue, s.cell, open, high, low, close, volume, n FROM s LEFT JOIN c USING (venue, cell)"),
    "merge_tagged_stream": (merge_tagged_stream, f"WITH {C}, u AS (SELECT venue, timestamp * 1000000 AS ts_ns, arrival, 'L2' AS kind, 0 AS r FROM tape WHERE side <> 2 UNION ALL SELECT venue, timestamp * 1000000, arrival, 'PLACE', 1 FROM tape WHERE side = 2 UNION ALL SELECT venue, timestamp * 1000000, arrival, 'CANCEL', 2 FROM tape WHERE side = 2 AND arrival % 3 = 0) SELECT venue, row_number() OVER (PARTITION BY venue ORDER BY ts_ns, r, arrival) AS line, ts_ns, kind, arrival FROM u"),
    "kway_merge": (kway_merge, f"WITH {C} SELECT arrival, timestamp // 86400000 AS day, row_number() OVER (PARTITION BY timestamp // 86400000 ORDER BY timestamp, side DESC, venue, arrival) AS line FROM tape"),
    "venue_anchor": (venue_anchor, f"WITH {T}, p AS (SELECT venue, min(timestamp) AS first FROM tape GROUP BY venue) SELECT max(first) AS anchor, max(first) - min(first) > {HOUR} AS skewed FROM p"),
    "linear_model_score": (linear_model_score, "WITH s AS (SELECT vec_id, (round((0.002::DOUBLE + " + " + ".join(f"(embedding[{i + 1}]::DOUBLE - {0.01 * i!r}::DOUBLE) * {0.1 * (i - 3)!r}::DOUBLE" for i in range(64)) + ") * 1e4, 6) + 0.0) AS alpha_bps FROM embeddings) SELECT *, abs(alpha_bps) >= 500.0 AS signals FROM s"),
    "quote_price": (quote_price, levels_sql() + TOP1 + " SELECT venue, seq, CASE WHEN seq % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN seq % 2 = 0 THEN (CASE WHEN best_bid + 0.5 < best_ask THEN best_bid + 0.5 ELSE best_bid END) ELSE (CASE WHEN best_ask - 0.5 > best_bid THEN best_ask - 0.5 ELSE best_ask END) END AS improved, CASE WHEN seq % 2 = 0 THEN best_bid ELSE best_ask END AS joined FROM top"),
    "spec_validate": (spec_validate, "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 1 <= 0 THEN 'QTY' WHEN l_extendedprice <= 0 THEN 'PRICE' WHEN abs(l_extendedprice / 0.25 - round_even(l_extendedprice / 0.25, 0)) > 1e-7 THEN 'TICK' WHEN abs((l_quantity - 1) / 2.0 - round_even((l_quantity - 1) / 2.0, 0)) > 1e-7 THEN 'LOT' WHEN l_extendedprice * (l_quantity - 1) < 20000.0 - 1e-7 THEN 'NOTIONAL' ELSE 'OK' END AS fault, ceil(l_extendedprice / 0.25) * 0.25::DOUBLE AS sell_price, floor(l_extendedprice / 0.25) * 0.25::DOUBLE AS buy_price, floor(l_quantity / 2.0) * 2.0::DOUBLE AS qty FROM lineitem"),
    "spec_lookup": (spec_lookup, f"WITH {T}, o AS (SELECT DISTINCT venue, 'S' || side AS symbol FROM tape), v(venue, symbol, tick, lot, least) AS (VALUES ('cc', 'S2', 1.0::DOUBLE, 0.001::DOUBLE, 500.0::DOUBLE), ('bj', 'S0', 0.1, 0.01, 0.0)), d(symbol, tick, lot, least) AS (VALUES ('S2', 0.5::DOUBLE, 0.1::DOUBLE, 5.0::DOUBLE), ('S1', 0.25, 0.1, 0.0)) SELECT o.venue, o.symbol, coalesce(v.tick, d.tick, 1e-8) AS tick, coalesce(v.lot, d.lot, 1e-8) AS lot, coalesce(v.least, d.least, 0.0) AS least FROM o LEFT JOIN v USING (venue, symbol) LEFT JOIN d ON d.symbol = o.symbol"),
    "adverse_horizons": (adverse_horizons, levels_sql() + TOP1 + f", p AS (SELECT venue, seq, timestamp, mid, unnest([1, 5, 30]) AS hours FROM top), g AS (SELECT hours, CASE WHEN seq % 2 = 0 THEN 1.0 ELSE -1.0 END AS sg, mid, (SELECT arg_max(b.mid, b.seq) FROM top b WHERE b.venue = p.venue AND b.timestamp < p.timestamp + p.hours * {HOUR}) AS later FROM p) SELECT hours, count(later) AS n, (round(avg(-ln(later / mid) * sg * 10000.0), 4) + 0.0) AS adverse_bps FROM g GROUP BY hours"),
    "session_verdict": (session_verdict, FILLS + ", i AS (SELECT session, CAST(n_fills < 6100 AS INTEGER) + CAST(pnl < 0 AS INTEGER) + CAST(edge_bps > 15000 AS INTEGER) AS issues FROM s) SELECT session, issues, CASE WHEN issues = 0 THEN 'HEALTHY' WHEN issues <= 2 THEN 'ACCEPT_WITH_TUNING' ELSE 'UNHEALTHY' END AS verdict FROM i"),
    "replay_segments": (replay_segments, f"WITH {T}, b AS (SELECT venue, min(timestamp) AS f, max(timestamp) AS l FROM tape GROUP BY venue), s AS (SELECT venue, f, l, unnest(range(0, (l - f) // {24 * HOUR} + 1)) AS segment FROM b), e AS (SELECT venue, segment, f + segment * {24 * HOUR} AS seg_start, least(f + (segment + 1) * {24 * HOUR}, l + 1) AS seg_end FROM s) SELECT e.venue, CAST(e.segment AS INTEGER) AS segment, seg_start, seg_end, count(*) AS n_fed, count(*) FILTER (t.timestamp >= seg_start) AS n_emit FROM e JOIN tape t ON t.venue = e.venue AND t.timestamp >= seg_start - {24 * HOUR} AND t.timestamp < seg_end GROUP BY ALL"),
}
