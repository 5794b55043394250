"""Registered queries over the path-dependent operators. Where the declarative form is equivalent, its SQL is the
oracle; the rest is held against worked cases in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import kernels as K
from tickloom.operators import recon
from tickloom.operators import windows as win
from tickloom.plans.book_plans import BY, TOP1, levels_sql, tape
from tickloom.plans.window_plans import segmented
from tickloom.sources.driver_tables import HOUR, tape_from_events, tape_sql


def crossed_tape(spark, sf_dir):
    """The tape with asks two lower, so that the book crosses."""
    return tape(spark, sf_dir).withColumn("price", F.when(F.col("side").isin(1, 4), F.col("price") - 2.0).otherwise(F.col("price")))


def book_kernel_top1(spark, sf_dir):
    return K.top_at_trades(tape(spark, sf_dir), BY, threshold=1).drop("age_ms")


def book_resolved_top(spark, sf_dir):
    return K.top_at_trades(crossed_tape(spark, sf_dir), BY, prune=True, stale_ms=6 * HOUR)


def throttle(spark, sf_dir):
    t = tape(spark, sf_dir).where("side IN (0, 1, 3, 4)")
    return K.throttled(t, BY, 6 * HOUR).select("venue", "timestamp")


def book_metrics_throttled(spark, sf_dir):
    m = K.book_metrics(tape(spark, sf_dir), BY, ms=2 * HOUR)
    return m.select("venue", "timestamp", "seq", *[S.rounded(c, 6).alias(c) for c in ("top1_imb", "topn_imb", "micro_dev_bps")])


def book_metric_means(spark, sf_dir):
    """Trailing means over 12 hours of the throttled book metrics, at every sample."""
    m = K.book_metrics(tape(spark, sf_dir), BY, ms=2 * HOUR)
    return m.select("venue", "timestamp", "seq", *[S.rounded(win.trailing_mean(F.col(c), BY, 12 * HOUR), 6).alias(f"{c}_mean") for c in ("top1_imb", "topn_imb", "micro_dev_bps")])


def simulated_lines(spark, sf_dir):
    """The tape as market rows, with a placement at every fifth trade and its cancellation an hour later."""
    t = tape(spark, sf_dir)
    ns = (F.col("timestamp") * 1_000_000).alias("ts_ns")
    market = t.select("venue", ns, "arrival", F.col("side").alias("tape_side"), "price", "quantity")
    oid = F.concat(F.lit("o"), F.col("arrival").cast("string")).alias("client_oid")
    at = t.where("side = 2 AND arrival % 5 = 0")
    place = at.select("venue", ns, "arrival", oid, F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("order_side"), F.when(F.col("k") % 2 == 0, 99.5).otherwise(101.5).cast("double").alias("price"), F.lit(1.0).alias("quantity"), F.lit(0.5).alias("alpha"))
    stop = at.select("venue", (F.col("timestamp") * 1_000_000 + HOUR * 1_000_000).alias("ts_ns"), "arrival", oid, F.lit("TTL").alias("reason"))
    lines = recon.tagged_merge({"L2": market, "PLACE": place, "CANCEL": stop}, BY)
    return lines


def session_replay(spark, sf_dir):
    return K.replay(simulated_lines(spark, sf_dir), BY, tick=0.5, cancel_ms=100.0)


def maker_backtest(spark, sf_dir):
    """cc's trades score the bj and cc flow; one passive quote at a time. All days are one session: the book, the open
    quote, inventory and cash go from day to day, and there is one warm-up. Only the flow is computed in segments."""
    m = segmented(tape(spark, sf_dir)).withColumn("seq", F.col("line"))
    is_t = lambda v: (F.col("venue") == v) & (F.col("side") == 2)
    flow = win.flow(F.when(is_t("bj"), S.taker_buy(F.col("quantity"))).otherwise(0.0), F.when(is_t("bj"), S.taker_sell(F.col("quantity"))).otherwise(0.0), ["segment"], 6 * HOUR)
    alpha = F.when(is_t("cc"), S.rounded(flow, 6) / 20.0)
    rows = m.withColumn("alpha", alpha).where("emits").withColumn("own", F.col("venue") == "cc").withColumn("session", F.lit("s"))
    rows = rows.withColumn("line", F.col("segment").cast("long") * (1 << 40) + F.col("line"))
    return K.backtest(rows, ["session"], 0.1, 1.0, 4 * HOUR, HOUR, "improve_1_tick", tick=0.5, cancel_ms=50.0)


def maker_backtest_report(spark, sf_dir):
    return K.backtest_report(maker_backtest(spark, sf_dir), ["session"])


def fill_matching(spark, sf_dir):
    """Trades as real fills against the same with a shift and half of the client ids changed."""
    t = tape_from_events(spark, sf_dir).where("side = 2")
    day = F.floor(F.col("timestamp") / 86_400_000).cast("long").alias("day")
    cols = lambda src, shift, oid: t.select("venue", day, F.lit(src).alias("source"), (F.col("timestamp") * 1_000_000 + shift).alias("ts_ns"), oid.alias("client_oid"), F.when(F.col("quantity") < 0, "SELL").otherwise("BUY").alias("side"), "price")
    name = F.concat(F.lit("o"), F.col("arrival").cast("string"))
    both = cols("real", F.lit(0), name).unionByName(cols("sim", F.lit(700_000_000), F.when(F.col("arrival") % 2 == 0, name).otherwise("x")))
    return K.match_fills(both, ["venue", "day"], 2000.0)


FM = f"WITH {tape_sql()} SELECT venue, timestamp // 86400000 AS day, timestamp * 1000000 AS ts_ns, 'o' || arrival AS client_oid, timestamp * 1000000 + 700000000 AS sim_ts_ns FROM tape WHERE side = 2"
ALL = {
    "book_kernel_top1": (book_kernel_top1, levels_sql() + TOP1 + " SELECT venue, timestamp, seq, best_bid, bid_qty, best_ask, ask_qty FROM top"),
    "book_resolved_top": (book_resolved_top, None),
    "throttle": (throttle, f"WITH RECURSIVE {tape_sql()}, b AS (SELECT venue, timestamp FROM tape WHERE side <> 2), acc AS (SELECT venue, min(timestamp) AS timestamp FROM b GROUP BY venue UNION ALL SELECT a.venue, (SELECT min(b.timestamp) FROM b WHERE b.venue = a.venue AND b.timestamp >= a.timestamp + {6 * HOUR}) FROM acc a WHERE a.timestamp IS NOT NULL) SELECT venue, timestamp FROM acc WHERE timestamp IS NOT NULL"),
    "book_metrics_throttled": (book_metrics_throttled, None),
    "book_metric_means": (book_metric_means, None),
    "session_replay": (session_replay, None),
    "maker_backtest": (maker_backtest, None),
    "maker_backtest_report": (maker_backtest_report, None),
    "fill_matching": (fill_matching, FM),
}
