"""Registered queries for sampling, flattened reports and small operational scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import book, quality
from tickloom.operators import windows as win
from tickloom.plans.book_plans import BY, TOP1, levels_sql, tape, trades
from tickloom.plans.quality_plans import FRESH_SQL, GAP, STREAM_SQL, freshness
from tickloom.plans.window_plans import TRADES, trade_rows
from tickloom.session import table
from tickloom.sources.driver_tables import HOUR, tape_from_events, tape_sql

#: Containers that are named by table; any other name is split at its dashes.
CONTAINERS = [("rec-cc", "cc", "spot"), ("rec-um", "um", "futures")]


def sample(tape_rows, mode: str, by: list[str]):
    """Rows to sample at by the name of a mode: `1s_grid`, `<n>ms_grid`, `event_at_book_update`, `event_at_<venue>_trade`."""
    if mode == "1s_grid":
        return book.grid_samples(tape_rows, by, 1000)
    if mode.endswith("ms_grid"):
        return book.grid_samples(tape_rows, by, int(mode.removesuffix("ms_grid")))
    if mode == "event_at_book_update":
        return book.event_samples(tape_rows, [0, 1])
    if mode.startswith("event_at_") and mode.endswith("_trade"):
        return book.event_samples(tape_rows, [2])
    raise ValueError(f"unknown sampling mode {mode!r}")


def simulated_fill_samples(spark, sf_dir):
    """A passive quote per trade: best prices, spread, mid, and the side that the trade would have filled (1 buy)."""
    t = tape(spark, sf_dir)
    at = t.where("side = 2").select("venue", "timestamp", "seq", "price", "quantity")
    top = book.top1(at, book.intervals(t, BY), BY)
    return top.select("venue", "timestamp", "seq", "price", F.col("best_bid").alias("best_bid_p"), F.col("best_ask").alias("best_ask_p"), F.col("spread").alias("spread_p"), F.when(F.col("quantity") < 0, 1).otherwise(2).cast("byte").alias("quote_side"), F.col("mid").alias("mid_t"))


def sampling_modes(spark, sf_dir):
    t = tape(spark, sf_dir)
    out = None
    for mode in (f"{6 * HOUR}ms_grid", "1s_grid", "event_at_book_update", "event_at_cc_trade"):
        n = sample(t, mode, BY).groupBy("venue").agg(F.count("*").alias("n"), F.min("timestamp").alias("first")).withColumn("mode", F.lit(mode))
        out = n if out is None else out.unionByName(n)
    return out


def forward_asof_own(spark, sf_dir):
    """The first price at or after t + h on the series itself; for h > 0 no row can answer itself."""
    f = win.forward_return(trade_rows(spark, sf_dir).select("venue", "timestamp", "seq", "price"), BY, 5 * HOUR)
    return f.select("venue", "timestamp", "seq", S.rounded("fwd_bps", 6).alias("fwd_bps"))


def gap_flatten(spark, sf_dir):
    """Nested gap reports back to one row per gap."""
    r = quality.gap_report(tape(spark, sf_dir), BY, GAP)
    return r.select("venue", F.explode("streams").alias("s")).select("venue", "s.stream", F.explode("s.gaps").alias("g")).select("venue", "stream", "g.start_ms", "g.end_ms", "g.gap_sec")


def health_summary(spark, sf_dir):
    f = freshness(spark, sf_dir).where("status <> 'fresh'")
    return f.groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat("venue", F.lit("/"), F.col("side").cast("string")))), ",").alias("who"))


def recent_trades(spark, sf_dir):
    """Trades in the last day of the tape, per venue, and whether there are enough."""
    t = tape_from_events(spark, sf_dir)
    newest = t.agg((F.max("timestamp") - 24 * HOUR).alias("since"))
    n = t.join(F.broadcast(newest), F.col("timestamp") > F.col("since")).groupBy("venue").agg(F.count_if(F.col("side") == 2).alias("n_trades"))
    return n.withColumn("ok", F.col("n_trades") >= 10)


def container_venues(spark, sf_dir):
    names = spark.createDataFrame([("rec-cc",), ("rec-um",), ("rec-bj-spot",), ("other",)], "name string")
    known = spark.createDataFrame(CONTAINERS, "name string, venue string, market string")
    guess = F.split("name", "-")
    out = names.join(F.broadcast(known), "name", "left")
    return out.select("name", F.coalesce("venue", F.when(F.size(guess) >= 3, F.get(guess, F.lit(1))), F.lit("unknown")).alias("venue"), F.coalesce("market", F.when(F.size(guess) >= 3, F.get(guess, F.lit(2))), F.lit("unknown")).alias("market"))


def backlog(spark, sf_dir):
    """Orders by status and priority, as the counts of a backlog."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), S.rounded(F.sum("o_totalprice"), 2).alias("total"))


def spread_widths(spark, sf_dir):
    """Distribution of the spread at trades over its ticks."""
    t = tape(spark, sf_dir)
    top = book.top1(trades(t), book.intervals(t, BY), BY)
    return top.groupBy("venue", S.rounded(F.col("spread") / 0.5).cast("long").alias("ticks")).agg(F.count("*").alias("n"))


T = tape_sql()
MODE = "SELECT venue, count(*) AS n, min(timestamp) AS first, '{m}' AS mode FROM {src} GROUP BY venue"
GRID = "(SELECT *, row_number() OVER (PARTITION BY venue, timestamp // {w} ORDER BY seq) AS r FROM tape) WHERE r = 1"
ALL = {
    "simulated_fill_samples": (simulated_fill_samples, levels_sql() + TOP1 + " SELECT venue, timestamp, seq, price, best_bid AS best_bid_p, best_ask AS best_ask_p, spread AS spread_p, CAST(CASE WHEN quantity < 0 THEN 1 ELSE 2 END AS TINYINT) AS quote_side, mid AS mid_t FROM top"),
    "sampling_modes": (sampling_modes, f"WITH {T} " + " UNION ALL ".join((MODE.format(m=f"{6 * HOUR}ms_grid", src=GRID.format(w=6 * HOUR)), MODE.format(m="1s_grid", src=GRID.format(w=1000)), MODE.format(m="event_at_book_update", src="tape WHERE side IN (0, 1)"), MODE.format(m="event_at_cc_trade", src="tape WHERE side = 2")))),
    "forward_asof_own": (forward_asof_own, f"WITH {T}{TRADES} SELECT venue, timestamp, seq, (round(ln((SELECT arg_min(price, seq) FROM t b WHERE b.venue = a.venue AND b.timestamp >= a.timestamp + {5 * HOUR}) / price) * 1e4, 6) + 0.0) AS fwd_bps FROM t a"),
    "gap_flatten": (gap_flatten, STREAM_SQL + f" SELECT venue, stream, before AS start_ms, timestamp AS end_ms, (round((timestamp - before) / 1000.0, 3) + 0.0) AS gap_sec FROM g WHERE timestamp - before > {GAP * 1000}"),
    "health_summary": (health_summary, FRESH_SQL + " SELECT status, count(*) AS n, string_agg(venue || '/' || side, ',' ORDER BY venue || '/' || side) AS who FROM st WHERE status <> 'fresh' GROUP BY status"),
    "recent_trades": (recent_trades, f"WITH {T} SELECT venue, count(*) FILTER (side = 2) AS n_trades, count(*) FILTER (side = 2) >= 10 AS ok FROM tape WHERE timestamp > (SELECT max(timestamp) FROM tape) - {24 * HOUR} GROUP BY venue"),
    "container_venues": (container_venues, "SELECT * FROM (VALUES ('rec-cc', 'cc', 'spot'), ('rec-um', 'um', 'futures'), ('rec-bj-spot', 'bj', 'spot'), ('other', 'unknown', 'unknown')) AS t(name, venue, market)"),
    "backlog": (backlog, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, (round(sum(o_totalprice), 2) + 0.0) AS total FROM orders GROUP BY ALL"),
    "spread_widths": (spread_widths, levels_sql() + TOP1 + " SELECT venue, CAST((round(spread / 0.5) + 0.0) AS BIGINT) AS ticks, count(*) AS n FROM top GROUP BY ALL"),
}
