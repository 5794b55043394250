"""Registered queries over the order book, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import book
from tickloom.sources.driver_tables import HOUR, tape_from_events, tape_sql
from tickloom.sources.tape import sequenced

BY = ["venue"]


def tape(spark, sf_dir, coarse=False):
    return sequenced(tape_from_events(spark, sf_dir, coarse), BY, ["arrival"])


def trades(t):
    return t.where("side = 2").select("venue", "timestamp", "seq")


def book_top1_at_trade(spark, sf_dir):
    t = tape(spark, sf_dir)
    return book.top1(trades(t), book.intervals(t, BY), BY)


def venue_spread_summary(spark, sf_dir):
    top = book_top1_at_trade(spark, sf_dir)
    return top.groupBy("venue").agg(F.count("*").alias("n"), S.rounded(F.avg("mid"), 6).alias("avg_mid"), S.rounded(F.avg("spread"), 6).alias("avg_spread"), S.rounded(F.avg("spread_bps"), 6).alias("avg_spread_bps"))


def book_top1_coarse(spark, sf_dir):
    t = tape(spark, sf_dir, True)
    return book.top1(trades(t), book.intervals(t, BY), BY)


def book_top5_at_trade(spark, sf_dir):
    t = tape(spark, sf_dir)
    s = book.topn_state(trades(t), book.intervals(t, BY), BY, 5)
    return s.select("venue", "timestamp", "seq", S.rounded("bid_sum", 6).alias("bid_sum"), S.rounded("ask_sum", 6).alias("ask_sum"), S.rounded("imbalance_n", 6).alias("imbalance_top5"))


def book_final_state(spark, sf_dir):
    return book.final_state(book.intervals(tape(spark, sf_dir), BY), BY)


def book_depth_curve(spark, sf_dir):
    c = book.depth_curve(book_final_state(spark, sf_dir), BY)
    return c.select("venue", "bid", "rank", "level_price", S.rounded("cum_qty", 6).alias("cum_qty"))


def book_ready(spark, sf_dir):
    t = tape(spark, sf_dir)
    return book.readiness(t, book.intervals(t, BY), BY)


def book_consistency(spark, sf_dir):
    return book.consistent(tape(spark, sf_dir, True), BY).groupBy("venue", "is_consistent").agg(F.count("*").alias("n"))


def book_grid_sample(spark, sf_dir):
    """Batch book (no clearing) on a 6-hour grid, with taker volumes between samples."""
    t = tape(spark, sf_dir)
    levels = book.intervals(t, BY, clear_on_snapshot=False)
    ready = book.readiness(t, levels, BY, 0)
    eligible = t.join(F.broadcast(ready), BY).where("seq >= ready_seq AND side IN (0, 1, 2)").select("venue", "timestamp", "seq")
    cells = book.grid_samples(eligible, BY, 6 * HOUR)
    state = book.topn_state(cells.select("venue", "timestamp", "seq"), levels, BY, 5)
    vols = book.period_volumes(t, state.select("venue", "seq"), BY)
    best = lambda side, f: F.get(f"{side}s", F.lit(0))[f]
    out = state.join(vols, ["venue", "seq"])
    return out.select("venue", "timestamp", ((best("bid", "level_price") + best("ask", "level_price")) / 2.0).alias("mid_price"), S.rounded("imbalance_n", 4).alias("imbalance"), S.rounded(best("ask", "level_price") - best("bid", "level_price"), 8).alias("spread"), S.rounded("taker_buy_vol", 4).alias("taker_buy_vol"), S.rounded("taker_sell_vol", 4).alias("taker_sell_vol"))


def l3_trade_align(spark, sf_dir):
    """Every trade with the batch book's best prices, once a snapshot has been seen."""
    t = tape(spark, sf_dir)
    levels = book.intervals(t, BY, clear_on_snapshot=False)
    ready = book.readiness(t, levels, BY, 0)
    s = t.where("side = 2").join(F.broadcast(ready), BY).where("seq >= ready_seq").select("venue", "timestamp", "seq", "price", "quantity")
    top = book.top1(s, levels, BY)
    return top.select("venue", "timestamp", "seq", "price", "quantity", F.col("best_bid").alias("bid1"), F.col("best_ask").alias("ask1"), S.rounded("spread", 8).alias("spread"))


def event_sampling(spark, sf_dir):
    t = tape(spark, sf_dir)
    return book.event_samples(t, [0, 1]).groupBy("venue").agg(F.count("*").alias("n_book"), F.max("seq").alias("last_seq"))


def levels_sql(coarse=False, clear=True):
    clr = "least(nxt, clr)" if clear else "nxt"
    return f"""WITH {tape_sql(coarse)}, rows AS (
  SELECT venue, seq, timestamp, side, price, quantity, side IN (0, 3) AS bid,
    lag(timestamp) OVER (PARTITION BY venue, side ORDER BY seq) AS before FROM tape WHERE side <> 2
), marked AS (
  SELECT *, CASE WHEN side IN (3, 4) AND (before IS NULL OR before <> timestamp) THEN seq END AS mark FROM rows
), ended AS (
  SELECT *, coalesce(lead(seq) OVER (PARTITION BY venue, bid, price ORDER BY seq), 4611686018427387904) AS nxt,
    coalesce(min(mark) OVER (PARTITION BY venue, bid ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 4611686018427387904) AS clr FROM marked
), levels AS (
  SELECT venue, bid, price AS level_price, quantity AS level_qty, seq AS st, {clr} AS en FROM ended WHERE quantity <> 0
)"""


TOP1 = """, best AS (
  SELECT s.venue, s.timestamp, s.seq, s.price, s.quantity, max(l.level_price) FILTER (bid) AS best_bid, arg_max(l.level_qty, l.level_price) FILTER (bid) AS bid_qty,
    min(l.level_price) FILTER (NOT bid) AS best_ask, arg_min(l.level_qty, l.level_price) FILTER (NOT bid) AS ask_qty
  FROM tape s JOIN levels l ON s.venue = l.venue AND l.st <= s.seq AND s.seq < l.en WHERE s.side = 2 GROUP BY ALL
), top AS (
  SELECT venue, timestamp, seq, best_bid, bid_qty, best_ask, ask_qty, (best_bid + best_ask) / 2.0 AS mid, best_ask - best_bid AS spread,
    (best_ask - best_bid) / ((best_bid + best_ask) / 2.0) * 10000.0 AS spread_bps, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS imbalance,
    (best_bid * ask_qty + best_ask * bid_qty) / (bid_qty + ask_qty) AS microprice, price, quantity
  FROM best WHERE best_bid < best_ask
)"""
TOP1_ROWS = " SELECT venue, timestamp, seq, best_bid, bid_qty, best_ask, ask_qty, mid, spread, spread_bps, imbalance, microprice FROM top"
TOP5 = """, ranked AS (
  SELECT s.venue, s.timestamp, s.seq, l.bid, l.level_price, l.level_qty,
    row_number() OVER (PARTITION BY s.venue, s.seq, l.bid ORDER BY CASE WHEN l.bid THEN -l.level_price ELSE l.level_price END) AS rank
  FROM samples s JOIN levels l ON s.venue = l.venue AND l.st <= s.seq AND s.seq < l.en
), state AS (
  SELECT venue, timestamp, seq, sum(level_qty) FILTER (bid) AS b, sum(level_qty) FILTER (NOT bid) AS a,
    max(level_price) FILTER (bid) AS bb, min(level_price) FILTER (NOT bid) AS ba FROM ranked WHERE rank <= 5 GROUP BY ALL
)"""
FINAL = """, final AS (
  SELECT venue, bid, CAST(row_number() OVER (PARTITION BY venue, bid ORDER BY CASE WHEN bid THEN -level_price ELSE level_price END) AS INTEGER) AS rank, level_price, level_qty
  FROM levels WHERE en = 4611686018427387904
)"""
READY = """, snaps AS (SELECT venue, min(seq) AS snap FROM tape WHERE side IN (3, 4) GROUP BY venue)"""

ALL = {
    "book_top1_at_trade": (book_top1_at_trade, levels_sql() + TOP1 + TOP1_ROWS),
    "venue_spread_summary": (venue_spread_summary, levels_sql() + TOP1 + " SELECT venue, count(*) AS n, (round(avg(mid), 6) + 0.0) AS avg_mid, (round(avg(spread), 6) + 0.0) AS avg_spread, (round(avg(spread_bps), 6) + 0.0) AS avg_spread_bps FROM top GROUP BY venue"),
    "book_top1_coarse": (book_top1_coarse, levels_sql(True) + TOP1 + TOP1_ROWS),
    "book_top5_at_trade": (book_top5_at_trade, levels_sql() + ", samples AS (SELECT * FROM tape WHERE side = 2)" + TOP5 + " SELECT venue, timestamp, seq, (round(b, 6) + 0.0) AS bid_sum, (round(a, 6) + 0.0) AS ask_sum, (round((b - a) / (b + a), 6) + 0.0) AS imbalance_top5 FROM state WHERE bb < ba"),
    "book_final_state": (book_final_state, levels_sql() + FINAL + " SELECT * FROM final"),
    "book_depth_curve": (book_depth_curve, levels_sql() + FINAL + " SELECT venue, bid, rank, level_price, (round(sum(level_qty) OVER (PARTITION BY venue, bid ORDER BY rank), 6) + 0.0) AS cum_qty FROM final"),
    "book_ready": (book_ready, levels_sql() + READY + """, steps AS (
  SELECT venue, st AS seq, bid, 1 AS d FROM levels UNION ALL SELECT venue, en, bid, -1 FROM levels WHERE en < 4611686018427387904
), sums AS (SELECT venue, seq, sum(d) FILTER (bid) AS b, sum(d) FILTER (NOT bid) AS a FROM steps GROUP BY ALL
), runs AS (SELECT venue, seq, sum(coalesce(b, 0)) OVER (PARTITION BY venue ORDER BY seq) AS b, sum(coalesce(a, 0)) OVER (PARTITION BY venue ORDER BY seq) AS a FROM sums
), filled AS (SELECT venue, min(seq) AS filled FROM runs WHERE b >= 5 AND a >= 5 GROUP BY venue)
SELECT t.venue, CAST(least(snap, filled) AS BIGINT) AS ready_seq FROM (SELECT DISTINCT venue FROM tape) t LEFT JOIN snaps USING (venue) LEFT JOIN filled USING (venue)"""),
    "book_consistency": (book_consistency, f"WITH {tape_sql(True)} SELECT venue, side NOT IN (3, 4) AS is_consistent, count(*) AS n FROM tape GROUP BY ALL"),
    "book_grid_sample": (book_grid_sample, levels_sql(clear=False) + READY + f""", eligible AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.venue, timestamp // {6 * HOUR} ORDER BY seq) AS n FROM tape t JOIN snaps USING (venue) WHERE seq >= snap AND side IN (0, 1, 2)
), samples AS (SELECT * FROM eligible WHERE n = 1)""" + TOP5 + """, emitted AS (
  SELECT *, lag(seq, 1, 0) OVER (PARTITION BY venue ORDER BY seq) AS prior FROM state WHERE bb < ba
)
SELECT e.venue, e.timestamp, (bb + ba) / 2.0 AS mid_price, (round((b - a) / (b + a), 4) + 0.0) AS imbalance, (round(ba - bb, 8) + 0.0) AS spread,
  (round(coalesce(sum(t.quantity) FILTER (t.quantity > 0), 0), 4) + 0.0) AS taker_buy_vol, (round(coalesce(sum(-t.quantity) FILTER (t.quantity <= 0), 0), 4) + 0.0) AS taker_sell_vol
FROM emitted e LEFT JOIN tape t ON t.venue = e.venue AND t.side = 2 AND t.seq > e.prior AND t.seq <= e.seq GROUP BY ALL"""),
    "l3_trade_align": (l3_trade_align, levels_sql(clear=False) + READY + TOP1 + " SELECT venue, timestamp, seq, price, quantity, best_bid AS bid1, best_ask AS ask1, (round(spread, 8) + 0.0) AS spread FROM top JOIN snaps USING (venue) WHERE seq >= snap"),
    "event_sampling": (event_sampling, f"WITH {tape_sql()} SELECT venue, count(*) AS n_book, max(seq) AS last_seq FROM tape WHERE side IN (0, 1) GROUP BY venue"),
}
