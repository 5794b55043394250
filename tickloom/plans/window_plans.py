"""Registered queries over trailing windows, as-of lookups and returns. Windows are hours, as test events are minutes
apart; every width is a parameter of the operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.functions.models import FEATURE_NAMES
from tickloom.operators import book, features, recon
from tickloom.operators import windows as win
from tickloom.plans.book_plans import BY, TOP1, levels_sql, tape, trades
from tickloom.sources.driver_tables import HOUR, tape_from_events, tape_sql
from tickloom.sources.tape import merged

TRADES = ", t AS (SELECT *, greatest(-quantity, 0.0) AS buy, greatest(quantity, 0.0) AS sell FROM tape WHERE side = 2)"
VENUES = ["cc", "bj", "um", "bs"]


def trade_rows(spark, sf_dir, coarse=False):
    t = tape(spark, sf_dir, coarse).where("side = 2")
    return t.withColumn("buy", S.taker_buy(F.col("quantity"))).withColumn("sell", S.taker_sell(F.col("quantity")))


def trade_flow_window(spark, sf_dir):
    """Signed flow and count over closed windows of 1 and 6 hours, on a tape with ties."""
    t = trade_rows(spark, sf_dir, True)
    cols = [c for h in (1, 6) for c in (S.rounded(win.flow(F.col("buy"), F.col("sell"), BY, h * HOUR), 6).alias(f"flow_{h}h"), win.count(F.lit(True), BY, h * HOUR).alias(f"n_{h}h"))]
    return t.select("venue", "timestamp", "seq", *cols)


def trade_imbalance_window(spark, sf_dir):
    t = trade_rows(spark, sf_dir)
    return t.select("venue", "timestamp", "seq", *[S.rounded(win.trade_imbalance(F.col("buy"), F.col("sell"), F.lit(True), BY, h * HOUR), 6).alias(f"imb_{h}h") for h in (1, 12)])


def trade_burst_count(spark, sf_dir):
    """Trades in the half-open window (t - w, t]."""
    t = trade_rows(spark, sf_dir, True)
    return t.select("venue", "timestamp", "seq", win.count(F.lit(True), BY, HOUR, closed=False).alias("burst"))


def log_return_asof(spark, sf_dir):
    """Returns over 1 h and 5 h, and the lagged form whose numerator stays the latest price."""
    t = trade_rows(spark, sf_dir)
    p = F.col("price")
    return t.select("venue", "timestamp", "seq", S.rounded(win.log_return(p, BY, HOUR), 9).alias("r_1h"), S.rounded(win.log_return(p, BY, 5 * HOUR), 9).alias("r_5h"), S.rounded(win.log_return(p, BY, HOUR, HOUR), 9).alias("r_lag1"), S.rounded(win.log_return(p, BY, HOUR, 2 * HOUR), 9).alias("r_lag2"))


def realised_abs_return(spark, sf_dir):
    t = trade_rows(spark, sf_dir)
    return t.select("venue", "timestamp", "seq", S.rounded(win.abs_return_sum(F.col("price"), BY, 5 * HOUR), 6).alias("vol_5h"))


def forward_return(spark, sf_dir):
    f = win.forward_return(trade_rows(spark, sf_dir, True).select("venue", "timestamp", "seq", "price"), BY, HOUR)
    return f.select("venue", "timestamp", "seq", S.rounded("fwd_bps", 6).alias("fwd_bps"))


def forward_return_same_ms(spark, sf_dir):
    """Horizon 0: the next row in order, even at the same time."""
    f = win.forward_return(trade_rows(spark, sf_dir, True).select("venue", "timestamp", "seq", "price"), BY, 0)
    return f.select("venue", "timestamp", "seq", S.rounded("fwd_bps", 6).alias("fwd_bps"))


DAY = 24 * HOUR


def segmented(rows):
    """Rows of all venues on one line within day-long segments that are fed a day of warm-up before them, so that the
    merged tape is sorted in parallel: segment, line, emits."""
    bounds = rows.agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    fed = recon.feed_segments(rows.withColumn("one", F.lit(1)), bounds.withColumn("one", F.lit(1)), ["one"], DAY, DAY).drop("one")
    return fed.withColumn("line", F.row_number().over(W.partitionBy("segment").orderBy(*merged(fed, F.col("venue"), ["arrival"]))).cast("long"))


def basis_cross_venue(spark, sf_dir):
    """At every cc trade: the last mid of cc and bj seen on the merged tape, and ln of their ratio in bps."""
    t = tape(spark, sf_dir)
    top = book.top1(trades(t), book.intervals(t, BY), BY).select("venue", "timestamp", "seq", "mid")
    everyone = segmented(top.join(t.select("venue", "seq", "arrival", "side"), ["venue", "seq"]))
    w = W.partitionBy("segment").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    last = lambda v: F.last(F.when(F.col("venue") == v, F.col("mid")), ignorenulls=True).over(w)
    out = everyone.select("venue", "timestamp", "arrival", "emits", last("cc").alias("cc_mid"), last("bj").alias("bj_mid")).where("emits AND venue = 'cc'")
    return out.select("timestamp", "arrival", "cc_mid", "bj_mid", S.rounded(S.log_bps(F.col("cc_mid"), F.col("bj_mid")), 6).alias("basis_bps"))


def hour_encoding(spark, sf_dir):
    t = tape_from_events(spark, sf_dir)
    ms = F.col("timestamp")
    return t.select("arrival", (S.rounded(S.hour_sin(ms), 9) + 0.0).alias("hour_sin"), (S.rounded(S.hour_cos(ms), 9) + 0.0).alias("hour_cos"))


def cumulative_volume(spark, sf_dir):
    t = trade_rows(spark, sf_dir)
    return t.select("venue", "seq", S.rounded(win.cumulative(F.col("buy"), BY), 6).alias("cum_buy"), S.rounded(win.cumulative(F.col("sell"), BY), 6).alias("cum_sell"))


def interarrival_gap(spark, sf_dir):
    t = tape(spark, sf_dir)
    return t.select("venue", "seq", win.gap_to_next(BY).alias("gap_ms")).where("gap_ms IS NOT NULL")


def venue_health(spark, sf_dir):
    """Venues whose last trade is within 2 hours of the newest event anywhere."""
    t = tape(spark, sf_dir)
    newest = t.agg(F.max("timestamp").alias("now"))
    per = t.where("side = 2").groupBy("venue").agg(F.max("timestamp").alias("last_trade"))
    return per.crossJoin(F.broadcast(newest)).select("venue", "last_trade", (F.col("last_trade") >= F.col("now") - 2 * HOUR).alias("healthy"))


def sorted_check(spark, sf_dir):
    t = tape(spark, sf_dir)
    ok = F.coalesce(F.col("timestamp") >= F.lag("timestamp").over(W.partitionBy("venue").orderBy("arrival")), F.lit(True))
    return t.withColumn("_ok", ok).groupBy("venue").agg(F.bool_and("_ok").alias("ts_sorted"), F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"))


UNIT, LOOKBACK = HOUR // 2, 30  # what a second of the feature widths is on a tape with minutes between events
WINDOWED = ("cc_l2_imb_top1_5s", "cc_l2_imb_top5_5s", "cc_micro_dev_5s")
PLAIN = [n for n in FEATURE_NAMES if n not in WINDOWED]


def feature_row(spark, sf_dir):
    """All features at each cc trade, on one merged tape of all venues."""
    m = segmented(tape(spark, sf_dir)).withColumn("seq", F.col("line"))
    m = m.withColumn("sample", F.expr("emits AND venue = 'cc' AND side = 2"))
    rows = features.feature_rows(m, ["segment"], ["arrival"], UNIT, LOOKBACK, threshold=1)
    return rows.select("timestamp", "arrival", *[S.rounded(n, 9).alias(n) for n in FEATURE_NAMES])


def feature_vector(spark, sf_dir):
    """The features that SQL can say: all but the trailing means of throttled book metrics."""
    return feature_row(spark, sf_dir).drop(*WINDOWED)


def feature_sequence(spark, sf_dir):
    """What a sequence model reads at the last cc trade: 12 steps of an hour of the feature vector."""
    return features.feature_sequence(feature_vector(spark, sf_dir), [], ["arrival"], 12 * HOUR, HOUR, PLAIN)


def grid_sequence(spark, sf_dir):
    """For the last cc trade: the price at or before each of 12 steps of an hour back."""
    t = trade_rows(spark, sf_dir).where("venue = 'cc'")
    last = t.agg(F.max("timestamp").alias("latest"))
    grid = last.select(F.lit("cc").alias("venue"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("step"), "latest").withColumn("at", F.col("latest") - F.col("step") * HOUR)
    found = win.probe_as_of(grid, t.select("venue", "timestamp", "seq", "price"), ["venue"], "at", "price", before_equal=False)
    return found.select("venue", "step", "price")


def sum_sql(expr, hours, order="seq", closed=True):
    edge = f"b.timestamp {'>=' if closed else '>'} a.timestamp - {hours * HOUR}"
    return f"(SELECT {expr} FROM t b WHERE b.venue = a.venue AND b.seq <= a.seq AND {edge})"


def then_sql(hours):
    return f"(SELECT arg_max(price, seq) FROM t b WHERE b.venue = a.venue AND b.timestamp <= a.timestamp - {hours * HOUR})"


LO = f"(SELECT min(timestamp) FROM {{rows}}) + ((timestamp - (SELECT min(timestamp) FROM {{rows}})) // {DAY} - 1) * {DAY} AS lo"


def mrow(what, venue, edge):
    return f"{what} FILTER (b.venue = '{venue}' AND {edge})"


def mret(venue, width, lag=0):
    then = f"b.timestamp <= a.at_ts - {int((width + lag) * UNIT)}"
    price, born = mrow("arg_max(price, line)", venue, "true"), mrow("max(timestamp)", venue, "true")
    return f"CASE WHEN {mrow('max(timestamp)', venue, then)} >= {born} - {LOOKBACK * UNIT} THEN ln({price} / {mrow('arg_max(price, line)', venue, then)}) END"


def msum(venue, expr, width, closed=True, also=""):
    edge = f"b.venue = '{venue}' AND b.timestamp {'>=' if closed else '>'} a.at_ts - {int(width * UNIT)}{also}"
    return f"(round(coalesce({expr.format(w=f'FILTER ({edge})')}, 0), 9) + 0.0)"


def feature_sql():
    """The features that need no throttle, as common table expressions that end in `fv`: books by segment and venue as
    intervals, trades by subqueries."""
    imb = "(round(sum(buy) {w}, 9) - round(sum(sell) {w}, 9)) / (round(sum(buy) {w}, 9) + round(sum(sell) {w}, 9))"
    net, n = "sum(buy - sell) {w}", "CAST(count(*) {w} AS DOUBLE)"
    cols = {
        **{name: mret("um", w) for name, w in (("r_um", 1), ("r_um_2s", 2), ("r_um_5s", 5), ("r_um_10s", 10))},
        **{f"{v}_imb_{name}": msum(v, imb, w) for v, name, w in (("um", "1s", 1), ("um", "30s_norm", 30), ("bj", "1s", 1), ("cc", "1s", 1), ("cc", "30s_norm", 30))},
        **{f"{v}_flow_{name}": msum(v, net, w) for v, name, w in (("um", "50ms", 0.05), ("um", "100ms", 0.1), ("um", "500ms", 0.5), ("um", "5s", 5), ("bj", "5s", 5), ("cc", "5s", 5), ("cc", "30s", 30))},
        "um_n_5s": msum("um", n, 5),
        "um_vol_5s": msum("um", "sum(abs(ln(price / prior))) {w}", 5, also=f" AND prior_ts >= greatest(a.lo, b.timestamp - {LOOKBACK * UNIT})"),
        "r_bj": mret("bj", 1), "trade_intensity_burst_50ms": msum("cc", n, 0.05, closed=False), "r_cc_lag1": mret("cc", 1, 1), "r_cc_lag2": mret("cc", 1, 2),
        "bs_last": mrow("arg_max(price, line)", "bs", "true"),
    }
    books = """, fed AS (
  SELECT s.segment, m.*, side IN (0, 3) AS bid FROM m JOIN (SELECT DISTINCT seg AS segment FROM m) s ON m.seg = s.segment OR m.seg = s.segment - 1
), marked AS (
  SELECT *, CASE WHEN side IN (3, 4) AND lag(timestamp) OVER (PARTITION BY segment, venue, side ORDER BY line) IS DISTINCT FROM timestamp THEN line END AS mark FROM fed WHERE side <> 2
), lived AS (
  SELECT segment, venue, bid, price AS p, quantity AS q, line AS st, least(
    coalesce(lead(line) OVER (PARTITION BY segment, venue, bid, price ORDER BY line), 4611686018427387904),
    coalesce(min(mark) OVER (PARTITION BY segment, venue, bid ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 4611686018427387904)) AS en FROM marked
), held AS (
  SELECT a.line, l.venue, l.bid, p, q, row_number() OVER (PARTITION BY a.line, l.venue, l.bid ORDER BY CASE WHEN l.bid THEN -p ELSE p END) AS rank
  FROM mt a JOIN lived l ON l.segment = a.seg AND l.st <= a.line AND a.line < l.en WHERE a.venue = 'cc' AND q <> 0
), sums AS (
  SELECT line, venue, max(p) FILTER (bid) AS b, min(p) FILTER (NOT bid) AS a, sum(q) FILTER (bid AND rank = 1) AS bq, sum(q) FILTER (NOT bid AND rank = 1) AS aq,
    sum(q) FILTER (bid) AS b5, sum(q) FILTER (NOT bid) AS a5 FROM held WHERE rank <= 5 GROUP BY ALL
), shown AS (
  SELECT line, venue, (a + b) / 2.0 AS mid, (bq - aq) / (bq + aq) AS i1, (b5 - a5) / (b5 + a5) AS i5, (a - b) / ((a + b) / 2.0) * 10000.0 AS spread,
    ((b * aq + a * bq) / (bq + aq) - (a + b) / 2.0) / ((a + b) / 2.0) * 10000.0 AS dev FROM sums WHERE b < a
), flat AS (
  SELECT line, """ + ", ".join(f"max({c}) FILTER (venue = '{v}') AS {v}_{c}" for v in VENUES for c in ("mid", "i1", "i5", "spread", "dev")) + " FROM shown GROUP BY line)"
    say = {
        "basis_bj_bps": "ln(cc_mid / bj_mid) * 10000.0", "um_x_basis": "x_um * ln(cc_mid / bj_mid) * 10000.0", "basis_um_bps": "ln(um_mid / bs_mid) * 10000.0",
        "basis_um_bps_trade_proxy": "ln(um_mid / bs_last) * 10000.0", "cc_l2_top1_imb": "cc_i1", "cc_l2_top5_imb": "cc_i5", "cc_l2_micro_dev_bps": "cc_dev",
        "cc_l2_spread_bps": "cc_spread", "bj_l2_top1_imb": "bj_i1", "bj_l2_top5_imb": "bj_i5", "l2_imb_diff": "cc_i1 - bj_i1",
        "hour_sin": "sin(2 * pi() * ((timestamp // 1000 % 86400) / 3600.0) / 24.0)", "hour_cos": "cos(2 * pi() * ((timestamp // 1000 % 86400) / 3600.0) / 24.0)",
    }
    traded = ", ".join(f"{e} AS {c}" if c == "bs_last" else f"(round({e}, 9) + 0.0) AS {c}" for c, e in cols.items())
    rounded = ", ".join(f"(round({e}, 9) + 0.0) AS {c}" for c, e in say.items())
    return f"""WITH {tape_sql()}, m AS (
  SELECT *, (timestamp - t0) // {DAY} AS seg, t0 + ((timestamp - t0) // {DAY} - 1) * {DAY} AS lo, row_number() OVER (ORDER BY timestamp, side DESC, venue, arrival) AS line
  FROM tape, (SELECT min(timestamp) AS t0 FROM tape)
), mt AS (
  SELECT *, greatest(-quantity, 0.0) AS buy, greatest(quantity, 0.0) AS sell, lag(price) OVER w AS prior, lag(timestamp) OVER w AS prior_ts FROM m WHERE side = 2 WINDOW w AS (PARTITION BY venue ORDER BY line)
){books}, traded AS (
  SELECT at_line AS line, at_ts AS timestamp, at_arrival AS arrival, {mret("um", 1)} AS x_um, {traded}
  FROM (SELECT line AS at_line, timestamp AS at_ts, arrival AS at_arrival, lo FROM mt WHERE venue = 'cc') a
  JOIN (SELECT line, timestamp, venue, price, buy, sell, prior, prior_ts FROM mt) b ON b.timestamp >= a.lo AND b.line <= a.at_line GROUP BY ALL
), fv AS (SELECT timestamp, arrival, {", ".join(n for n in PLAIN if n not in say)}, {rounded} FROM traded LEFT JOIN flat USING (line))"""


FWD = "(SELECT {pick} FROM t b WHERE b.venue = a.venue AND b.seq > a.seq AND b.timestamp >= a.timestamp + {h})"
ALL = {
    "trade_flow_window": (trade_flow_window, f"WITH {tape_sql(True)}{TRADES} SELECT venue, timestamp, seq, " + ", ".join(f"(round({sum_sql('sum(buy - sell)', h)}, 6) + 0.0) AS flow_{h}h, {sum_sql('count(*)', h)} AS n_{h}h" for h in (1, 6)) + " FROM t a"),
    "trade_imbalance_window": (trade_imbalance_window, f"WITH {tape_sql()}{TRADES} SELECT venue, timestamp, seq, " + ", ".join(f"(round({sum_sql('((round(sum(buy), 9) + 0.0) - (round(sum(sell), 9) + 0.0)) / ((round(sum(buy), 9) + 0.0) + (round(sum(sell), 9) + 0.0))', h)}, 6) + 0.0) AS imb_{h}h" for h in (1, 12)) + " FROM t a"),
    "trade_burst_count": (trade_burst_count, f"WITH {tape_sql(True)}{TRADES} SELECT venue, timestamp, seq, {sum_sql('count(*)', 1, closed=False)} AS burst FROM t a"),
    "log_return_asof": (log_return_asof, f"WITH {tape_sql()}{TRADES} SELECT venue, timestamp, seq, (round(ln(price / {then_sql(1)}), 9) + 0.0) AS r_1h, (round(ln(price / {then_sql(5)}), 9) + 0.0) AS r_5h, (round(ln(price / {then_sql(2)}), 9) + 0.0) AS r_lag1, (round(ln(price / {then_sql(3)}), 9) + 0.0) AS r_lag2 FROM t a"),
    "realised_abs_return": (realised_abs_return, f"WITH {tape_sql()}, t AS (SELECT *, coalesce(abs(ln(price / lag(price) OVER (PARTITION BY venue ORDER BY seq))), 0.0) AS step FROM tape WHERE side = 2) SELECT venue, timestamp, seq, (round({sum_sql('sum(step)', 5)}, 6) + 0.0) AS vol_5h FROM t a"),
    "forward_return": (forward_return, f"WITH {tape_sql(True)}{TRADES} SELECT venue, timestamp, seq, (round(ln({FWD.format(pick='arg_min(price, seq)', h=HOUR)} / price) * 10000.0, 6) + 0.0) AS fwd_bps FROM t a"),
    "forward_return_same_ms": (forward_return_same_ms, f"WITH {tape_sql(True)}{TRADES} SELECT venue, timestamp, seq, (round(ln({FWD.format(pick='arg_min(price, seq)', h=0)} / price) * 10000.0, 6) + 0.0) AS fwd_bps FROM t a"),
    "basis_cross_venue": (basis_cross_venue, levels_sql() + TOP1 + """, keyed AS (
  SELECT top.venue, top.timestamp, top.seq, mid, arrival, side FROM top JOIN tape USING (venue, seq)
), lined AS (SELECT *, """ + LO.format(rows="keyed") + """, row_number() OVER (ORDER BY timestamp, side DESC, venue, arrival) AS line FROM keyed
), mids AS (SELECT a.timestamp, a.arrival, (SELECT arg_max(mid, line) FROM lined b WHERE b.venue = 'cc' AND b.timestamp >= a.lo AND b.line <= a.line) AS cc_mid,
  (SELECT arg_max(mid, line) FROM lined b WHERE b.venue = 'bj' AND b.timestamp >= a.lo AND b.line <= a.line) AS bj_mid FROM lined a WHERE a.venue = 'cc')
SELECT *, (round(ln(cc_mid / bj_mid) * 10000.0, 6) + 0.0) AS basis_bps FROM mids"""),
    "hour_encoding": (hour_encoding, f"WITH {tape_sql()} SELECT arrival, round(sin(2 * pi() * ((timestamp // 1000 % 86400) / 3600.0) / 24.0), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * ((timestamp // 1000 % 86400) / 3600.0) / 24.0), 9) + 0.0 AS hour_cos FROM tape"),
    "cumulative_volume": (cumulative_volume, f"WITH {tape_sql()}{TRADES} SELECT venue, seq, (round(sum(buy) OVER w, 6) + 0.0) AS cum_buy, (round(sum(sell) OVER w, 6) + 0.0) AS cum_sell FROM t WINDOW w AS (PARTITION BY venue ORDER BY seq)"),
    "interarrival_gap": (interarrival_gap, f"WITH {tape_sql()} SELECT * FROM (SELECT venue, seq, lead(timestamp) OVER (PARTITION BY venue ORDER BY seq) - timestamp AS gap_ms FROM tape) WHERE gap_ms IS NOT NULL"),
    "venue_health": (venue_health, f"WITH {tape_sql()} SELECT venue, max(timestamp) AS last_trade, max(timestamp) >= (SELECT max(timestamp) FROM tape) - {2 * HOUR} AS healthy FROM tape WHERE side = 2 GROUP BY venue"),
    "sorted_check": (sorted_check, f"WITH {tape_sql()} SELECT venue, bool_and(ok) AS ts_sorted, min(timestamp) AS ts_min, max(timestamp) AS ts_max FROM (SELECT *, coalesce(timestamp >= lag(timestamp) OVER (PARTITION BY venue ORDER BY arrival), true) AS ok FROM tape) GROUP BY venue"),
    "feature_row": (feature_row, None),
    "feature_vector": (feature_vector, feature_sql() + " SELECT * FROM fv"),
    "feature_sequence": (feature_sequence, feature_sql() + f", g AS (SELECT step, max(timestamp) - step * {HOUR} AS till FROM fv, (SELECT unnest(range(12)) AS step) GROUP BY step), f AS (SELECT step, arg_max(fv, (timestamp, arrival)) AS x FROM g JOIN fv ON timestamp <= till GROUP BY step) SELECT CAST(step AS INTEGER) AS step, {', '.join(f'x.{n} AS {n}' for n in PLAIN)} FROM f WHERE (SELECT count(*) FROM f) = 12"),
    "grid_sequence": (grid_sequence, f"WITH {tape_sql()}{TRADES}, c AS (SELECT * FROM t WHERE venue = 'cc'), g AS (SELECT unnest(range(12)) AS step, (SELECT max(timestamp) FROM c) AS latest) SELECT 'cc' AS venue, CAST(step AS INTEGER) AS step, (SELECT arg_max(price, seq) FROM c WHERE c.timestamp <= g.latest - g.step * {HOUR}) AS price FROM g"),
}
