"""Registered data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import quality as q
from tickloom.plans.book_plans import BY, tape
from tickloom.session import table
from tickloom.sources.driver_tables import HOUR, tape_from_events, tape_sql

GAP = 6 * 3600.0
STREAM_SQL = f"""WITH {tape_sql()}, s AS (SELECT *, CASE WHEN side IN (0, 1) THEN 'depth' WHEN side = 2 THEN 'trade' END AS stream FROM tape
), g AS (SELECT *, lag(timestamp) OVER (PARTITION BY venue, stream ORDER BY timestamp) AS before FROM s WHERE stream IS NOT NULL)"""
MIN_SQL = f"""WITH {tape_sql()}, f AS (SELECT venue, min(timestamp) AS first, max(timestamp) AS last FROM tape GROUP BY venue
), spine AS (SELECT venue, first, unnest(range(0, (last - first) // {HOUR} + 1)) AS minute FROM f
), seen AS (SELECT t.venue, (timestamp - first) // {HOUR} AS minute, count(*) AS n FROM tape t JOIN f USING (venue) WHERE side IN (0, 1) GROUP BY ALL
), counts AS (SELECT s.venue, s.minute, coalesce(n, 0) AS n FROM spine s LEFT JOIN seen USING (venue, minute))"""


def gap_detect(spark, sf_dir):
    return q.gaps(tape(spark, sf_dir), BY, GAP)


def gap_stats(spark, sf_dir):
    return q.gap_stats(tape(spark, sf_dir), BY, GAP)


def gap_report(spark, sf_dir):
    r = q.gap_report(tape(spark, sf_dir), BY, GAP)
    return r.select("venue", "total_gaps", F.size("streams").alias("n_streams"), F.aggregate("streams", F.lit(0), lambda a, s: a + F.size(s["gaps"])).alias("n_listed"))


def minute_health(spark, sf_dir):
    """Hourly here: the width is a parameter."""
    return q.minute_counts(tape(spark, sf_dir), BY, HOUR)


def dead_intervals(spark, sf_dir):
    return q.dead_intervals(q.minute_counts(tape(spark, sf_dir), BY, HOUR), BY, 2)


def side_distribution(spark, sf_dir):
    return q.side_distribution(tape_from_events(spark, sf_dir), BY)


def max_gap(spark, sf_dir):
    return q.max_gap(tape(spark, sf_dir), BY)


def daily_integrity(spark, sf_dir):
    d = q.daily_integrity(tape(spark, sf_dir), BY, 60_000)
    return d.select("venue", "day", "events_in_day", "trades", "n_gaps", "n_pattern", S.rounded("head_min", 6).alias("head_min"), S.rounded("tail_min", 6).alias("tail_min"), S.rounded("outage_min", 6).alias("outage_min"), S.rounded("coverage_pct", 6).alias("coverage_pct"), "top_gap_sec", "top_gap_start")


def coverage_rollup(spark, sf_dir):
    r = q.coverage_rollup(q.daily_integrity(tape(spark, sf_dir), BY, 3600_000), BY)
    return r.withColumn("coverage_pct", S.rounded("coverage_pct", 6))


def validate_frame(spark, sf_dir):
    t = tape_from_events(spark, sf_dir).withColumn("day", F.floor(F.col("timestamp") / q.DAY).cast("long"))
    v = q.validate(t, ["venue", "day"], "price", "timestamp", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))
    return v.select("venue", "day", "row_count", "bad_price", "start_ms", "avg_price", "date_ok", "is_valid")


def freshness(spark, sf_dir):
    t = tape_from_events(spark, sf_dir)
    now = F.lit(1706745600000)
    f = q.freshness(t, ["venue", "side"], "timestamp", now, 6 * 3600, 7 * 86400)
    return f.select("venue", "side", "last_ts", "n_shards", "age_sec", "status", q.status_order(F.col("status")).alias("worst"))


def worst_offenders(spark, sf_dir):
    """The ten most stale groups: a top-k report, whose limit is the feature."""
    return freshness(spark, sf_dir).orderBy(F.desc("age_sec"), "venue", "side").limit(10).drop("worst")


def fleet_summary(spark, sf_dir):
    return q.fleet_summary(freshness(spark, sf_dir))


def coverage_bitmap(spark, sf_dir):
    """144 ten-minute marks of a day per venue, over all days; a deletion row marks its bucket bad."""
    t = tape_from_events(spark, sf_dir).withColumn("bucket", (F.floor(F.col("timestamp") / 600_000) % 144).cast("int"))
    return q.bitmap(t, BY, "bucket", 144, (F.col("quantity") == 0) & (F.col("k") % 49 == 0))


def cold_history(spark, sf_dir):
    """Landing history of 40 days: days with trades landed, days with a trade of k % 97 = 0 are bad."""
    t = tape_from_events(spark, sf_dir).where("side = 2").withColumn("day", F.floor(F.col("timestamp") / q.DAY).cast("int"))
    days = t.groupBy("venue", "day").agg(F.max(F.col("k") % 97 == 0).alias("bad"))
    return q.landing_history(days, BY, 19755, 40, F.col("venue") == "bs")


def cold_status(spark, sf_dir):
    t = tape_from_events(spark, sf_dir).groupBy("venue", "side").agg(F.floor(F.max("timestamp") / q.DAY).cast("int").alias("latest_day"))
    return q.cold_status(t.withColumn("parked", F.col("venue") == "bs"), 19755).drop("parked")


def price_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"), S.rounded(F.avg("l_extendedprice"), 4).alias("mean"))


def distinct_days(spark, sf_dir):
    t = tape_from_events(spark, sf_dir)
    return t.groupBy("venue").agg(F.count_distinct(F.floor(F.col("timestamp") / q.DAY)).alias("n_days"), F.count_distinct("side").alias("n_sides"))


INTEGRITY_SQL = f"""WITH {tape_sql()}, d AS (SELECT *, timestamp // 86400000 AS day FROM tape
), g AS (SELECT *, lag(timestamp) OVER (PARTITION BY venue, day ORDER BY timestamp, seq) AS before FROM d
), i AS (SELECT venue, day, count(*) AS events_in_day, count(*) FILTER (side = 2) AS trades, count(*) FILTER (timestamp - before >= {{gap}}) AS n_gaps,
    count(*) FILTER (timestamp - before BETWEEN 1797000 AND 1807000) AS n_pattern, (min(timestamp) - day * 86400000) / 60000.0 AS head_min,
    (day * 86400000 + 86400000 - max(timestamp)) / 60000.0 AS tail_min, coalesce(sum(timestamp - before) FILTER (timestamp - before >= {{gap}}), 0) / 60000.0 AS gap_min,
    CAST(coalesce(max(timestamp - before) // 1000, 0) AS BIGINT) AS top_gap_sec, arg_max(before, (timestamp - before) * 1000000 - before / 1e7) AS top_gap_start FROM g GROUP BY venue, day
), o AS (SELECT *, head_min + tail_min + gap_min AS outage_min FROM i)"""
FRESH_SQL = f"""WITH {tape_sql()}, p AS (SELECT venue, side, max(timestamp) AS last_ts, count(*) AS n_shards FROM tape GROUP BY ALL
), fr AS (SELECT *, (1706745600000 - last_ts) / 1000.0 AS age_sec FROM p
), st AS (SELECT *, CASE WHEN age_sec > 604800 THEN 'parked' WHEN age_sec > 21600 THEN 'stale' ELSE 'fresh' END AS status FROM fr)"""
ALL = {
    "gap_detect": (gap_detect, STREAM_SQL + f" SELECT venue, stream, before AS start_ms, timestamp AS end_ms, (round((timestamp - before) / 1000.0, 3) + 0.0) AS gap_sec FROM g WHERE timestamp - before > {GAP * 1000}"),
    "gap_stats": (gap_stats, STREAM_SQL + f""", p AS (SELECT venue, stream, count(*) AS n_events, count(*) FILTER (timestamp - before > {GAP * 1000}) AS n_gaps,
  coalesce(max((round((timestamp - before) / 1000.0, 3) + 0.0)) FILTER (timestamp - before > {GAP * 1000}), 0.0) AS max_gap_sec,
  (round(coalesce(sum((round((timestamp - before) / 1000.0, 3) + 0.0)) FILTER (timestamp - before > {GAP * 1000}), 0.0), 3) + 0.0) AS total_gap_sec,
  (round((max(timestamp) - min(timestamp)) / 1000.0, 3) + 0.0) AS span_sec FROM g GROUP BY ALL)
SELECT *, CASE WHEN span_sec > 0 THEN (round(100.0 * (1 - total_gap_sec / span_sec), 3) + 0.0) ELSE 100.0 END AS coverage_pct FROM p"""),
    "gap_report": (gap_report, STREAM_SQL + f" SELECT venue, count(*) FILTER (timestamp - before > {GAP * 1000}) AS total_gaps, CAST(count(DISTINCT stream) AS INTEGER) AS n_streams, CAST(count(*) FILTER (timestamp - before > {GAP * 1000}) AS INTEGER) AS n_listed FROM g GROUP BY venue"),
    "minute_health": (minute_health, MIN_SQL + " SELECT * FROM counts"),
    "dead_intervals": (dead_intervals, MIN_SQL + ", d AS (SELECT *, minute - row_number() OVER (PARTITION BY venue ORDER BY minute) AS run FROM counts WHERE n < 2) SELECT venue, min(minute) AS start_min, max(minute) + 1 AS end_min FROM d GROUP BY venue, run"),
    "side_distribution": (side_distribution, f"WITH {tape_sql()} SELECT venue, side, count(*) AS n FROM tape GROUP BY ALL"),
    "max_gap": (max_gap, f"WITH {tape_sql()} SELECT venue, max(s) AS max_gap_ms FROM (SELECT venue, timestamp - lag(timestamp) OVER (PARTITION BY venue ORDER BY timestamp) AS s FROM tape) GROUP BY venue"),
    "daily_integrity": (daily_integrity, INTEGRITY_SQL.format(gap=60000) + " SELECT venue, day, events_in_day, trades, n_gaps, n_pattern, (round(head_min, 6) + 0.0) AS head_min, (round(tail_min, 6) + 0.0) AS tail_min, (round(outage_min, 6) + 0.0) AS outage_min, (round(100 * (1 - outage_min / 1440), 6) + 0.0) AS coverage_pct, top_gap_sec, top_gap_start FROM o"),
    "coverage_rollup": (coverage_rollup, INTEGRITY_SQL.format(gap=3600000) + " SELECT venue, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(n_gaps) AS BIGINT) AS n_gaps, CAST(sum(n_pattern) AS BIGINT) AS n_pattern, count(*) AS days, (round(100 * (1 - sum(outage_min) / 60 / 24 / count(*)), 6) + 0.0) AS coverage_pct FROM o GROUP BY venue"),
    "validate_frame": (validate_frame, f"WITH {tape_sql()} SELECT venue, timestamp // 86400000 AS day, count(*) AS row_count, count(*) FILTER (price <= 0) AS bad_price, min(timestamp) AS start_ms, (round(avg(price), 2) + 0.0) AS avg_price, min(timestamp) // 86400000 = timestamp // 86400000 AS date_ok, count(*) FILTER (price <= 0) = 0 AND min(timestamp) // 86400000 = timestamp // 86400000 AS is_valid FROM tape GROUP BY venue, timestamp // 86400000"),
    "freshness": (freshness, FRESH_SQL + " SELECT *, CASE status WHEN 'stale' THEN 0 WHEN 'unknown' THEN 1 WHEN 'fresh' THEN 2 ELSE 3 END AS worst FROM st"),
    "worst_offenders": (worst_offenders, FRESH_SQL + " SELECT * FROM st ORDER BY age_sec DESC, venue, side LIMIT 10"),
    "fleet_summary": (fleet_summary, FRESH_SQL + ", c AS (SELECT count(*) AS n, count(*) FILTER (status = 'fresh') AS n_fresh, count(*) FILTER (status = 'stale') AS n_stale, count(*) FILTER (status = 'parked') AS n_parked FROM st) SELECT *, CASE WHEN n = 0 THEN 'EMPTY' WHEN n_stale * 2 > n THEN 'RED' WHEN n_stale > 0 THEN 'DEGRADED' ELSE 'GREEN' END AS overall FROM c"),
    "coverage_bitmap": (coverage_bitmap, f"WITH {tape_sql()}, b AS (SELECT venue, timestamp // 600000 % 144 AS bucket, bool_or(quantity = 0 AND k % 49 = 0) AS bad FROM tape GROUP BY ALL), s AS (SELECT v.venue, r.i FROM (SELECT DISTINCT venue FROM tape) v, (SELECT unnest(range(144)) AS i) r) SELECT s.venue, string_agg(CASE WHEN bad THEN 'x' WHEN NOT bad THEN '1' ELSE '0' END, '' ORDER BY i) AS bitmap FROM s LEFT JOIN b ON b.venue = s.venue AND b.bucket = s.i GROUP BY s.venue"),
    "cold_history": (cold_history, f"WITH {tape_sql()}, d AS (SELECT venue, timestamp // 86400000 AS day, bool_or(k % 97 = 0) AS bad FROM tape WHERE side = 2 GROUP BY ALL), f AS (SELECT venue, min(day) FILTER (NOT bad) AS first FROM d GROUP BY venue), s AS (SELECT f.venue, f.first, unnest(range(19716, 19756)) AS day FROM f) SELECT s.venue, string_agg(CASE WHEN bad THEN 'x' WHEN NOT bad THEN '1' WHEN s.venue = 'bs' THEN 'p' WHEN s.day < s.first THEN '-' WHEN s.day >= 19754 THEN '?' ELSE '0' END, '' ORDER BY s.day) AS history FROM s LEFT JOIN d ON d.venue = s.venue AND d.day = s.day GROUP BY s.venue"),
    "cold_status": (cold_status, f"WITH {tape_sql()}, l AS (SELECT venue, side, CAST(max(timestamp) // 86400000 AS INTEGER) AS latest_day FROM tape GROUP BY ALL) SELECT *, CASE WHEN venue <> 'bs' THEN 19754 - latest_day END AS days_behind, CASE WHEN venue = 'bs' THEN 'parked' WHEN 19754 - latest_day <= 0 THEN 'ok' WHEN 19754 - latest_day = 1 THEN 'lag' ELSE 'stale' END AS status FROM l"),
    "price_summary": (price_summary, "SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo, (round(avg(l_extendedprice), 4) + 0.0) AS mean FROM lineitem GROUP BY l_returnflag"),
    "distinct_days": (distinct_days, f"WITH {tape_sql()} SELECT venue, count(DISTINCT timestamp // 86400000) AS n_days, count(DISTINCT side) AS n_sides FROM tape GROUP BY venue"),
}
