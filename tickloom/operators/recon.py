"""Reconciliation and diagnostics: comparing series, sessions and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import scalars as S


def blacklisted(rows: DataFrame, blacklist: DataFrame, day: str, exchange: str, symbol: str) -> DataFrame:
    """rows without those on the blacklist (day, exchange or *, symbol or *); a small list of reference data.

    The day is an equi key; wildcards are the residual condition, so this is a hash anti join and no nested loop.
    """
    b = blacklist.select(F.col("day").alias("_d"), F.col("exchange").alias("_e"), F.col("symbol").alias("_s"))
    on = (F.col(day) == F.col("_d")) & ((F.col("_e") == "*") | (F.col("_e") == F.col(exchange))) & ((F.col("_s") == "*") | (F.col("_s") == F.col(symbol)))
    return rows.join(b, on, "left_anti")


def reconcile(local: DataFrame, official: DataFrame, by: list[str], qty_local: str, qty_official: str) -> DataFrame:
    """Counts and volumes of two sources per group, and their differences in percent of the official."""
    a = local.groupBy(*by).agg(F.count("*").alias("n_local"), F.sum(F.abs(qty_local)).alias("vol_local"))
    b = official.groupBy(*by).agg(F.count("*").alias("n_official"), F.sum(F.abs(qty_official)).alias("vol_official"))
    pct = lambda x, y: F.when(F.col(y) != 0, S.rounded(100.0 * (F.col(x) - F.col(y)) / F.col(y), 4))
    return a.join(b, by).withColumn("n_diff_pct", pct("n_local", "n_official")).withColumn("vol_diff_pct", pct("vol_local", "vol_official"))


def pool_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """The i-th occurrence of a key on the left with the i-th on the right, in their orders."""
    i = lambda order: F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return left.withColumn("_i", i(left_order)).join(right.withColumn("_i", i(right_order)), [*keys, "_i"]).drop("_i")


def duplicate_stats(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Per group: distinct times, times with several rows, the most rows at one time."""
    per = rows.groupBy(*by, at).agg(F.count("*").alias("_n"))
    return per.groupBy(*by).agg(F.count("*").alias("n_ts"), F.count_if(F.col("_n") > 1).alias("n_dup_ts"), F.max("_n").alias("max_dup"))


def quantile_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, share above 0, 1st and 99th percentile (linear), and the ratio of the tails."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    per = good.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (100.0 * F.avg((F.col(value) > 0).cast("int"))).alias("pos_pct"), F.percentile(value, 0.01).alias("p1"), F.percentile(value, 0.99).alias("p99"))
    return per.withColumn("tail_ratio", F.abs("p1") / F.greatest("p99", F.lit(1e-9)))


def gap_bucket(gap_ms: Column, edges: list[int]) -> Column:
    """The number of the bucket: edges are the upper ends, exclusive."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(gap_ms < edges[i], i).otherwise(out)
    return out


def bucket_stats(rows: DataFrame, bucket: str, gap: str, value: str) -> DataFrame:
    per = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.median(gap).alias("median_gap"), F.median(value).alias("median_value"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"))
    total = rows.agg(F.count("*").alias("_all"))  # one row
    return per.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def bucket_means(rows: DataFrame, bucket: str, gap: str, names: list[str]) -> DataFrame:
    """Per bucket: its share of the samples and of the time between them, their ratio, and the mean of each of `names`
    over the rows that have it (neither null nor NaN)."""
    there = lambda c: F.when(~F.isnan(c), F.col(c))
    per = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(gap).alias("_held"), *[F.avg(there(c)).alias(f"{c}_mean") for c in names])
    total = per.agg(F.sum("n").alias("_n"), F.sum("_held").alias("_all"))  # one row
    out = per.crossJoin(F.broadcast(total)).withColumn("sample_share", F.col("n") / F.col("_n")).withColumn("time_share", F.col("_held") / F.col("_all"))
    return out.withColumn("ratio", F.col("time_share") / F.col("sample_share")).drop("_held", "_n", "_all")


def time_weighted(rows: DataFrame, by: list[str], gap_ms: str, value: str) -> DataFrame:
    """The mean of a value weighted by the seconds it held, clipped to [0.001, 10], beside the plain mean."""
    w = F.greatest(F.lit(0.001), F.least(F.lit(10.0), F.col(gap_ms) / 1000.0))
    return rows.groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("weighted"), F.avg(value).alias("plain"), F.sum(w).alias("weight"))


def index_percentile(sorted_values: Column, share: float) -> Column:
    """The element at floor(n * share) of an ascending array: a percentile by index, not by interpolation."""
    return F.try_element_at(sorted_values, (F.floor(F.size(sorted_values) * share) + 1).cast("int"))


def index_percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95 and p99 by index; p99 only with more than 100 values, else p95.

    The positions are found by rank in a distributed sort of each group, so no group becomes an array.
    """
    good = rows.where(F.col(value) > 0)
    w = W.partitionBy(*by).orderBy(value)
    n = F.count("*").over(W.partitionBy(*by))
    at = good.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    pick = lambda share: F.max(F.when(F.col("_i") == F.floor(F.col("_n") * share), F.col(value)))
    per = at.groupBy(*by).agg(F.max("_n").alias("n"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("_p99"))
    return per.withColumn("p99", F.when(F.col("n") > 100, F.col("_p99")).otherwise(F.col("p95"))).drop("_p99")


def pnl(fills: DataFrame, by: list[str], last_mid: DataFrame) -> DataFrame:
    """Cash, inventory, profit at the last mid, notional and edge of fills (side BUY or SELL, price, qty)."""
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    per = fills.groupBy(*by).agg(F.count("*").alias("n_fills"), F.sum(-sign * F.col("price") * F.col("qty")).alias("cash"), F.sum(sign * F.col("qty")).alias("inventory"), F.sum(F.abs(F.col("price") * F.col("qty"))).alias("notional"))
    out = per.join(last_mid, by).withColumn("pnl", F.col("cash") + F.col("inventory") * F.col("last_mid"))
    return out.withColumn("edge_bps", F.when(F.col("notional") > 0, F.col("pnl") / F.col("notional") * 1e4))


def daily_performance(days: DataFrame, by: list[str], value: str) -> DataFrame:
    """Over days: mean, sample deviation, Sharpe ratio of a 365-day year, share of winning days."""
    per = days.groupBy(*by).agg(F.count("*").alias("n_days"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))
    return per.withColumn("sharpe", F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(F.lit(365.0))))


def adverse_selection(probed: DataFrame, by: list[str]) -> DataFrame:
    """Mean of -ln(mid later / mid at fill) * side sign, in bps, per group. Needs side, mid_at_fill and mid_later."""
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    ok = (F.col("mid_at_fill") > 0) & (F.col("mid_later") > 0)
    return probed.groupBy(*by).agg(F.count_if(ok).alias("n"), F.avg(F.when(ok, -F.log(F.col("mid_later") / F.col("mid_at_fill")) * sign * 10000.0)).alias("adverse_bps"))


def verdict(issues: Column) -> Column:
    """From the number of issues."""
    return F.when(issues == 0, "HEALTHY").when(issues <= 2, "ACCEPT_WITH_TUNING").otherwise("UNHEALTHY")


def ohlc(trades: DataFrame, by: list[str], interval_ms: int) -> DataFrame:
    """Open, high, low, close, volume and count per cell of the grid; empty cells have no row."""
    cell = (F.floor(F.col("timestamp") / interval_ms) * interval_ms).cast("long")
    return trades.groupBy(*by, cell.alias("cell")).agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum(F.abs("quantity")).alias("volume"), F.count("*").alias("n"))


def dense(cells: DataFrame, by: list[str], interval_ms: int) -> DataFrame:
    """cells with the empty ones between a group's first and last filled in, their values null."""
    span = cells.groupBy(*by).agg(F.min("cell").alias("_lo"), F.max("cell").alias("_hi"))
    spine = span.select(*by, F.explode(F.sequence("_lo", "_hi", F.lit(interval_ms).cast("long"))).alias("cell"))
    return spine.join(cells, [*by, "cell"], "left")


def tagged_merge(streams: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Streams (by, ts_ns, arrival, payload...) on one line: by time, then by the streams' order, then arrival."""
    out = None
    for rank, (kind, rows) in enumerate(streams.items()):
        rows = rows.withColumn("kind", F.lit(kind)).withColumn("_rank", F.lit(rank))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("line", F.row_number().over(W.partitionBy(*by).orderBy("ts_ns", "_rank", "arrival")).cast("long")).drop("_rank")


def spec_of(orders: DataFrame, venue_specs: DataFrame, default_specs: DataFrame, tick: float = 1e-8, lot: float = 1e-8) -> DataFrame:
    """orders (venue, symbol) with tick, lot and least notional: the venue's table, else the default, else permissive."""
    v = venue_specs.select("venue", "symbol", F.col("tick").alias("_vt"), F.col("lot").alias("_vl"), F.col("least").alias("_vn"))
    d = default_specs.select("symbol", F.col("tick").alias("_dt"), F.col("lot").alias("_dl"), F.col("least").alias("_dn"))
    out = orders.join(F.broadcast(v), ["venue", "symbol"], "left").join(F.broadcast(d), "symbol", "left")
    pick = lambda a, b, c: F.coalesce(F.col(a), F.col(b), F.lit(c))
    return out.select(*orders.columns, pick("_vt", "_dt", tick).alias("tick"), pick("_vl", "_dl", lot).alias("lot"), pick("_vn", "_dn", 0.0).alias("least"))


def segments(bounds: DataFrame, by: list[str], width_ms: int) -> DataFrame:
    """by, segment, seg_start, seg_end from (by, first_ts, last_ts): consecutive, half-open, the last one cut short."""
    n = F.floor((F.col("last_ts") - F.col("first_ts")) / width_ms).cast("int")
    out = bounds.withColumn("segment", F.explode(F.sequence(F.lit(0), n)))
    width = F.lit(width_ms).cast("long")
    return out.select(*by, "segment", (F.col("first_ts") + F.col("segment") * width).alias("seg_start"), F.least(F.col("first_ts") + (F.col("segment") + 1) * width, F.col("last_ts") + 1).alias("seg_end"))


def feed_segments(tape: DataFrame, bounds: DataFrame, by: list[str], width_ms: int, warmup_ms: int) -> DataFrame:
    """Each row once for every segment that it feeds: its own (emits) and those whose warm-up holds it."""
    rows = tape.join(F.broadcast(bounds), by)
    own = F.floor((F.col("timestamp") - F.col("first_ts")) / width_ms)
    most = F.floor((F.col("last_ts") - F.col("first_ts")) / width_ms)
    last = F.least(most, F.floor((F.col("timestamp") + warmup_ms - F.col("first_ts")) / width_ms))
    out = rows.withColumn("segment", F.explode(F.sequence(own.cast("int"), last.cast("int"))))
    return out.withColumn("emits", F.col("segment") == own).drop("first_ts", "last_ts")
