"""Trailing windows, as-of lookups and returns over a tape with seq.

A trailing window of width w ends at the current row, in tape order, and not at the current millisecond: rows of the
same ms that come later are not in it. So a sum is (everything up to this row) - (everything older than the window):
a running sum by row and a running sum by time, both linear, in one sort. Sums carry rounding noise; emptiness is
always decided by integer counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import scalars as S


def trailing(value: Column, by: list[str], width_ms: int, closed: bool = True) -> Column:
    """The sum of value over [t - w, t] up to this row, or (t - w, t] if not closed."""
    upto = F.sum(value).over(W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    older = F.sum(value).over(W.partitionBy(*by).orderBy("timestamp").rangeBetween(W.unboundedPreceding, -(width_ms + 1 if closed else width_ms)))
    return upto - F.coalesce(older, F.lit(0))


def flow(buy: Column, sell: Column, by: list[str], width_ms: int) -> Column:
    return trailing(buy - sell, by, width_ms)


def count(flag: Column, by: list[str], width_ms: int, closed: bool = True) -> Column:
    return trailing(F.when(flag, 1).otherwise(0).cast("long"), by, width_ms, closed)


def trade_imbalance(buy: Column, sell: Column, flag: Column, by: list[str], width_ms: int) -> Column:
    """(buys - sells) / (buys + sells) over the closed window, 0 without trades; sums to 9 digits, against noise."""
    b, s = S.rounded(trailing(buy, by, width_ms), 9), S.rounded(trailing(sell, by, width_ms), 9)
    return F.when(count(flag, by, width_ms) > 0, (b - s) / (b + s)).otherwise(F.lit(0.0))


def trailing_mean(value: Column, by: list[str], width_ms: int) -> Column:
    """The mean over the closed window of the values that are there: neither null nor NaN. Null if there are none."""
    there = value.isNotNull() & ~F.isnan(value)
    n = count(there, by, width_ms)
    return F.when(n > 0, trailing(F.when(there, value).otherwise(0.0), by, width_ms) / n)


def latest(value: Column, by: list[str]) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0))


def before(value: Column, by: list[str]) -> Column:
    """The last value that is not null, before this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))


def at_or_before(value: Column, by: list[str], lag_ms: int) -> Column:
    """The last value that is not null with a time at or before t - lag. A lag of at least 1 ms sees all such rows; of
    several in one ms it is the last by seq, whatever order the sort by time left them in."""
    found = F.max(F.when(value.isNotNull(), F.struct("seq", value.alias("v"))))
    return found.over(W.partitionBy(*by).orderBy("timestamp").rangeBetween(W.unboundedPreceding, -lag_ms))["v"]


def log_return(price: Column, by: list[str], width_ms: int, lag_ms: int = 0) -> Column:
    """ln(latest price / price at or before t - lag - width): the numerator is the latest price whatever the lag."""
    now, then = latest(price, by), at_or_before(price, by, width_ms + lag_ms)
    return F.when((now > 0) & (then > 0), F.log(now / then))


def abs_return_sum(price: Column, by: list[str], width_ms: int) -> Column:
    """The sum of |ln| of successive trade prices in the closed window; a step counts at its later trade. `price` is
    never null here (use it on trades)."""
    before = F.lag(price).over(W.partitionBy(*by).orderBy("seq"))
    return _after(F.when((before > 0) & (price > 0), F.abs(F.log(price / before))).otherwise(F.lit(0.0)), by, width_ms)


def _after(step: Column, by: list[str], width_ms: int) -> Column:
    return trailing(step, by, width_ms)


def forward_return(trades: DataFrame, by: list[str], horizon_ms: int) -> DataFrame:
    """fwd_bps: ln(price at the first later row with time >= t + h / price), in bps; null near the end.

    Probes at t + h are merged with the rows and take the next row in order, so it is one sort and no join. At equal
    times a probe comes before rows, but a row never answers its own probe or an earlier row's (h = 0).
    """
    rows = trades.select("*", F.col("timestamp").alias("_t"), F.lit(1).alias("_kind"))
    asks = trades.select("*", (F.col("timestamp") + horizon_ms).alias("_t"), F.lit(0).alias("_kind"))
    both = rows.unionByName(asks)
    if horizon_ms == 0:
        order = [F.col("_t").desc(), F.col("seq").desc(), F.col("_kind")]
    else:
        order = [F.col("_t").desc(), F.col("_kind").desc(), F.col("seq").desc()]
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if horizon_ms == 0 else 0)
    hit = F.last(F.when(F.col("_kind") == 1, F.col("price")), ignorenulls=True).over(w)
    out = both.withColumn("_hit", hit).where("_kind = 0")
    return out.withColumn("fwd_bps", F.when((F.col("price") > 0) & (F.col("_hit") > 0), F.log(F.col("_hit") / F.col("price")) * 10000.0)).drop("_t", "_kind", "_hit")


def probe_as_of(probes: DataFrame, values: DataFrame, by: list[str], at: str, value: str, before_equal: bool) -> DataFrame:
    """probes with the last value of `values` (by, timestamp, seq, value) before `at`.

    before_equal=True: rows at exactly `at` are not seen yet (a probe fires before the event at its time).
    Merge, one sort, last non-null: linear, and no range join.
    """
    v = values.select(*by, F.col("timestamp").alias("_t"), F.col("seq").alias("_s"), F.col(value).alias("_v"), F.lit(1).alias("_k"))
    names = [c for c in probes.columns if c not in by]
    p = probes.select(*by, F.col(at).cast("long").alias("_t"), F.lit(0).cast("long").alias("_s"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.lit(0 if before_equal else 2).alias("_k"), F.struct(*names).alias("_p"))
    both = v.withColumn("_p", F.lit(None).cast(p.schema["_p"].dataType)).unionByName(p)
    w = W.partitionBy(*by).orderBy("_t", "_k", "_s").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_k <> 1").select(*by, "_p.*", F.col("_v").alias(value))


def merged_asof(tape: DataFrame, venue: str, value: Column, everyone: list[str]) -> Column:
    """On one tape of several venues: the last value seen from `venue` up to this row."""
    return latest(F.when(F.col("venue") == venue, value), everyone)


def cumulative(value: Column, by: list[str]) -> Column:
    return F.sum(value).over(W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0))


def gap_to_next(by: list[str]) -> Column:
    """Milliseconds to the next row, null for the last."""
    return F.lead("timestamp").over(W.partitionBy(*by).orderBy("seq")) - F.col("timestamp")
