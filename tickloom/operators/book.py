"""The order book as a table: each price level lives on an interval of the tape.

A level set at row `seq` lives until the next row of the same price and side, or until a new snapshot batch clears
its side. The book at any row is then the set of levels whose interval holds it, and every book query (top of book,
top N, final state, samples on a grid) is a join of sample rows with intervals plus an aggregation. All windows run
forward in one sort of each `by` group; use (venue, symbol, day) or (venue, segment) as `by` at scale.

`clear_on_snapshot=True` is the streaming book: the first row of a snapshot at a new time empties its side. `False`
is the batch book, which only upserts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import bps, imbalance, microprice, mid
from tickloom.operators.interval_join import join_points


def is_bid() -> Column:
    return F.col("side").isin(0, 3)


def intervals(tape: DataFrame, by: list[str], clear_on_snapshot: bool = True) -> DataFrame:
    """by, bid (boolean), level_price, level_qty, st, en: levels that live on rows st <= seq < en.

    `tape` has seq within `by`. Running minima go backwards over the rows, so the cost is linear.
    """
    rows = tape.where("side <> 2").select(*by, "seq", "timestamp", "side", F.col("price").alias("level_price"), F.col("quantity").alias("level_qty"), is_bid().alias("bid"))
    before = F.lag("timestamp").over(W.partitionBy(*by, "side").orderBy("seq"))
    fresh = F.col("side").isin(3, 4) & (before.isNull() | (before != F.col("timestamp")))
    rows = rows.withColumn("_clear", F.when(fresh, F.col("seq")))
    later = W.partitionBy(*by, "bid").orderBy(F.col("seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    same = F.lead("seq").over(W.partitionBy(*by, "bid", "level_price").orderBy("seq"))
    forever = F.lit(1 << 62)
    end = F.coalesce(same, forever)
    if clear_on_snapshot:
        end = F.least(end, F.coalesce(F.min("_clear").over(later), forever))
    return rows.withColumn("en", end).where("level_qty <> 0").select(*by, "bid", "level_price", "level_qty", F.col("seq").alias("st"), "en")


def levels_at(samples: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """The live levels at each sample row (which has by and seq)."""
    return join_points(samples, levels, by, "seq", "st", "en")


def top1(samples: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """Samples with best_bid, bid_qty, best_ask, ask_qty and what follows from them; both sides must be there and
    not crossed. One partial aggregation: a level is reduced where it is joined."""
    keys = samples.columns
    best = levels_at(samples, levels, by).groupBy(*keys).agg(
        F.max(F.when(F.col("bid"), F.struct("level_price", "level_qty"))).alias("_b"),
        F.min(F.when(~F.col("bid"), F.struct("level_price", "level_qty"))).alias("_a"),
    )
    flat = best.where("_b.level_price < _a.level_price").select(*keys, F.col("_b.level_price").alias("best_bid"), F.col("_b.level_qty").alias("bid_qty"), F.col("_a.level_price").alias("best_ask"), F.col("_a.level_qty").alias("ask_qty"))
    return quoted(flat)


def quoted(flat: DataFrame) -> DataFrame:
    b, bq, a, aq = (F.col(c) for c in ("best_bid", "bid_qty", "best_ask", "ask_qty"))
    out = flat.withColumn("mid", mid(b, a)).withColumn("spread", a - b)
    return out.withColumn("spread_bps", bps(F.col("spread"), F.col("mid"))).withColumn("imbalance", imbalance(bq, aq)).withColumn("microprice", microprice(b, bq, a, aq))


def topn(samples: DataFrame, levels: DataFrame, by: list[str], n: int) -> DataFrame:
    """One row per sample, side and rank (1 is best), at most n ranks. The rank filter is pushed into the sort."""
    keys = samples.columns
    rank = F.row_number().over(W.partitionBy(*keys, "bid").orderBy(F.when(F.col("bid"), -F.col("level_price")).otherwise(F.col("level_price"))))
    return levels_at(samples, levels, by).withColumn("rank", rank).where(F.col("rank") <= n).select(*keys, "bid", "rank", "level_price", "level_qty")


def topn_state(samples: DataFrame, levels: DataFrame, by: list[str], n: int) -> DataFrame:
    """Per sample: sums of the first n levels of either side, their imbalance, and the levels as arrays."""
    keys = samples.columns
    listed = F.struct("rank", "level_price", "level_qty")
    flat = topn(samples, levels, by, n).groupBy(*keys).agg(
        F.sum(F.when(F.col("bid"), F.col("level_qty"))).alias("bid_sum"),
        F.sum(F.when(~F.col("bid"), F.col("level_qty"))).alias("ask_sum"),
        F.sort_array(F.collect_list(F.when(F.col("bid"), listed))).alias("bids"),
        F.sort_array(F.collect_list(F.when(~F.col("bid"), listed))).alias("asks"),
    )
    flat = flat.where("get(bids, 0).level_price < get(asks, 0).level_price")
    return flat.withColumn("imbalance_n", imbalance(F.col("bid_sum"), F.col("ask_sum")))


def final_state(levels: DataFrame, by: list[str]) -> DataFrame:
    """The levels that are never replaced, with rank from the best."""
    rank = F.row_number().over(W.partitionBy(*by, "bid").orderBy(F.when(F.col("bid"), -F.col("level_price")).otherwise(F.col("level_price"))))
    return levels.where(F.col("en") == F.lit(1 << 62)).select(*by, "bid", rank.alias("rank"), "level_price", "level_qty")


def depth_curve(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Cumulative quantity from the best level outwards."""
    w = W.partitionBy(*by, "bid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("cum_qty", F.sum("level_qty").over(w))


def readiness(tape: DataFrame, levels: DataFrame, by: list[str], threshold: int = 5) -> DataFrame:
    """by, ready_seq: the first row at which the book may be used. A snapshot row makes it ready, or as many levels on
    both sides as `threshold` (0: snapshots only); once ready it stays so."""
    snap = tape.where("side IN (3, 4)").groupBy(*by).agg(F.min("seq").alias("_snap"))
    out = tape.select(*by).distinct().join(snap, by, "left")
    if threshold > 0:
        ups = levels.select(*by, "bid", F.col("st").alias("seq"), F.lit(1).alias("_d"))
        downs = levels.where(F.col("en") < F.lit(1 << 62)).select(*by, "bid", F.col("en").alias("seq"), F.lit(-1).alias("_d"))
        step = ups.unionByName(downs).groupBy(*by, "seq").agg(F.sum(F.when(F.col("bid"), F.col("_d")).otherwise(0)).alias("_b"), F.sum(F.when(~F.col("bid"), F.col("_d")).otherwise(0)).alias("_a"))
        w = W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
        full = step.withColumn("_b", F.sum("_b").over(w)).withColumn("_a", F.sum("_a").over(w)).where((F.col("_b") >= threshold) & (F.col("_a") >= threshold))
        out = out.join(full.groupBy(*by).agg(F.min("seq").alias("_full")), by, "left")
    else:
        out = out.withColumn("_full", F.lit(None).cast("long"))
    return out.select(*by, F.least("_snap", "_full").alias("ready_seq"))


def consistent(tape: DataFrame, by: list[str]) -> DataFrame:
    """tape with is_consistent: false on the rows of a snapshot batch, while it is being written."""
    return tape.withColumn("is_consistent", ~F.col("side").isin(3, 4))


def grid_samples(tape: DataFrame, by: list[str], interval_ms: int, extra: Column | None = None) -> DataFrame:
    """The first eligible row at or after each boundary of a global grid (a boundary without one is skipped).

    The next boundary is set only by a sample that was taken, so the first eligible row of each cell is it.
    """
    cell = F.floor(F.col("timestamp") / interval_ms)
    rows = tape if extra is None else tape.where(extra)
    first = F.row_number().over(W.partitionBy(*by, "_cell").orderBy("seq"))
    return rows.withColumn("_cell", cell).withColumn("_n", first).where("_n = 1").drop("_n", "_cell")


def event_samples(tape: DataFrame, sides: list[int]) -> DataFrame:
    """Sampling at events of the given sides."""
    return tape.where(F.col("side").isin(*sides))


def period_volumes(tape: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """samples (by, seq) with taker_buy_vol and taker_sell_vol since the sample before: differences of running sums.

    A positive trade quantity counts as buying here, as the book's own accumulators have it.
    """
    w = W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    trade = F.col("side") == 2
    run = tape.select(*by, "seq", F.sum(F.when(trade & (F.col("quantity") > 0), F.col("quantity")).otherwise(0.0)).over(w).alias("_buy"), F.sum(F.when(trade & (F.col("quantity") <= 0), F.abs("quantity")).otherwise(0.0)).over(w).alias("_sell"))
    at = samples.join(run, [*by, "seq"])
    prior = W.partitionBy(*by).orderBy("seq")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(prior), F.lit(0.0))
    return at.withColumn("taker_buy_vol", step("_buy")).withColumn("taker_sell_vol", step("_sell")).drop("_buy", "_sell")
