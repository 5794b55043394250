"""The full feature row of the alpha models, and sequences of it.

A kernel reads each segment's merged tape once, keeps the books, and lets through trades, samples and throttled book
metrics. All windows over these are window functions of one partitioning, so a row costs one pass in Python over the
tape and two sorts of what is left of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.functions.models import FEATURE_NAMES
from tickloom.operators import windows as win
from tickloom.operators.kernels import market_rows


def feature_rows(tape: DataFrame, by: list[str], keep: list[str] = (), second_ms: int = 1000, lookback_s: int = 300, **options) -> DataFrame:
    """by, keep, timestamp, seq and FEATURE_NAMES at the rows where `sample` is true.

    `tape` holds the venues cc, bj, um and bs in the order of seq within `by` (a day or a segment with its warm-up); all
    windows end at the sample's row. A venue's history reaches `lookback_s` back from its own last trade: an earlier
    price is missing (null), and a step from a trade longer ago doesn't count as volatility. Books that aren't ready
    leave their columns null; null columns are what a model refuses to score. `second_ms` stretches every width; a
    look-back shorter than the longest window, 30 s, raises ValueError.
    """
    if lookback_s < 30:
        raise ValueError("the look-back must hold the windows of 30 s")
    ms = lambda seconds: int(seconds * second_ms)
    rows = market_rows(tape, by, list(keep), ms=ms(0.5), n=5, **options)
    trade = lambda v: (F.col("venue") == v) & F.col("price").isNotNull()
    far = ms(lookback_s)

    before = win.before(F.when(trade("um"), F.struct("timestamp", "price")), by)
    rows = rows.withColumn("_before", before)
    near = trade("um") & (F.col("_before.timestamp") >= F.col("timestamp") - far) & (F.col("_before.price") > 0) & (F.col("price") > 0)
    rows = rows.withColumn("_step", F.when(near, F.abs(F.log(F.col("price") / F.col("_before.price")))).otherwise(0.0))

    def moved(v: str, width: float, lag: float = 0) -> Column:
        now = win.latest(F.when(trade(v), F.struct("timestamp", "price")), by)
        then = win.at_or_before(F.when(trade(v), F.struct("timestamp", "price")), by, ms(width + lag))
        there = (then["timestamp"] >= now["timestamp"] - far) & (then["price"] > 0) & (now["price"] > 0)
        return F.when(there, F.log(now["price"] / then["price"]))

    def side(v: str, of) -> Column:
        return F.when(trade(v), of(F.col("quantity"))).otherwise(0.0)

    def number(v: str, width: float, closed: bool = True) -> Column:
        return win.count(trade(v), by, ms(width), closed).cast("double")

    def flow(v: str, width: float) -> Column:
        return F.when(number(v, width) > 0, S.rounded(win.flow(side(v, S.taker_buy), side(v, S.taker_sell), by, ms(width)), 9)).otherwise(0.0)

    def imbalance(v: str, width: float) -> Column:
        return win.trade_imbalance(side(v, S.taker_buy), side(v, S.taker_sell), trade(v), by, ms(width))

    def mean(c: str) -> Column:
        return win.trailing_mean(F.col(c), by, ms(5))

    last_bs = win.latest(F.when(trade("bs"), F.col("price")), by)
    out = {
        **{name: moved("um", s) for name, s in (("r_um", 1), ("r_um_2s", 2), ("r_um_5s", 5), ("r_um_10s", 10))},
        "um_imb_1s": imbalance("um", 1),
        "um_imb_30s_norm": imbalance("um", 30),
        "um_n_5s": number("um", 5),
        "um_vol_5s": F.when(number("um", 5) > 0, S.rounded(win.trailing(F.col("_step"), by, ms(5)), 12)).otherwise(0.0),
        **{name: flow("um", s) for name, s in (("um_flow_50ms", 0.05), ("um_flow_100ms", 0.1), ("um_flow_500ms", 0.5), ("um_flow_5s", 5))},
        "r_bj": moved("bj", 1),
        "bj_imb_1s": imbalance("bj", 1),
        "bj_flow_5s": flow("bj", 5),
        "trade_intensity_burst_50ms": number("cc", 0.05, closed=False),
        "r_cc_lag1": moved("cc", 1, 1),
        "r_cc_lag2": moved("cc", 1, 2),
        "cc_imb_1s": imbalance("cc", 1),
        "basis_um_bps_trade_proxy": S.log_bps(F.col("um_mid"), last_bs),
        "cc_flow_5s": flow("cc", 5),
        "cc_flow_30s": flow("cc", 30),
        "cc_imb_30s_norm": imbalance("cc", 30),
        "cc_l2_imb_top1_5s": mean("cc_top1_metric"),
        "cc_l2_imb_top5_5s": mean("cc_topn_metric"),
        "cc_micro_dev_5s": mean("cc_dev_metric"),
    }
    wide = rows.select("*", *(c.alias(name) for name, c in out.items())).where("sample")
    wide = wide.withColumn("basis_bj_bps", S.log_bps(F.col("cc_mid"), F.col("bj_mid")))
    shown = {
        "um_x_basis": F.col("r_um") * F.col("basis_bj_bps"),
        "basis_um_bps": S.log_bps(F.col("um_mid"), F.col("bs_mid")),
        "hour_sin": S.hour_sin(F.col("timestamp")),
        "hour_cos": S.hour_cos(F.col("timestamp")),
        "cc_l2_top1_imb": F.col("cc_top1"),
        "cc_l2_top5_imb": F.col("cc_topn"),
        "cc_l2_micro_dev_bps": F.col("cc_dev_bps"),
        "cc_l2_spread_bps": F.col("cc_spread_bps"),
        "bj_l2_top1_imb": F.col("bj_top1"),
        "bj_l2_top5_imb": F.col("bj_topn"),
        "l2_imb_diff": F.col("cc_top1") - F.col("bj_top1"),
    }
    return wide.withColumns(shown).select(*by, *keep, "timestamp", "seq", *FEATURE_NAMES)


def feature_sequence(rows: DataFrame, by: list[str], order: list[str], window_ms: int, step_ms: int, names: list[str] = FEATURE_NAMES) -> DataFrame:
    """by, step (0 is the latest) and names: for each group's last row the rows at or before every step back, as a
    sequence model reads them. A group whose history is shorter than the window gives nothing.

    One aggregation with a value a step, so rows are reduced where they lie."""
    last = rows.groupBy(*by).agg(F.max("timestamp").alias("_latest"))
    row = F.struct("timestamp", *order, *names)
    steps = [F.max(F.when(F.col("timestamp") <= F.col("_latest") - i * step_ms, row)).alias(f"_{i}") for i in range(window_ms // step_ms)]
    found = (rows.join(last, by) if by else rows.crossJoin(F.broadcast(last))).groupBy(*by).agg(*steps)
    whole = found.where(f"_{len(steps) - 1} IS NOT NULL")
    return whole.select(*by, F.posexplode(F.array(*(F.col(f"_{i}") for i in range(len(steps))))).alias("step", "_row")).select(*by, "step", *(F.col("_row")[c].alias(c) for c in names))
