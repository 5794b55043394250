"""Scalar expressions over quotes, trades, orders and names. All are built-in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int = 0) -> Column:
    """Rounded, and never the negative zero that a small negative sum would come to: which sign a sum that cancels out
    has depends on the order of its terms."""
    return F.round(value, digits) + F.lit(0.0)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2.0


def microprice(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    """Each price weighted by the other side's quantity; the mid where there is no quantity."""
    size = bid_qty + ask_qty
    return F.when(size > 0, (bid * ask_qty + ask * bid_qty) / size).otherwise(mid(bid, ask))


def bps(value: Column, of: Column) -> Column:
    return value / of * 10000.0


def imbalance(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where both are empty."""
    return F.when(a + b > 0, (a - b) / (a + b)).otherwise(F.lit(0.0))


def log_bps(x: Column, y: Column) -> Column:
    """ln(x / y) in basis points where both are positive, else null."""
    return F.when((x > 0) & (y > 0), F.log(x / y) * 10000.0)


def hour_of_day(ms: Column) -> Column:
    return (F.floor(ms / 1000) % 86400) / 3600.0


def hour_sin(ms: Column) -> Column:
    return F.sin(2 * math.pi * hour_of_day(ms) / 24.0)


def hour_cos(ms: Column) -> Column:
    return F.cos(2 * math.pi * hour_of_day(ms) / 24.0)


def taker_buy(signed: Column) -> Column:
    """Aggressive buying, where a negative quantity is a buyer's."""
    return F.greatest(-signed, F.lit(0.0))


def taker_sell(signed: Column) -> Column:
    return F.greatest(signed, F.lit(0.0))


def round_price(price: Column, tick: Column, side: Column) -> Column:
    """Down to the tick for a buyer, up for a seller."""
    return F.when(F.upper(side) == "BUY", F.floor(price / tick) * tick).otherwise(F.ceil(price / tick) * tick)


def round_qty(qty: Column, lot: Column) -> Column:
    return F.floor(qty / lot) * lot


def order_fault(price: Column, qty: Column, tick: Column, lot: Column, least: Column, tolerance: float = 1e-7) -> Column:
    """The first rule that an order breaks, or null: QTY, PRICE, TICK, LOT, NOTIONAL."""
    off = lambda x, step: F.abs(x / step - F.rint(x / step)) > tolerance
    return F.when(qty <= 0, "QTY").when(price <= 0, "PRICE").when(off(price, tick), "TICK").when(off(qty, lot), "LOT").when((least > 0) & (price * qty < least - tolerance), "NOTIONAL")


def quote_price(side: Column, bid: Column, ask: Column, tick: Column, strategy: Column) -> Column:
    """The price of a passive quote: join the best, or improve on it by a tick if that doesn't cross."""
    better = F.when(side == "BUY", F.when(bid + tick < ask, bid + tick).otherwise(bid)).otherwise(F.when(ask - tick > bid, ask - tick).otherwise(ask))
    join = F.when(side == "BUY", bid).otherwise(ask)
    return F.when(strategy == "improve_1_tick", better).when(strategy == "join_back", join)


def to_std(native: Column) -> Column:
    """A venue's symbol in the common form: upper case, no separators but one before the quote currency."""
    flat = F.upper(F.regexp_replace(native, r"[-_/]", ""))
    return F.regexp_replace(flat, r"^(.+)(JPY|USDT|USDC|USD|EUR|BTC)$", "$1_$2")


def to_native(std: Column, separator: str, lower: bool) -> Column:
    out = F.replace(std, F.lit("_"), F.lit(separator))
    return F.lower(out) if lower else F.upper(out)


def human_size(size: Column) -> Column:
    """Bytes as text with two digits and a unit."""
    out = F.concat(F.format_string("%.2f", size / 1024.0**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (power + 1), F.concat(F.format_string("%.2f", size / 1024.0**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def linear_score(features: list[Column], mean: list[float], beta: list[float], intercept: float, scale: float = 1e4) -> Column:
    """(x - mean) . beta + intercept, scaled; null if any feature is missing."""
    bad = F.lit(False)
    total = F.lit(intercept)
    for x, m, b in zip(features, mean, beta, strict=True):
        bad = bad | x.isNull() | F.isnan(x)
        total = total + (x - F.lit(m)) * F.lit(b)
    return F.when(~bad, total * F.lit(scale))
